"""Sharding: best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncframe.llm.common import Workspace, order_key, rank_within, text_of


class _Node:
    __slots__ = ("key", "left", "right", "height")

    def __init__(self, key):
        self.key, self.left, self.right, self.height = key, None, None, 1


class RoomTree:
    """A height-balanced tree of (remaining capacity, bin)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(node):
        return node.height if node else 0

    def _balanced(self, node):
        h = self._height
        node.height = 1 + max(h(node.left), h(node.right))
        lean = h(node.left) - h(node.right)
        if lean > 1:
            if h(node.left.left) < h(node.left.right):
                node.left = self._rotated(node.left, "right", "left")
            return self._rotated(node, "left", "right")
        if lean < -1:
            if h(node.right.right) < h(node.right.left):
                node.right = self._rotated(node.right, "left", "right")
            return self._rotated(node, "right", "left")
        return node

    def _rotated(self, node, up, down):
        child = getattr(node, up)
        setattr(node, up, getattr(child, down))
        setattr(child, down, node)
        for x in (node, child):
            x.height = 1 + max(self._height(x.left), self._height(x.right))
        return child

    def add(self, key) -> None:
        def put(node):
            if node is None:
                return _Node(key)
            side = "left" if key < node.key else "right"
            setattr(node, side, put(getattr(node, side)))
            return self._balanced(node)

        self.root = put(self.root)

    def remove(self, key) -> None:
        def cut(node, key):
            if key != node.key:
                side = "left" if key < node.key else "right"
                setattr(node, side, cut(getattr(node, side), key))
            elif node.left is None or node.right is None:
                return node.left or node.right
            else:
                least = node.right
                while least.left:
                    least = least.left
                node.key = least.key
                node.right = cut(node.right, least.key)
            return self._balanced(node)

        self.root = cut(self.root, key)

    def tightest(self, size: int):
        """The least (room, bin) with room for ``size``, or None."""
        node, best = self.root, None
        while node:
            if node.key[0] >= size:
                node, best = node.left, node.key
            else:
                node = node.right
        return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each unit: units in falling size, each into the tightest bin that still holds it."""
    rooms, bins, used = RoomTree(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        place = rooms.tightest(sizes[i])
        if place is None:
            place = (capacity, used)
            used += 1
        else:
            rooms.remove(place)
        bins[i] = place[1]
        rooms.add((place[0] - sizes[i], place[1]))
    return bins


def _smallest_capacity(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The least capacity found by bisection at which the units fill no more than ``shards`` bins."""
    low = max([-(-sum(sizes) // shards), *sizes, 1])
    high = low + max([*sizes, 1])
    best = best_fit_decreasing(sizes, high)
    while max(best, default=0) >= shards:
        high *= 2
        best = best_fit_decreasing(sizes, high)
    while low < high:
        middle = (low + high) // 2
        bins = best_fit_decreasing(sizes, middle)
        if max(bins, default=0) < shards:
            high, best = middle, bins
        else:
            low = middle + 1
    return high, best


def shard_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = 8, capacity: int | None = None, bundles: int = 4096,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot, capacity.

    ``size`` is the text's UTF-8 bytes plus 1.  Rows with equal texts are a group and stay together.
    Groups above ``1 / bundles`` of all bytes, of which there are fewer than ``bundles``, are units of
    their own; the others join one of ``bundles`` bundles by a hash of their text.  So at most
    ``2 * bundles`` units reach the driver whatever the corpus size, and best-fit decreasing puts them
    into bins of one capacity: the given ``capacity`` (the fewest shards follow; bundles are then so many that
    one is a sixteenth of it at most, as far as groups allow), or the least one at
    which ``shards`` bins are enough, which makes the shards nearly equal in bytes.  The shard of a row
    is then a map-side lookup in those units.  A group larger than a bin's fair share fills a bin beyond
    it: a group is never divided, and one larger than a given capacity raises that to its own size, as the column
    ``capacity`` says.  ``slot`` numbers a shard's rows from 0 without gaps.

    Null texts have size 1 and share a group with empty texts; repeated rows keep a slot each; an empty
    table gives an empty result."""
    work = Workspace(df.sparkSession)
    digest = F.md5(text_of(text_col).cast("binary"))
    docs = work.save(
        df.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text_of(text_col)).cast("long") + 1).alias("size"),
            F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"), digest.alias("_group"), order_key(id_col).alias("_key"),
        ),
        "sizes",
    )
    total = docs.agg(F.sum("size")).first()[0] or 0
    groups = docs.groupBy("_group").agg(F.sum("size").alias("size"))
    if capacity is not None:
        groups = work.save(groups, "groups")
        capacity = max(capacity, groups.agg(F.max("size")).first()[0] or 0)
        bundles = max(bundles, -(-16 * total // max(capacity, 1)))
    while True:
        bundle = F.pmod(F.conv(F.substring("_group", 1, 8), 16, 10).cast("long"), F.lit(bundles)).cast("string")
        unit = F.when(F.col("size") > total / bundles, F.col("_group")).otherwise(bundle)
        units = sorted(map(tuple, groups.groupBy(unit.alias("unit")).agg(F.sum("size").alias("size")).collect()))
        sizes = [size for _, size in units]
        if capacity is None or max(sizes, default=0) <= capacity:
            break
        bundles *= 2  # a bundle, which is no group, is too large
    if capacity is None:
        capacity, bins = _smallest_capacity(sizes, shards)
    else:
        bins = best_fit_decreasing(sizes, capacity)
    placed = df.sparkSession.createDataFrame([(u, b) for (u, _), b in zip(units, bins, strict=True)], "unit string, shard int")
    large = placed.where(F.length("unit") == 32).select(F.col("unit").alias("_group"), F.col("shard").alias("_own"))
    small = placed.where(F.length("unit") < 32).select(F.col("unit").alias("_bundle"), F.col("shard").alias("_shared"))
    sharded = (
        docs.withColumn("_bundle", bundle)
        .join(F.broadcast(large), "_group", "left").join(F.broadcast(small), "_bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("_own", "_shared").alias("shard"), F.lit(capacity).cast("long").alias("capacity"), "_key")
    )
    return rank_within(sharded, ["shard"], "_key", ["doc_id", "text_crc32"], "slot").drop("_key")
