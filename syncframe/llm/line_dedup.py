"""Line deduplication by pairwise alignment of documents that share rare lines."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncframe.llm.arrow import record_batch, small_batches, texts_of
from syncframe.llm.common import Workspace, text_of

_LAST = 2**63 - 1


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first place, whose second places rise."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, q) in enumerate(pairs):
        k = bisect.bisect_left(tops, q)
        back.append(ends[k - 1] if k else -1)
        tops[k : k + 1] = [q]
        ends[k : k + 1] = [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience_blocks(later: dict[int, int], earlier: dict[int, int]) -> list[tuple[int, int, int]]:
    """(place in later, place in earlier, length) of aligned common blocks, by patience diff.

    Both arguments map places to line numbers.  Within a range, lines that occur once on both sides are
    anchors; the longest rising run of anchors is fixed, grows over equal neighbours, and the ranges
    between are aligned in the same way."""
    matched: dict[int, int] = {}
    big = 1 << 62
    ranges = [(-1, big, -1, big)]
    mine, other = sorted(later), sorted(earlier)
    while ranges:
        a, b, c, d = ranges.pop()
        left: dict[int, list[int]] = {}
        right: dict[int, list[int]] = {}
        for p in mine[bisect.bisect_right(mine, a) : bisect.bisect_left(mine, b)]:
            left.setdefault(later[p], []).append(p)
        for q in other[bisect.bisect_right(other, c) : bisect.bisect_left(other, d)]:
            right.setdefault(earlier[q], []).append(q)
        anchors = _rising(sorted((p[0], right[x][0]) for x, p in left.items() if len(p) == 1 and len(right.get(x, ())) == 1))
        if not anchors:
            continue
        fixed: list[tuple[int, int]] = []
        for k, (p, q) in enumerate(anchors):
            if fixed and fixed[-1][0] >= p:
                continue  # a block has grown over it
            low_p, low_q = fixed[-1] if fixed else (a, c)
            high_p, high_q = anchors[k + 1] if k + 1 < len(anchors) else (b, d)
            back = 1
            while p - back > low_p and q - back > low_q and p - back in later and later[p - back] == earlier.get(q - back):
                back += 1
            on = 1
            while p + on < high_p and q + on < high_q and p + on in later and later[p + on] == earlier.get(q + on):
                on += 1
            fixed += [(p + i, q + i) for i in range(1 - back, on)]
        matched.update(fixed)
        edges = [(a, c), *fixed, (b, d)]
        ranges += [(p, r, q, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False) if r - p > 1 and s - q > 1]
    blocks: list[tuple[int, int, int]] = []
    for p, q in sorted(matched.items()):
        if blocks and (p, q) == (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]):
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((p, q, 1))
    return blocks


def removed_places(later: dict[int, int], earlier: dict[int, int], sound: set[int]) -> set[int]:
    """Places of the later document's lines that go: aligned blocks with a line of ``sound``, and moved blocks.

    A sound line that the alignment left over, because it crosses others or occurs several times, is the anchor of a
    moved block: it stands for its occurrence of the same number in the earlier document (or the last there) and grows over
    equal neighbours.  Lines that only one side has can be left out of both, as places tell what follows what."""
    gone: set[int] = set()
    for p, _, n in patience_blocks(later, earlier):
        if any(later[i] in sound for i in range(p, p + n)):
            gone.update(range(p, p + n))
    left = [p for p in sorted(later) if later[p] in sound and p not in gone]
    if not left:
        return gone
    places: dict[int, list[int]] = {}
    for q in sorted(earlier):
        places.setdefault(earlier[q], []).append(q)
    number: dict[int, int] = {}
    for p in left:
        line = later[p]
        if line not in places:
            continue
        k = number[line] = number.get(line, -1) + 1
        q = places[line][min(k, len(places[line]) - 1)]
        for side in (1, -1):
            i = 0
            while p + i in later and later[p + i] == earlier.get(q + i) and (i == 0 or p + i not in gone):
                gone.add(p + i)
                i += side
    return gone


def units(lines: dict[int, bytes], sound: set[int]) -> Iterator[tuple[bytes, int]]:
    """(key, place) of what a document must share with another one to lose the line at that place to it.

    ``lines`` holds the shared lines by place, ``sound`` the places of sound ones.  A sound line's key is the
    line.  A block that takes another line takes all lines from it to the nearest sound line before or after it
    too, so its keys are these two runs, as far as they are unbroken."""
    for p in sound:
        yield lines[p], p
    for side, order in ((1, sorted(lines)), (-1, sorted(lines, reverse=True))):
        key, before = b"", None
        for p in order:
            if p in sound:
                key = lines[p]
            elif key and before == p - side:
                key = hashlib.blake2b(key + lines[p], digest_size=16, salt=b"after" if side > 0 else b"before").digest()
                yield key, p
            else:
                key = b""
            before = p


def line_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_words: int = 5, rare_share: float = 0.05, rare_texts: int = 10,
) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, removed_chars, cleaned_text.

    Lines are what newlines separate; blank ones (white space only) are not counted, and white space at the
    ends of a line does not matter.  A line is rare if the different texts that hold it are no more than
    ``rare_share`` of all rows or than ``rare_texts``; copies of one text count once, so a large group
    of copies makes no line frequent.  It is sound if it is rare and has ``min_words`` words or more.  A
    document is aligned by patience diff, on all lines that both hold, with every earlier document that shares a
    sound line; an aligned block, lines that follow each other in both documents, goes from the later one
    if it holds a sound line.  A sound line that crosses the alignment goes with its neighbours as a moved block.

    Not every pair is looked at.  A copy of an earlier text goes whole, or not at all if no line is sound.
    For other texts, ``units`` gives the keys that an earlier document must share to take a line: the line itself if it is
    sound, else the unbroken run to the nearest sound line.  Each key leads to its first holder, which has the run and so
    takes it, whoever else holds it.  Pairs are bounded by the number of keys, so a group of near copies meets its
    first document and not itself, and no later holder can add lines but where a run occurs several
    times in its first holder.

    Null and empty texts have no lines.  Repeated rows are one document and lose nothing to each other; a null
    id comes after all others; an empty table gives an empty result.  A blank line between two lines
    that go goes with them."""
    spark = df.sparkSession
    small_batches(spark)
    work = Workspace(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), text_of(text_col).alias("text"))
    docs = docs.withColumn("version", F.unhex(F.md5(F.col("text").cast("binary"))))

    def lines_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc", pa.int64()), ("version", pa.binary()), ("line", pa.list_(pa.binary())), ("long", pa.list_(pa.bool_())), ("places", pa.list_(pa.list_(pa.int32())))]
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for doc, version, text in zip(batch["doc"].to_pylist(), batch["version"].to_pylist(), texts_of(batch["text"]), strict=True):
                places: dict[bytes, list[int]] = {}
                for place, line in enumerate(x for x in map(bytes.strip, text.split(b"\n")) if x):
                    places.setdefault(line, []).append(place)
                if not places:
                    continue
                keys = [hashlib.blake2b(x, digest_size=16).digest() for x in places]
                for column, x in zip(out, (doc, version, keys, [len(x.split()) >= min_words for x in places], list(places.values())), strict=True):
                    column.append(x)
            yield record_batch(pa.schema(kinds), out)

    fields = ["line", "long", "places"]
    rows = docs.select("doc", "version", "text").mapInArrow(lines_of, "doc long, version binary, line array<binary>, long array<boolean>, places array<array<int>>")
    texts = rows.groupBy("version").agg(F.min(F.struct("doc", *fields)).alias("x"), F.max("doc").alias("last")).select("version", "x.*", "last")
    texts = work.save(texts, "texts")
    limit = max(rare_texts, rare_share * docs.count())
    lines = texts.select("doc", "version", F.explode(F.arrays_zip("line", "long", "places")).alias("x")).select("doc", "version", "x.*")
    counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("line", (F.col("texts") <= limit).alias("rare"))
    counted = work.save(counted, "counted")  # between tables the join can split a line that many texts have
    shared = work.save(
        lines.join(counted, "line").withColumn("sound", F.col("rare") & F.col("long"))
        .groupBy("doc", "version").agg(F.collect_list(F.struct("line", "places", "sound")).alias("shared"), F.count_if(F.col("long") & ~F.col("rare")).alias("worn")),
        "shared",
    )

    def units_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("doc", pa.int64()), ("version", pa.binary()), ("place", pa.int32())])
        for batch in batches:
            out = []
            for doc, version, shared in zip(batch["doc"].to_pylist(), batch["version"].to_pylist(), batch["shared"].to_pylist(), strict=True):
                if any(x["sound"] for x in shared):
                    at = {p: x["line"] for x in shared for p in x["places"]}
                    out += [(key, doc, version, p) for key, p in units(at, {p for x in shared if x["sound"] for p in x["places"]})]
            yield record_batch(schema, zip(*out, strict=True) if out else [[]] * 4)

    def aligned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("version", pa.binary()), ("gone", pa.list_(pa.int32()))])
        for batch in batches:
            out = []
            for doc, version, mine, other in zip(batch["doc"].to_pylist(), batch["version"].to_pylist(), batch["shared"].to_pylist(), batch["other"].to_pylist(), strict=True):
                theirs = {x["line"]: x["places"] for x in other}
                both = [(x, theirs[x["line"]]) for x in mine if x["line"] in theirs]
                later = {p: k for k, (x, _) in enumerate(both) for p in x["places"]}
                earlier = {q: k for k, (_, places) in enumerate(both) for q in places}
                gone = removed_places(later, earlier, {k for k, (x, _) in enumerate(both) if x["sound"]})
                if gone:
                    out.append((doc, version, sorted(gone)))
            yield record_batch(schema, zip(*out, strict=True) if out else [[]] * 3)

    def align(pairs: DataFrame, name: str) -> DataFrame:
        other = shared.select(F.col("version").alias("partner"), F.col("shared").alias("other"))
        both = pairs.join(other, "partner").join(shared.select("version", "shared"), "version").select("doc", "version", "shared", "other")
        return work.save(both.mapInArrow(aligned, "doc long, version binary, gone array<int>"), name)

    held = work.save(shared.mapInArrow(units_of, "key binary, doc long, version binary, place int"), "units")
    heads = held.groupBy("key").agg(F.min(F.struct("doc", "version")).alias("head"), F.max("doc").alias("last")).where("head.doc < last").select("key", "head")
    wanted = held.join(heads, "key").where("doc > head.doc")
    pairs = work.save(wanted.select("doc", "version", F.col("head.version").alias("partner")).distinct(), "pairs")
    taken = align(pairs, "gone").groupBy("doc", "version").agg(F.flatten(F.collect_list("gone")).alias("gone")).withColumn("whole", F.lit(False))
    copied = (
        texts.where("last > doc").withColumn("n_long", F.size(F.filter("long", lambda x: x)))
        .join(shared.where("worn > 0").select("version", "worn"), "version", "left").where("n_long > coalesce(worn, 0)")
        .select("version", F.col("doc").alias("_first"))
    )
    copies = docs.select("doc", "version").join(copied, "version").where("doc > _first").select("doc", "version").distinct()
    taken = taken.unionByName(copies.select("doc", "version", F.lit(None).cast("array<int>").alias("gone"), F.lit(True).alias("whole")))

    def cleaned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("removed_chars", pa.int64()), ("cleaned_text", pa.string())])
        for batch in batches:
            out = []
            for doc, text, places, whole in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"]), batch["gone"].to_pylist(), batch["whole"].to_pylist(), strict=True):
                gone = set(range(text.count(b"\n") + 1) if whole else places or ())
                kept, held, place, lost, n_lost, after_gone = [], [], 0, 0, 0, False
                for line in text.split(b"\n"):
                    if not line.strip():
                        held.append(line)
                        continue
                    if place in gone:
                        lost += len(line.decode(errors="replace"))
                        n_lost += 1
                        if not after_gone:
                            kept += held
                    else:
                        kept += [*held, line]
                    after_gone, held, place = place in gone, [], place + 1
                out.append((doc, place, n_lost, lost, b"\n".join([*kept, *held]) if gone else text))
            *columns, texts = zip(*out, strict=True) if out else [[]] * 5
            yield record_batch(schema, [*columns, pa.array(texts, pa.binary()).view(pa.string())])

    return docs.join(taken, ["doc", "version"], "left").select("doc_id", "text", "gone", "whole").mapInArrow(
        cleaned, "doc_id long, n_lines long, n_removed long, removed_chars long, cleaned_text string"
    )
