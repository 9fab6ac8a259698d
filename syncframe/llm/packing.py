"""Packing of token sequences by a configuration linear program."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncframe.llm.arrow import record_batch, small_batches, texts_of
from syncframe.llm.common import Workspace, order_key, rank_within
from syncframe.llm.sharding import best_fit_decreasing
from syncframe.llm.tokens import TokenCache

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, key string"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
Config = tuple[tuple[int, int], ...]


def _fullest(prices: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Pricing by bounded knapsack DP: for each room up to the capacity the value of the most valuable multiset of pieces
    that fills it to the last place, -inf if none does; which items it takes, and the items (length, pieces)."""
    items = []
    for length in np.flatnonzero(counts).tolist():
        most, n = min(int(counts[length]), capacity // length), 1
        while most > 0:
            items.append((length, min(n, most)))
            most, n = most - n, 2 * n
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    taken = np.zeros((len(items), capacity + 1), bool)
    for k, (length, n) in enumerate(items):
        size = length * n
        value = best[: capacity + 1 - size] + prices[length] * n
        better = value > best[size:]
        taken[k, size:] = better
        np.copyto(best[size:], value, where=better)
    return best, taken, items


def _configuration(room: int, taken: np.ndarray, items: list[tuple[int, int]]) -> Counter:
    """The pieces that fill the room."""
    found, k = Counter(), len(items)
    while room:
        k = int(np.flatnonzero(taken[:k, room])[-1])
        length, n = items[k]
        found[length] += n
        room -= length * n
    return found


def _fractional(demand: np.ndarray, capacity: int, full: bool, share: float = 0.02, rate: float = 0.5, rounds: int = 400) -> dict[Config, int]:
    """Multiplicative weights for the configuration program: cover each length's demand with configurations, full ones if
    asked to.

    Each round prices the program once, over what is not covered yet.  Then the lengths, the dearest first, buy their priciest
    configurations, as much as covers a fixed share of the scarcest length's demand (one whole, if the demand is
    small, which rounds the solution as it goes); a length's price falls by a factor for the share of its demand that is
    covered.  Prices rise a little faster than lengths, so that short pieces are left to fill the last rooms.  It ends when no
    configuration is left to buy."""
    covered, bought = np.zeros(capacity + 1, np.int64), Counter()
    for _ in range(rounds):
        counts = demand - covered
        sold = np.flatnonzero(counts)
        if not len(sold):
            break
        prices = np.zeros(capacity + 1)
        prices[sold] = sold * (1 + 0.1 * sold / capacity) * np.exp(-rate * covered[sold] / demand[sold])
        best, taken, items = _fullest(prices, counts, capacity)
        rooms = np.arange(capacity + 1)
        if not full:  # the most valuable room within each
            rooms = np.maximum.accumulate(np.where(best == np.maximum.accumulate(best), rooms, 0))
        before = covered.sum()
        of_length = prices[sold] + best[rooms[capacity - sold]]
        for length in sold[np.argsort(-of_length, kind="stable")].tolist():
            room = int(rooms[capacity - length])
            if counts[length] < 1 or best[room] == -np.inf:
                continue
            config = _configuration(room, taken, items)
            config[length] += 1
            if all(n <= counts[x] for x, n in config.items()):
                step = max(1, int(min(min(share * demand[x], counts[x]) / n for x, n in config.items())))
                bought[tuple(sorted(config.items()))] += step
                for x, n in config.items():
                    covered[x] += step * n
                    counts[x] -= step * n
        if covered.sum() == before:
            break
    return bought


def _plan(histogram: dict[int, int], capacity: int, fulls: tuple[bool, ...]) -> list[tuple[Config, int]]:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan: list[tuple[Config, int]] = []

    def use(config: Config, times: int) -> None:
        plan.append((config, times))
        for length, n in config:
            left[length] -= n * times

    if left[capacity]:
        use(((capacity, 1),), int(left[capacity]))
    for full in fulls:
        if full or True not in fulls or left.sum() > 8 * capacity:
            for config, times in _fractional(left.copy(), capacity, full).items():
                use(config, times)
    sizes = np.repeat(np.arange(capacity + 1), left).tolist()
    bins: dict[int, Counter] = {}
    for size, at in zip(sizes, best_fit_decreasing(sizes, capacity), strict=True):
        bins.setdefault(at, Counter())[size] += 1
    for config, times in Counter(tuple(sorted(c.items())) for c in bins.values()).items():
        use(config, times)
    return plan


def pack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Configurations and how often each is used: together exactly the histogram.

    The configuration program is solved and rounded at every size of the histogram: over full configurations, and if that
    takes more sequences than the dual bound, also over any configurations; the better plan counts.  What no
    full configuration holds, mostly a handful of pieces, goes by best-fit decreasing; more than ``8 * capacity``
    such pieces, of lengths that do not add up to the capacity, go by a program over configurations that leave room.
    The number of configurations is bounded by the capacity and the rounds, not by the number of pieces."""
    used = lambda plan: sum(times for _, times in plan)
    plan = _plan(histogram, capacity, (True, False))
    if used(plan) > dual_bound(histogram, capacity):
        plan = min(plan, _plan(histogram, capacity, (False,)), key=used)
    return plan


def dual_bound(histogram: dict[int, int], capacity: int, most: int = 24) -> int:
    """Sequences that any packing needs: the best of a family of dual solutions of the configuration program.

    Prices are dual feasible if no configuration costs more than 1.  The volume's are (length / capacity), and so are, for each k,
    floor((k + 1) * length / capacity) / k (the length's share itself where the division has no rest), which tell pieces apart
    that cannot share a sequence."""
    best = -(-sum(length * n for length, n in histogram.items()) // capacity)
    for k in range(1, most + 1):
        total = Fraction(0)
        for length, n in histogram.items():
            whole, rest = divmod((k + 1) * length, capacity)
            total += n * (Fraction(whole, k) if rest else Fraction(length, capacity))
        best = max(best, -(-total.numerator // total.denominator))
    return best


class _Places:
    """For a length and a rank in it, the sequence and the offset: the plan's configurations take the
    ranks of each length in turn."""

    def __init__(self, plan: list[tuple[Config, int]]):
        taken, sequence, rows = Counter(), 0, {}
        for config, times in plan:
            offset = 0
            for length, n in config:
                rows.setdefault(length, []).append((taken[length], n, sequence, offset))
                taken[length] += n * times
                offset += n * length
            sequence += times
        self.rows = {length: np.array(x, np.int64).T for length, x in rows.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for length in np.unique(lengths):
            of = lengths == length
            begins, n, first, at = self.rows[int(length)]
            k = np.searchsorted(begins, ranks[of], side="right") - 1
            local = ranks[of] - begins[k]
            sequence[of] = first[k] + local // n[k]
            offset[of] = at[k] + local % n[k] * length
        return sequence, offset


def token_pieces(df: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: a document's token ids and an end id 0, cut after every ``capacity`` ids."""
    small_batches(df.sparkSession)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        cache = TokenCache.of(tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("key", pa.string())])
        for batch in batches:
            rows = []
            for doc, text, key in zip(batch["doc_id"].to_pylist(), texts_of(batch["text"]), batch["key"].to_pylist(), strict=True):
                ids = cache.ids(text.decode(errors="replace")) + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), key))
            yield record_batch(schema, zip(*rows, strict=True) if rows else [[]] * len(schema))

    read = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), order_key(id_col).alias("key"))
    return read.mapInArrow(cut, PIECES)


def pack_documents(
    df: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents longer than ``capacity`` are cut.  The driver gets the histogram of piece lengths (at
    most ``capacity`` rows whatever the corpus), solves the configuration program over it and sends the
    plan back.  Pieces of one length are interchangeable, so a piece's place follows from its rank
    among the pieces of its length; ranks are counted in slices, so one length may hold any share.

    A null or empty text is a piece of the end id alone; repeated rows are packed as often as they occur;
    a null id stays null; an empty table gives an empty result."""
    work = Workspace(df.sparkSession)
    pieces = work.save(token_pieces(df, tokenizer, capacity, id_col, text_col), "pieces")
    histogram = {int(length): int(n) for length, n in pieces.groupBy("length").count().collect()}
    places = _Places(pack_plan(histogram, capacity))
    ranked = rank_within(pieces, ["length"], "key", ["doc_id", "piece", "ids_crc32"], "rank")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.find(batch["length"].to_numpy(), batch["rank"].to_numpy())
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], names=[*kept.schema.names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)
