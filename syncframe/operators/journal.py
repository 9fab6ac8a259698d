"""Hash-chained journals."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncframe.operators.folds import fold_sorted


def entry_hash(prev: Column, seq: Column, ts: Column, event: Column, detail: Column) -> Column:
    nul = F.lit("\0")
    return F.sha2(F.concat(prev, nul, seq.cast("string"), nul, ts, nul, event, nul, detail), 256)


def append_journal(rows: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(journal, seq, ts, event, detail, prev, hash): entries (journal, ord, ts, event, detail) chained behind each journal's
    head (journal, seq, hash).

    A chain is serial within a journal: its rows are hashed as a sorted stream that holds the last hash; the work spreads
    over journals."""
    known = rows.select("journal", "ord", "ts", "event", "detail")
    if heads is None:
        known = known.withColumns({"seq": F.lit(0).cast("long"), "head": F.lit("")})
    else:
        first = heads.select("journal", F.col("seq").cast("long").alias("seq"), F.col("hash").alias("head"))
        known = known.join(first, "journal", "left").withColumns({"seq": F.coalesce("seq", F.lit(0).cast("long")), "head": F.coalesce("head", F.lit(""))})

    def step(key: tuple, held: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        _, ts, event, detail, seq, head = row
        seq, prev = held or (seq, head)
        mark = chained(prev, seq + 1, ts, event, detail)
        return (seq + 1, mark), (seq + 1, ts, event, detail, prev, mark)

    return fold_sorted(known, ["journal"], ["ord", "ts", "event", "detail"], step, "seq long, ts string, event string, detail string, prev string, hash string")


def chained(prev: str, seq: int, ts: str, event: str, detail: str) -> str:
    """The hash of an entry, as ``entry_hash`` computes it."""
    return hashlib.sha256(f"{prev}\0{seq}\0{ts}\0{event}\0{detail}".encode()).hexdigest()


def with_computed(journal: DataFrame) -> DataFrame:
    """Entries with ``line_no`` and the hash that their contents should have."""
    computed = entry_hash(F.col("prev"), F.col("seq"), F.col("ts"), F.col("event"), F.col("detail"))
    return journal.withColumn("computed", computed).withColumn("line_no", F.col("seq")) if "line_no" not in journal.columns else journal.withColumn("computed", computed)
