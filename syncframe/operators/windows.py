"""Numbering, first occurrences, chains, rates and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syncframe import functions as S
from syncframe.operators.folds import fold_sorted
from syncframe.operators.scans import numbered


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def manifest_order(path: Column) -> Column:
    """The order of a depth-first walk: by components, not by the path's text."""
    return S.components(path)


def number_entries(entries: DataFrame) -> DataFrame:
    """Adds ``number``, from 1 in walk order.  Entries are laid out by ranges of their components, so a tree with one top
    directory is cut like any other; no window holds more than a part."""
    return numbered(entries.withColumn("_walk", manifest_order(F.col("path"))), ["_walk"]).drop("_walk")


def mark_hardlinks(entries: DataFrame) -> DataFrame:
    """Adds ``link_ref``: of the regular files that share device and inode the first keeps its data, the others
    become hardlinks to it without a size.  Inode 0 is no inode.  Only inodes with several files are joined, on the least id
    that partial aggregation found; entries without an inode go past it."""
    shared = (F.col("kind") == "file") & (F.col("ino") != 0)
    several = entries.where(shared).groupBy("dev", "ino").agg(F.min("id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = several.select(F.col("dev").alias("_dev"), F.col("ino").alias("_ino"), "_first")
    joined = entries.join(first, shared & (F.col("dev") == F.col("_dev")) & (F.col("ino") == F.col("_ino")), "left")
    link = F.col("_first") != F.col("id")
    return joined.withColumns({
        "link_ref": F.when(link, F.col("_first")), "size": F.when(link, 0).otherwise(F.col("size")), "kind": F.when(link, "hardlink").otherwise(F.col("kind")),
    }).drop("_first", "_dev", "_ino")


def verify_chain(journal: DataFrame) -> DataFrame:
    """(journal, intact, problem) from (journal, line_no, prev, hash, computed): entries before the first break, and
    what broke: the link to the entry before is tested first, then the contents."""
    at = Window.partitionBy("journal").orderBy("line_no")
    link = F.col("prev") != F.coalesce(F.lag("hash").over(at), F.lit(""))
    bad = F.when(link, "broken link").when(F.col("hash") != F.col("computed"), "altered entry")
    seen = journal.withColumn("bad", bad).withColumn("n", F.row_number().over(at))
    return seen.groupBy("journal").agg(
        (F.coalesce(F.min(F.when(F.col("bad").isNotNull(), F.col("n"))), F.count("*") + 1) - 1).cast("long").alias("intact"),
        F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("n"))).alias("problem"),
    )


def newest_part(parts: DataFrame) -> DataFrame:
    """(path, final, stale): of several parts of one file the newest counts, then the larger."""
    named = parts.withColumn("final", S.part_final(F.col("path"))).where("final is not null")
    rank = F.row_number().over(Window.partitionBy("final").orderBy(F.desc("mtime_ns"), F.desc("size"), "path"))
    return named.select("path", "final", (rank > 1).alias("stale"))


def transfer_rate(samples: DataFrame, seconds: float, least: float = 0.1) -> DataFrame:
    """Adds ``rate`` to samples (session, ts, sent): the slope from the oldest to the newest sample of the trailing
    window, null if they are too close."""
    us = _micros(F.col("ts"))
    span = Window.partitionBy("session").orderBy(us).rangeBetween(-int(seconds * 1e6), 0)
    gap = (us - F.first(us).over(span)) / 1e6
    return samples.withColumn("rate", F.when(gap > least, (F.last("sent").over(span) - F.first("sent").over(span)) / gap))


def smoothed_rate(samples: DataFrame, least: float = 0.05) -> DataFrame:
    """(path, rate): 0.6 old + 0.4 new over a file's samples in time order, when the new rate is positive and far
    enough from the sample before.  A file's samples are folded as a sorted stream, which holds one of them."""

    def step(key: tuple, held: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        ts, event, sent = row
        rate = held[2] if held else None
        if held and ts is not None and held[0] is not None and sent is not None and held[1] is not None:
            gap = (ts - held[0]).total_seconds()
            if gap > least and (new := (sent - held[1]) / gap) > 0:
                rate = new if rate is None else 0.6 * rate + 0.4 * new
        return (ts, sent, rate), (ts, event, rate)

    kinds = dict(samples.dtypes)
    rated = fold_sorted(samples.select("path", "ts", "event_id", "sent"), ["path"], ["ts", "event_id", "sent"], step, f"ts {kinds['ts']}, event_id {kinds['event_id']}, rate double")
    return rated.groupBy("path").agg(F.max_by("rate", F.struct("ts", "event_id")).alias("rate"))


def first_path_wins(entries: DataFrame) -> DataFrame:
    """(id, path, verdict, first): the first entry of a path stays; the same path again is skipped; another case of
    it is an error that names the first."""
    same = Window.partitionBy(S.ascii_lower(F.col("path"))).orderBy("id")
    first = F.first("path").over(same)
    verdict = F.when(F.row_number().over(same) == 1, "keep").when(F.col("path") == first, "skip").otherwise("case clash")
    return entries.select("id", "path", verdict.alias("verdict"), first.alias("first"))


def rarest_first(missing: DataFrame) -> DataFrame:
    """Adds ``rank`` per peer: missing chunks by rarity, then by file and chunk."""
    order = Window.partitionBy("peer").orderBy("rarity", "file_idx", "chunk_idx")
    return missing.withColumn("rank", F.row_number().over(order).cast("long"))


def counter_deltas(samples: DataFrame) -> DataFrame:
    """Adds ``delta`` and ``rate`` between a session's samples."""
    at = Window.partitionBy("session").orderBy("ts", "event_id")
    gap = (_micros(F.col("ts")) - F.lag(_micros(F.col("ts"))).over(at)) / 1e6
    delta = F.col("sent") - F.lag("sent").over(at)
    return samples.withColumn("delta", delta).withColumn("rate", F.when(gap > 0, delta / gap))


def eta_seconds(total: Column, skipped: Column, sent: Column, rate: Column) -> Column:
    left = total - skipped - sent
    return F.when((rate > 0) & (left > 0), left / rate)


def latest_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def list_page(entries: DataFrame, offset: int, limit: int, most: int = 4096, usual: int = 1024) -> DataFrame:
    """A page of entries by name, with the total and whether more follow."""
    limit = limit if 0 < limit <= most else usual
    page = entries.orderBy("path", "id").offset(offset).limit(limit)
    total = entries.agg(F.count("*").alias("total"))
    return page.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > offset + limit)


def journal_tail(rows: DataFrame, n: int | str = 20) -> DataFrame:
    """The last n rows of each journal."""
    n = int(n) if str(n).isdigit() and int(n) > 0 else 20
    back = F.row_number().over(Window.partitionBy("journal").orderBy(F.desc("line_no")))
    return rows.withColumn("_back", back).where(F.col("_back") <= n).drop("_back")


def progress_table(files: DataFrame, active: int = 12, waiting: int = 24, errors: int = 48) -> DataFrame:
    """(session, path, state) rows to show: the newest active files up to a number, then waiting ones until a total,
    then errors until another."""
    rank = F.row_number().over(Window.partitionBy("session", "state").orderBy(F.desc("ts"), "path"))
    counts = {s: F.least(F.count_if(F.col("state") == s).over(Window.partitionBy("session")), F.lit(most)) for s, most in (("active", active), ("wait", waiting), ("error", errors))}
    shown_waiting = F.least(counts["wait"], F.lit(waiting) - counts["active"])
    ranked = files.withColumn("rank", rank).withColumn("a", counts["active"]).withColumn("w", shown_waiting)
    room = F.when(F.col("state") == "active", F.lit(active)).when(F.col("state") == "wait", F.col("w")).when(F.col("state") == "error", errors - F.col("a") - F.col("w")).otherwise(0)
    return ranked.where(F.col("rank") <= room).select("session", "path", "state")


def sample_peers(members: DataFrame, k: int = 64, salt: int = 0) -> DataFrame:
    """(room, addr, seed): all seeds, then others in a salted order until the list has k."""
    order = Window.partitionBy("room").orderBy(F.desc("seed"), F.md5(F.concat("addr", F.lit(f"#{salt}"))), "addr")
    return members.withColumn("_n", F.row_number().over(order)).where((F.col("_n") <= k) | F.col("seed")).select("room", "addr", "seed")


def evict_stalest(members: DataFrame, cap: int = 256) -> DataFrame:
    """Members that stay when a room has a cap: the stalest that are no seeds go; seeds may exceed the cap."""
    room = Window.partitionBy("room")
    over = F.greatest(F.count("*").over(room) - cap, F.lit(0))
    age = F.row_number().over(Window.partitionBy("room", "seed").orderBy("seen", "addr"))
    return members.withColumn("_over", over).withColumn("_age", age).where(F.col("seed") | (F.col("_age") > F.col("_over"))).drop("_over", "_age")
