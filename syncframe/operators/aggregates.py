"""Totals, digests and bitmaps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from syncframe import functions as S


def manifest_totals(entries: DataFrame) -> DataFrame:
    return entries.agg(
        F.count("*").alias("files"), F.sum(F.when(F.col("kind") == "file", F.col("size")).otherwise(0)).alias("bytes"),
        F.count_if(F.col("kind") == "dir").alias("dirs"), F.coalesce(F.bool_or(F.col("kind") == "hardlink"), F.lit(False)).alias("has_hardlinks"),
    )


def transfer_report(rows: DataFrame) -> DataFrame:
    """One row from (size, moved, status): sender_bytes moved in this run, receiver_bytes of all sound entries."""
    sound = F.col("status") != "error"
    return rows.agg(
        F.count_if(sound).alias("files"), F.sum("moved").alias("sender_bytes"), F.sum(F.when(sound, F.col("size")).otherwise(0)).alias("receiver_bytes"),
        F.sum(F.when(F.col("status") == "skip", F.col("size")).otherwise(0)).alias("skipped_bytes"), F.count_if(~sound).alias("errors"),
    )


def plan_totals(plan: DataFrame) -> DataFrame:
    """Totals of (size, chunks, have, status, missing): the estimate divides a file's size evenly over its chunks."""
    send = F.col("status") != "skip"
    estimate = S.div(F.col("size"), F.greatest(F.col("chunks"), F.lit(1))) * (F.col("chunks") - F.col("have"))
    return plan.agg(
        F.count_if(send).alias("to_send"), F.sum(F.when(~send, F.col("size")).otherwise(0)).alias("skipped_bytes"),
        F.sum(F.when(send, estimate).otherwise(0)).alias("estimated_bytes"), F.sum(F.when(send, F.col("missing")).otherwise(0)).alias("exact_bytes"),
    )


def completeness(chunks: DataFrame) -> DataFrame:
    """(path, have_count, chunk_count, complete) from (path, idx, have); idx is null for an empty file."""
    have, count = F.count_if(F.col("have")), F.count("idx")
    return chunks.groupBy("path").agg(have.alias("have_count"), count.alias("chunk_count"), (have == count).alias("complete"))


def bitmap_agg(bits: DataFrame, keys: list[str], bit: str) -> DataFrame:
    """The keys with ``bitmap``: set bits as hex bytes, low bit first, up to the last byte with a bit."""
    byte = bits.withColumn("_byte", F.shiftright(bit, 3)).withColumn("_bit", F.col(bit) % 8)
    some = byte.groupBy(*keys, "_byte").agg(S.packed_byte(F.col("_bit")).alias("_hex"))
    placed = F.map_from_entries(F.collect_list(F.struct(F.col("_byte").cast("int"), "_hex")))
    packed = some.groupBy(*keys).agg(F.max(F.col("_byte").cast("int")).alias("_last"), placed.alias("_map"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.coalesce(F.try_element_at("_map", i), F.lit("00"))), "")
    return packed.select(*keys, text.alias("bitmap"))


def chunk_rarity(spec: DataFrame, holdings: DataFrame) -> DataFrame:
    """(file_idx, chunk_idx, rarity): how many peers have each chunk of the spec, also none."""
    counts = holdings.groupBy("file_idx", "chunk_idx").agg(F.count_distinct("peer").alias("n"))
    return spec.select("file_idx", "chunk_idx").join(counts, ["file_idx", "chunk_idx"], "left").select("file_idx", "chunk_idx", F.coalesce("n", F.lit(0)).alias("rarity"))


def manifest_digest(entries: DataFrame, row: Column, order: Column, bits: int = 16) -> DataFrame:
    """(digest): the root of a hash tree over the rows in the order of distinct numbers, 2^bits children at each node.

    The lowest nodes hash the hashes of the rows whose numbers agree but for the last ``bits``, the next ones the hashes of
    those nodes, and so on up to one node, two levels at least.  A node's row holds 2^bits hashes at most, whatever the number
    of rows; the largest number, which one aggregate finds, says how many levels there are."""
    level = entries.select(F.sha2(row, 256).alias("h"), order.cast("long").alias("o"))
    top = level.agg(F.max(F.abs("o"))).first()[0] or 0
    levels = max(2, -(-int(top).bit_length() // bits))
    node = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), ""), 256)
    for _ in range(levels - 1):
        level = level.groupBy(F.shiftright("o", bits).alias("_up")).agg(node.alias("h")).withColumnRenamed("_up", "o")
    return level.agg(node.alias("digest"))


def spec_hash(files: DataFrame, chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(spec_hash) of a descriptor, or one for each value of ``keys``: over ``path NUL size NUL octal mode NUL sha
    NUL`` and each chunk's hash and NUL, files in the order of their paths.  SHA-256 reads a descriptor in
    order, so one task reads its sorted rows as a stream, with nothing but the hash's state in memory."""
    keys, nul = keys or [], F.lit("\0")
    head = F.concat("path", nul, F.col("size").cast("string"), nul, S.octal_mode(F.col("mode")), nul, "sha", nul)
    group = F.to_json(F.struct(*keys)) if keys else F.lit("")
    rows = files.select(*keys, "path", head.alias("head"), F.monotonically_increasing_id().alias("row")).where("head is not null")
    rows = rows.join(chunks.select(*keys, "path", "idx", F.col("sha").alias("part")), [*keys, "path"], "left").withColumn("group", group)
    ordered = (rows.repartition("group") if keys else rows.repartition(1)).sortWithinPartitions("group", "path", "head", "row", "idx")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, file, state = ["group", "spec_hash"], None, None, hashlib.sha256()
        for batch in batches:
            for at, row, start, part in zip(*(batch[c].to_pylist() for c in ("group", "row", "head", "part")), strict=True):
                if at != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=names)
                    now, file, state = at, None, hashlib.sha256()
                if row != file:
                    state.update(start.encode())
                    file = row
                if part is not None:
                    state.update(part.encode() + b"\0")
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=names)

    found = ordered.select("group", "row", "head", "part").mapInArrow(hashed, "group string, spec_hash string")
    if not keys:
        return found.agg(F.coalesce(F.max("spec_hash"), F.lit(hashlib.sha256().hexdigest())).alias("spec_hash"))
    kinds = files.select(*keys).schema
    return found.select(F.from_json("group", kinds).alias("g"), "spec_hash").select("g.*", "spec_hash")


def server_counters(sessions: DataFrame) -> DataFrame:
    """From session rows (event, bytes): sessions, files, bytes, errors and those still active."""
    is_ = lambda e: F.col("event") == e
    return sessions.agg(
        F.count_if(is_("start")).alias("sessions"), F.count_if(is_("file")).alias("files"), F.sum("bytes").alias("bytes"),
        F.count_if(is_("error")).alias("errors"), (F.count_if(is_("start")) - F.count_if(is_("end"))).alias("active"),
    )


def file_states(events: DataFrame) -> DataFrame:
    """(path, state, bytes): the latest state of each file; a resolved file does not change again, and done, error
    and skip resolve."""
    first_end = F.min_by("kind", F.when(F.col("kind").isin("done", "error", "skip"), F.struct("ts", "event_id")))
    return events.groupBy("path").agg(
        F.coalesce(first_end, F.when(F.bool_or(F.col("kind") == "active") | F.bool_or(F.col("kind") == "chunk"), "active"), F.lit("wait")).alias("state"),
        F.sum(F.when(F.col("kind") == "chunk", F.col("bytes")).otherwise(0)).alias("bytes"),
    )


def progress_snapshot(events: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.col("state") == s)
    return file_states(events).agg(
        F.count("*").alias("total"), is_("done").alias("done"), is_("error").alias("errors"), is_("skip").alias("skipped"), F.sum("bytes").alias("sent_bytes")
    )


def chunk_failures(fetches: DataFrame, most: int = 6) -> DataFrame:
    """(file_idx, chunk_idx, failures, fatal): failed rounds before the first success."""
    first = F.min(F.when(F.col("ok"), F.col("ts"))).over(Window.partitionBy("file_idx", "chunk_idx"))
    before = fetches.withColumn("first", first).where("first is null or ts < first")
    n = F.count("*")
    return before.groupBy("file_idx", "chunk_idx").agg(n.alias("failures"), ((n >= most) & F.first("first").isNull()).alias("fatal"))


def common_ancestor(paths: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(ancestor), or one for each value of ``keys``: the deepest directory that holds all paths: the shared components of the
    least and the greatest path; for a single path its parent; refused (null) at the root."""
    keys = keys or []
    ends = paths.select(*keys, S.components(F.col("path")).alias("p")).groupBy(*keys).agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count("*").alias("n"))
    same = F.filter(F.sequence(F.lit(1), F.size("a")), lambda i: F.slice("a", F.lit(1), i) == F.slice("b", F.lit(1), i))
    deep = F.when(F.col("n") == 1, F.size("a") - 1).otherwise(F.size(same))
    return ends.select(*keys, F.nullif(F.array_join(F.slice("a", F.lit(1), deep), "/"), F.lit("")).alias("ancestor"))


def artifact_progress(grid: DataFrame, holdings: DataFrame) -> DataFrame:
    """(peer, done_bytes, total_bytes, percent) over the artifact's chunks (file_idx, chunk_idx, len)."""
    total = grid.agg(F.sum("len").alias("total_bytes"))
    done = holdings.join(grid, ["file_idx", "chunk_idx"]).groupBy("peer").agg(F.sum("len").alias("done_bytes"))
    return done.crossJoin(total).select("peer", "done_bytes", "total_bytes", S.div(F.col("done_bytes") * 100, F.col("total_bytes")).alias("percent"))
