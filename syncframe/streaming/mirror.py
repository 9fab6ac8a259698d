"""A mirror that follows a stream of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from syncframe import functions as S
from syncframe import sinks
from syncframe.operators import joins
from syncframe.operators.filters import chunks_of
from syncframe.operators.scans import FREED, Staging, settings

FILES = "path string, kind string, size long, mtime_ns long, version long"


#: Parts that a change set is dealt to before they are joined to parts of ordinary size.
PARTS = 1024
#: Bytes of changes and of the mirror for each share of the buckets that is done by itself, and the most shares there are.
SHARE_BYTES = 128 << 20
SHARES = 16
#: Adaptive parts for what is done with a batch: a stream's session has them off, and its number of parts is that of its state
#: stores, whatever the batch holds.
DEALT_BY_SIZE = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(PARTS)}


def apply_changes(changes: DataFrame, folder: str, chunk_size: int, buckets: int = 64) -> None:
    """Applies changes (path, version, deleted, size, mtime_ns, content) to the mirror in ``folder``: its tables ``files`` and
    ``chunks`` (path, idx, len, hash, payload).

    Of several changes of a path the newest counts, and one that is no newer than what the mirror has does nothing.  Files that
    the quick check calls unchanged keep their chunks; of the others only chunks of another identity are taken from the change.
    Chunks are written first and files last, so a run that dies in between is taken up again by the same changes.

    The changes are read once and laid down by their buckets.  A large set is applied by shares of the buckets, one after the
    other: besides the mirror, the disk holds the changes that are left and what one share needs."""
    with settings(changes.sparkSession, DEALT_BY_SIZE | FREED):
        _apply(changes, folder, chunk_size, buckets)


def _shares(laid: DataFrame, chunks: str, most: int) -> int:
    """How many shares the buckets are done in, a power of two for shares of one size: by the bytes of the changes and of what may
    have to be rewritten."""
    spark = laid.sparkSession
    size = laid.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if sinks.exists(spark, chunks):
        there = spark._jvm.org.apache.hadoop.fs.Path(chunks)
        size += there.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(there).getLength()
    return min(most, 1 << (size // SHARE_BYTES).bit_length())


def _apply(changes: DataFrame, folder: str, chunk_size: int, buckets: int) -> None:
    spark, files = changes.sparkSession, f"{folder}/files"
    if not sinks.exists(spark, files):
        sinks.replace_paths(spark.createDataFrame([], FILES), spark.createDataFrame([], "path string"), files, buckets=buckets)
    slots = min(buckets, SHARES)
    with Staging(spark) as staged:
        laid = staged.save(changes.withColumn("_slot", sinks.bucket_of("path", buckets) % slots), "changes", by=("_slot",))
        shares = _shares(laid, f"{folder}/chunks", slots)
        for k in range(shares):
            own = range(k, slots, shares)
            held = [b for b in range(buckets) if b % slots in own]
            _apply_share(laid.where(F.col("_slot").isin(*own)).drop("_slot"), folder, chunk_size, buckets, held, staged)
            for slot in own:
                staged.drop(f"changes/_slot={slot}")


def _apply_share(changes: DataFrame, folder: str, chunk_size: int, buckets: int, held: list[int], staged: Staging) -> None:
    """Applies changes whose paths lie in the buckets ``held``."""
    spark = changes.sparkSession
    rest = [c for c in changes.columns if c != "path"]
    newest = changes.groupBy("path").agg(F.max_by(F.struct(*rest), "version").alias("x")).select("path", "x.*")
    files, chunks = f"{folder}/files", f"{folder}/chunks"
    there = sinks.read_buckets(spark, StructType.fromDDL(f"{FILES}, bucket int"), files, held).drop("bucket")
    known = there.select("path", F.col("version").alias("_had"))
    newer = newest.join(known, "path", "left").where("_had is null or version > _had").drop("_had").withColumn("kind", F.lit("file"))
    used = F.when(F.col("deleted") | (F.col("status") == "skip"), None).otherwise(F.col("content"))
    fresh = staged.save(joins.quick_checked(newer, there).withColumn("content", used), "fresh")
    alive = fresh.where("not deleted")
    changed = alive.where("status <> 'skip'")
    ident = S.chunk_id(F.col("path"), F.col("idx"), F.col("payload")).alias("hash")
    new = chunks_of(changed, chunk_size).select("path", "idx", "len", ident, "payload")
    # a chunk that the mirror has keeps its own payload
    had = sinks.read_buckets(spark, new.withColumn("bucket", F.lit(0)).schema, chunks, held)
    old = had.select("path", "idx", F.col("hash").alias("_old"), F.col("payload").alias("_payload"))
    same = F.col("hash").eqNullSafe(F.col("_old"))
    new = new.join(old, ["path", "idx"], "left").select("path", "idx", "len", "hash", F.when(same, F.col("_payload")).otherwise(F.col("payload")).alias("payload"))
    gone = fresh.where("deleted").select("path")
    sinks.replace_paths(new, changed.select("path").unionByName(gone), chunks, buckets=buckets)
    kept = alive.select("path", "kind", "size", "mtime_ns", "version")
    sinks.replace_paths(kept, fresh.select("path"), files, buckets=buckets)
    staged.drop("fresh")


def continuous_mirror(
    changes: DataFrame, folder: str, checkpoint: str, chunk_size: int = 1 << 20, buckets: int = 64, after: Callable[[int, str], None] | None = None,
) -> StreamingQuery:
    """Applies a stream of changes to the mirror in ``folder`` until what is there has been handled.

    Each micro-batch plans by itself (quick check, delta, deletes) and is entered in the ledger beside the mirror once it is
    done; one that the ledger has is passed over, so a replayed batch changes nothing.  ``after`` is told of each step."""
    told = after or (lambda batch, step: None)

    def handle(batch: DataFrame, number: int) -> None:
        spark, entry = batch.sparkSession, f"{folder}/ledger/batch={number}"
        if sinks.exists(spark, f"{entry}/_SUCCESS"):
            told(number, "passed over")
            return
        apply_changes(batch, folder, chunk_size, buckets)
        told(number, "applied")
        spark.range(1).select(F.lit(number).cast("long").alias("done")).coalesce(1).write.mode("overwrite").parquet(entry)
        told(number, "entered")

    return changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
