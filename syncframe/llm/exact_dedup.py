"""Exact deduplication with a split of the heavy hitters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncframe.llm.common import SPACE, Workspace, text_of


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.0005) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their digests are, after each run of white space became one space; of equal
    texts the smallest id stays.  A Misra-Gries summary (``freqItems``) names at most ``1 / support``
    digests, among them every digest that holds more than that share of the rows.  These are counted
    exactly; the ones that reach the share are the winners, and their rows are resolved on the map
    side by a broadcast of at most ``1 / support`` rows.  The other digests, none of which can fill
    more than ``support`` of the rows, are shuffled as usual: their groups are aggregated, and only those of two rows or
    more are joined, as a table, so that Spark can split the rows of a group.

    Null texts count as empty, and empty texts equal each other.  Rows that repeat an id are the same
    document and get the same verdict.  A null id never wins against another id; a group that has
    only null ids has keep_id null and keeps its rows.  An empty table gives an empty result."""
    work = Workspace(df.sparkSession)
    normal = F.regexp_replace(text_of(text_col), f"{SPACE}+", " ")
    digests = work.save(df.select(F.col(id_col).alias("doc_id"), F.sha2(normal, 256).alias("text_sha256")), "digests")
    rows = digests.count()
    names = digests.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    found = (
        digests.join(F.broadcast(names), "text_sha256")
        .groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where((F.col("group_size") > 1) & (F.col("group_size") >= support * rows))
    )
    winners = F.broadcast(work.save(found, "winners"))
    frequent = digests.join(winners, "text_sha256").select("doc_id", "keep_id", "group_size", "text_sha256")
    rest = digests.join(winners, "text_sha256", "left_anti")
    several = rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    joined = rest.join(work.save(several, "several"), "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    ordinary = joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")
    return frequent.unionByName(ordinary).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
