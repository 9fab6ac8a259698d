"""Unions and differences of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, change): added, removed or modified regular files, by size and time."""
    x = a.where("kind = 'file'").select("path", F.col("size").alias("s1"), F.col("mtime_ns").alias("t1"))
    y = b.where("kind = 'file'").select("path", F.col("size").alias("s2"), F.col("mtime_ns").alias("t2"))
    change = F.when(F.col("s1").isNull(), "added").when(F.col("s2").isNull(), "removed").when(F.expr("s1 <> s2 or t1 <> t2"), "modified")
    return x.join(y, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def mirror_state(src_chunks: DataFrame, dst_chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """(path, idx, hash) of the destination after a mirror: chunks of ``plan`` (path, idx, send) that are kept come
    from the destination, those that are sent from the source; other paths are gone."""
    kept = dst_chunks.join(plan.where("not send").select("path", "idx"), ["path", "idx"], "left_semi")
    sent = src_chunks.join(plan.where("send").select("path", "idx"), ["path", "idx"], "left_semi")
    return kept.unionByName(sent)


def spec_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, idx, change) between two chunk catalogues."""
    a, b = old.select("path", "idx", F.col("sha").alias("was")), new.select("path", "idx", "sha")
    change = F.when(F.col("was").isNull(), "added").when(F.col("sha").isNull(), "removed").when(F.col("was") != F.col("sha"), "changed")
    return a.join(b, ["path", "idx"], "full_outer").select("path", "idx", change.alias("change")).where("change is not null")
