"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syncframe.llm.common import WORD, Workspace, order_key, text_of


def curriculum_mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, slope: float = 0.5, copies: bool = False,
) -> DataFrame:
    """One row per input row, sorted by training position: doc_id, source, size, source_size, target,
    repeats, taken, position, last_position.  With ``copies``, one row per copy that is taken: doc_id, source, size, copy
    (from 0) and position, which inverts the demand for each copy's own words.

    ``size`` counts words.  Sources sorted by code point, null last, take their mean weight from
    ``cycle`` in turn and share all words; a target stops at ``most`` times the source's size and the
    excess goes to the other sources by weight (solved at once by the water level at which the
    targets add up).  The weight of a source changes over training time: its density is
    ``1 + a (2 t - 1)`` with ``a = slope * (weight - middle weight)``, so light sources come early and
    heavy ones late.  The integral of that density, times the target, is the source's cumulative
    demand; a document whose words begin at a share ``u`` of its source's taken words stands at the
    time at which the demand reaches ``u``.

    A source of target T and size S takes ``T div S`` whole passes over its documents and of the rest
    the first documents in a fixed pseudo-random order, as far as a document's middle word lies
    within it: ``taken`` stays within half a document of the target.  Documents without words take 0
    and stand where they fall; ``position`` is null for a document that is not taken at all.  Cumulative
    sums run over 4,096 slices of each source, so one source may hold any share of the rows.  The
    table of sources alone is ordered as a whole.  Null or empty texts have size 0, repeated rows count
    as often as they occur, an empty table gives an empty result."""
    work = Workspace(df.sparkSession)
    docs = work.save(
        df.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"), order_key(id_col).alias("_key"),
        ).withColumn("_slice", F.substring("_key", 1, 3)).withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))),
        "sizes",
    )
    parts = docs.groupBy("_source", "_slice").agg(F.sum("size").alias("_part"))
    by_code = Window.orderBy(F.col("_source") == "", "_source")
    by_level = Window.orderBy("_ratio", "_source")
    middle = sum(cycle) / len(cycle)
    weights = F.array(*[F.lit(w) for w in cycle])
    levels = (
        parts.groupBy("_source").agg(F.sum("_part").alias("source_size"))
        .withColumn("_weight", F.element_at(weights, ((F.row_number().over(by_code) - 1) % len(cycle) + 1).cast("int")))
        .withColumn("_ratio", most * F.col("source_size") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("_full", F.sum(most * F.col("source_size")).over(by_level) - most * F.col("source_size"))
        .withColumn("_heavier", F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_heavier"))
        .withColumn("_level", F.min_by("_level", F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_source"))).over(Window.partitionBy()))
        .select(
            "_source", "source_size", (F.lit(slope) * (F.col("_weight") - middle)).alias("_a"),
            F.least((most * F.col("source_size")).cast("double"), F.col("_level") * F.col("_weight")).alias("target"),
        )
    )
    slices = parts.join(work.save(levels, "targets"), "_source").withColumn(
        "_before", F.sum("_part").over(Window.partitionBy("_source").orderBy("_slice")) - F.col("_part")
    )
    local = Window.partitionBy("_source", "_slice").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    passes = F.least(F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)), F.lit(most))
    placed = (
        docs.withColumn("_local", F.sum("size").over(local) - F.col("size"))
        .join(slices.drop("_part"), ["_source", "_slice"])
        .withColumn("_at", F.col("_before") + F.col("_local"))
        .withColumn("_passes", passes)
        .withColumn("_rest", F.col("target") - F.col("_passes") * F.col("source_size"))
        .withColumn("_more", ((F.col("_at") + F.col("size") / 2) < F.col("_rest")).cast("int"))
        .withColumn("repeats", (F.col("_passes") + F.col("_more")).cast("int"))
    )

    def time_of(words):
        u = F.least(words / F.col("target"), F.lit(1.0))
        rising = F.lit(1.0) - F.col("_a")
        root = (F.sqrt(rising * rising + 4 * F.col("_a") * u) - rising) / (2 * F.col("_a"))
        return F.when((F.col("repeats") > 0) & (F.col("target") > 0), F.when(F.col("_a") == 0, u).otherwise(root))

    if copies:
        each = placed.where("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
        at = time_of(F.col("copy") * F.col("source_size") + F.col("_at"))
        return each.select("doc_id", "source", "size", "copy", at.alias("position"), "_key").orderBy("position", "_key", "doc_id", "copy").drop("_key")

    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"),
        time_of(F.col("_at")).alias("position"),
        time_of((F.col("repeats") - 1) * F.col("source_size") + F.col("_at")).alias("last_position"), "_key",
    ).orderBy("position", "_key", "doc_id").drop("_key")
