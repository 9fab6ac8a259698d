"""Numbers and running sums over a distributed order: no window ever holds the rows of a hot key or of the whole table.

Rows are laid out by range, written once (the bounds of a range layout are sampled, so a second evaluation could cut
elsewhere), summed within each part, and corrected by what the parts before hold.  What is broadcast has a row for each
part and none for rows or keys."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The shared checkpoint folder; one of the session's own is set only where none is named and all runs on one machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows in the shared checkpoint folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


#: What was shuffled goes when the step that read it is done, and not when the driver collects its garbage.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings until the block ends; the session has its own ones afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Staging:
    """Tables in the shared checkpoint folder, by name and compressed, which are gone when they are dropped or the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{_shared(spark)}/staged-{uuid.uuid4().hex}"

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def save(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        """The table as written, in a folder ``name/column=value`` for each value of the columns ``by``."""
        df.write.option("compression", "zstd").partitionBy(*by).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(rows: DataFrame, order: list[Column | str], name: str = "number", save: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Adds ``name``: gapless numbers from 1 in the given order.  The order should be total; ties fall as they lie.

    Parts are counted, and a row's number is its place in its sorted part behind the counts of the parts before."""
    laid = rows.repartitionByRange(_parts(rows), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = save(laid)
    part = F.shiftrightunsigned("_at", 33).alias("_part")
    before = laid.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = laid.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def running(
    rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], how: Callable[[Column], Column] = F.sum, before: bool = False,
    save: Callable[[DataFrame], DataFrame] = cut,
) -> DataFrame:
    """Adds, under each name in ``values``, its column folded over the rows of the same keys up to this one, or ``before`` it.

    ``how`` is an aggregate that may be folded from partial results: ``sum``, ``max`` or ``min``.  Null keys are a key;
    nulls among the values are passed over.  Rows that tie in ``order`` fall as they lie."""
    laid = save(rows.withColumns(values).repartitionByRange(_parts(rows), *keys, *order).withColumn("_part", F.spark_partition_id()))
    group, names = F.struct(*keys), list(values)
    local = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    ends = laid.groupBy("_part").agg(F.max(group).alias("_last"))
    tails = laid.join(F.broadcast(ends), "_part").where(group.eqNullSafe(F.col("_last"))).groupBy("_part", "_last").agg(*[how(F.col(n)).alias(n) for n in names])
    upto = Window.partitionBy("_last").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    carried = tails.select(
        F.lead("_part").over(Window.orderBy("_part")).alias("_next"), F.col("_last").alias("_key"), *[how(F.col(n)).over(upto).alias(f"_c_{n}") for n in names]
    ).where("_next is not null")
    summed = laid.withColumns({n: how(F.col(n)).over(local) for n in names})
    same = (F.col("_part") == F.col("_next")) & group.eqNullSafe(F.col("_key"))
    fold = {F.sum: lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), F.max: F.greatest, F.min: F.least}[how]
    joined = summed.join(F.broadcast(carried), same, "left")
    return joined.withColumns({n: fold(F.col(f"_c_{n}"), F.col(n)) for n in names}).drop("_part", "_next", "_key", *[f"_c_{n}" for n in names])
