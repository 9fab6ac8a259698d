"""Shared pieces of the corpus operators: written tables, text normalisation and distributed ranks."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of every contract in this package: space and the controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


class Workspace:
    """Tables written once to the shared checkpoint folder and read back, so that a lost executor
    costs a re-read and not a recomputation.  What a table was shuffled from is freed once the table
    is written, and ``drop`` frees tables that no later step reads: disk follows the largest step
    and not the sum of all."""

    FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
    BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        self.root = f"{base or tempfile.mkdtemp(prefix='spark-')}/corpus-{uuid.uuid4().hex}"

    @contextlib.contextmanager
    def _set(self, **settings: str) -> Iterator[None]:
        """Settings for one write; the session has its own ones afterwards."""
        names = {getattr(self, k): v for k, v in settings.items()}
        before = {k: self.spark.conf.get(k, None) for k in names}
        try:
            for k, v in names.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)

    def save(self, df: DataFrame, name: str, batch_rows: int = 512, batch_bytes: str | None = None) -> DataFrame:
        """The table as written; its Arrow batches hold at most ``batch_rows`` rows and, if given, about ``batch_bytes``, as
        texts may be long."""
        with self._set(FREE="true", BATCH=str(batch_rows), **({"BYTES": batch_bytes} if batch_bytes else {})):
            df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def text_of(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def order_key(id_column: str) -> Column:
    """A fixed pseudo-random order of documents that any engine with MD5 can repeat."""
    return F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))


def rank_within(df: DataFrame, keys: list[str], key_order: str, ties: list[str], name: str) -> DataFrame:
    """Gapless ranks from 0 in each group of ``keys``, in the order of the hex column ``key_order``.

    A group may hold any share of all rows: it is cut into 4,096 slices by the leading digits of the
    order key, slices are counted, and a row's rank is its place in its slice plus the sizes of the
    slices before.  Keys must not be null."""
    cut = df.withColumn("_slice", F.substring(key_order, 1, 3))
    by = [*keys, "_slice"]
    before = (
        cut.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice")) - F.col("_n"))
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*by).orderBy(key_order, *ties)) - 1
    return (
        cut.withColumn("_local", local).join(before, by)
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_slice", "_before", "_local")
    )
