"""A training-data pipeline of five corpus operators, each stage written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Null texts count as empty; extra columns of ``docs`` are kept as they are; rows without an id, or of one id
but different contents, are documents of their own; an empty table goes through every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from syncframe.llm.common import Workspace, order_key
from syncframe.llm.line_dedup import line_dedup
from syncframe.llm.mixing import curriculum_mix
from syncframe.llm.ngram_join import ngram_jaccard_join
from syncframe.llm.packing import pack_documents
from syncframe.llm.quality_classifier import quality_scores
from syncframe.llm.queries import tokenizer_path
from syncframe.operators.scans import numbered


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """Documents with a column that names each row: a long that is never null or repeated and rises with the id; the column's
    name, which the documents do not have; and whether it is the id itself.

    It is, where the ids are sound.  Else rows are numbered by id, null last, and by all that they hold, so that rows without
    an id and different texts of one id stay apart through an operator and find their own decisions again."""
    row = "op_row"
    while row in docs.columns:
        row = f"_{row}"
    if isinstance(docs.schema["doc_id"].dataType, IntegralType) and docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long")), row, True
    work = Workspace(docs.sparkSession)
    order = [F.col("doc_id").isNull(), "doc_id", F.sha2(F.to_json(F.struct(*docs.columns)), 256)]
    return numbered(docs, order, row, lambda x: work.save(x, "keyed")), row, False


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    keyed, row, same = _keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    if not same:
        labels = labels.join(keyed.select("doc_id", row), "doc_id").drop("doc_id").withColumnRenamed(row, "doc_id")
    scores = quality_scores(keyed.select(F.col(row).alias("doc_id"), "text"), labels)
    return keyed.join(scores.where("predicted = 0").select(F.col("doc_id").alias(row)), row, "left_anti").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier document has; those with no line left go."""
    keyed, row, _ = _keyed(docs)
    cleaned = line_dedup(keyed.select(F.col(row).alias("doc_id"), "text")).where("n_removed > 0")
    cleaned = cleaned.select(F.col("doc_id").alias(row), F.struct("n_lines", "n_removed", "cleaned_text").alias(f"{row}_lines"))
    cut = F.col(f"{row}_lines")
    joined = keyed.join(cleaned, row, "left").where(cut.isNull() | (cut.n_removed < cut.n_lines))
    text = F.when(cut.isNull(), F.col("text")).otherwise(cut.cleaned_text)
    changed = {"text": text, "n_chars": F.when(cut.isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))}
    return joined.select([changed.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id; documents without words stay."""
    keyed, row, _ = _keyed(docs)
    groups = ngram_jaccard_join(keyed.select(F.col(row).alias("doc_id"), "text")).where("component_id <> doc_id")
    return keyed.join(groups.select(F.col("doc_id").alias(row)), row, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of their training positions."""
    keyed, row, _ = _keyed(docs)
    plan = curriculum_mix(keyed.select(F.col(row).alias("doc_id"), "text", "source"), copies=True)
    plan = plan.select(F.col("doc_id").alias(row), F.col("position").alias(f"{row}_at"))
    return keyed.join(plan, row).orderBy(f"{row}_at", order_key(row), row).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2,048 that hold the documents."""
    return pack_documents(docs, tokenizer_path(), 2048)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("mixing", mix), ("best_fit_packing", pack)]

#: SQL can neither fit the classifier nor encode tokens; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; a stage's table goes once the next one's is written."""
    work = Workspace(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if before:
            work.drop(before)
        before = f"{k}-{name}"
    return docs
