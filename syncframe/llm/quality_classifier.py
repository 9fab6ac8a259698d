"""A quality classifier: ridge scores on random Fourier features of text statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncframe.llm.arrow import record_batch, small_batches, texts_of
from syncframe.llm.common import Workspace, text_of


def _class_table() -> np.ndarray:
    """For each byte, which of the counted classes it belongs to."""
    groups = [
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b".,;:?", b"!",
        b"\"'()[]{}", b"-_/\\@=+~^`", b" ", b"\n", bytes([*range(0, 9), *range(11, 32), 127]), bytes(range(128, 256)),
    ]
    table = np.zeros((256, len(groups)))
    for k, group in enumerate(groups):
        table[list(group), k] = 1
    return table


_CLASSES = _class_table()


def text_statistics(text: bytes) -> list[float]:
    """Statistics of the whole text that do not follow its language: sizes, shares of character classes,
    lengths and variety of words, and how lines end and repeat."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES
    size = max(len(text), 1)
    words = text.split()
    distinct = set(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    n = max(len(words), 1)
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
    m = max(len(lines), 1)
    same = sum(map(bytes.__eq__, words[1:], words)) if len(words) > 1 else 0
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(words)), np.log1p(len(text)), *(np.sqrt(counts / size)).tolist(),
        float(lengths.mean()), float(lengths.std()), len(distinct) / np.sqrt(n), len(distinct) / n, pairs / n, same / n,
        sum(x[-1:] in b".!?:;\"')" for x in lines) / m, len(set(lines)) / m, np.log1p(len(text) / m),
    ]


#: Folds of crc32(id as text) mod FOLDS: 0 is held out, 1 calibrates, the others fit.
FOLDS = 5
BINS = 400
#: Sums of tasks that are added up apart from each other.
LANES = 256


def _fold(column: Column) -> Column:
    return (F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def _summed(rows: DataFrame, per_batch, size: int) -> np.ndarray:
    """The sum over all rows of ``per_batch`` (a vector of ``size`` numbers for a batch): one vector per task, added up block
    by block on the executors: first ``LANES`` sums of the tasks that share a lane, then the lanes' sums, so that no task
    holds a block of every task."""
    block = 16384

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total += per_batch(batch)
                any_rows = True
        schema = pa.schema([("block", pa.int32()), ("task", pa.int32()), ("sums", pa.binary())])
        task = TaskContext.get().partitionId()
        for at in range(0, size, block) if any_rows else ():
            yield record_batch(schema, [[at // block], [task], [total[at : at + block].tobytes()]])

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        ordered = parts.sort_values("task")["sums"]  # sums of doubles follow their order
        return pd.DataFrame({"block": [key[0]], "task": [key[-1]], "sums": [sum(np.frombuffer(x) for x in ordered).tobytes()]})

    schema = "block int, task int, sums binary"
    total = np.zeros(size)
    lanes = rows.mapInArrow(part, schema).withColumn("lane", F.col("task") % LANES).groupBy("block", "lane").applyInPandas(add, schema)
    for at, _, sums in lanes.groupBy("block").applyInPandas(add, schema).collect():
        values = np.frombuffer(sums)
        total[at * block : at * block + len(values)] = values
    return total


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and levels of the rising steps that fit best."""
    steps: list[list[float]] = []
    for centre, value, w in zip(x, y, weight, strict=True):
        steps.append([centre * w, value * w, w])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            top = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], top, strict=True)]
    return np.array([s[0] / s[2] for s in steps]), np.array([s[1] / s[2] for s in steps])


def quality_scores(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    features: int = 512, ridge: float = 1e-4, threshold: float = 0.3, seed: int = 5,
) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= ``threshold``).

    Each whole text becomes a vector of statistics, standardised over the labelled rows.  ``features`` random
    cosines approximate a Gaussian kernel as wide as the vector's usual length; the normal equations of
    ridge regression are summed within partitions and then over them, so the driver gets one matrix of
    ``features`` squared whatever the corpus.  Raw scores are calibrated by an isotonic fit over ``BINS``
    bins of a fold that the regression did not see.  All labelled rows outside the held-out fold are used.

    Null and empty texts have statistics too and get a score.  Without labels every score is 0.5; with labels
    of one kind only, every score is that label.  Null labels and labels of unknown documents are left
    out.  Repeated rows get the same score; a null id is held out; an empty table gives an empty result."""
    spark = df.sparkSession
    small_batches(spark)
    work = Workspace(spark)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
        for batch in batches:
            yield record_batch(schema, [batch["doc_id"], [text_statistics(t) for t in texts_of(batch["text"])]])

    measured = work.save(docs.mapInArrow(measure, "doc_id long, x array<double>").withColumn("fold", _fold(F.col("doc_id"))), "statistics")
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null")
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    learnt = work.save(measured.where("fold <> 0").join(marks, "doc_id").select("x", "y", "fold"), "learnt")

    width = len(text_statistics(b""))
    matrix = lambda batch: np.stack(batch["x"].to_numpy(zero_copy_only=False)).astype(float)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = matrix(batch)
        return np.concatenate([[len(x), batch["y"].to_numpy().sum()], x.sum(0), (x * x).sum(0)])

    sums = _summed(learnt, moments, 2 + 2 * width)
    count, positive = sums[0], sums[1]
    held = (F.col("fold") == 0).alias("held_out")

    def finished(score) -> DataFrame:
        return score.select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

    if count == 0 or positive in (0, count):
        return finished(measured.withColumn("score", F.lit(0.5 if count == 0 else positive / count)))
    mean = sums[2 : 2 + width] / count
    spread = np.sqrt(np.maximum(sums[2 + width :] / count - mean**2, 0))
    spread[spread < 1e-9] = 1.0
    chance = np.random.default_rng(seed)
    directions = chance.normal(size=(width, features)) / np.sqrt(width)
    phases = chance.uniform(0, 2 * np.pi, features)

    def lifted(batch: pa.RecordBatch) -> np.ndarray:
        z = np.clip((matrix(batch) - mean) / spread, -5, 5)
        return np.column_stack([np.sqrt(2 / features) * np.cos(z @ directions + phases), np.ones(len(z))])

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z = lifted(batch)
        return np.concatenate([(z.T @ z).ravel(), z.T @ batch["y"].to_numpy()])

    size = features + 1
    fit, calibrate = learnt.where("fold <> 1"), learnt.where("fold = 1")
    sums = _summed(fit, normal, size * size + size)
    gram, right = sums[: size * size].reshape(size, size), sums[size * size :]
    seen = max(gram[-1, -1], 1.0)
    weights = np.linalg.solve(gram + ridge * seen * np.eye(size), right)

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        raw = lifted(batch) @ weights
        place = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        y = batch["y"].to_numpy()
        return np.concatenate([np.bincount(place, minlength=BINS), np.bincount(place, y, BINS), np.bincount(place, raw, BINS)])

    n, ones, total = _summed(calibrate, histogram, 3 * BINS).reshape(3, BINS)
    full = n > 0
    if full.any():
        centres, levels = isotonic(total[full] / n[full], ones[full] / n[full], n[full])
    else:
        centres, levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("fold", pa.int32()), ("score", pa.float64())])
        for batch in batches:
            if batch.num_rows:
                raw = lifted(batch) @ weights
                yield record_batch(schema, [batch["doc_id"], batch["fold"], np.clip(np.interp(raw, centres, levels), 0, 1)])

    return finished(measured.mapInArrow(score, "doc_id long, fold int, score double"))
