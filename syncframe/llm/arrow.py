"""Helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Texts are worked on in runs of about this many bytes, so memory does not follow the batch size.
RUN_BYTES = 2_000_000


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Lets no Arrow batch hold more than ``rows`` rows: texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000") or 10000)
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of a batch as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def runs(texts: list[bytes], limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes together; a longer text is a range of its own."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in one array and where each begins, with the end last."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def record_batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
