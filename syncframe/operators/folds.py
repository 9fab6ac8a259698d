"""Folds over the sorted rows of a key, as streams: a task holds a batch of rows and the state of one key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame

Step = Callable[[tuple, object, tuple], tuple[object, tuple]]

UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}


def spark_seconds(span: str) -> timedelta:
    """The span of an interval text such as ``3 days`` or ``1 hour 30 minutes``."""
    words = span.split()
    return timedelta(seconds=sum(float(n) * UNITS[unit.lower().removesuffix("s")] for n, unit in zip(words[::2], words[1::2], strict=True)))


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """One row per input row: the keys and what ``step`` gives for it.

    ``step`` takes the key, the state (None at first) and the row's columns other than the keys, and returns the new state and
    a tuple of ``schema``.  Spark deals rows by key and sorts them, spilling if need be; a chain is serial within its key, and
    the work spreads over keys."""
    rest = [c for c in rows.columns if c not in keys]
    kinds = dict(rows.dtypes)
    out_schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema])
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in (*keys, *rest)]
            for values in zip(*columns, strict=True):
                key, row = values[: len(keys)], values[len(keys) :]
                if key != now:
                    now, state = key, None
                state, made = step(key, state, row)
                out.append((*key, *made))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), arrow_kinds, strict=True)], names=[*keys, *names])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow_kinds = [to_arrow_type(f.dataType) for f in _parse_datatype_string(out_schema).fields]
    laid = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return laid.mapInArrow(run, out_schema)
