"""Stateful streams without deadlines: small folds over the rows of a key, kept in Spark's state store.

A fold takes the key, its state (any JSON value, None at first) and one row, and returns the new state and the rows
to emit.  Rows of a micro-batch are folded in the order of their time."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from syncframe.operators.journal import chained

Fold = Callable[[tuple, object, dict], tuple[object, list[tuple]]]


def fold_stream(rows: DataFrame, keys: list[str], order: list[str], fold: Fold, schema: str) -> DataFrame:
    """Emits what the fold emits, in append mode."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        out: list[tuple] = []
        for row in pd.concat(list(batches)).sort_values(order, kind="stable").to_dict("records"):
            held, emitted = fold(key, held, row)
            out += emitted
        state.update((json.dumps(held),))
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def ban_stream(rows: DataFrame) -> DataFrame:
    """(session, peer, ref, banned) for fetches (session, peer, ts, ref, ok): rows after the first failing one."""

    def fold(key, held, row):
        banned = bool(held)
        return banned or (not row["ok"] and key[1] != "http"), [(key[0], key[1], int(row["ref"]), banned)]

    return fold_stream(rows, ["session", "peer"], ["ts", "ref"], fold, "session long, peer string, ref long, banned boolean")


def journal_stream(rows: DataFrame) -> DataFrame:
    """(journal, seq, ts, event, detail, prev, hash): chained entries of (journal, ord, ts, event, detail)."""

    def fold(key, held, row):
        seq, prev = held or [0, ""]
        mark = chained(prev, seq + 1, row["ts"], row["event"], row["detail"])
        return [seq + 1, mark], [(key[0], seq + 1, row["ts"], row["event"], row["detail"], prev, mark)]

    return fold_stream(rows, ["journal"], ["ord"], fold, "journal string, seq long, ts string, event string, detail string, prev string, hash string")
