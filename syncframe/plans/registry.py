"""Queries with their SQL counterparts, and the views over the test tables that both read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: View name: (SQL, what it reads).  BYTES(x) is the UTF-8 encoding of x in either dialect.
VIEWS: dict[str, tuple[str, list[str]]] = {
    "src_files": (
        """SELECT doc_id AS id, concat(source, '/', lang, '/d', doc_id, '.txt') AS path, 'file' AS kind, BYTES(text) AS content,
        CAST(octet_length(BYTES(text)) AS BIGINT) AS size, 1700000000000000000 + doc_id * 1000000000 + doc_id % 1000 AS mtime_ns,
        CAST(CASE doc_id % 4 WHEN 0 THEN 2541 WHEN 1 THEN 420 WHEN 2 THEN 1005 ELSE 0 END AS INT) AS mode, source, lang FROM {documents}""",
        ["documents"],
    ),
    "dst_files": (
        """SELECT id, path, kind, BYTES(text) AS content, CAST(octet_length(BYTES(text)) AS BIGINT) AS size, mtime_ns, mode FROM (
          SELECT doc_id AS id, concat(source, '/', lang, '/d', doc_id, '.txt') AS path, 'file' AS kind,
                 CASE WHEN doc_id % 5 = 1 THEN concat('#', substring(text, 2)) ELSE text END AS text,
                 1700000000000000000 + doc_id * 1000000000 + doc_id % 1000 + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS mtime_ns,
                 CAST(420 AS INT) AS mode FROM {documents} WHERE doc_id % 10 <> 0
          UNION ALL
          SELECT -doc_id - 1, concat('stale/d', doc_id, '.txt'), 'file', 'stale', 1600000000000000000, CAST(420 AS INT) FROM {documents} WHERE doc_id % 11 = 0) t""",
        ["documents"],
    ),
    "big_files": (
        """SELECT concat(l_orderkey, '/', l_linenumber) AS path, CAST(max(round(l_extendedprice * 100)) AS BIGINT) * 400 AS size,
        min(l_suppkey) AS volume FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
        ["lineitem"],
    ),
    "linked": (
        """SELECT p_partkey AS id, concat(p_type, '/', p_brand, '/', p_partkey) AS path, 'file' AS kind, CAST(p_size AS BIGINT) AS dev,
        CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE length(p_name) END AS BIGINT) AS ino, CAST(round(p_retailprice * 100) AS BIGINT) AS size FROM {part}""",
        ["part"],
    ),
    "tree": (
        """SELECT p_partkey AS id, concat(p_type, '/', p_brand, '/', replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN '/' ELSE '-' END), p_partkey) AS path,
        CASE p_partkey % 10 WHEN 0 THEN 'dir' WHEN 1 THEN 'symlink' WHEN 2 THEN 'fifo' WHEN 3 THEN 'socket' WHEN 4 THEN 'blockdev' ELSE 'file' END AS kind,
        CAST(round(p_retailprice * 100) AS BIGINT) AS size, CAST(p_size % 3 AS BIGINT) AS dev FROM {part}""",
        ["part"],
    ),
    "holdings": (
        """SELECT DISTINCT concat('peer', l_suppkey) AS peer, CAST(l_partkey % 100 AS BIGINT) AS file_idx, CAST(l_linenumber AS BIGINT) AS chunk_idx
        FROM {lineitem} WHERE l_suppkey % 2 = l_linenumber % 2""",
        ["lineitem"],
    ),
    "spec_chunks": (
        """SELECT file_idx, chunk_idx, CAST((file_idx * 7 + chunk_idx) % 5 * 1000 + 500 AS BIGINT) AS len FROM
        (SELECT DISTINCT CAST(p_partkey % 110 AS BIGINT) AS file_idx FROM {part}) f CROSS JOIN
        (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS chunk_idx FROM {lineitem}) c""",
        ["part", "lineitem"],
    ),
    "transfer_events": (
        """SELECT event_id, ts, user_id AS session, concat('s', user_id, '/f', event_id % 7) AS path,
        CASE event_type WHEN 'click' THEN 'chunk' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'view' THEN 'active' ELSE 'skip' END AS kind,
        CAST(round(value * 1000) AS BIGINT) AS bytes FROM {events}""",
        ["events"],
    ),
    "announces": (
        "SELECT event_id, CAST(user_id % 10 AS BIGINT) AS room, concat('10.0.', user_id, ':', 9000 + user_id % 7) AS addr, user_id % 25 = 0 AS seed, ts AS seen, CAST(round(value) AS BIGINT) AS have FROM {events}",
        ["events"],
    ),
    "offers": ("SELECT event_id AS offer, user_id AS id, ts FROM {events} WHERE event_type = 'signup'", ["events"]),
    "takes": ("SELECT event_id AS take, user_id AS id, ts FROM {events} WHERE event_type = 'purchase'", ["events"]),
    "envelopes": (
        """SELECT CAST(o_custkey % 20 AS BIGINT) AS node, o_orderkey AS version, o_orderstatus <> 'P' AS sig_ok, o_orderpriority <> '5-LOW' AS key_ok,
        o_orderdate AS ts, concat('ep', o_custkey % 50) AS name, concat('10.1.', o_custkey % 250, ':7000') AS addr FROM {orders}""",
        ["orders"],
    ),
    "listing": (
        r"""SELECT page_id AS id, url, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, page_id % 6 = 0 AS is_dir,
        CAST(length(html) AS BIGINT) AS size FROM {pages}""",
        ["pages"],
    ),
    "sessions_log": ("SELECT conv_id AS session, turn, role AS event, CAST(length(text) AS BIGINT) AS bytes FROM {conversations}", ["conversations"]),
}


def _encoded(sql: str, how: str) -> str:
    return re.sub(r"BYTES\((.*?)\)", how, sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = VIEWS[name]
    return spark.sql(_encoded(sql, r"encode(\1, 'UTF-8')"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def with_views(sql: str) -> str:
    """The DuckDB statement with the views that it names in front."""
    ctes = []
    for name, (body, tables) in VIEWS.items():
        if re.search(rf"\b{name}\b", sql):
            for t in tables:
                body = body.replace(f"{{{t}}}", t)
            ctes.append(f"{name} AS ({_encoded(body, r'encode(\1)')})")
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if not ctes:
        return sql
    if own:
        return f"WITH {own[1] or ''}" + ",\n".join(ctes) + ",\n" + sql[own.end() :]
    return "WITH " + ",\n".join(ctes) + "\n" + sql


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of views: its parameters name the views it takes."""

    def add(f):
        parameters = f.__code__.co_varnames[: f.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[view(spark, sf_dir, p) if p in VIEWS else spark.read.parquet(f"{sf_dir}/{p}.parquet") for p in parameters])

        key = name or f.__name__
        QUERIES[key] = run
        if sql:
            ORACLES[key] = with_views(sql)
        return f

    return add
