"""The registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syncframe.llm.centroid_clustering import centroid_clusters
from syncframe.llm.common import Workspace
from syncframe.llm.exact_dedup import exact_dedup
from syncframe.llm.line_dedup import line_dedup
from syncframe.llm.mixing import curriculum_mix
from syncframe.llm.ngram_join import ngram_jaccard_join
from syncframe.llm.packing import pack_documents
from syncframe.llm.prefix_trie import conversation_trie
from syncframe.llm.quality_classifier import quality_scores
from syncframe.llm.quality_rules import NAVIGATION, PHRASES, SIGN_IN, line_first_rules
from syncframe.llm.sharding import shard_documents
from syncframe.llm.suffix_dedup import suffix_dedup
from syncframe.llm.url_filters import list_verdict, url_filter, url_parts
from syncframe.llm.warc import archive_pages, page_of, read_warc

URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    cleaned = line_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "removed_chars", F.sha2("cleaned_text", 256).alias("kept_sha256"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark, sf_dir):
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer's file is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op5_quality_classifier(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark, sf_dir):
    shards = shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark, sf_dir):
    return curriculum_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "repeats", "position")


def op8_quality_rules(spark, sf_dir):
    return line_first_rules(table(spark, sf_dir, "documents")).drop("cleaned_text")


def labelled_urls(spark, sf_dir) -> DataFrame:
    """What the tables say of URLs: those that a given rule decides are bad if it blocks them; others are bad or good as the
    labelled document is that their path names; of the rest nothing is known, and nothing is learnt from them."""
    pages = table(spark, sf_dir, "pages").select("url")
    host, path = url_parts(F.col("url"))
    named = pages.select("url", list_verdict(host, path, URL_RULES)[1].alias("verdict"), F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("_bad"))
    bad = F.coalesce(F.col("verdict") == "block", F.col("_bad"))
    return named.join(labels, "doc_id", "left").select("url", bad.alias("bad")).where("bad is not null")


def op9_url_filters(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"), labelled_urls(spark, sf_dir), URL_RULES)


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("removed")


def op11_warc(spark, sf_dir):
    """The pages' records as read back; the archives are gone once they are read."""
    work = Workspace(spark)
    records = read_warc(archive_pages(table(spark, sf_dir, "pages"), work))
    page = lambda c: page_of(F.col(c)).cast("long")
    sound = F.when(F.col("problem").isNull(), F.col("type")).otherwise(F.raise_error(F.concat("archive", F.lit(": "), "problem")))
    found = work.save(
        records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), page("refers_to").alias("refers_to"), "uri", "block_bytes"), "records"
    )
    work.drop("warc", "winners", "archives")
    return found.drop("uri", "block_bytes")


def op12_centroid_clustering(spark, sf_dir):
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator, and the pipeline."""
    return {
        f.__name__: f
        for f in (
            op1_line_dedup, op2_exact_dedup, op3_ngram_join, op4_packing, op5_quality_classifier, op6_sharding,
            op7_mixing, op8_quality_rules, op9_url_filters, op10_suffix_dedup, op11_warc, op12_centroid_clustering, op13_prefix_trie, pipeline,
        )
    }


OP2 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, 3 * source_size / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - (sum(3 * source_size) OVER o - 3 * source_size))
             / sum(weight) OVER (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM r WINDOW o AS (ORDER BY ratio, source NULLS FIRST)),
t AS (SELECT source, source_size, 0.5::DOUBLE * (weight - 2) AS a, least((3 * source_size)::DOUBLE,
             (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)::DOUBLE * weight) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, t.a,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS begins,
             least(coalesce(floor(t.target / nullif(t.source_size, 0)), 0), 3)::BIGINT AS passes
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, (passes + CASE WHEN begins + size / 2 < target - passes * source_size THEN 1 ELSE 0 END)::INT AS repeats FROM p)
SELECT doc_id, size, source_size, target, (size * repeats)::BIGINT AS taken, repeats,
       CASE WHEN repeats > 0 AND target > 0 THEN CASE WHEN a = 0 THEN least(begins / target, 1)
            ELSE (sqrt((1 - a) * (1 - a) + 4 * a * least(begins / target, 1)) - (1 - a)) / (2 * a) END END AS position
FROM q"""

OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
f AS (SELECT *, list_filter(ls, lambda x: NOT regexp_matches(x, '[.!?:;…。！？][''"”’»)\]]*[\x20\x09-\x0D]*$')
             OR regexp_matches(x, '@NAVIGATION@')
             OR regexp_matches(lower(x), '@SIGN_IN@') OR @STOCK@
             OR 100 * len(regexp_extract_all(x, '[#*$%&|<>]')) > 10 * length(x)) AS bad FROM e),
v AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4] AS win
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM e)),
u AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM v) WHERE n > 1),
c AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n
      FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM u) GROUP BY doc_id),
b AS (SELECT f.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, len(bad)::BIGINT AS n_failed_lines,
             coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0)::BIGINT AS chars,
             coalesce(list_sum(list_transform(bad, lambda x: length(x))), 0)::BIGINT AS lost_chars
      FROM f LEFT JOIN c ON f.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= 50 * chars AS kept,
       n_lines, n_failed_lines, lost_chars
FROM b"""


def _op8() -> str:
    stock = " OR ".join("contains(lower(x), '{}')".format(p.replace("'", "''")) for p in PHRASES)
    return OP8.replace("@NAVIGATION@", NAVIGATION).replace("@SIGN_IN@", SIGN_IN).replace("@STOCK@", stock)


OP11 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT DISTINCT h, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest FROM p),
k AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM k JOIN d ON k.h = d.h"""


def _op12(rounds: int = 10) -> str:
    """Vectors as rows, distances as sums of squares, a pair of tables for each round."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT"
    nearest = f"SELECT row, vec_id, v.q, arg_min(k, ({distance}, k)) AS k, min({distance}) AS distance FROM v, c{{n}} c GROUP BY row, vec_id, v.q"
    text = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS k, q FROM v ORDER BY k LIMIT 8)"""
    for n in range(rounds):
        text += f""",
a{n} AS MATERIALIZED ({nearest.format(n=n)}),
m{n} AS (SELECT k, i, floor(sum(q[i])::DECIMAL(38, 0) / count(*))::BIGINT AS x FROM a{n}, range(1, 65) r(i) GROUP BY k, i),
c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(any_value(u.q), any_value(c.q)) AS q FROM c{n} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS q FROM m{n} GROUP BY k) u ON c.k = u.k GROUP BY c.k)"""
    return text + f""",
a AS MATERIALIZED ({nearest.format(n=rounds)})
SELECT a.vec_id, a.k::INT AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a JOIN c{rounds} c ON a.k = c.k"""


#: DuckDB has no CRC-32: eight steps for each byte.  Subtrees are found by comparing prefixes.
OP13 = r"""
WITH t AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
            sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i,
            struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS turn FROM conversations WHERE conv_id IS NOT NULL),
k AS MATERIALIZED (SELECT c, c - c % 20 AS b, (xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
            lambda s, d: list_reduce(list_prepend(xor(s, d), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda u, z: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END))) % 4)::BIGINT AS h
      FROM (SELECT DISTINCT c FROM t)),
l AS MATERIALIZED (SELECT c, list(turn ORDER BY i) AS turns FROM t GROUP BY c),
r AS MATERIALIZED (SELECT k.c, list_concat(coalesce(o.turns, [])[1:h], l.turns[h + 1:]) AS p FROM k JOIN l ON l.c = k.c LEFT JOIN l o ON o.c = k.b),
m AS MATERIALIZED (SELECT c, d, p[1:d] AS p, len(p) = d AS ends FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT min(c) AS conv_id, d AS depth, p, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
      (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].x, '[^ 	-
]+')) END AS saved FROM m GROUP BY d, p),
e AS (SELECT p.conv_id, p.depth, count(*) AS n FROM n JOIN n p ON p.depth = n.depth - 1 AND p.p = n.p[1:n.depth - 1] GROUP BY ALL),
w AS MATERIALIZED (SELECT n.*, coalesce(e.n, 0) AS n_children FROM n LEFT JOIN e ON e.conv_id = n.conv_id AND e.depth = n.depth)
SELECT a.conv_id, a.depth::BIGINT AS depth, (SELECT conv_id FROM n WHERE n.depth = a.depth - 1 AND n.p = a.p[1:a.depth - 1]) AS parent_conv_id, a.n_convs, a.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, a.ends_sha256
FROM w a JOIN (SELECT a.conv_id, a.depth, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(b.saved) AS saved
               FROM (SELECT w.conv_id, w.depth, w.n_children, w.saved, u.depth AS at, w.p[1:u.depth] AS up FROM w, (SELECT DISTINCT depth FROM w) u WHERE u.depth <= w.depth) b
               JOIN w a ON a.depth = b.at AND a.p = b.up GROUP BY ALL) s ON s.conv_id = a.conv_id AND s.depth = a.depth"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2, "op7_mixing": OP7, "op8_quality_rules": _op8(), "op11_warc": OP11, "op12_centroid_clustering": _op12(), "op13_prefix_trie": OP13}
