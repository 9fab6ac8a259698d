"""URL filters: explicit rules, and association rules mined from labelled URLs."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncframe.llm.common import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for a URL without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens: labels of the host cut at hyphens, segments of the path without their endings, endings, and
    names of query parameters.  Numbers are left out: they name one page."""
    host, path = url_parts(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pieces = lambda text, pattern, mark: F.transform(
        F.filter(F.split(text, pattern), lambda x: (F.length(x) > 0) & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit(mark), x)
    )
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})/?$", 1)
    return F.array_sort(F.array_distinct(F.concat(
        pieces(host, r"[.-]", "h:"), pieces(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}/?$", ""), "/", "p:"),
        pieces(ending, "/", "e:"), pieces(F.regexp_replace(query, "=[^&]*", ""), "&", "q:"),
    )))


def least_share(hits: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound, ``z`` deviations wide, of the share that ``hits`` of ``n`` rows show."""
    share, zz = hits / n, z * z
    return (share + zz / (2 * n) - z * F.sqrt(share * (1 - share) / n + zz / (4 * n * n))) / (1 + zz / n)


def _holding(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``sets`` (tokens and more) beside each rule (rule, index_token) whose tokens they all hold: an inverted index
    in which a rule stands under its rarest token."""
    listed = sets.withColumn("_token", F.explode("tokens"))
    return listed.join(rules, F.col("_token") == F.col("index_token")).where(F.size(F.array_except("rule", "tokens")) == 0).drop("_token")


#: Copies of a token set that one row of the miner's input may stand for before they are dealt out.
COPIES = 4096


def mine_rules(labelled: DataFrame, work: Workspace, min_rows: int, min_confidence: float, z: float, min_support: float = 1e-5) -> DataFrame:
    """Rules (rule, index_token, confidence, lift, support) that conclude ``block``, from rows of ``tokens`` and ``bad``.

    FP-growth mines the token sets of ``min_rows`` bad rows or of a share of ``min_support`` of them, whichever are more, of any
    size; so what its driver holds is at most a row's tokens / ``min_support`` of them.  Equal token sets are counted
    first and dealt to the miner in blocks of ``COPIES``.  Tokens of all rows say nothing, and of tokens
    that always occur together the first stands for all, so neither multiplies the sets.  A set is a rule if
    its share of bad rows among all labelled rows is at least ``min_confidence`` by Wilson's bound and above the overall
    share; rules whose tokens include those of a rule at least as confident are pruned."""
    baskets = labelled.where(F.col("bad").isNotNull() & (F.size("tokens") > 0)).groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("hits"))
    baskets = work.save(baskets, "baskets")
    rows, hits = baskets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("hits"), F.lit(0))).first()
    single = baskets.select("n", "hits", F.xxhash64("tokens").alias("of"), F.explode("tokens").alias("token")).groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum(F.col("of").cast("decimal(38,0)")).alias("where"),
    )
    single = work.save(single, "single")
    least = max(min_rows, math.ceil(min_support * hits))
    often = single.where((F.col("hits") >= least) & (F.col("n") < rows)).groupBy("n", "hits", "where").agg(F.min("token").alias("token")).select("token")
    bad = baskets.where("hits > 0").select("tokens", "hits", F.explode("tokens").alias("token")).join(often, "token")
    bad = bad.groupBy("tokens", "hits").agg(F.collect_list("token").alias("items"))
    bad = bad.withColumn("block", F.explode(F.expr(f"sequence(0, (hits - 1) div {COPIES})"))).repartition(int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bad = work.save(bad.select(F.explode(F.expr(f"array_repeat(items, cast(least({COPIES}, hits - {COPIES} * block) as int))")).alias("items")), "bad")
    mined = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(bad.count(), least)), minConfidence=1.0).fit(bad).freqItemsets
    mined = mined.where(F.col("freq") >= least).select(F.array_sort("items").alias("rule"), F.col("freq").alias("hits"))
    rarest = single.select(F.col("token").alias("_token"), F.col("n").alias("_n"))
    indexed = mined.withColumn("_token", F.explode("rule")).join(rarest, "_token").groupBy("rule", "hits").agg(F.min_by("_token", F.struct("_n", "_token")).alias("index_token"))
    indexed = work.save(indexed, "itemsets")
    counted = _holding(baskets.select("tokens", "n"), indexed).groupBy("rule", "hits", "index_token").agg(F.sum("n").alias("n"))
    confidence = F.col("hits") / F.col("n")
    good = counted.where(least_share(F.col("hits"), F.col("n"), z) >= min_confidence).select(
        "rule", "index_token", confidence.alias("confidence"), (confidence * rows / F.lit(max(hits, 1))).alias("lift"), (F.col("hits") / F.lit(max(rows, 1))).alias("support"), "hits",
    ).where(F.col("lift") > 1)
    good = work.save(good, "good")
    wide = good.select(F.col("rule").alias("tokens"), F.col("confidence").alias("_confidence"))
    covered = _holding(wide, good).where((F.size("rule") < F.size("tokens")) & (F.col("confidence") >= F.col("_confidence"))).select(F.col("tokens").alias("rule"))
    return good.join(covered.distinct(), "rule", "left_anti")


def list_verdict(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the given rules that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, where in sorted(rules, key=lambda r: len(r[1])):
        on, _, under = where.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith("/" + under)
        rule, verdict = F.when(fits, where).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def url_filter(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
    min_rows: int = 10, min_confidence: float = 0.6, z: float = 3.0,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined (true if an association rule matched).

    ``rules`` are (verdict, host and path); a rule fits its host, all subdomains and paths that start
    with its path, and the longest fitting rule decides.  Other pages are blocked if a mined rule
    matches.  Rules are mined by FP-growth from the tokens of the URLs in ``labels`` (url, bad), kept if ``min_rows`` bad
    rows or more hold them, at any size of the table, and the share of bad rows is ``min_confidence`` or more with
    ``z`` deviations to spare, and matched by an inverted index: each rule stands
    under its rarest token, distinct token sets meet the rules there, and a meeting counts if the set
    holds all tokens of the rule.  Neither side is broadcast by a hint; the join back to the pages stands between written
    tables, so that Spark can split a token set that many pages have.

    A null URL or one without ``://`` has an empty host and path, no tokens and the verdict allow; null
    labels are left out; repeated pages are judged alike; URLs of any length are read whole; of rules of the same length
    that fit the last given one decides.  Without labelled rows no rule is mined; an empty table gives an empty result;
    other columns of any name are ignored."""
    work = Workspace(pages.sparkSession)
    host, path = url_parts(F.col(url_col))
    read = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), url_tokens(F.coalesce(F.col(url_col), F.lit(""))).alias("tokens"))
    known = labels.select(url_tokens(F.coalesce(F.col("url"), F.lit(""))).alias("tokens"), F.col("bad").cast("boolean").alias("bad"))
    mined = work.save(mine_rules(known, work, min_rows, min_confidence, z), "rules")
    key = F.array_join("tokens", "\n")
    matched = _holding(read.select("tokens").distinct(), mined.select("rule", "index_token")).select(key.alias("_key")).distinct()
    matched = work.save(matched.withColumn("_mined", F.lit(True)), "matched")
    rule, verdict = list_verdict(F.col("host"), F.col("path"), rules)
    mined_here = F.coalesce(F.col("_mined"), F.lit(False))
    return read.withColumn("_key", key).join(matched, "_key", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(mined_here, "block").otherwise("allow")).alias("verdict"), mined_here.alias("mined"),
    )
