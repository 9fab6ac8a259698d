"""Near-duplicate join on word shingles with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncframe.llm.arrow import record_batch, texts_of
from syncframe.llm.common import Workspace, order_key, rank_within, text_of
from syncframe.llm.components import connected_components
from syncframe.llm.shingles import set_key, shingle_sets

#: The similarity that links, as whole numbers: 5 * intersection >= 4 * union.
TOP, BOTTOM = 4, 5
#: The most prefix tokens that a document may ask for.
MOST = 4
#: ``required`` of a column n.
REQUIRED = f"(({TOP} * n + {BOTTOM - 1}) div {BOTTOM})"


def required(n: int) -> int:
    """Tokens that a document of n tokens shares at least with any document it links to."""
    return -(-TOP * n // BOTTOM)


def _matches(extra: float, n):
    """Matches that the first look asks of a document of n tokens, for numbers and for columns."""
    return F.greatest(F.lit(1), F.floor(F.lit(extra) * n)) if isinstance(n, Column) else max(1, int(extra * n))


def _sets_table(extra: float):
    """(doc_id, n, k1, k2, prefix): each set's size, 128 bits that stand for it, and its least hashes: the prefix that shares
    ``_matches`` tokens with any set it links to."""

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("prefix", pa.list_(pa.int64()))]
        for batch in batches:
            sets = shingle_sets(texts_of(batch["text"]))
            keys = [set_key(s) for s in sets]
            prefixes = [s[: len(s) - required(len(s)) + _matches(extra, len(s))].view(np.int64) for s in sets]
            yield record_batch(pa.schema(kinds), [batch["doc_id"], [len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys], prefixes])

    return emit


def _tokens_table(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    for batch in batches:
        sets = shingle_sets(texts_of(batch["text"]))
        yield record_batch(schema, [batch["doc_id"], [len(s) for s in sets], [s.view(np.int64) for s in sets]])


def _repeated(lists: DataFrame) -> DataFrame:
    """(token, df) of the tokens that stand in two lists or more."""
    return lists.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")


def _likely(work: Workspace, lists: DataFrame, extra: float) -> DataFrame:
    """doc_id of documents whose prefixes (``tokens``) hold enough tokens that another prefix has too.

    A partner of a document of n tokens has at least required(n), and the two share as many tokens of their prefixes as
    the one of fewer matches asks for."""
    repeated = work.save(_repeated(lists).select("token"), "repeated")
    hits = lists.select("doc_id", "n", F.explode("tokens").alias("token")).join(repeated, "token", "left_semi").groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("hits"))
    return work.save(hits.where(F.col("hits") >= _matches(extra, F.expr(REQUIRED))).select("doc_id"), "likely")


def prefix_length(spare: int, need: int, alone: int, often: np.ndarray, check: float = 20.0) -> int:
    """How many shared prefix tokens a document asks for: the number at which the estimated cost of reading its prefix
    tokens' lists and of checking the documents that reach that number is least.  A link takes ``need`` of its tokens and
    leaves ``spare`` at most; ``alone`` of them are in no other document, ``often`` has the lengths of the others' lists in
    rising order.  A document that needs none of these tokens asks for the most, so that its partner decides."""
    if need < 1:
        return MOST
    best, asked = None, 1
    for ell in range(1, min(MOST, need) + 1):
        read = float(often[: max(spare + ell - alone, 0)].sum())
        cost = read + check * read / ell
        if best is None or cost < best:
            best, asked = cost, ell
    return asked


def _prefixes(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, inside, asked, alone, tokens) of (keys, n, inside, shared): the part of each document's prefix that other
    documents have too, in the order (number of documents, hash); ``alone`` tokens stand before it.  ``inside`` of the
    document's tokens are left out of the lists, as all documents of a list may have them."""
    whole = (*keys, "n", "inside")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((k, pa.int64()) for k in whole), ("asked", pa.int32()), ("alone", pa.int32()), ("tokens", pa.list_(pa.int64()))])
        for batch in batches:
            out = []
            for *key, n, inside, shared in zip(*(batch[k].to_pylist() for k in whole), batch["shared"], strict=True):
                often, token = (shared.values.field(k).to_numpy() for k in range(2))
                order = np.lexsort((token, often))
                spare, alone = n - required(n), n - inside - len(order)
                asked = prefix_length(spare, required(n) - inside, alone, often[order])
                out.append((*key, n, inside, asked, alone, token[order[: max(spare + asked - alone, 0)]]))
            yield record_batch(schema, zip(*out, strict=True) if out else [[]] * len(schema))

    fields = ", ".join(f"{k} long" for k in whole)
    return rows.select(*whole, "shared").mapInArrow(cut, f"{fields}, asked int, alone int, tokens array<long>")


#: The least number of matches whose prefix has the token at ``pos`` behind ``alone`` others.
FROM_MATCH = f"greatest(alone + pos - (n - {REQUIRED}) + 1, 1)"


def _lists(work: Workspace, prefixes: DataFrame) -> DataFrame:
    """(token, low, doc_id, n, class, asked, from_match, hub, hub_n): postings of tokens that two documents of like sizes share.

    Sizes fall into classes of one power of 5/4 each, and documents that link lie in the same or in neighbouring classes. So
    a token has a list for each two neighbours, named by the lower one, and a document stands in two of them.  The
    hub is the document of smallest id in a list, since originals come before their copies.  ``from_match`` is the least number of
    matches whose prefix has the token."""
    rows = prefixes.select("doc_id", "n", "asked", "alone", F.posexplode("tokens").alias("pos", "token"))
    size_class = F.floor(F.log("n") / F.log(F.lit(BOTTOM / TOP)) + 1e-9)
    rows = rows.select("token", "doc_id", "n", size_class.alias("class"), "asked", F.expr(FROM_MATCH).alias("from_match"))
    rows = work.save(rows.withColumn("low", F.explode(F.array(F.col("class") - 1, F.col("class")))), "postings", batch_rows=10_000)
    heads = rows.groupBy("token", "low").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"), F.min_by("n", "doc_id").alias("hub_n")).where("hub <> last")
    return rows.join(work.save(heads.drop("last"), "heads"), ["token", "low"])


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")


def _pairs_of_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    left, right = texts_of(batch["text_a"]), texts_of(batch["text_b"])
    distinct = list(dict.fromkeys([*left, *right]))
    sets = dict(zip(distinct, shingle_sets(distinct), strict=True))
    for a, b, x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), left, right, strict=True):
        yield a, b, sets[x], sets[y]


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose whole shingle sets reach the similarity."""

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            found = []
            for a, b, s, t in _pairs_of_sets(batch):
                if BOTTOM * min(len(s), len(t)) >= TOP * max(len(s), len(t)):
                    shared = len(np.intersect1d(s, t, assume_unique=True))
                    if BOTTOM * shared >= TOP * (len(s) + len(t) - shared):
                        found.append((a, b))
            yield record_batch(schema, zip(*found, strict=True) if found else [[], []])

    return _with_texts(pairs, texts).mapInArrow(check, "a long, b long").distinct()


def _beyond_hub(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, doc_id, n, inside, beyond, within) of pairs (a = hub, b = document): how much of the document the hub has,
    the shingles that the hub has not, and, if the hub has at least what a link takes, as many of those within, by
    hash, as a link needs that rests on them alone."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("hub", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("inside", pa.int64()), ("beyond", pa.list_(pa.int64())), ("within", pa.list_(pa.int64()))]
        for batch in batches:
            rows = []
            for a, b, s, t in _pairs_of_sets(batch):
                of_hub = np.isin(t, s, assume_unique=True)
                inside = int(of_hub.sum())
                within = t[of_hub][: max(inside - required(len(t)) + 1, 0)]
                rows.append((a, b, len(t), inside, t[~of_hub].view(np.int64), within.view(np.int64)))
            yield record_batch(pa.schema(kinds), zip(*rows, strict=True) if rows else [[]] * 6)

    fields = "hub long, doc_id long, n long, inside long, beyond array<long>, within array<long>"
    return _with_texts(members, texts).mapInArrow(split, fields)


#: Two documents of a list are looked at in the list of the lower of their classes only.
MEET = "x.token = y.token and x.low = y.low and x.low = least(x.class, y.class) and x.component < y.component"
NEAR = f"{BOTTOM} * least(x.n, y.n) >= {TOP} * greatest(x.n, y.n)"


def _crossing_short(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that share enough prefix tokens of short lists.  A pair whose documents
    both stand in long lists may share further tokens there and needs one."""
    asked = F.expr("if(x.in_long and y.in_long, 1, least(x.asked, y.asked))")
    return (
        lists.alias("x").join(lists.alias("y"), F.expr(f"{MEET} and {NEAR}"))
        .select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"), asked.alias("asked"), F.greatest("x.from_match", "y.from_match").alias("from_match"))
        .groupBy("a", "b").agg(F.max("asked").alias("asked"), F.count_if((F.col("from_match") <= F.col("asked")) | (F.col("asked") == 1)).alias("shared"))
        .where("shared >= asked").select("a", "b")
    )


def _enough(shared: str) -> Column:
    """Whether two documents that share so much at most can link."""
    return F.expr(f"{TOP + BOTTOM} * ({shared}) >= {TOP} * (x.n + y.n)")


def _neighbours(split: DataFrame, reach: int) -> DataFrame:
    """Pairs (a, b) of a hub's members (hub, doc_id, component, n, inside) in different components: each member and the ``reach``
    that follow it in a fixed pseudo-random order, if the sizes allow a link.

    Where many members of a hub lie in components of their own, a few of their links join most of them.  Only hubs of
    more than ``2 * reach`` members take part; pairs are at most ``reach`` for each member."""
    sizes = split.groupBy("hub").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 2 * reach)
    rows = split.select("hub", "doc_id", "component", "n", "inside").join(sizes, "hub").withColumn("order", order_key("doc_id"))
    ranked = rank_within(rows, ["hub"], "order", ["doc_id"], "place").drop("order", "members")
    ahead = ranked.withColumn("place", F.explode(F.sequence(F.col("place") + 1, F.col("place") + reach)))
    shared = "least(x.inside, y.inside) + least(x.n - x.inside, y.n - y.inside)"
    met = ahead.alias("x").join(ranked.alias("y"), F.expr(f"x.hub = y.hub and x.place = y.place and x.component <> y.component and {NEAR}"))
    return met.where(_enough(shared)).select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


#: What two profiles share beyond the hub at least, if they link, and how many matches they ask of each other.
NEED = f"(({TOP} * (x.n + y.n) + {TOP + BOTTOM - 1}) div {TOP + BOTTOM} - least(x.inside, y.inside))"
ASKED = f"least(x.asked, y.asked, {NEED})"


def _met_profiles(postings: DataFrame) -> DataFrame:
    """Pairs of postings x and y (hub, p1, p2, lo, hi, n, inside, asked, left, token) of the same token, one for each match of two
    profiles of a hub; ``left`` of the profile's tokens beyond the hub stand from this one on.

    The prefix is that of the pair: for a match it must hold the token on either side, and if two profiles share as many
    tokens as they need, they share ``ASKED`` of those behind which, with themselves, more than ``NEED - ASKED`` stand.  Two
    profiles that the hub alone may link need none: any token that they share counts."""
    once = "(x.p1 < y.p1 or (x.p1 = y.p1 and x.p2 <= y.p2)) and not (x.lo = x.hi and y.lo = y.hi and x.lo = y.lo)"
    met = postings.alias("x").join(postings.alias("y"), F.expr(f"x.hub = y.hub and x.token = y.token and {once} and {NEAR} and least(x.left, y.left) > {NEED} - {ASKED}"))
    return met.where(_enough("least(x.inside, y.inside) + least(x.n - x.inside, y.n - y.inside)"))


def _likely_profiles(postings: DataFrame) -> DataFrame:
    """(hub, xp1, xp2, yp1, yp2) of profiles that match as often as they ask."""
    sides = [F.col(f"{side}.{c}").alias(f"{side}{c}") for side in "xy" for c in ("p1", "p2")]
    counted = _met_profiles(postings).groupBy(F.col("x.hub").alias("hub"), *sides).agg(F.count(F.lit(1)).alias("matches"), F.first(F.expr(ASKED)).alias("asked"))
    return counted.where("matches >= asked").drop("matches", "asked")


def _crossing_long(work: Workspace, split: DataFrame) -> DataFrame:
    """Pairs (a, b) in different components that may link although they meet in long lists only.

    Two documents share at most the smaller of their two shares of the list's hub, and what they share beyond it.
    So they can only link if they share a shingle beyond the hub, or if what they share of the hub is enough for both
    sizes by itself.  The first kind meets by shingles beyond the hub: those that documents of other components have too
    are counted for each hub, and members of equal sizes that have the same of them are one profile.  Profiles meet by
    multi-match prefixes, which put the shingles of fewest documents first and are cut for each pair to what its sizes and its
    shares of the hub leave open, and those that meet are counted out before their members are paired.  The second kind meets by shingles within the hub, as many as a prefix of a document's
    share of the hub takes.  No pair is looked at that has no shingle in common."""
    def crossing(side: str) -> DataFrame:
        """Tokens that documents of two components or more have, with the number of their documents."""
        rows = split.select("hub", "doc_id", "component", "n", "inside", F.explode(side).alias("token"))
        mixed = rows.groupBy("hub", "token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("df")).where("lo < hi")
        return work.save(rows.join(work.save(mixed.select("hub", "token", "df"), f"{side}-mixed"), ["hub", "token"]), f"{side}-open")

    def meeting(rows: DataFrame) -> DataFrame:
        return rows.alias("x").join(rows.alias("y"), F.expr(f"x.hub = y.hub and x.token = y.token and x.component < y.component and {NEAR}"))

    # Members of a hub that have as much of it and the same shingles beyond it are one profile: profiles meet, not members.
    shared = crossing("beyond").groupBy("hub", "doc_id", "component", "n", "inside").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    marks = {f"p{k}": F.xxhash64("n", "inside", "shared", F.lit(k)) for k in (1, 2)}
    shared = work.save(shared.where(f"size(shared) >= {REQUIRED} - inside").withColumns(marks), "shared")
    members = shared.select("hub", "p1", "p2", "doc_id", "component")
    key = ["hub", "p1", "p2"]
    profiles = shared.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("n", "inside", "shared")], F.min("component").alias("lo"), F.max("component").alias("hi"))
    profiles = work.save(profiles, "profiles")
    keys = [*key, "lo", "hi"]
    beyond = work.save(_prefixes(profiles, *keys), "beyond-prefixes").select(*keys, "n", "inside", "asked", "alone", F.posexplode("tokens").alias("pos", "token"))
    beyond = work.save(beyond.select(*keys, "n", "inside", "asked", F.expr("n - inside - alone - pos").alias("left"), "token"), "beyond-postings")

    least = "least(x.inside, y.inside)"
    pair = F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")
    likely = _likely_profiles(beyond)
    # What two profiles share beyond the hub is counted whole.
    tokens = profiles.select(*key, "n", "inside", F.transform("shared", lambda t: t["token"]).alias("tokens"))
    for side in "xy":
        likely = likely.join(tokens.select("hub", *[F.col(c).alias(f"{side}{c}") for c in ("p1", "p2")], F.struct("n", "inside", "tokens").alias(side)), ["hub", f"{side}p1", f"{side}p2"])
    likely = likely.where(_enough(f"{least} + size(array_intersect(x.tokens, y.tokens))")).select("hub", *[f"{side}{c}" for side in "xy" for c in ("p1", "p2")])
    likely = work.save(likely, "likely-profiles")
    one = likely.alias("l").join(members.alias("x"), F.expr("l.hub = x.hub and l.xp1 = x.p1 and l.xp2 = x.p2")).select("l.hub", "yp1", "yp2", F.col("x.doc_id").alias("left"), F.col("x.component").alias("of"))
    by_beyond = one.alias("o").join(members.alias("y"), F.expr("o.hub = y.hub and o.yp1 = y.p1 and o.yp2 = y.p2 and o.of <> y.component"))
    by_beyond = by_beyond.select(F.least("o.left", "y.doc_id").alias("a"), F.greatest("o.left", "y.doc_id").alias("b")).distinct()
    return by_beyond.unionByName(meeting(crossing("within")).where(_enough(least)).select(*pair).distinct())


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: int = 16, extra: float = 0.05, reach: int = 32) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents link when their sets of distinct five-word shingles (words by white space, A-Z in lower
    case) have a Jaccard similarity of 0.8 or more; a component is what links reach, named by its
    smallest id.  Documents with equal sets are one node.

    Prefixes are multi-match: if a document asks for l matches, its prefix is l - 1 tokens longer than the shortest safe one,
    and two documents can only link if they share at least as many tokens of the prefixes for the smaller of
    their two numbers.  The first look takes prefixes in the order of hashes, longer by ``extra`` of the set, and counts
    exactly how many of their tokens other prefixes have: documents with too few link to none.  The sets of the others are
    counted whole, which orders their tokens by the number of documents; each document then lengthens its prefix by the
    estimated cost of its candidates, and those of which more than a fifth stands in no other document drop out.

    Candidates are checked on their whole sets in three rounds.  First each document of a token's list meets
    the list's hub, its smallest id, at one shared token, which is linear in the lists and already joins groups of copies.
    Lists that then lie in one component are done, so a group never meets itself pair by pair.  Second, where more than
    ``2 * reach`` members of a hub are left in several components, each meets the ``reach`` next to it in a random order.
    In lists that are open still documents of different components meet: directly in lists of up to ``short`` documents, and
    in longer ones only those that may link by what each shares with the hub and by what they share beyond
    it.  No component can be missed: a link is checked or within a component, and pairs that are
    left out cannot reach the similarity.

    Null and empty texts have no shingles and are alone; a text of one to four words has one shingle for
    its whole sequence; very long texts are hashed whole.  Repeated rows are the same node.  Rows with a null id get their own
    size and a null component.  An empty table gives an empty result; other columns of any name are ignored."""
    work = Workspace(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    sets = work.save(docs.mapInArrow(_sets_table(extra), "doc_id long, n long, k1 long, k2 long, prefix array<long>"), "sets")
    nodes = work.save(sets.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "nodes")
    own = nodes.select(F.col("node").alias("doc_id"))
    prefixes = sets.select("doc_id", "n", F.col("prefix").alias("tokens")).join(own.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    first = work.save(prefixes, "first")
    sets = work.save(sets.drop("prefix"), "sizes")
    work.drop("sets")
    likely = _likely(work, first, extra)
    work.drop("first", "repeated")
    # ids are as many as the corpus makes them: never broadcast
    texts = work.save(docs.join(likely.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    tokens = work.save(texts.mapInArrow(_tokens_table, "doc_id long, n long, tokens array<long>"), "tokens")
    repeated = work.save(_repeated(tokens), "repeated")
    shared = tokens.select("doc_id", "n", F.explode("tokens").alias("token")).join(repeated, "token")
    shared = shared.groupBy("doc_id", "n").agg(F.collect_list(F.struct("df", "token")).alias("shared")).where(f"size(shared) >= {REQUIRED}")
    prefixes = work.save(_prefixes(shared.withColumn("inside", F.lit(0).cast("long")), "doc_id"), "prefixes")
    lists = work.save(_lists(work, prefixes), "lists")
    work.drop("tokens", "repeated", "prefixes", "postings", "heads")

    near = f"{BOTTOM} * least(n, hub_n) >= {TOP} * greatest(n, hub_n)"
    to_hubs = lists.where("hub <> doc_id").where(near).select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct()
    to_hubs = work.save(to_hubs, "to-hubs")
    links = work.save(_similar(to_hubs, texts), "links")
    groups = connected_components(work, links, "first")

    placed = lists.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = work.save(placed, "placed")
    work.drop("lists")
    mixed = placed.groupBy("token", "low").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("length")).where("lo < hi")
    open_lists = work.save(placed.join(work.save(mixed.drop("lo", "hi"), "mixed"), ["token", "low"]), "open")
    work.drop("placed", "mixed")
    long_lists = open_lists.where(F.col("length") > short)
    members = long_lists.where("hub <> doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    split = work.save(_beyond_hub(members, texts), "split")
    component = work.save(open_lists.groupBy("doc_id").agg(F.first("component").alias("component")), "component")
    near_pairs = _neighbours(split.join(component, "doc_id"), reach).join(to_hubs, ["a", "b"], "left_anti")
    near_pairs = work.save(near_pairs, "near-pairs")
    if not near_pairs.isEmpty():
        links = work.save(links.unionByName(_similar(near_pairs, texts)), "near-links")
        to_hubs = work.save(to_hubs.unionByName(near_pairs), "met")
        groups = connected_components(work, links, "second").withColumnRenamed("node", "doc_id")
        component = component.drop("component").join(groups, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        component = work.save(component, "component-2")
    placed = open_lists.drop("component", "length").join(component, "doc_id")
    mixed = placed.groupBy("token", "low").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("length")).where("lo < hi")
    open_lists = work.save(placed.join(work.save(mixed.drop("lo", "hi"), "mixed-2"), ["token", "low"]), "open-2")
    long_lists = open_lists.where(F.col("length") > short)
    left = long_lists.where("hub <> doc_id").select("hub", "doc_id").distinct()
    split = split.join(left, ["hub", "doc_id"], "left_semi").join(component, "doc_id")
    in_long = long_lists.select("doc_id").distinct().withColumn("in_long", F.lit(True))
    short_lists = work.save(open_lists.where(F.col("length") <= short).join(in_long, "doc_id", "left").withColumn("in_long", F.coalesce("in_long", F.lit(False))), "short")
    crossing = _crossing_short(short_lists).unionByName(_crossing_long(work, split)).distinct()
    crossing = work.save(crossing.join(to_hubs, ["a", "b"], "left_anti"), "crossing")
    links = work.save(links.unionByName(_similar(crossing, texts)), "all-links")
    work.drop("texts", "open", "open-2", "mixed-2", "component", "component-2", "near-pairs", "near-links", "met", "short", "split", "beyond-mixed", "beyond-open", "shared", "profiles", "likely-profiles", "beyond-prefixes", "beyond-postings", "within-mixed", "within-open", "crossing", "to-hubs")
    groups = connected_components(work, links, "last")
    named = work.save(nodes.join(groups, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id")), "named")
    own = sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("doc_id")).alias("component_id"))
    return sets.where("n > 0 and doc_id is not null").join(named, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(own)
