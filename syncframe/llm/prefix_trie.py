"""The trie of conversation prefixes, rolled up by centroid decomposition of its parent edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncframe.llm.common import WORD, Workspace, text_of
from syncframe.operators.scans import running

#: Four sums of 32 random bits a turn name a prefix.
LANES = [f"s{i}" for i in range(4)]
EMPTY = hashlib.sha256(b"").hexdigest()


def ranked_turns(df: DataFrame, work: Workspace, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, idx, turn digest, words): turns from 0 in each conversation, by turn (null first), then role and text digest."""
    role = text_of(role_col)
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text_of(text_col)), 256)
    turns = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("words"),
    )
    placed = running(turns, ["conv"], ["turn", "role", "digest"], {"idx": F.lit(1).cast("long")}, save=lambda x: work.save(x, "turns"))
    return work.save(placed.select("conv", (F.col("idx") - 1).alias("idx"), "digest", "words"), "ranked")


def taken_over(conv: Column, most: int) -> Column:
    """How many turns a conversation takes from its base."""
    return F.crc32(conv.cast("string").cast("binary")) % most


def rebuilt_paths(ranked: DataFrame, convs: DataFrame, work: Workspace, most: int) -> DataFrame:
    """(conv, depth, words, lanes of the prefix, lanes of the parent's): each conversation with the first turns of its base in
    place of its own.  ``convs`` is (conv, base, h)."""
    heads = ranked.where(F.col("idx") < most).select(F.col("conv").alias("base"), "idx", "digest", "words")
    given = convs.where("h > 0").join(heads, "base").where("idx < h").select("conv", F.col("idx").alias("at"), "digest", "words")
    first = taken_over(F.col("conv"), most)
    own = ranked.where(F.col("idx") >= first)
    have = given.groupBy("conv").agg(F.count(F.lit(1)).alias("given"))
    kept = own.join(work.save(have, "given"), "conv", "left")
    kept = kept.select("conv", (F.col("idx") - first + F.coalesce("given", F.lit(0))).alias("at"), "digest", "words")
    bits = [F.xxhash64("at", "digest", F.lit(k)) for k in (1, 2)]
    mask = F.lit((1 << 32) - 1).cast("long")
    terms = [half for b in bits for half in (F.shiftrightunsigned(b, 32), b.bitwiseAND(mask))]
    rows = given.unionByName(kept).withColumns({f"t{i}": t for i, t in enumerate(terms)}).select("conv", "at", "words", *[f"t{i}" for i in range(4)])
    summed = running(rows, ["conv"], ["at"], {s: F.col(f"t{i}") for i, s in enumerate(LANES)}, save=lambda x: work.save(x, "terms"))
    before = [(F.col(s) - F.col(f"t{i}")).alias(f"p{i}") for i, s in enumerate(LANES)]
    return work.save(summed.select("conv", (F.col("at") + 1).cast("long").alias("depth"), "words", *LANES, *before), "prefixes")


def local_rollup(parent: list[int], values: np.ndarray) -> np.ndarray:
    """Subtree sums of one component by centroid decomposition.  ``parent[i] < i``, and -1 for the top, which is node 0.

    The centroid of a piece is the deepest node below which half of it or more lies.  What lies below it in the piece is totalled,
    the total is added along the path from above the centroid to the piece's top, and the pieces that are left when the
    centroid goes are decomposed in turn."""
    n = len(parent)
    size, below = [1] * n, [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        size[parent[i]] += size[i]
        below[parent[i]].append(i)
    cut, out, open_tops = [False] * n, np.zeros_like(values), [0]
    while open_tops:
        top = open_tops.pop()
        c, half = top, size[top]
        while (heavy := next((x for x in below[c] if not cut[x] and 2 * size[x] >= half), None)) is not None:
            c = heavy
        piece, walk = [c], 0
        while walk < len(piece):
            piece += [x for x in below[piece[walk]] if not cut[x]]
            walk += 1
        total = values[piece].sum(axis=0)
        out[c] += total
        gone, at = size[c], c
        while at != top:
            at = parent[at]
            out[at] += total
            size[at] -= gone
        open_tops += [x for x in below[c] if not cut[x]]
        cut[c] = True
        if c != top:
            open_tops.append(top)
    return out


def _solve_small(rows: DataFrame, names: list[str]) -> DataFrame:
    """(conv, depth, sums) of components that a task can hold: rows (top_conv, top_depth, depth, conv, parent_conv, carried sums,
    own values), each component as a whole in one task."""
    schema = "conv long, depth long, " + ", ".join(f"{n} long" for n in names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(block: np.ndarray) -> np.ndarray:
            at = {(int(c), int(d)): i for i, (d, c) in enumerate(block[:, 2:4])}
            parent = [-1, *(at[int(p), int(d) - 1] for p, d in zip(block[1:, 4], block[1:, 2], strict=True))]
            k = 5 + len(names)
            return np.column_stack([block[:, 3], block[:, 2], local_rollup(parent, block[:, k:]) + block[:, 5:k]])

        def emit(blocks: list[np.ndarray]) -> pa.RecordBatch:
            out = np.concatenate(blocks)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, i])) for i in range(out.shape[1])], names=["conv", "depth", *names])

        for batch in batches:
            new = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows = np.concatenate([*held, new]) if held else new
            tops = rows[:, :2]
            starts = np.flatnonzero(np.r_[True, (tops[1:] != tops[:-1]).any(axis=1)]) if len(rows) else []
            if len(starts) > 1:
                yield emit([done(rows[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)])
                rows = rows[starts[-1] :]
            held = [rows]
        if held and len(held[0]):
            yield emit([done(held[0])])

    carried = [f"carried_{n}" for n in names]
    ready = rows.withColumn("up", F.coalesce("parent_conv", F.lit(-1).cast("long"))).select("top_conv", "top_depth", "depth", "conv", "up", *carried, *names)
    return ready.repartition("top_conv", "top_depth").sortWithinPartitions("top_conv", "top_depth", "depth", "conv").mapInArrow(solve, schema)


def centroid_rollup(nodes: DataFrame, paths: DataFrame, names: list[str], work: Workspace, local_nodes: int = 4096) -> DataFrame:
    """(conv, depth, sums): the sums of ``names`` over each node's subtree, the node included.

    ``nodes`` is (conv, depth, parent_conv, size, values): a node is named by its smallest member and its depth, and ``size``
    counts the nodes below and including it.  ``paths`` is (conv, depth, owner, above): the name of the node at each depth of
    the path of every conversation that names a node, and of the node above that.

    In each round every component of more than ``local_nodes`` nodes loses its centroid, the deepest node below which half of
    it or more lies.  Components' totals are aggregated, added to the nodes on the path from the centroid to the component's top,
    and what is left falls into the parts under the centroid's children and the part above, each at most half as large or
    without the centroid's subtree; so there are as many rounds as the logarithm of the number of nodes, however
    deep or wide the tree is.  Smaller components are finished in the same way by tasks that hold them whole."""
    carried = [f"carried_{n}" for n in names]
    open_ = _with_root(nodes, names, carried)
    solved: list[DataFrame] = []
    small: list[DataFrame] = []
    step = 0
    while True:
        level = work.save(open_, f"open-{step}")
        if step:
            work.drop(f"open-{step - 1}")
        held = work.save(level.where(F.col("n") <= local_nodes).drop("n", "size"), f"small-{step}")
        small.append(held)
        large = level.where(F.col("n") > local_nodes)
        centroid = large.where("2 * size >= n").groupBy("top_conv", "top_depth").agg(F.min_by(F.struct("conv", "depth", "size"), "size").alias("c"))
        centroid = work.save(centroid.select("top_conv", "top_depth", F.col("c.conv").alias("c_conv"), F.col("c.depth").alias("c_depth"), F.col("c.size").alias("c_size")), f"centroid-{step}")
        if centroid.isEmpty():
            break
        top = ["top_conv", "top_depth"]
        # The node just below the centroid on a node's path; it is in the centroid's subtree if the node above that is the centroid.
        under = paths.select(F.col("conv").alias("u_conv"), F.col("depth").alias("u_depth"), "owner", "above")
        onward = paths.join(centroid, F.col("conv") == F.col("c_conv")).where("depth >= top_depth and depth < c_depth").select(*top, F.col("owner").alias("conv"), "depth", F.lit(True).alias("on_path"))
        rows = large.join(centroid, top)
        rows = rows.join(under, (F.col("conv") == F.col("u_conv")) & (F.col("u_depth") == F.col("c_depth") + 1) & (F.col("depth") > F.col("c_depth")), "left")
        rows = rows.join(onward, [*top, "conv", "depth"], "left")
        is_centroid = (F.col("conv") == F.col("c_conv")) & (F.col("depth") == F.col("c_depth"))
        inside = F.coalesce(F.col("above") == F.col("c_conv"), F.lit(False))
        rows = work.save(rows.withColumns({"is_c": is_centroid, "inside": inside, "on_path": F.coalesce("on_path", F.lit(False))}).drop("u_conv", "u_depth", "above"), f"marked-{step}")
        parts = rows.where("is_c or inside").withColumn("branch", F.when(F.col("inside"), F.col("owner")))
        totals = parts.groupBy(*top, "branch").agg(*[F.sum(n).alias(n) for n in names], F.count(F.lit(1)).alias("members"))
        totals = work.save(totals, f"totals-{step}")
        whole = work.save(totals.groupBy(*top).agg(*[F.sum(n).alias(f"d_{n}") for n in names]), f"whole-{step}")
        joined = rows.join(whole, top)
        solved.append(work.save(joined.where("is_c").select("conv", "depth", *[(F.col(c) + F.col(f"d_{n}")).alias(n) for n, c in zip(names, carried, strict=True)]), f"solved-{step}"))
        add = lambda n: F.when(F.col("on_path"), F.col(f"d_{n}")).otherwise(F.lit(0))
        upper = joined.where("not is_c and not inside").select(
            "conv", "depth", "parent_conv", (F.col("size") - F.when(F.col("on_path"), F.col("c_size")).otherwise(0)).alias("size"), *names,
            *[(F.col(c) + add(n)).alias(c) for n, c in zip(names, carried, strict=True)], *top, (F.col("n") - F.col("c_size")).alias("n"),
        )
        sizes = totals.where("branch is not null").select(*top, F.col("branch").alias("owner"), "members")
        lower = rows.where("inside").join(sizes, [*top, "owner"]).select(
            "conv", "depth", "parent_conv", "size", *names, *carried, F.col("owner").alias("top_conv"), (F.col("c_depth") + 1).alias("top_depth"), F.col("members").alias("n")
        )
        open_ = upper.unionByName(lower)
        step += 1
    out = _solve_small(_all(small), names)
    return _all([out, *solved])


def _all(tables: list[DataFrame]) -> DataFrame:
    first, *others = tables
    for t in others:
        first = first.unionByName(t)
    return first


def _with_root(nodes: DataFrame, names: list[str], carried: list[str]) -> DataFrame:
    """Nodes as one component under the root."""
    root = nodes.where("depth = 0").select(F.col("conv").alias("top_conv"), F.col("size").alias("n"))
    zero = [F.lit(0).cast("long").alias(c) for c in carried]
    return nodes.crossJoin(F.broadcast(root)).select("conv", "depth", "parent_conv", "size", *names, *zero, "top_conv", F.lit(0).cast("long").alias("top_depth"), "n")


def ends_digest(ends: DataFrame, most: int = 8192) -> DataFrame:
    """(conv, depth, ends_sha256) from (conv, depth, member): SHA-256 over the members' numbers, ascending, joined by commas.

    SHA-256 reads a node's members in order, so a node ends in one task; what that task reads are runs of up to ``most``
    members that the parts of a range layout have joined before, and it holds one run at a time."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = ends.select("conv", "depth", "member").repartitionByRange(parts, "conv", "depth", "member").sortWithinPartitions("conv", "depth", "member")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, now, run, out = TaskContext.get().partitionId(), 0, None, [], []

        def close() -> None:
            nonlocal seq, run
            if run:
                out.append((*now, part, seq, ",".join(map(str, run))))
                seq, run = seq + 1, []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "depth", "part", "seq", "run"])

        for batch in batches:
            for conv, depth, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, depth) != now or len(run) >= most:
                    close()
                    now = conv, depth
                run.append(member)
            if len(out) >= 256:
                yield batch_of()
                out = []
        close()
        if out:
            yield batch_of()

    runs = laid.mapInArrow(join, "conv long, depth long, part int, seq long, run string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for conv, depth, run in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, depth) != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (conv, depth), hashlib.sha256(run.encode())
                else:
                    state.update(b"," + run.encode())
            if out:
                yield done(out)
        if now is not None:
            yield done([(*now, state.hexdigest())])

    def done(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["conv", "depth", "ends_sha256"])

    ordered = runs.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "part", "seq").select("conv", "depth", "run")
    return ordered.mapInArrow(hashed, "conv long, depth long, ends_sha256 string")


def conversation_trie(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", span: int = 20, most: int = 4, local_nodes: int = 4096
) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    Turns stand in the order of ``turn`` (null first), then of role and of the text's digest; null roles and texts are empty.
    Conversation c is rebuilt: the first h = crc32(c) % ``most`` turns of conversation c - c % ``span`` (all if it has fewer,
    none if it is not there), then c's own from its turn h on.  Each distinct sequence of first d turns is a node; all
    rebuilt conversations, also empty ones, are members of the root.  ``saved_tokens`` sums (members - 1) * words of the
    last turn over the subtree, ``n_leaves`` its nodes without children.

    A prefix is named by its length and 128 bits that each turn and its place add to, so prefixes are running sums, which
    need no task to hold a conversation.  Of two different prefixes of equal length both would have to agree in all of them;
    at 10^11 nodes the chance of any such pair is below 10^-16.

    Rows that repeat a conversation's turn are turns of their own.  Rows without a conversation id belong to none and are left
    out; ids of another type are read as longs.  A conversation, a turn or a group of copies may hold any share of the rows.
    An empty table gives no node, not even a root.  Other columns are ignored."""
    work = Workspace(df.sparkSession)
    ranked = ranked_turns(df, work, conv_col, turn_col, role_col, text_col)
    number = F.col("conv")
    convs = ranked.where("idx = 0").select("conv", (number - number % span).alias("base"), taken_over(number, most).alias("h"))
    convs = work.save(convs, "convs")
    prefixes = rebuilt_paths(ranked, convs, work, most)
    work.drop("turns", "ranked", "terms")

    before = [f"p{i}" for i in range(4)]
    key = ["depth", *LANES]
    distinct = work.save(
        prefixes.groupBy(*key).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), *[F.min(p).alias(p) for p in before]), "distinct"
    )
    # The root has no turn and all members; every other node's parent is the node of its prefix without the last turn.
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = work.save(root.select("conv", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"), F.lit(None).cast("long").alias("parent_conv")), "root")
    parent = distinct.select((F.col("depth") + 1).alias("depth"), *[F.col(s).alias(p) for s, p in zip(LANES, before, strict=True)], F.col("conv").alias("parent_conv"))
    deep = distinct.where("depth > 1").join(parent, ["depth", *before]).select("conv", "depth", "n_convs", "words", "parent_conv", *LANES)
    flat = distinct.where("depth = 1").crossJoin(F.broadcast(root.select(F.col("conv").alias("parent_conv")))).select("conv", "depth", "n_convs", "words", "parent_conv", *LANES)
    named = work.save(deep.unionByName(flat), "named")
    work.drop("distinct")

    # The path of every conversation that names a node, as names of nodes.
    naming = work.save(named.select("conv").unionByName(root.select("conv")).distinct(), "naming")
    owner = named.select(*key, F.col("conv").alias("owner"), F.col("parent_conv").alias("above"))
    own = prefixes.join(naming, "conv", "left_semi").select("conv", *key).join(owner, key).select("conv", "depth", "owner", "above")
    tops = naming.crossJoin(F.broadcast(root.select(F.col("conv").alias("owner")))).select("conv", F.lit(0).cast("long").alias("depth"), "owner", F.lit(None).cast("long").alias("above"))
    paths = work.save(own.unionByName(tops), "paths")
    # Nodes below and including each: what every path names for itself from there on.
    reach = paths.groupBy("conv").agg(F.max("depth").alias("length"), F.max(F.when(F.col("owner") != F.col("conv"), F.col("depth"))).alias("shared"))
    named_below = F.col("length") - F.greatest(F.coalesce("shared", F.lit(-1)), F.col("depth") - 1)
    sizes = paths.join(work.save(reach, "reach"), "conv").groupBy("owner", "depth").agg(F.sum(named_below).alias("size")).withColumnRenamed("owner", "conv")

    all_ = named.select("conv", "depth", "n_convs", "words", "parent_conv").unionByName(root.select("conv", "depth", "n_convs", "words", "parent_conv"))
    children = named.groupBy(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = all_.join(children, ["conv", "depth"], "left").join(sizes, ["conv", "depth"]).withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    nodes = work.save(nodes.withColumns({"n_leaves": leaf, "saved_tokens": saved}), "nodes")
    rolled = centroid_rollup(nodes, paths, ["n_leaves", "saved_tokens"], work, local_nodes)

    last = prefixes.groupBy("conv").agg(F.max_by(F.struct(*key), "depth").alias("x")).select("conv", "x.*")
    ended = last.join(owner, key).select(F.col("owner").alias("conv"), "depth", F.col("conv").alias("member"))
    bare = convs.join(last, "conv", "left_anti").select(F.col("conv").alias("member")).crossJoin(F.broadcast(root.select("conv", "depth"))).select("conv", "depth", "member")
    ends = ends_digest(work.save(ended.unionByName(bare), "ends"))
    facts = nodes.select("conv", "depth", "parent_conv", "n_convs", "n_children")
    whole = facts.join(rolled, ["conv", "depth"]).join(ends, ["conv", "depth"], "left")
    return whole.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
