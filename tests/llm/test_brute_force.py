"""The classifier and the sharding against plain solutions of the same problem."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from syncframe.llm import packing, sharding
from syncframe.llm import quality_classifier as qc


def test_sums_over_many_tasks(spark):
    rows = spark.range(3000).select((F.col("id") % 7).cast("double").alias("v")).repartition(40)
    size = 20_000  # more than a block
    vector = lambda batch: np.outer(batch["v"].to_numpy(), np.ones(size)).sum(0) * np.arange(size)
    want = sum(k % 7 for k in range(3000)) * np.arange(size)
    assert np.allclose(qc._summed(rows, vector, size), want, rtol=1e-12)
    assert not qc._summed(rows.limit(0), vector, size).any()


def plain_scores(texts, labels, features=512, ridge=1e-4, seed=5):
    """One matrix, one solve."""
    fold = {i: zlib.crc32(str(i).encode()) % qc.FOLDS for i in texts}
    x = {i: np.asarray(qc.text_statistics(t.encode()), float) for i, t in texts.items()}
    known = [i for i in sorted(texts) if i in labels and fold[i] != 0]
    all_x = np.stack([x[i] for i in known])
    mean, spread = all_x.mean(0), np.sqrt(np.maximum((all_x**2).mean(0) - all_x.mean(0) ** 2, 0))
    spread[spread < 1e-9] = 1.0
    chance = np.random.default_rng(seed)
    width = all_x.shape[1]
    directions, phases = chance.normal(size=(width, features)) / np.sqrt(width), chance.uniform(0, 2 * np.pi, features)
    lift = lambda m: np.column_stack([np.sqrt(2 / features) * np.cos(np.clip((m - mean) / spread, -5, 5) @ directions + phases), np.ones(len(m))])
    fit, held = [i for i in known if fold[i] != 1], [i for i in known if fold[i] == 1]
    z, y = lift(np.stack([x[i] for i in fit])), np.array([labels[i] for i in fit], float)
    weights = np.linalg.solve(z.T @ z + ridge * max(len(fit), 1.0) * np.eye(features + 1), z.T @ y)
    raw = lift(np.stack([x[i] for i in held])) @ weights
    place = np.clip(((raw + 0.5) / 2 * qc.BINS).astype(int), 0, qc.BINS - 1)
    bins = collections.defaultdict(list)
    for b, r, i in zip(place, raw, held, strict=True):
        bins[b].append((r, labels[i]))
    order = sorted(bins)
    centres, levels = qc.isotonic(*(np.array(v) for v in zip(*[(np.mean([r for r, _ in bins[b]]), np.mean([y for _, y in bins[b]]), float(len(bins[b]))) for b in order], strict=True)))
    ids = sorted(texts)
    return dict(zip(ids, np.clip(np.interp(lift(np.stack([x[i] for i in ids])) @ weights, centres, levels), 0, 1), strict=True))


def test_scores_equal_a_plain_solve(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in marks.collect() if r.quality is not None}
    want = plain_scores(texts, labels)
    got = {r.doc_id: r.score for r in qc.quality_scores(docs, marks).collect()}
    assert max(abs(got[i] - want[i]) for i in texts) < 1e-5


@pytest.mark.parametrize(("shards", "capacity", "bundles"), [(4, None, 64), (None, 3000, 64), (None, 900, 8)])
def test_sharding_equals_a_plain_packing(spark, shards, capacity, bundles):
    chance = random.Random(7)
    texts = ["x" * chance.randrange(200) + str(k % 90) for k in range(300)] + ["hot" * 20] * 30
    out = sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=shards, capacity=capacity, bundles=bundles).collect()
    groups = collections.Counter()
    for t in texts:
        groups[hashlib.md5(t.encode()).hexdigest()] += len(t.encode()) + 1
    total = sum(groups.values())
    if capacity is not None:
        capacity = max(capacity, *groups.values())
        bundles = max(bundles, -(-16 * total // capacity))
    while True:
        unit_of = {g: g if s > total / bundles else str(int(g[:8], 16) % bundles) for g, s in groups.items()}
        units = collections.Counter()
        for g, s in groups.items():
            units[unit_of[g]] += s
        if capacity is None or max(units.values()) <= capacity:
            break
        bundles *= 2
    names = sorted(units)
    sizes = [units[u] for u in names]

    def scan(capacity):
        """Best fit over all bins, the largest first; of equal rooms the lowest bin."""
        rooms, at = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [b for b, r in enumerate(rooms) if r >= sizes[i]]
            b = min(fits, key=lambda b: (rooms[b], b)) if fits else len(rooms)
            if not fits:
                rooms.append(capacity)
            rooms[b] -= sizes[i]
            at[i] = b
        return at, len(rooms)

    held = out[0].capacity
    at, bins = scan(held)
    loads = collections.Counter()
    for r in out:
        loads[r.shard] += r.size
        assert r.shard == at[names.index(unit_of[hashlib.md5(texts[r.doc_id].encode()).hexdigest()])]
    assert max(loads.values()) <= held and len(loads) == bins
    if capacity is None:
        assert bins <= shards and scan(held - 1)[1] > shards
    else:
        assert held == capacity


def fewest(sizes, capacity):
    """The fewest bins, by trying all packings."""
    best = [len(sizes)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for b in sorted({r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values()):
            place(k + 1, [*rooms[:b], rooms[b] - sizes[k], *rooms[b + 1 :]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best[0]


def test_dual_bound_and_plan_bracket_the_optimum():
    chance = random.Random(11)
    for _ in range(60):
        capacity = chance.choice([10, 24, 64])
        sizes = sorted((chance.randrange(1, capacity + 1) for _ in range(chance.randrange(1, 10))), reverse=True)
        histogram = collections.Counter(sizes)
        bound, best = packing.dual_bound(histogram, capacity), fewest(sizes, capacity)
        used = sum(times for _, times in packing.pack_plan(histogram, capacity))
        assert bound <= best <= used <= best + 1, (sizes, capacity)
    assert packing.dual_bound({600: 90}, 1000) == 90 and packing.dual_bound({}, 1000) == 0


@pytest.mark.parametrize("pieces", [1000, 20_000])
def test_gap_to_the_dual_bound(pieces):
    chance = random.Random(pieces)
    histogram = collections.Counter(min(2048, int(chance.lognormvariate(6, 1.2)) + 1) for _ in range(pieces))
    bound, used = packing.dual_bound(histogram, 2048), sum(times for _, times in packing.pack_plan(histogram, 2048))
    print(f"{pieces} pieces: {used} sequences for a dual bound of {bound}")
    assert bound <= used <= bound + 1
