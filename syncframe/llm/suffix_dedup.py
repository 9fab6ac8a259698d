"""Removal of repeated byte strings by longest-previous-factor arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syncframe.llm.arrow import joined, record_batch, runs, texts_of
from syncframe.llm.common import Workspace, text_of
from syncframe.llm.shingles import mix

#: Bytes of the grams whose smallest hash marks a window.  A power of two.
GRAM = 32
#: A text is searched in segments of this many bytes, which overlap by a window less one byte; arrays of this size stay in
#: a core's cache.
SEGMENT = 200_000
_PLACE = np.uint64((1 << 24) - 1)
_BYTE = np.random.default_rng(20240502).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_LAST = 2**63 - 1


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the gram at each place."""
    grams, span = _BYTE[data], 1
    while span < GRAM:
        grams = grams[:-span] * (_FACTOR + np.uint64(2 * span)) + grams[span:]
        span *= 2
    return mix(grams)


def _marked(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, mark, gram hash, context hash): each window of ``length`` bytes within a text is
    marked by its gram of least hash, the leftmost of equals, so equal windows have the same mark wherever
    they stand; neighbours with the same mark form one row.  A row's context is what its windows cover; the
    hash stands for the grams that tile it, its size and the mark's place in it."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = _grams(data)
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    wide, span = length - GRAM + 1, 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    inside = np.ones(len(least) + 1, bool)  # windows that cross no end of a text
    inside[-1] = False
    for a, b in zip(np.maximum(bounds[1:] - (length - 1), bounds[:-1]).tolist(), bounds[1:].tolist(), strict=True):
        inside[a:b] = False
    changes = least[1:] != least[:-1]
    first, last = inside[:-1].copy(), inside[:-1].copy()
    first[1:] &= changes | ~inside[:-2]
    last[:-1] &= changes | ~inside[1:-1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    mark = (least[first] & _PLACE).astype(np.int64)
    size = last - first + length
    context = mix(size.astype(np.uint64) * _FACTOR + (mark - first).astype(np.uint64))
    for tile in range(0, 2 * length - GRAM, GRAM):
        context = mix(context * _FACTOR + grams[first + np.minimum(tile, size - GRAM)])
    return first, last, mark, grams[mark], context


def marked_windows(texts: list[bytes], length: int) -> list[tuple[np.ndarray, ...]]:
    """For each text its rows (first window, last window, mark, gram hash, context hash), in places of that text."""
    found = []
    for begin, end in runs(texts, SEGMENT):
        if end - begin == 1 and len(texts[begin]) > SEGMENT:
            parts = []
            for at in range(0, len(texts[begin]) - length + 1, SEGMENT - length + 1):
                data = np.frombuffer(texts[begin], np.uint8)[at : at + SEGMENT]
                first, last, mark, *hashes = _marked(data, np.array([0, len(data)]), length)
                parts.append((first + at, last + at, mark + at, *hashes))
            found.append(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))
            continue
        data, bounds = joined(texts[begin:end])
        first, last, mark, *hashes = _marked(data, bounds, length)
        cuts = np.searchsorted(first, bounds)
        for i in range(end - begin):
            of = slice(cuts[i], cuts[i + 1])
            found.append((first[of] - bounds[i], last[of] - bounds[i], mark[of] - bounds[i], *(h[of] for h in hashes)))
    return found


def _smaller_before(places: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each suffix in order the nearest one before it with a smaller place that still shares the length, or -1."""
    found = np.where(linked, np.arange(len(places)) - 1, -1)
    at = np.flatnonzero(found >= 0)
    at = at[places[found[at]] >= places[at]]
    while len(at):
        found[at] = found[found[at]]
        at = at[found[at] >= 0]
        at = at[places[found[at]] >= places[at]]
    return found


def earlier_factors(contexts: list[bytes], group: np.ndarray, order: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, begin, end) of runs covered by strings of ``length`` bytes that start earlier in the same group.
    ``order`` numbers the contexts' documents.

    Equal suffixes (their first ``length`` bytes) are found by hash; those that occur once end there, and the distinct
    others are sorted by their bytes.  In suffix order the previous and the next suffix with a smaller
    place (document, start) that share ``length`` bytes are what the longest-previous-factor array is made of; the
    array reaches ``length`` exactly where one of the two exists.  Contexts may overlap: equal places are
    one and the same string."""
    data, bounds = joined(contexts)
    windows = np.maximum(np.diff(bounds) - length + 1, 0)
    of = np.repeat(np.arange(len(contexts)), windows)
    if not len(of):
        return of, of, of
    offset = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    at, begin = bounds[of] + offset, start[of] + offset
    grams = _grams(data)
    key = mix(group[of].view(np.uint64))
    for tile in range(0, length, GRAM):
        key = mix(key * _FACTOR + grams[at + min(tile, length - GRAM)])
    by_key = np.argsort(key)
    same = np.append(False, np.diff(key[by_key]) == 0)
    number = np.cumsum(~same) - 1
    several = same | np.append(same[1:], False)
    kept, number = by_key[several], number[several]
    if not len(kept):
        return kept, kept, kept
    new = np.append(True, np.diff(number) != 0)
    strings = data[at[kept[new]][:, None] + np.arange(length)].view(f"S{length}")[:, 0]
    rank = np.empty(len(strings), np.int64)
    rank[np.argsort(strings)] = np.arange(len(strings))
    rank = rank[np.cumsum(new) - 1]
    by_place = np.lexsort((begin[kept], order[of[kept]]))
    step = np.append(True, (np.diff(begin[kept][by_place]) != 0) | (np.diff(order[of[kept]][by_place]) != 0))
    place = np.empty(len(kept), np.int64)
    place[by_place] = np.cumsum(step)
    ranked = np.argsort(rank, kind="stable")
    linked = np.append(False, np.diff(rank[ranked]) == 0)
    before = _smaller_before(place[ranked], linked)
    after = _smaller_before(place[ranked][::-1], np.append(linked[1:], False)[::-1])[::-1]
    repeated = np.zeros(len(of), bool)
    repeated[kept[ranked]] = (before >= 0) | (after >= 0)
    hits = np.flatnonzero(repeated)
    if not len(hits):
        return hits, hits, hits
    new = np.append(True, (np.diff(hits) != 1) | (np.diff(of[hits]) != 0))
    firsts, lasts = hits[new], hits[np.append(new[1:], True)]
    return of[firsts], begin[firsts], begin[lasts] + length


SPANS = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _lists(counts: list[int], values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(values))


def _whole_keys(batches: Iterable[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Tables of about ``least`` bytes or more from batches sorted by ``key``; no key is in two tables."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        if held.nbytes < least:
            continue
        keys = held[key].to_numpy()
        begins = int(np.searchsorted(keys, keys[-1]))
        if begins:
            yield held.slice(0, begins)
            held = held.slice(begins).combine_chunks()
    if held is not None and len(held):
        yield held


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, begins, ends): maximal runs of each document's spans, which come sorted by document and begin."""
    kinds = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
    for rows in _whole_keys(batches, "doc", 1_000_000):
        doc, tie, begin, end = (rows[c].to_numpy() for c in ("doc", "tie", "begin", "end"))
        new_doc = np.append(True, (np.diff(doc) != 0) | (np.diff(tie) != 0))
        number = np.cumsum(new_doc) - 1
        reach = np.maximum.accumulate((number << 40) + end) - (number << 40)
        new = new_doc.copy()
        new[1:] |= begin[1:] > reach[:-1]
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(new)) - 1
        counts = np.bincount(number[firsts], minlength=number[-1] + 1)
        yield record_batch(kinds, [doc[new_doc], tie[new_doc], _lists(counts, begin[firsts]), _lists(counts, reach[lasts])])


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, crowd: int = 4096) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (the spans).

    A byte goes if a string of ``length`` UTF-8 bytes (32 at least) covers it that also starts earlier: in a document of
    smaller id, or before in the same one.  Strings never cross documents and are judged on the input.

    Of equal texts only the first is searched: each later copy goes as a whole if it has ``length`` bytes.
    Every window of ``length`` bytes is marked by the gram in it with the least hash, about three marks in
    a hundred bytes; equal windows have equal marks.  Marks are counted by partial aggregation, and those that
    occur once end the search for their windows.  Of the others, the windows around a mark form a
    context; equal contexts are reduced to their first, the later ones are repeats as a whole.  Where one mark
    has several contexts, their suffixes are sorted and the longest-previous-factor array decides window by
    window.  Marks with more than ``crowd`` different contexts do not go to one task: their windows are grouped by
    their bytes, which partial aggregation spreads.  Joins on marks stand between written tables, so that Spark can split a
    mark that many documents have.

    Null texts count as empty; a null id comes after all others.  Rows of the same id and text are one document; rows of
    the same id, or without one, that differ in text are documents of their own, in an order of their texts' hashes.
    Very long texts are marked in segments.  Texts shorter than ``length`` keep all bytes.  An empty table gives
    an empty result; other columns of any name are ignored."""
    work = Workspace(df.sparkSession)
    text = text_of(text_col)
    docs = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), text.alias("text"),
        F.xxhash64(text).alias("tie"), F.unhex(F.md5(text.cast("binary"))).alias("md5"),
    )
    facts = work.save(docs.select("doc_id", "doc", "tie", "md5", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own")), "facts")
    firsts = work.save(facts.where(F.col("n_bytes") >= length).groupBy("md5").agg(F.min("doc").alias("first")), "firsts")

    def marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("gram", pa.list_(pa.int64())), ("context", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())), ("size", pa.list_(pa.int32()))])
        for batch in batches:
            rows = marked_windows(texts_of(batch["text"]), length)
            if rows:
                counts = [len(r[0]) for r in rows]
                first, last, _, gram, context = (np.concatenate(x) for x in zip(*rows, strict=True))
                lists = gram.view(np.int64), context.view(np.int64), first, (last - first + length).astype(np.int32)
                yield record_batch(kinds, [batch["doc"], batch["tie"], *(_lists(counts, x) for x in lists)])

    found = docs.join(firsts.select("md5", F.col("first").alias("doc")), ["md5", "doc"], "left_semi").select("doc", "tie", "text")
    found = work.save(found.mapInArrow(marks, "doc long, tie long, gram array<long>, context array<long>, start array<long>, size array<int>"), "marks")
    repeated = work.save(found.select(F.explode("gram").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "repeated")
    seen = found.select("doc", "tie", F.inline(F.arrays_zip("gram", "context", "start", "size")))
    seen = work.save(seen.join(repeated, "gram", "left_semi"), "seen")
    work.drop("marks", "repeated")
    heads = work.save(seen.groupBy("gram", "context").agg(F.min(F.struct("doc", "tie", "start", "size")).alias("head"), F.count(F.lit(1)).alias("n")), "heads")
    again = heads.where("n > 1").select("gram", "context", F.struct("head.doc", "head.tie", "head.start").alias("first"))
    whole = seen.join(again, ["gram", "context"]).where(F.struct("doc", "tie", "start") != F.col("first"))
    whole = work.save(whole.select("doc", "tie", F.col("start").alias("begin"), (F.col("start") + F.col("size")).alias("end")), "whole")
    work.drop("seen")
    several = work.save(heads.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "several")
    contested = heads.select("gram", "head.*").join(several, "gram").groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "size", "gram", "n")).alias("parts"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("gram", pa.int64()), ("n", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())])
        for batch in batches:
            parts, counts = batch["parts"].flatten(), batch["parts"].value_lengths().to_numpy()
            start, size, gram, n = (parts.field(k).to_numpy() for k in range(4))
            texts = texts_of(batch["text"])
            bytes_ = [texts[i][a:b] for i, a, b in zip(np.repeat(np.arange(len(texts)), counts).tolist(), start.tolist(), (start + size).tolist(), strict=True)]
            yield record_batch(kinds, [gram, n, np.repeat(batch["doc"].to_numpy(), counts), np.repeat(batch["tie"].to_numpy(), counts), start, bytes_])

    texts = docs.select("doc", "tie", "text")
    pieces = texts.join(contested, ["doc", "tie"]).select("doc", "tie", "text", "parts").mapInArrow(cut, "gram long, n long, doc long, tie long, start long, bytes binary")
    pieces = work.save(pieces, "pieces")
    work.drop("heads", "several")

    def factors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_keys(batches, "gram", 1_000_000):
            gram, doc, tie, start = (rows[c].to_numpy() for c in ("gram", "doc", "tie", "start"))
            by_doc = np.lexsort((tie, doc))
            order = np.empty(len(doc), np.int64)
            order[by_doc] = np.cumsum(np.append(0, (np.diff(doc[by_doc]) != 0) | (np.diff(tie[by_doc]) != 0)))
            of, begin, end = earlier_factors(rows["bytes"].to_pylist(), gram, order, start, length)
            yield record_batch(SPANS, [doc[of], tie[of], begin, end])

    of_spans = "doc long, tie long, begin long, end long"
    usual_marks = pieces.where(F.col("n") <= crowd).repartition("gram").sortWithinPartitions("gram").mapInArrow(factors, of_spans)

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("window", pa.binary()), ("doc", pa.int64()), ("tie", pa.int64()), ("begin", pa.int64())])
        for batch in batches:
            for doc, tie, start, context in zip(*(batch[c].to_pylist() for c in ("doc", "tie", "start", "bytes")), strict=True):
                n = len(context) - length + 1
                yield record_batch(kinds, [[context[k : k + length] for k in range(n)], [doc] * n, [tie] * n, range(start, start + n)])

    each = pieces.where(F.col("n") > crowd).mapInArrow(windows, "window binary, doc long, tie long, begin long")
    earliest = each.groupBy("window").agg(F.min(F.struct("doc", "tie", "begin")).alias("first"))
    crowded = each.join(earliest, "window").where(F.struct("doc", "tie", "begin") != F.col("first")).select("doc", "tie", "begin", (F.col("begin") + length).alias("end"))

    spans = whole.unionByName(usual_marks).unionByName(crowded)
    merged = spans.repartition("doc", "tie").sortWithinPartitions("doc", "tie", "begin").mapInArrow(_merged, "doc long, tie long, begins array<long>, ends array<long>")
    merged = work.save(merged, "spans", batch_rows=20_000)
    work.drop("whole", "pieces")

    def removed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
        for batch in batches:
            lost, hashes = [], []
            for text, begins, ends in zip(texts_of(batch["text"]), batch["begins"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                kept = hashlib.sha256()
                for a, b in zip([0, *ends], [*begins, len(text)], strict=True):
                    kept.update(text[a:b])
                lost.append(sum(ends) - sum(begins))
                hashes.append(kept.hexdigest())
            yield record_batch(kinds, [batch["doc"], batch["tie"], lost, hashes, batch["begins"], batch["ends"]])

    changed = texts.join(merged, ["doc", "tie"]).select("doc", "tie", "text", "begins", "ends").mapInArrow(
        removed, "doc long, tie long, n_removed long, kept_sha256 string, begins array<long>, ends array<long>"
    )
    changed = changed.select("doc", "tie", "n_removed", "kept_sha256", F.arrays_zip(F.col("begins").alias("begin"), F.col("ends").alias("end")).alias("removed"))
    changed = work.save(changed, "changed").dropDuplicates(["doc", "tie"])
    work.drop("spans")
    copy = F.col("first") < F.col("doc")
    span = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    gone = F.when(copy, span).otherwise(F.col("removed"))
    return facts.join(firsts, "md5", "left").join(changed, ["doc", "tie"], "left").select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"), gone.alias("removed"),
    )
