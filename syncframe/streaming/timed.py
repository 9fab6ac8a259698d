"""Stateful streams in event time: rules over the rows of a key, with timers and state that goes when it is over.

A rule sees a key's rows in the order of their time however they were dealt to micro-batches: rows wait in state until
the watermark has passed them, and a timer wakes them for the first of them and for the rule's own next deadline.
So a stream gives what the batch form gives up to the watermark, deadlines are met without a later event, and a key
with nothing to wait for holds no state and no timer.

Keys are kept by buckets, as each call to the state store from Python costs more than many rows: a bucket's values and
waiting rows are read and written as a few pages, whatever the number of its keys.

These streams need the RocksDB state store; ``with_timers`` chooses it for a session."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Fixed spans of the protocol, in seconds.
MEMBER_TTL, SEED_TTL, ROOM_CAP, STALL_AFTER, OFFER_TTL, BOOTSTRAP_AGE = 60, 300, 256, 120, 600, 30 * 86400

BUCKETS = 1024  #: Buckets of keys.
ROWS = 1 << 16  #: Rows of a page of waiting rows, and of a frame that goes out.
EPOCH = datetime(1970, 1, 1)


def with_timers(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def _time(us: int | None) -> datetime | None:
    return None if us is None else EPOCH + timedelta(microseconds=us)


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows as objects, so that integers beside nulls stay exact."""
    return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, zip(*rows, strict=True), strict=True)})


class Rule:
    """What a stream does with the rows of a key.  A row is a tuple with its time in microseconds first; rows of equal time
    come in the order of their other fields.  ``value`` is what it holds of the key; None if nothing."""

    row = "at long"  #: Fields of a row.
    value: object = None

    def take(self, key: tuple, row: tuple, out: list[tuple]) -> None:
        """One row, when all earlier ones have been taken and deadlines before it met."""
        raise NotImplementedError

    def due(self) -> int | None:
        """The next deadline in microseconds, if any."""
        return None

    def meet(self, key: tuple, at: int, out: list[tuple]) -> None:
        """The deadline has passed."""

    @classmethod
    def fields(cls) -> list[str]:
        return _names(cls.row)


def _sort(rows: list[tuple]) -> None:
    try:
        rows.sort()
    except TypeError:  # nulls come first
        rows.sort(key=lambda r: tuple((x is not None, x) for x in r))


class Buckets(StatefulProcessor):
    """Runs a rule over the keys of a bucket.  Page 0 has the values of its keys, the pages after it have waiting rows."""

    def __init__(self, rule: Rule, keys: list[str], columns: list[str], longs: list[str], names: list[str]):
        self.rule, self.keys, self.columns, self.longs, self.names = rule, keys, columns, longs, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.pages = handle, handle.getMapState("pages", "page long", "content binary")

    def _page(self, page: int) -> dict | None:
        return pickle.loads(self.pages.getValue((page,))[0]) if self.pages.containsKey((page,)) else None

    def _put(self, page: int, content: dict) -> None:
        self.pages.updateValue((page,), (pickle.dumps(content, 5),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self._go(rows, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._go([], timerValues.getCurrentWatermarkInMs() * 1000)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """What a batch run has left for the rule: the keys, then the fields of its value."""
        values = self._page(0) or {}
        plain = initialState.astype(object).where(initialState.notna(), None)
        rest = [c for c in plain.columns if c not in self.keys and c != "bucket_"]
        for key, value in zip(zip(*(plain[c] for c in self.keys), strict=True), zip(*(plain[c] for c in rest), strict=True), strict=True):
            values[key] = value
        self._put(0, values)

    def _read(self, frames, waiting: dict[tuple, list[tuple]]) -> None:
        n = len(self.keys)
        place = {c: k for k, c in enumerate(self.columns)}
        fields = [place[c] for c in self.rule.fields()]
        for frame in frames:
            columns = [frame[c].tolist() for c in self.columns]
            if frame["nulls_"].any():
                for k, gone in enumerate(frame["nulls_"].tolist()):
                    for bit, c in enumerate(self.longs):
                        if gone >> bit & 1:
                            columns[place[c]][k] = None
            for key, row in zip(zip(*columns[:n], strict=True), zip(*(columns[k] for k in fields), strict=True), strict=True):
                if key in waiting:
                    waiting[key].append(row)
                else:
                    waiting[key] = [row]

    def _go(self, frames, passed: int) -> Iterator[pd.DataFrame]:
        """All that the watermark has passed, rows and deadlines in the order of time; a deadline comes before a row of a later time."""
        rule, values, waiting, old = self.rule, self._page(0), {}, 0
        had, values = values is not None, values or {}
        while (page := self._page(old + 1)) is not None:
            old += 1
            for key, rows in page.items():
                waiting.setdefault(key, []).extend(rows)
        self._read(frames, waiting)
        out: list[tuple] = []
        made: list[pd.DataFrame] = []
        left: dict[tuple, list[tuple]] = {}
        wakes = []
        for key in [*waiting, *(k for k in values if k not in waiting)]:
            rows = waiting.pop(key, [])
            _sort(rows)
            rule.value = values.get(key)
            taken = 0
            for r in rows:
                if r[0] > passed:
                    break
                while (at := rule.due()) is not None and at < r[0]:
                    rule.meet(key, at, out)
                rule.take(key, r, out)
                taken += 1
                if len(out) >= ROWS:
                    made.append(_frame(out, self.names))
                    out = []
            while (at := rule.due()) is not None and at <= passed:
                rule.meet(key, at, out)
            wakes += [x for x in (rule.due(), rows[taken][0] if taken < len(rows) else None) if x is not None]
            if taken < len(rows):
                left[key] = rows[taken:] if taken else rows
            if rule.value is None:
                values.pop(key, None)
            else:
                values[key] = rule.value
        if values:
            self._put(0, values)
        elif had:
            self.pages.removeKey((0,))
        new = 0
        for page in _cut(left):
            new += 1
            self._put(new, page)
        for k in range(new + 1, old + 1):
            self.pages.removeKey((k,))
        # Rounded up, so that a timer fires when the watermark has passed the time itself; one at the watermark would be lost.
        wake = {-(-min(wakes) // 1000)} if wakes else set()
        there = set(self.handle.listTimers())
        for at in there - wake:
            self.handle.deleteTimer(at)
        for at in wake - there:
            self.handle.registerTimer(at)
        if out:
            made.append(_frame(out, self.names))
        return iter(made)


def _cut(rows: dict[tuple, list[tuple]]) -> Iterator[dict[tuple, list[tuple]]]:
    """Waiting rows in pages."""
    page: dict[tuple, list[tuple]] = {}
    n = 0
    for key, some in rows.items():
        start = 0
        while start < len(some):
            page[key] = some[start : start + ROWS - n]
            start += len(page[key])
            n += len(page[key])
            if n >= ROWS:
                yield page
                page, n = {}, 0
    if page:
        yield page


def _timed(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """Rows with their time as an instant under the watermark, and its microseconds as ``at``."""
    instant = rows.withColumn(time, F.col(time).cast("timestamp"))
    return instant.withColumn("at", F.unix_micros(time)).withWatermark(time, delay)


def _by_rule(timed: DataFrame, keys: list[str], rule: Rule, schema: str, time: str = "ts", first: DataFrame | None = None) -> DataFrame:
    """The rule over rows that have ``at`` and a watermark.  Rows without a time are left out: no watermark ever passes them.

    Nulls among the integers go beside them as bits, as a frame would make the column inexact."""
    kinds, columns = dict(timed.dtypes), list(dict.fromkeys([*keys, *rule.fields()]))
    longs = [c for c in columns if kinds[c] in ("bigint", "int", "smallint", "tinyint")]
    nulls = sum((F.col(c).isNull().cast("int") * (1 << k) for k, c in enumerate(longs)), F.lit(0))
    plain = [F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) if c in longs else F.col(c) for c in columns]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket_")
    dealt = timed.where("at is not null").select(time, bucket, nulls.alias("nulls_"), *plain).groupBy("bucket_")
    begun = None if first is None else first.select(bucket, "*").groupBy("bucket_")
    return dealt.transformWithStateInPandas(Buckets(rule, keys, columns, longs, _names(schema)), schema, "append", "EventTime", begun)


def run_rule(rows: DataFrame, keys: list[str], rule: Rule, schema: str, delay: str, time: str = "ts") -> DataFrame:
    """The stream of what the rule emits, in append mode; rows later than ``delay`` behind the newest are dropped."""
    return _by_rule(_timed(rows, time, delay), keys, rule, schema, time)


class RoomRule(Rule):
    """Members of a room: a refresh keeps the seed flag of the joining; the stalest member that is no seed goes when a new one
    finds the room full; members go at the end of their span without being asked."""

    row = "at long, addr string, seed boolean"

    def __init__(self, member: float, seed: float, cap: int | None):
        self.spans, self.cap = (int(member * 1e6), int(seed * 1e6)), cap

    def _ends(self, member: tuple[int, bool]) -> int:
        return member[0] + self.spans[member[1]]

    def due(self) -> int | None:
        return min(map(self._ends, self.value.values())) if self.value else None

    def meet(self, key: tuple, at: int, out: list[tuple]) -> None:
        for addr in sorted(a for a, m in self.value.items() if self._ends(m) == at):
            del self.value[addr]
            out.append((key[0], addr, "expired", _time(at)))
        self.value = self.value or None

    def take(self, key: tuple, row: tuple, out: list[tuple]) -> None:
        at, addr, seed = row
        members = self.value = self.value or {}
        if addr in members:
            members[addr] = (at, members[addr][1])
            out.append((key[0], addr, "refreshed", _time(at)))
            return
        if self.cap is not None and len(members) >= self.cap and (plain := [(m[0], a) for a, m in members.items() if not m[1]]):
            gone = min(plain)[1]
            del members[gone]
            out.append((key[0], gone, "evicted", _time(at)))
        members[addr] = (at, bool(seed))
        out.append((key[0], addr, "joined", _time(at)))


def room_stream(rows: DataFrame, delay: str, member: float = MEMBER_TTL, seed: float = SEED_TTL, cap: int | None = ROOM_CAP) -> DataFrame:
    """(room, addr, what, at) from announces (room, addr, seed, ts): joined, refreshed, expired or evicted.

    A room's cap makes its members depend on each other, so a room is the key; its state is at most the cap (and its seeds).
    Without a cap (None) nobody is evicted and each member is a key of its own."""
    keys = ["room"] if cap is not None else ["room", "addr"]
    return run_rule(rows, keys, RoomRule(member, seed, cap), "room long, addr string, what string, at timestamp_ntz", delay)


class PairRule(Rule):
    """One offer at a time, until it is taken or its span ends; then nothing is kept."""

    row = "at long, kind string, ref long"

    def __init__(self, ttl: float):
        self.ttl = int(ttl * 1e6)

    def due(self) -> int | None:
        return None if self.value is None else self.value[1]

    def meet(self, key: tuple, at: int, out: list[tuple]) -> None:
        self.value = None

    def take(self, key: tuple, row: tuple, out: list[tuple]) -> None:
        at, kind, ref = row
        live = self.value is not None
        if kind == "offer":
            verdict, offer = ("duplicate" if live else "open"), None
            self.value = self.value if live else (ref, at + self.ttl)
        else:
            verdict, offer = ("paired" if live else "rejected"), self.value[0] if live else None
            self.value = None
        out.append((kind, ref, key[0], offer, verdict))


def pair_stream(rows: DataFrame, delay: str, ttl: float = OFFER_TTL) -> DataFrame:
    """(kind, ref, id, offer, verdict) of offers and takes (id, ts, kind, ref)."""
    return run_rule(rows, ["id"], PairRule(ttl), "kind string, ref long, id long, offer long, verdict string", delay)


class StallRule(Rule):
    """A session is stalled when its span without useful events ends, once until it goes on."""

    row = "at long"

    def __init__(self, idle: float):
        self.idle = int(idle * 1e6)

    def due(self) -> int | None:
        return None if self.value is None or self.value[1] else self.value[0] + self.idle

    def meet(self, key: tuple, at: int, out: list[tuple]) -> None:
        out.append((key[0], _time(self.value[0]), "stalled", _time(at)))
        self.value = (self.value[0], True)

    def take(self, key: tuple, row: tuple, out: list[tuple]) -> None:
        if self.value is not None and self.value[1]:
            out.append((key[0], _time(self.value[0]), "resumed", _time(row[0])))
        self.value = (row[0], False)


def stall_stream(rows: DataFrame, delay: str, idle: float = STALL_AFTER) -> DataFrame:
    """(session, since, what, at) of useful events (session, ts): stalled at the end of the idle span, with no further event
    needed, and resumed by the next event."""
    return run_rule(rows, ["session"], StallRule(idle), "session long, since timestamp_ntz, what string, at timestamp_ntz", delay)


class EnvelopeRule(Rule):
    """A node's envelopes against the version it holds; a node that holds none takes none older than ``age`` at ``now``."""

    row = "at long, version long, sig_ok boolean, key_ok boolean"

    def __init__(self, now: int, age: float):
        self.oldest = now - int(age * 1e6)

    def take(self, key: tuple, row: tuple, out: list[tuple]) -> None:
        at, version, sig_ok, key_ok = row
        held = self.value[0] if self.value else 0
        if not key_ok:
            verdict = "foreign key"
        elif version == held and sig_ok:
            verdict = "same"
        elif version <= held:
            verdict = "stale"
        elif not sig_ok:
            verdict = "bad signature"
        elif held == 0 and at < self.oldest:
            verdict = "too old"
        else:
            verdict, self.value = "applied", (version,)
        out.append((key[0], version, verdict, self.value[0] if self.value else 0))


def envelope_stream(rows: DataFrame, delay: str, now: str, age: float = BOOTSTRAP_AGE) -> DataFrame:
    """(node, version, verdict, applied) of envelopes (node, ts, version, sig_ok, key_ok); ``now`` is the time, in UTC, against
    which a first envelope's age counts."""
    us = int(datetime.fromisoformat(now).replace(tzinfo=timezone.utc).timestamp() * 1e6)
    return run_rule(rows, ["node"], EnvelopeRule(us, age), "node long, version long, verdict string, applied long", delay)


class SweepRule(Rule):
    """Snapshots of a session against the one before; the first is the baseline."""

    row = "at long, fingerprint string"

    def take(self, key: tuple, row: tuple, out: list[tuple]) -> None:
        if self.value is not None and self.value[0] != row[1]:
            out.append((key[0], _time(row[0]), row[1]))
        self.value = (row[1],)


def sweep_stream(events: DataFrame, every: str, delay: str, baseline: DataFrame | None = None) -> DataFrame:
    """(session, start, fingerprint) of periodic checks of events (session, path, kind, ts) whose snapshot differs from that of the
    check before.  ``baseline`` (session, fingerprint) hands over what a batch run saw last."""
    shot = F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws("|", "path", "kind"))), "\n"), 256)
    checks = _timed(events, "ts", delay).groupBy("session", F.window("ts", every).alias("w")).agg(shot.alias("fingerprint"))
    timed = checks.select(F.window_time("w").alias("ts"), "session", F.unix_micros(F.col("w.start").cast("timestamp")).alias("at"), "fingerprint")
    first = None if baseline is None else baseline.select("session", "fingerprint")
    return _by_rule(timed, ["session"], SweepRule(), "session long, start timestamp_ntz, fingerprint string", first=first)


class LifecycleRule(Rule):
    """A file is waiting, active, and resolved once: done, error or skip; only bytes count after that."""

    row = "at long, event_id long, kind string, bytes long"

    def take(self, key: tuple, row: tuple, out: list[tuple]) -> None:
        state, size = self.value or ("wait", 0)
        _, _, kind, moved = row
        size += moved if kind == "chunk" and moved is not None else 0
        after = state if state in ("done", "error", "skip") else kind if kind in ("done", "error", "skip") else "active" if kind in ("active", "chunk") else state
        self.value = (after, size)
        if after != state:
            out.append((key[0], after, size, _time(row[0])))


def lifecycle_stream(events: DataFrame, delay: str, states: DataFrame | None = None) -> DataFrame:
    """(path, state, bytes, at) whenever a file changes its state, from events (path, ts, event_id, kind, bytes).  ``states``
    (path, state, bytes), as ``file_states`` gives them, hands over where a batch run ended."""
    first = None if states is None else states.select("path", "state", "bytes")
    return _by_rule(_timed(events, "ts", delay), ["path"], LifecycleRule(), "path string, state string, bytes long, at timestamp_ntz", first=first)


PAGE = 8192  #: Chunks of a bitmap page.
SHELVES = 4096  #: Shelves of files.
FIRST = 64  #: A file's chunks below this number are bits of its entry on the shelf.


class ArrivalRule(StatefulProcessor):
    """The chunks of files that have come.  Rows are taken as they come.

    The files of a shelf have their first chunks in one value, read and written at once; later chunks are pages of bits of
    their own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shelf, self.pages = handle.getValueState("shelf", "content binary"), handle.getMapState("pages", "path string, page long", "bits binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        firsts, laters = pickle.loads(self.shelf.get()[0]) if self.shelf.exists() else ({}, {})  # bits of the first chunks, number of later ones
        pages: dict[tuple[str, int], bytearray] = {}
        out: list[tuple] = []
        come = pd.concat(list(rows)).sort_values(["ts", "idx"], kind="stable")
        for path, idx, total in zip(come["path"].tolist(), come["idx"].tolist(), come["chunk_count"].tolist(), strict=True):
            if not 0 <= idx < total:
                out.append((path, idx, "out of range"))
                continue
            if idx < FIRST:
                bits = firsts.get(path, 0)
                if bits >> idx & 1:
                    continue
                firsts[path] = bits | 1 << idx
            else:
                page, bit = divmod(idx, PAGE)
                if (path, page) not in pages:
                    got = self.pages.getValue((path, page)) if self.pages.containsKey((path, page)) else None
                    pages[path, page] = bytearray(got[0] if got else bytes(PAGE // 8))
                some = pages[path, page]
                if some[bit >> 3] >> (bit & 7) & 1:
                    continue
                some[bit >> 3] |= 1 << (bit & 7)
                laters[path] = laters.get(path, 0) + 1
            out.append((path, idx, "new"))
            if firsts.get(path, 0).bit_count() + laters.get(path, 0) == total:
                out.append((path, idx, "complete"))
        for place, bits in pages.items():
            self.pages.updateValue(place, (bytes(bits),))
        self.shelf.update((pickle.dumps((firsts, laters), 5),))
        return iter([_frame(out, ["path", "idx", "what"])] if out else [])


def arrivals_stream(rows: DataFrame, shelves: int = SHELVES) -> DataFrame:
    """(path, idx, what) for (path, idx, chunk_count, ts): new or out of range, and complete once.  A row touches its file's
    shelf, and one page of 8,192 chunks whatever the file's size; a shelf holds a few bytes for each of its files."""
    dealt = rows.select("path", "idx", "chunk_count", "ts", F.pmod(F.xxhash64("path"), F.lit(shelves)).cast("int").alias("shelf_"))
    return dealt.groupBy("shelf_").transformWithStateInPandas(ArrivalRule(), "path string, idx long, what string", "append", "None")
