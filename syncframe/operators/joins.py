"""Planning joins: what a mirror, a resume or a swarm has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from syncframe import functions as S
from syncframe.operators.filters import chunks_of
from syncframe.operators.folds import fold_sorted, spark_seconds


def quick_check(src: DataFrame, dst: DataFrame, mode: str = "strict") -> DataFrame:
    """(path, size, status): skip, delta, full, new or empty.  ``mode`` is strict (size and time), size or fresh."""
    return quick_checked(src, dst, mode).select("path", "size", "status")


def quick_checked(src: DataFrame, dst: DataFrame, mode: str = "strict") -> DataFrame:
    """The source's rows with the status that ``quick_check`` gives them."""
    other = dst.select("path", F.col("kind").alias("dst_kind"), F.col("size").alias("dst_size"), F.col("mtime_ns").alias("dst_ns"))
    same = (F.col("dst_kind") == "file") & (F.col("size") == F.col("dst_size"))
    unchanged = same & {"strict": F.col("mtime_ns") == F.col("dst_ns"), "size": F.lit(True), "fresh": F.lit(False)}[mode]
    status = (
        F.when(unchanged, "skip").when(F.col("size") == 0, "empty").when(F.col("dst_size").isNull(), "new")
        .when(same, "delta").otherwise("full")
    )
    return src.join(other, "path", "left").select(*src.columns, status.alias("status"))


def delta_chunks(src: DataFrame, dst: DataFrame, chunk_size: int) -> DataFrame:
    """(path, idx, len, claimed, send) for the files that the quick check calls delta: a chunk is kept if the
    destination's has the same identity and is not all zero."""
    changed = quick_check(src, dst).where("status = 'delta'").select("path")
    ident = S.chunk_id(F.col("path"), F.col("idx"), F.col("payload")).alias("hash")
    here = chunks_of(src.join(changed, "path", "left_semi"), chunk_size).select("path", "idx", "len", ident)
    there = chunks_of(dst.join(changed, "path", "left_semi"), chunk_size).select("path", "idx", ident.alias("dst_hash"), S.all_zero(F.col("payload")).alias("zero"))
    claimed = F.coalesce(~F.col("zero"), F.lit(False))
    kept = claimed & F.col("hash").eqNullSafe(F.col("dst_hash"))
    return here.join(there, ["path", "idx"], "left").select("path", "idx", "len", claimed.alias("claimed"), (~kept).alias("send"))


def verify_claims(delta: DataFrame) -> DataFrame:
    """(path, claims, cleared, verdict): commit if every claim holds, else claim_result."""
    wrong = F.count_if(F.col("claimed") & F.col("send"))
    return delta.groupBy("path").agg(
        F.count_if("claimed").alias("claims"), wrong.alias("cleared"), F.when(wrong == 0, "commit").otherwise("claim_result").alias("verdict")
    )


def mirror_deletes(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Destination paths that the source does not have; unfinished transfers stay."""
    return dst.where(~S.is_resume_state(F.col("path"))).join(src.select("path"), "path", "left_anti").select("path", "size")


def resolve_hardlinks(entries: DataFrame, failed: DataFrame) -> DataFrame:
    """(id, link_ref, target, ok): each link with the path of its data row; a missing or failed one fails it."""
    data = entries.where("kind = 'file'").join(failed.select("id"), "id", "left_anti").select(F.col("id").alias("link_ref"), F.col("path").alias("target"))
    links = entries.where("kind = 'hardlink'").select("id", "link_ref")
    return links.join(data, "link_ref", "left").select("id", "link_ref", "target", F.col("target").isNotNull().alias("ok"))


def validate_sidecars(sidecars: DataFrame, files: DataFrame, strict: bool = True, version: int = 1) -> DataFrame:
    """(path, reason): the first rule that a resume state breaks against the source file; null if it is valid."""
    f = files.select("path", F.col("size").alias("f_size"), F.col("mtime_ns").alias("f_ns"))
    reason = (
        F.when(F.col("version") != version, "version").when(F.col("f_size").isNull(), "path")
        .when(F.col("size") != F.col("f_size"), "size").when(F.lit(strict) & (F.col("mtime_ns") != F.col("f_ns")), "mtime")
        .when(F.col("chunk_size") <= 0, "grid").when(F.col("chunk_count") != S.chunk_count(F.col("size"), F.col("chunk_size")), "count")
    )
    return sidecars.join(f, "path", "left").select("path", reason.alias("reason"))


def rehash_resume(part: DataFrame, marks: DataFrame) -> DataFrame:
    """(path, idx, action): ``part`` has hash and zero of the chunks on disk, ``marks`` the recorded ones (hash, Z
    or empty).  A recorded chunk is kept if it matches; without a record a chunk with data is adopted
    as untrusted."""
    recorded = marks.select("path").distinct().withColumn("known", F.lit(True))
    good = F.when(F.col("zero"), F.col("mark") == "Z").otherwise(F.col("mark") == F.col("hash"))
    action = F.when(F.col("known"), F.when(F.coalesce(good, F.lit(False)), "keep").otherwise("drop")).when(F.col("zero"), "drop").otherwise("untrusted")
    return part.join(recorded, "path", "left").join(marks, ["path", "idx"], "left").select("path", "idx", action.alias("action"))


def missing_chunks(spec: DataFrame, have: DataFrame) -> DataFrame:
    return spec.join(have, ["file_idx", "chunk_idx"], "left_anti")


def verify_chunks(spec: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, idx, verdict): ok, bad, deferred (no catalogue for the file) or short (catalogue ends before)."""
    known = spec.select("path").distinct().withColumn("listed", F.lit(True))
    verdict = (
        F.when(F.col("listed").isNull(), "deferred").when(F.col("want").isNull(), "short")
        .when(F.col("want") == F.col("sha"), "ok").otherwise("bad")
    )
    return chunks.join(known, "path", "left").join(spec, ["path", "idx"], "left").select("path", "idx", verdict.alias("verdict"))


def verify_files(spec: DataFrame, files: DataFrame) -> DataFrame:
    """(path, verdict): ok, mismatch, missing or extra, by the whole files' hashes."""
    a, b = spec.select("path", F.col("sha").alias("want")), files.select("path", F.col("sha").alias("got"))
    verdict = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") == F.col("got"), "ok").otherwise("mismatch")
    return a.join(b, "path", "full_outer").select("path", verdict.alias("verdict"))


def banned_peers(fetches: DataFrame) -> DataFrame:
    """Peers that delivered a chunk which fails the catalogue; the web source is never banned."""
    return fetches.where("not ok and peer <> 'http'").select("peer").distinct()


def exclude_banned(holdings: DataFrame, fetches: DataFrame) -> DataFrame:
    return holdings.join(banned_peers(fetches), "peer", "left_anti")


def assign_sources(tasks: DataFrame, holdings: DataFrame) -> DataFrame:
    """(file_idx, chunk_idx, peer, try_no): each chunk's holders in an order that rotates with the chunk, so that
    load spreads; chunks that nobody holds go to the web source, which is also everybody's last resort."""
    chunk = Window.partitionBy("file_idx", "chunk_idx")
    listed = (
        tasks.join(holdings, ["file_idx", "chunk_idx"])
        .withColumn("n", F.count("*").over(chunk)).withColumn("place", F.row_number().over(chunk.orderBy("peer")) - 1)
        .withColumn("try_no", (F.pmod(F.col("place") - (F.col("file_idx") * 31 + F.col("chunk_idx")), F.col("n")) + 1).cast("long"))
    )
    counts = tasks.join(listed.groupBy("file_idx", "chunk_idx").agg(F.max("n").alias("n")), ["file_idx", "chunk_idx"], "left")
    web = counts.select("file_idx", "chunk_idx", F.lit("http").alias("peer"), (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("try_no"))
    return listed.select("file_idx", "chunk_idx", "peer", "try_no").unionByName(web)


def apply_policies(inventory: DataFrame, policies: list[dict]) -> DataFrame:
    """(target, path): for each target its include and exclude lists applied to the inventory.  The lists are part
    of the plan, so the inventory is read once and nothing is joined."""
    path = F.col("path")
    takes = [
        F.when((S.matches(path, p["include"]) if p.get("include") else F.lit(True)) & ~S.matches_or_below(path, p.get("exclude", [])), p["target"])
        for p in policies
    ]
    return inventory.select(F.explode(F.array_compact(F.array(*takes))).alias("target"), "path")


def merge_snapshot(local: DataFrame, envelope: DataFrame) -> DataFrame:
    """(name, addr, managed) after an envelope: it wins for each of its names, names that it managed before and
    no longer has go, purely local names stay."""
    a = local.select("name", F.col("addr").alias("old"), F.col("managed").alias("was"))
    b = envelope.select("name", F.col("addr").alias("new"))
    return (
        a.join(b, "name", "full_outer").where(F.col("new").isNotNull() | ~F.coalesce("was", F.lit(False)))
        .select("name", F.coalesce("new", "old").alias("addr"), F.col("new").isNotNull().alias("managed"))
    )


def map_owners(entries: DataFrame, users: DataFrame, groups: DataFrame, policy: str) -> DataFrame:
    """(id, uid, gid) under the policy none, numeric or name; an unknown name falls back to the number."""
    if policy == "none":
        return entries.select("id", F.lit(None).cast("long").alias("uid"), F.lit(None).cast("long").alias("gid"))
    if policy == "numeric":
        return entries.select("id", "uid", "gid")
    u, g = users.select(F.col("name").alias("uname"), F.col("id").alias("u")), groups.select(F.col("name").alias("gname"), F.col("id").alias("g"))
    return entries.join(u, "uname", "left").join(g, "gname", "left").select("id", F.coalesce("u", "uid").alias("uid"), F.coalesce("g", "gid").alias("gid"))


def unsafe_parents(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Paths with a proper ancestor that is a symbolic link."""
    above = entries.select("path", F.explode(S.ancestors(F.col("path"))).alias("above"))
    return above.join(links.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()


def prune_nested(selected: DataFrame) -> DataFrame:
    """Selected paths without those that have a selected ancestor."""
    return selected.join(unsafe_parents(selected, selected), "path", "left_anti")


def room_members(members: DataFrame, most: int | None = 64, salt: int = 0, slices: int = 64) -> DataFrame:
    """(addr, room, other): what each member of a room (room, addr, seed) is told: all seeds, and others up to ``most`` in all.
    Without ``most`` (None) it is told all others, whose number is the square of the room's: the members that ask are dealt to
    ``slices``, each of which meets the room's list, so a large room is the work of many tasks.

    A room's list is its seeds and the first ``most + 1`` others in a salted order, so a member finds ``most`` without itself;
    members meet that list and never each other."""
    if most is None:
        asking = members.select("room", "addr", F.pmod(F.xxhash64("addr"), F.lit(slices)).cast("int").alias("_slice"))
        others = members.select("room", F.col("addr").alias("other"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"))
        return asking.join(others, ["room", "_slice"]).where("addr <> other").select("addr", "room", "other")
    order = Window.partitionBy("room").orderBy(F.md5(F.concat("addr", F.lit(f"#{salt}"))), "addr")
    plain = members.where("not seed").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most + 1).select("room", "addr", "place")
    other = plain.select("room", F.col("addr").alias("other"), F.lit(False).alias("other_seed"), "place")
    other = other.unionByName(members.where("seed").select("room", F.col("addr").alias("other"), F.lit(True).alias("other_seed"), F.lit(0).alias("place")))
    seeds = members.where("seed").groupBy("room").agg(F.count("*").alias("seeds"))
    asking = members.select("room", "addr", "seed").join(plain.withColumnRenamed("place", "own_place"), ["room", "addr"], "left").join(seeds, "room", "left")
    met = asking.join(other, "room").where("addr <> other")
    # Its place among the others once the member itself is out of the list, and the seeds that come before.
    place = F.col("place") - F.when(~F.col("seed") & (F.col("own_place") < F.col("place")), 1).otherwise(0)
    told = F.col("other_seed") | (place + F.coalesce("seeds", F.lit(0)) - F.col("seed").cast("int") <= most)
    return met.where(told).select("addr", "room", "other")


def pair_offers(offers: DataFrame, takes: DataFrame, ttl: str) -> DataFrame:
    """(kind, ref, id, offer, verdict): offers and takes of an id in the order of time.  An offer is live for
    ``ttl`` or until taken; an offer while one is live is a duplicate; a take without a live offer is
    rejected.  An id's rows are folded as a sorted stream, which holds one offer."""
    span = spark_seconds(ttl)
    rows = offers.select("id", "ts", F.lit("offer").alias("kind"), F.col("offer").alias("ref")).unionByName(
        takes.select("id", "ts", F.lit("take").alias("kind"), F.col("take").alias("ref"))
    )
    names = ["id", "ts", "kind", "ref"]

    def step(key: tuple, held: tuple | None, row: tuple) -> tuple[tuple | None, tuple]:
        ts, kind, ref = row
        live = held is not None and ts <= held[1]
        if kind == "offer":
            return (held if live else (ref, ts + span)), (kind, ref, None, "duplicate" if live else "open")
        return None, (kind, ref, held[0] if live else None, "paired" if live else "rejected")

    return fold_sorted(rows.select(*names), ["id"], ["ts", "kind", "ref"], step, "kind string, ref long, offer long, verdict string")


def changed_during(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, code) of files whose size or time is another after the transfer."""
    b = after.select("path", F.col("size").alias("size2"), F.col("mtime_ns").alias("ns2"))
    return before.join(b, "path").where("size <> size2 or mtime_ns <> ns2").select("path", F.lit(4).cast("long").alias("code"))


def attach_results(plan: DataFrame, results: DataFrame) -> DataFrame:
    """The plan's rows with the first result of their id; later results and unknown ids do not count."""
    first = results.groupBy("id").agg(F.min_by("status", "seq").alias("result"))
    return plan.join(first, "id", "left")
