"""Sinks: documents and files written from DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from syncframe.functions import is_resume_state
from syncframe.operators.journal import append_journal
from syncframe.operators.scans import FREED, cut, settings
from syncframe.sources.documents import journal_heads


def exposition(counters: DataFrame, prefix: str = "server") -> DataFrame:
    """(name, type, value, line) of a one-row table of counters, in the text format of metrics scrapers."""
    names = counters.columns
    kind = F.when(F.col("name") == "active", "gauge").otherwise("counter")
    pairs = F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("long"))])).alias("name", "value")
    line = F.format_string(f"# TYPE {prefix}_%s %s\n{prefix}_%s %d", "name", "type", "name", "value")
    return counters.select(pairs).withColumn("type", kind).select("name", "type", "value", line.alias("line"))


def write_events(events: DataFrame, path: str) -> None:
    """(ts, type, path, msg) as JSON lines with milliseconds."""
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ts")
    events.select(F.to_json(F.struct(ts, "type", "path", "msg")).alias("value")).write.mode("overwrite").text(path)


def write_receipt(report: DataFrame, digest: DataFrame, path: str, direction: str, peer: str, ts: str) -> None:
    """One JSON document for a transfer report (files, bytes, skipped, errors) and a manifest digest."""
    said = report.crossJoin(digest).select(
        F.lit(ts).alias("ts"), F.lit(direction).alias("direction"), F.lit(peer).alias("peer"), "files", "bytes", "skipped", "errors",
        F.col("digest").alias("manifest_sha256"), (F.col("errors") == 0).alias("ok"),
    )
    said.coalesce(1).write.mode("overwrite").json(path)


def write_spec(files: DataFrame, chunks: DataFrame, spec_id: DataFrame, path: str, artifact: str) -> None:
    """The descriptor of an artifact: (path, size, mode, sha) with distinct paths, (path, idx, sha) and its id.

    One document in one file, a line for each of the artifact's files: the task that writes it sorts lines and holds one."""
    lists = chunks.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "sha"))), lambda x: x["sha"]).alias("chunks"))
    entry = F.to_json(F.struct("path", "size", F.col("mode").cast("long").alias("mode"), F.col("sha").alias("sha256"), "chunks"))
    first = files.agg(F.min("path").alias("_first"))
    described = files.join(lists, "path", "left").crossJoin(F.broadcast(first))  # one row
    comma = F.when(F.col("path") > F.col("_first"), ",").otherwise("")
    entries = described.select(F.lit(1).alias("part"), "path", F.concat(comma, entry).alias("value"))
    total = F.coalesce(F.sum("size"), F.lit(0)).cast("string")
    ends = files.agg(total.alias("total")).crossJoin(spec_id).select(
        F.explode(F.array(
            F.struct(F.lit(0).alias("part"), F.concat(F.lit('{"version":2,"artifact":'), F.lit(json.dumps(artifact)), F.lit(',"manifest_sha":"'), "spec_hash", F.lit('","file_entries":[')).alias("value")),
            F.struct(F.lit(2).alias("part"), F.concat(F.lit('],"total_bytes":'), "total", F.lit("}")).alias("value")),
        )).alias("e")
    ).select("e.part", F.lit("").alias("path"), "e.value")
    document = entries.unionByName(ends).coalesce(1).sortWithinPartitions("part", "path")
    document.select("value").write.mode("overwrite").text(path)


def write_sidecars(chunks: DataFrame, files: DataFrame, path: str) -> None:
    """Resume states of files (path, nonce, size, mtime_ns, chunk_size) from their chunks (path, idx, mark)."""
    marks = chunks.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "mark"))), lambda x: x["mark"]).alias("hashes"))
    when = F.struct(F.expr("mtime_ns div 1000000000").alias("sec"), F.expr("mtime_ns % 1000000000").alias("nsec"))
    bits = F.transform("hashes", lambda m: (m != "").cast("int"))
    byte = lambda k: F.aggregate(
        F.transform(F.slice(bits, k * 8 + 1, F.lit(8)), lambda b, i: F.call_function("shiftleft", b, i)), F.lit(0), lambda a, b: a + b
    )
    count = F.expr("(size(hashes) + 7) div 8").cast("int")
    packed = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.lpad(F.hex(byte(k)), 2, "0")), "")
    have = F.base64(F.unhex(F.when(count > 0, packed).otherwise("")))
    doc = files.join(marks, "path").select(
        F.lit(1).alias("version"), "path", "nonce", F.col("size").alias("srcSize"), when.alias("srcMtime"), F.col("chunk_size").alias("chunkSize"),
        F.size("hashes").cast("long").alias("chunkCount"), "hashes", have.alias("have"),
    )
    doc.write.mode("overwrite").json(path)


def apply_mirror(kept: DataFrame, sent: DataFrame, path: str) -> None:
    """The chunk table of the destination after a mirror, as a dataset."""
    kept.unionByName(sent).write.mode("overwrite").parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _rewrite(content: DataFrame, touched: list[int], folder: str) -> None:
    """Puts ``content`` in the place of the touched buckets.  It may be read from the folder that it goes to: a dynamic overwrite
    writes all of it beside the buckets before it takes any away, so no further copy is staged.

    Buckets are rebalanced: one that is larger than a part should be is written by several tasks."""
    files = lambda: set(read_buckets(content.sparkSession, content.schema, folder, touched).inputFiles())
    before = files()
    content.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    for b in {f.split("/")[-2] for f in before & files()}:  # was not written, so it has become empty
        _remove(content.sparkSession, f"{folder}/{b}")


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, schema: StructType, folder: str, buckets: Iterable[int]) -> DataFrame:
    """These buckets of a bucketed dataset; no other folder is looked into."""
    top, wanted = spark._jvm.org.apache.hadoop.fs.Path(folder), {f"bucket={b}" for b in buckets}
    names = [s.getPath().getName() for s in top.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(top)] if exists(spark, folder) else []
    there = [f"{folder}/{name}" for name in names if name in wanted]
    return spark.read.schema(schema).option("basePath", folder).parquet(*there) if there else spark.createDataFrame([], schema)


def replace_paths(rows: DataFrame, paths: DataFrame, folder: str, key: str = "path", buckets: int = 64) -> None:
    """In the bucketed dataset of ``folder``, puts ``rows`` in the place of all that it has of ``paths``; rewrites their buckets only."""
    spark = rows.sparkSession
    new = rows.withColumn("bucket", bucket_of(key, buckets))
    if not exists(spark, folder):
        spark.createDataFrame([], new.schema).write.partitionBy("bucket").parquet(folder)
    touched = sorted(r.bucket for r in paths.select(bucket_of(key, buckets).alias("bucket")).distinct().collect())  # at most a row for each bucket
    old = read_buckets(spark, new.schema, folder, touched)
    kept = old.join(paths.select(key).distinct(), key, "left_anti").select(*new.columns)
    _rewrite(kept.unionByName(new), touched, folder)


def mirror_into(src: DataFrame, folder: str, key: str = "path", same: tuple[str, ...] = ("idx", "hash"), delete: bool = True, buckets: int = 64, protect: Column | None = None) -> DataFrame:
    """Makes the dataset in ``folder`` a mirror of ``src`` and returns (bucket, added, changed, deleted) of the buckets that were
    rewritten.

    The dataset is partitioned by a hash of the path, fixed by its first write.  Rows of the same path and ``same`` columns are
    equal; a bucket whose rows all are stays as it is, files and names included.  Of the others the new content is written
    beside them and takes their place by dynamic partition overwrite, so a run that dies before leaves the
    destination whole, and one that is repeated finds nothing to do.  Paths that the source does not have go if ``delete``,
    but for those that ``protect`` holds for (resume states, by default)."""
    with settings(src.sparkSession, FREED):
        return _mirror_into(src, folder, key, same, delete, buckets, protect)


def _mirror_into(src: DataFrame, folder: str, key: str, same: tuple[str, ...], delete: bool, buckets: int, protect: Column | None) -> DataFrame:
    spark = src.sparkSession
    new = src.withColumn("bucket", bucket_of(key, buckets))
    if not exists(spark, folder):
        spark.createDataFrame([], new.schema).write.partitionBy("bucket").parquet(folder)
    old = spark.read.schema(new.schema).parquet(folder)
    keys = [key, *same]
    gone = old.join(new.select(key).distinct(), key, "left_anti")
    held = protect if protect is not None else is_resume_state(F.col(key))
    staying = gone if not delete else gone.where(held)
    leaving = gone.where(~held) if delete else gone.limit(0)
    fresh = new.join(old.select(*keys), keys, "left_anti").join(old.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    worn = old.join(new.select(*keys), keys, "left_anti").join(new.select(key).distinct(), key, "left_semi")
    changes = fresh.select("bucket", key, F.when(F.col("_known"), "changed").otherwise("added").alias("what"))
    changes = changes.unionByName(worn.select("bucket", key, F.lit("changed").alias("what"))).unionByName(leaving.select("bucket", key, F.lit("deleted").alias("what")))
    paths = changes.distinct().groupBy("bucket").agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("added", "changed", "deleted")])
    touched = cut(paths)
    content = new.unionByName(staying).join(F.broadcast(touched.select("bucket")), "bucket", "left_semi")  # at most a row for each bucket
    _rewrite(content.select(*new.columns), [r.bucket for r in touched.select("bucket").collect()], folder)
    return touched


def append_to_journal(rows: DataFrame, folder: str, together: bool = False) -> None:
    """Appends entries (journal, ord, ts, event, detail) to the journals ``folder/journal=<name>``, each as a further piece.

    That is a file for each journal and append.  Where journals are many, ``together`` puts those of an append into the files
    of one piece ``folder/gen=<number>``, as many as its size asks for: a journal lies in one of them, and each line begins with its
    journal's name.  A folder is appended to in one of the two ways.

    Entries chain behind the intact head of their journal.  A torn tail, which a writer that died has left, stays in its own
    piece, where it hides nothing that comes later.  If a journal that is appended to has whole lines that do not parse, that
    is no torn tail but evidence: nothing at all is written and the journals are named."""
    spark = rows.sparkSession
    rows = rows.withColumn("journal", F.col("journal").cast("string"))
    if together:
        rows = rows.withColumn("journal", F.coalesce("journal", F.lit("__HIVE_DEFAULT_PARTITION__")))  # as a partition without a name
    gen, heads, last = F.lit(0).cast("long"), None, -1
    if exists(spark, folder):
        plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
        name = plain(plain(F.regexp_extract("journal", r"journal=([^/]*)$", 1)))  # as a URI, and as the name of a partition
        known = journal_heads(spark, folder).withColumn("journal", name)
        if together:
            known = cut(known)
            last = known.agg(F.coalesce(F.max("gen"), F.lit(-1))).first()[0]
        heads = cut(known.join(rows.select("journal").distinct(), "journal", "left_semi"))
        corrupt = [r.journal for r in heads.where("corrupt").orderBy("journal").limit(5).collect()]
        if corrupt:
            raise ValueError(f"journals with unreadable entries before their end, nothing is appended: {', '.join(corrupt)}")
    chained = append_journal(rows, None if heads is None else heads.select("journal", "seq", "hash"))
    if heads is not None and not together:
        chained = chained.join(heads.select("journal", F.col("gen").alias("last")), "journal", "left")
        gen = F.coalesce(F.col("last") + 1, F.lit(0).cast("long"))
    quoted = lambda c: F.regexp_replace(F.substring(F.to_json(F.struct(F.col(c).alias("v"))), 6, 2**31 - 1), r"\}$", "")  # noqa: E731  as JSON text
    entry = F.concat(
        F.lit('"seq":'), F.col("seq").cast("string"), F.lit(',"ts":'), quoted("ts"), F.lit(',"event":'), quoted("event"),
        F.lit(',"detail":'), "detail", F.lit(',"prev":"'), "prev", F.lit('","hash":"'), "hash", F.lit('"}'),
    )
    if together:  # dealt by journal and in order, as the chain was made
        chained.select(F.concat(F.lit('{"journal":'), quoted("journal"), F.lit(","), entry).alias("value")).write.mode("append").text(f"{folder}/gen={last + 1:08d}")
        return
    lines = chained.select("journal", F.format_string("%08d", gen).alias("gen"), "seq", F.concat(F.lit("{"), entry).alias("value")).repartition("journal").sortWithinPartitions("journal", "gen", "seq")
    lines.select("journal", "gen", "value").write.mode("append").partitionBy("journal", "gen").text(folder)


def assemble_files(chunks: DataFrame, wanted: DataFrame, dest: str) -> DataFrame:
    """(path, ok, got_sha): files written under ``dest``, a folder that all executors share, from (path, idx, off, payload,
    sha) and checked against (path, sha) of ``wanted``.

    A file's chunks go in order through one task that writes and hashes as it reads, so memory holds one chunk; a
    chunk that fails its hash, or a whole file that does, leaves no file.  A wanted file without chunks is an empty file."""
    whole = wanted.select("path", F.col("sha").alias("want"))
    rows = whole.join(chunks, "path", "left").select("path", "idx", "off", "payload", "sha", "want").repartition("path").sortWithinPartitions("path", "idx")

    def write(batches):
        import hashlib
        import os

        import pyarrow as pa

        path = part = file = sha = want = None
        sound, done = True, []

        def finish():
            nonlocal file
            if file is None:
                return
            file.close()
            file = None
            got = sha.hexdigest()
            if sound and got == want:
                os.replace(part, os.path.join(dest, path))
            else:
                os.remove(part)
            done.append((path, sound and got == want, got))

        for batch in batches:
            for p, _, off, payload, mark, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != path or file is None:
                    finish()
                    path, want, sha, sound = p, w, hashlib.sha256(), True
                    full = os.path.join(dest, p)
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    part = f"{full}.fs-part-{os.getpid()}"
                    file = open(part, "wb")  # noqa: SIM115
                if payload is None:  # no chunk
                    continue
                sound &= hashlib.sha256(payload).hexdigest() == mark and file.tell() == off
                file.write(payload)
                sha.update(payload)
        finish()
        columns = list(zip(*done, strict=True)) if done else [[], [], []]
        kinds = [pa.string(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "ok", "got_sha"])

    return rows.mapInArrow(write, "path string, ok boolean, got_sha string")
