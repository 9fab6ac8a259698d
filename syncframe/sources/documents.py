"""Documents with known shapes: journals, event logs, specs, resume states, announces, beacons and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from syncframe import functions as S
from syncframe.operators.aggregates import spec_hash

EVENT = "ts timestamp, type string, path string, msg string"
ENTRY = "seq bigint, ts string, event string, prev string, hash string"
#: The name that a line of journals kept together begins with, as JSON.
NAMED = r'^\{"journal":("(?:[^"\\]|\\.)*"),'
FILE = "struct<path:string,size:bigint,mode:bigint,sha256:string,chunks:array<string>>"
SPEC = f"version int, artifact string, manifest_sha string, file_entries array<{FILE}>"
SIDECAR = (
    "version int, path string, nonce string, srcSize bigint, srcMtime struct<sec:bigint,nsec:bigint>, chunkSize bigint, chunkCount bigint, "
    "hashes array<string>, have string"
)
BEACON = "proto int, name string, port int, root string, ver string"
ENDPOINT = "struct<addr:string,token:string,pass:string,cloak:boolean>"
POLICY = "endpoints map<string,struct<addr:string,include:array<string>,exclude:array<string>,delete:boolean,dest:string>>"
ENVELOPE = f"version bigint, origin string, ts string, endpoints map<string,{ENDPOINT}>, pubkey string, sig string"


def journal_lines(spark: SparkSession, path: str) -> DataFrame:
    """(journal, gen, file, together, line_no, line, whole) of journals as text: one file, or a folder of pieces ``gen=<number>`` that
    later appends have added.  Pieces that lie in no ``journal=<name>`` hold many journals ``together``; the journal is then their folder.

    Files are split: a line's number is its place in its block behind the line counts of the blocks and pieces before, so
    no task needs a file as a whole.  A line is whole if a newline ends it: the lines' bytes say whether the file ends with one."""
    meta = F.col("_metadata")
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    gen = r"/gen=([0-9]+)/[^/]*$"
    rows = text.select(
        F.regexp_replace(meta.file_path, gen, "").alias("journal"), F.coalesce(F.regexp_extract(meta.file_path, gen, 1).try_cast("long"), F.lit(0).cast("long")).alias("gen"),
        meta.file_path.alias("file"), meta.file_block_start.alias("block"), meta.file_size.alias("bytes"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )
    piece = ["journal", "gen", "file", "bytes"]
    local = F.row_number().over(Window.partitionBy(*piece, "block").orderBy("at"))
    placed = rows.withColumn("local", local)
    blocks = rows.groupBy(*piece, "block").agg(F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("seen"))
    behind = Window.partitionBy("journal").orderBy("gen", "file", "block")
    last = F.lead("block").over(Window.partitionBy(*piece).orderBy("block")).isNull()
    torn = F.sum("seen").over(Window.partitionBy(*piece)) > F.col("bytes")
    blocks = blocks.select(*piece, "block", "n", (F.sum("n").over(behind) - F.col("n")).alias("before"), (last & torn).alias("torn"))
    joined = placed.join(blocks, [*piece, "block"])
    whole = ~(F.col("torn") & (F.col("local") == F.col("n")))
    together = F.col("file").rlike(gen) & ~F.col("file").rlike(f"/journal=[^/]*{gen}")
    return joined.select("journal", "gen", "file", together.alias("together"), (F.col("before") + F.col("local") - 1).alias("line_no"), "line", whole.alias("whole"))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(journal, line_no, seq, ts, event, detail, prev, hash) of the intact prefix of each journal.

    Blank lines are skipped; the first whole line that does not parse ends the prefix; a last line without a
    newline is a torn tail and is left out.  ``detail`` is the text as written, which the hash covers."""
    entries = _entries(spark, path)
    kept = entries.join(_broken(entries), "journal", "left").where("sound and (stop is null or line_no < stop)")
    detail = F.regexp_extract("line", r'"detail":(.*),"prev":"[0-9a-f]*","hash":"[0-9a-f]*"\}$', 1)
    return kept.select("journal", "line_no", "e.seq", "e.ts", "e.event", detail.alias("detail"), "e.prev", "e.hash")


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """Whole lines as entries ``e``; of pieces that hold journals together a line begins with the name, as the sink writes it, and the
    journal is null where that cannot be read."""
    lines = journal_lines(spark, path).where("whole and line <> ''").withColumn("e", F.from_json("line", ENTRY))
    quoted = F.nullif(F.regexp_extract("line", NAMED, 1), F.lit(""))
    name = F.from_json(F.concat(F.lit('{"v":'), quoted, F.lit("}")), "v string")["v"]
    for _ in range(2):  # as a URI, and as the name of a partition
        name = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    journal = F.when(F.col("together"), F.concat("journal", F.lit("/journal="), name)).otherwise(F.col("journal"))
    lines = lines.withColumn("journal", journal)
    return lines.withColumn("sound", F.col("e.seq").isNotNull() & F.col("e.hash").isNotNull() & F.col("journal").isNotNull())


def _broken(entries: DataFrame) -> DataFrame:
    """(journal, stop): the first line of a journal that does not parse.  One whose journal cannot be read may belong to any that
    has lines in its file."""
    nameless = entries.where("together and journal is null").groupBy("file").agg(F.min("line_no").alias("line_no"))
    holders = entries.where("together and journal is not null").select("journal", "file").distinct().join(nameless, "file").select("journal", "line_no")
    lines = entries.where("not sound and journal is not null").select("journal", "line_no").unionByName(holders)
    return lines.groupBy("journal").agg(F.min("line_no").alias("stop"))


def journal_heads(spark: SparkSession, path: str) -> DataFrame:
    """(journal, gen, seq, hash, corrupt): where each journal's intact prefix ends, its newest piece, and whether whole lines
    that do not parse follow: its own, or in pieces of many journals those of which nobody can tell whose they are."""
    entries = _entries(spark, path)
    seen = entries.where("journal is not null").join(_broken(entries), "journal", "left")
    head = F.max_by(F.struct("e.seq", "e.hash"), F.when(F.col("sound") & (F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))), F.col("line_no")))
    found = seen.groupBy("journal").agg(F.max("gen").alias("gen"), head.alias("head"), F.bool_or(F.col("stop").isNotNull()).alias("corrupt"))
    doubt = entries.where("journal is null").agg((F.count(F.lit(1)) > 0).alias("doubt"))
    found = found.crossJoin(F.broadcast(doubt)).withColumn("corrupt", F.col("corrupt") | F.col("doubt"))  # one row
    return found.select("journal", "gen", F.coalesce("head.seq", F.lit(0).cast("long")).alias("seq"), F.coalesce("head.hash", F.lit("")).alias("hash"), "corrupt")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path)


def parse_transfer_log(lines: DataFrame) -> DataFrame:
    """(ts, kind, path, msg) of text lines; ``kind`` is padded to ten."""
    part = lambda k: F.regexp_extract("value", r"^(\S+) +(\S+) +(\S+) ?(.*)$", k)
    return lines.select(part(1).try_cast("timestamp").alias("ts"), part(2).alias("kind"), part(3).alias("path"), part(4).alias("msg")).where("ts is not null")


def spec_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(manifest_sha) and the entries (f) of one descriptor.

    One with a line for each entry, as the sink writes it, is read in splits and a row is one entry; in any other layout the
    document is one row."""
    lines = spark.read.option("lineSep", "\n").text(path)
    opens, ends = F.col("value").endswith('"file_entries":['), F.col("value").startswith('],"total_bytes":')
    if lines.where(opens).isEmpty():
        doc = spark.read.schema(SPEC).json(path, multiLine=True)
        return doc.select("manifest_sha"), doc.select(F.explode("file_entries").alias("f"))
    head = lines.where(opens).select(F.regexp_extract("value", r'"manifest_sha":"([0-9a-f]*)","file_entries":\[$', 1).alias("manifest_sha"))
    return head, lines.where(~opens & ~ends).select(F.from_json(F.regexp_replace("value", "^,", ""), FILE).alias("f"))


def read_spec(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The file rows and the chunk rows of one descriptor; refused if its id is not the hash of its contents."""
    head, entries = spec_entries(spark, path)
    files = entries.select("f.path", "f.size", "f.mode", F.col("f.sha256").alias("sha"), "f.chunks")
    chunks = files.select("path", F.posexplode(F.coalesce("chunks", F.array().cast("array<string>"))).alias("idx", "sha")).withColumn("idx", F.col("idx").cast("long"))
    found, stored = spec_hash(files.select("path", "size", "mode", "sha"), chunks).first()[0], head.select("manifest_sha").first()[0]
    if found != stored:
        raise ValueError(f"the descriptor's id {stored} is not the hash of its contents")
    return files.select("path", "size", "mode", "sha"), chunks


def read_sidecars(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Resume states with ``marks`` and the bitmap ``have``, one document in a file or in a line (``lines``); those whose marks do not fit their grid are left out, and
    a bitmap that cannot be decoded is empty.  A bitmap is cut or filled up with zeros to the bytes of its grid."""
    doc = spark.read.schema(SIDECAR).json(path, multiLine=not lines)
    ns = F.col("srcMtime.sec") * 1_000_000_000 + F.col("srcMtime.nsec")
    length = F.expr("(chunkCount + 7) div 8").cast("int")
    padded = F.concat(F.coalesce(F.try_to_binary("have", F.lit("base64")), F.lit(b"")), F.unhex(F.repeat(F.lit("00"), length)))
    have = F.substring(padded, F.lit(1), length)
    return doc.where("size(hashes) = chunkCount").select(
        "version", "path", "nonce", F.col("srcSize").alias("size"), ns.alias("mtime_ns"), F.col("chunkSize").alias("chunk_size"), F.col("chunkCount").alias("chunk_count"), F.col("hashes").alias("marks"), have.alias("have")
    )


def parse_announces(lines: DataFrame, magic: str = "SWARM1") -> DataFrame:
    """(room, addr, have, seed, reject) of lines of seven fields seen from ``source_ip``; ``reject`` says why a line
    does not count.  An address without a host gets the source's."""
    f = F.split(F.trim("line"), r"\s+")
    at = lambda k: F.get(f, F.lit(k))
    host, port = S.host_of(at(3)), F.regexp_extract(at(3), r":([0-9]+)$", 1)
    reject = (
        F.when((F.size(f) != 7) | (at(0) != magic) | (at(1) != "announce"), "protocol")
        .when(~at(2).rlike("^[0-9a-fA-F]{64}$") | (F.length(at(4)) > 8192) | (F.length(at(3)) > 256), "args").when(port == "", "addr")
    )
    addr = F.when(host.isin("", "0.0.0.0", "::"), F.concat("source_ip", F.lit(":"), port)).otherwise(at(3))
    return lines.select(at(2).alias("room"), addr.alias("addr"), at(4).alias("have"), (at(6) == "1").alias("seed"), reject.alias("reject"))


def parse_beacons(beacons: DataFrame) -> DataFrame:
    """(addr, name, root, ver) of JSON beacons (json, source_ip): version 1, a usable port, an IPv4 source and no control
    characters."""
    b = beacons.withColumn("b", F.from_json("json", BEACON))
    plain = lambda c: ~S.has_control(F.coalesce(c, F.lit("")))
    good = (F.col("b.proto") == 1) & F.col("b.port").between(1, 65535) & F.col("source_ip").rlike(r"^\d+\.\d+\.\d+\.\d+$") & plain(F.col("b.name")) & plain(F.col("b.root")) & plain(F.col("b.ver"))
    return b.where(good).select(F.concat("source_ip", F.lit(":"), F.col("b.port")).alias("addr"), "b.name", "b.root", "b.ver")


def read_policies(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(target, addr, include, exclude, delete, dest) of the endpoints of configuration documents, one in a file or in a line."""
    return spark.read.schema(POLICY).json(path, multiLine=not lines).select(F.explode("endpoints").alias("target", "p")).select("target", "p.*")


def read_envelopes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(version, origin, ts, name, addr) of versioned endpoint snapshots, one in a file or in a line."""
    doc = spark.read.schema(ENVELOPE).json(path, multiLine=not lines)
    return doc.select("version", "origin", "ts", F.explode("endpoints").alias("name", "e")).select("version", "origin", "ts", "name", "e.addr")


def holdings_of(announces: DataFrame) -> DataFrame:
    """(peer, file_idx, chunk_idx) of announced bitmaps (addr, have): per-file hex joined by ``/``; a part that cannot be
    decoded is skipped."""
    parts = announces.select(F.col("addr").alias("peer"), F.posexplode(F.split("have", "/")).alias("file_idx", "hex"))
    bits = parts.withColumn("bitmap", F.try_to_binary("hex", F.lit("hex"))).where("bitmap is not null and octet_length(bitmap) > 0")
    return bits.select("peer", F.col("file_idx").cast("long").alias("file_idx"), F.explode(S.bits_of(F.col("bitmap")).cast("array<long>")).alias("chunk_idx"))
