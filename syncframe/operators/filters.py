"""Selection of entries, and the chunk tables of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syncframe import functions as S


def grid_of(files: DataFrame, chunk_size: int | None = None) -> DataFrame:
    """One row per chunk: the file's columns with chunk_size, idx, off and len.  Empty files have none."""
    size = F.col("size")
    cs = F.lit(chunk_size).cast("long") if chunk_size else S.chunk_size_for(size)
    sized = files.withColumn("chunk_size", cs).withColumn("chunks", S.chunk_count(size, F.col("chunk_size"))).where("chunks > 0")
    rows = sized.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    return rows.withColumns({
        "off": S.chunk_offset(F.col("idx"), F.col("chunk_size")), "len": S.chunk_len(size, F.col("chunk_size"), F.col("idx")),
    })


def header_bounds(files: DataFrame, chunk_size: int | None = None) -> DataFrame:
    """(path, n, low, high): the number of a file's range headers, the first and the last of them as text; empty files have none.

    Exact without a row for each chunk.  The offset 0 is the least text.  Among offsets of as many digits the greatest
    number is the greatest text, so the greatest of all is among one for each number of digits."""
    size, cs = F.col("size"), F.col("_size")
    sized = files.withColumn("_size", F.lit(chunk_size).cast("long") if chunk_size else S.chunk_size_for(size)).withColumn("n", S.chunk_count(size, F.col("_size"))).where("n > 0")
    last = [F.least(F.col("n") - 1, F.call_function("div", F.lit(min(10**digits, 2**63) - 1).cast("long"), cs)) for digits in range(1, 20)]
    header = lambda k: S.range_header(S.chunk_offset(k, cs), S.chunk_len(size, cs, k))
    bounds = sized.select("path", "n", header(F.lit(0).cast("long")).alias("low"), F.greatest(*map(header, last)).alias("high"))
    return bounds.groupBy("path").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def chunks_of(files: DataFrame, chunk_size: int) -> DataFrame:
    """The chunks of small files whose bytes are in the column ``content``: path, idx, len, payload."""
    grid = grid_of(files, chunk_size)
    payload = F.substring(F.col("content"), (F.col("off") + 1).cast("int"), F.col("len").cast("int"))
    return grid.select("path", "idx", "len", payload.alias("payload"))


def exclude(entries: DataFrame, patterns: list[str], root: str | None = None) -> DataFrame:
    """Entries that no pattern matches, itself or by an ancestor; rows flagged by the column ``root`` always stay."""
    keep = ~S.matches_or_below(F.col("path"), patterns)
    return entries.where(keep | F.col(root) if root else keep)


def include(entries: DataFrame, patterns: list[str]) -> DataFrame:
    """Directories, and the leaves that a pattern matches."""
    return entries.where((F.col("kind") == "dir") | S.matches(F.col("path"), patterns))


def glob_select(entries: DataFrame, pattern: str) -> DataFrame:
    regex = S.segments_regex(pattern)
    return entries.where(F.lit(False) if regex is None else F.col("path").rlike(regex))


def select_literal_first(entries: DataFrame, patterns: list[str]) -> DataFrame:
    """(pattern, path, no_match): a pattern that is itself a path selects that path, any other is matched.  A
    pattern without a match has one row that says so."""
    spark = entries.sparkSession
    asked = spark.createDataFrame([(p,) for p in patterns], "pattern string")
    literal = entries.select("path", F.col("path").alias("pattern")).where(F.col("path").isin(patterns)).dropDuplicates(["path"])
    hits = F.array_compact(F.array(*[F.when(F.col("path").rlike(r), p) for p in patterns if (r := S.segments_regex(p))]))
    matched = entries.select("path", F.explode(hits).alias("pattern")).join(literal.select("pattern"), "pattern", "left_anti")
    found = literal.select("pattern", "path").unionByName(matched.select("pattern", "path"))
    return asked.join(found, "pattern", "left").select("pattern", "path", F.col("path").isNull().alias("no_match"))


def name_regex(entries: DataFrame, pattern: str) -> DataFrame:
    return entries.where(F.col("path").rlike(f"(?i){pattern}"))


def kind_reason(kind: Column, devices: bool) -> Column:
    """Why an entry of a kind is not transferred; null if it is."""
    socket = F.when(kind == "socket", "socket")
    return socket if devices else F.when(kind.isin("fifo", "chardev", "blockdev"), "device").when(kind == "socket", "socket")


def same_filesystem(entries: DataFrame) -> DataFrame:
    """Entries that are on the device of their parent, as are all their ancestors that are listed."""
    parts = S.components(F.col("path"))
    parent = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    above = entries.select(F.col("path").alias("parent"), F.col("dev").alias("parent_dev"))
    crossing = entries.withColumn("parent", parent).join(above, "parent").where("dev <> parent_dev").select(F.col("path").alias("mount"))
    below = entries.select("path", F.explode(S.prefixes(F.col("path"))).alias("mount")).join(crossing, "mount", "left_semi").select("path").distinct()
    return entries.join(below, "path", "left_anti")


def safe_xattrs(xattrs: Column, limit: int = 65536) -> Column:
    """Attributes of users by name, up to the first at which the values together exceed the limit."""
    own = F.array_sort(F.filter(xattrs, lambda x: x["name"].startswith("user.")))
    sizes = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + F.octet_length(x["value"]))
    fits = F.filter(F.sequence(F.lit(0), F.size(own)), lambda n: sizes(F.slice(own, F.lit(1), n)) <= limit)
    return F.slice(own, F.lit(1), F.array_max(fits))


def fits_on_disk(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """Adds ``fits``: each file by itself against its volume's free bytes, where 0 is unknown and fits."""
    return files.join(volumes, "volume").withColumn("fits", (F.col("free") == 0) | (F.col("size") <= F.col("free")))
