"""Trees of files that executors can reach: inventories, chunk ranges and whole blobs."""

from __future__ import annotations

import contextlib
import functools
import hashlib
import os
import re
import stat
from collections.abc import Iterable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from syncframe.functions import glob_to_regex
from syncframe.operators.filters import grid_of
from syncframe.operators.scans import numbered
from syncframe.operators.windows import number_entries

#: Fields of an entry; a reader is asked for those that it needs.
ENTRY = (
    "root string, path string, kind string, size bigint, mode int, uid bigint, gid bigint, uname string, gname string, mtime_ns bigint, atime_ns bigint, "
    "dev decimal(20,0), ino decimal(20,0), rdev decimal(20,0), link_target string, xattrs array<struct<name:string,value:binary>>, skipped string"
)
KINDS = {c.split(" ")[0]: c for c in re.split(r", (?=[a-z_]+ )", ENTRY)}
#: What needs no look at the file itself: its directory has it.
CHEAP = {"root", "path", "kind", "skipped"}

FORMATS = {stat.S_IFREG: "file", stat.S_IFDIR: "dir", stat.S_IFLNK: "symlink", stat.S_IFIFO: "fifo", stat.S_IFCHR: "chardev", stat.S_IFBLK: "blockdev", stat.S_IFSOCK: "socket"}


@functools.cache
def _name_of(number: int, group: bool) -> str | None:
    import grp
    import pwd

    try:
        return grp.getgrgid(number).gr_name if group else pwd.getpwuid(number).pw_name
    except KeyError:
        return None


def _xattrs(full: str) -> list[tuple[str, bytes]]:
    out = []
    try:
        for name in sorted(os.listxattr(full, follow_symlinks=False)):
            with contextlib.suppress(OSError):  # gone meanwhile, or not ours to read
                out.append((name, os.getxattr(full, name, follow_symlinks=False)))
    except OSError:
        pass
    return out


def _entry(root: str, path: str, kind: str | None, columns: list[str]) -> tuple:
    """The columns of an entry; the file itself is looked at only if one of them needs it."""
    full, row = os.path.join(root, path), dict.fromkeys(columns)
    row |= {"root": root, "path": path, "kind": kind}
    if not CHEAP.issuperset(columns) or (kind is None and "kind" in columns):
        try:
            s = os.lstat(full)
            kind = FORMATS.get(stat.S_IFMT(s.st_mode), "socket")
            row |= {
                "kind": kind, "size": s.st_size if kind == "file" else 0, "mode": stat.S_IMODE(s.st_mode), "uid": s.st_uid, "gid": s.st_gid, "mtime_ns": s.st_mtime_ns,
                "atime_ns": s.st_atime_ns, "dev": Decimal(s.st_dev), "ino": Decimal(s.st_ino), "rdev": Decimal(s.st_rdev) if kind in ("chardev", "blockdev") else None,
            }
            if "uname" in row:
                row["uname"] = _name_of(s.st_uid, False)
            if "gname" in row:
                row["gname"] = _name_of(s.st_gid, True)
            if "link_target" in row and kind == "symlink":
                row["link_target"] = os.readlink(full)
            if "xattrs" in row:
                row["xattrs"] = _xattrs(full)
        except OSError as e:
            row |= dict.fromkeys(columns) | {"root": root, "path": path, "skipped": e.strerror}
    return tuple(row[c] for c in columns)


class _Subtree(InputPartition):
    def __init__(self, root: str, path: str, deep: bool):
        self.root, self.path, self.deep = root, path, deep


class _Walk(DataSourceReader):
    """The driver lists the top levels only; each of their directories is a partition that an executor walks.
    Excluded directories are never entered, nor are those that a filter on the path rules out."""

    def __init__(self, options: dict, columns: list[str]):
        import json

        self.columns = columns
        self.roots = json.loads(options["roots"])
        self.levels = int(options.get("levels", "1"))
        patterns = json.loads(options.get("exclude", "[]"))
        self.rules = [("/" in p, re.compile(r)) for p in patterns if (r := glob_to_regex(p))]
        self.kinds: set[str] | None = None
        self.starts: list[str] = []

    def _excluded(self, path: str) -> bool:
        return any(rule.match(path if whole else path.rpartition("/")[2]) for whole, rule in self.rules)

    def _children(self, root: str, path: str) -> list[tuple[str, str | None]]:
        """(path, kind) in order; the kind is what the listing says, null if it does not."""
        out = []
        with os.scandir(os.path.join(root, path)) as listing:
            for child in sorted(listing, key=lambda e: os.fsencode(e.name)):
                below = f"{path}/{child.name}" if path else child.name
                if self._excluded(below) or not all(below.startswith(s) or s.startswith(f"{below}/") for s in self.starts):
                    continue
                kind = "symlink" if child.is_symlink() else "dir" if child.is_dir(follow_symlinks=False) else "file" if child.is_file(follow_symlinks=False) else None
                out.append((below, kind))
        return out

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for root in self.roots:
            level = [""]
            for _ in range(self.levels):
                below = []
                for path in level:
                    out.append(_Subtree(root, path, False))
                    with contextlib.suppress(OSError):
                        below += [p for p, kind in self._children(root, path) if kind == "dir"]
                level = below
            out += [_Subtree(root, path, True) for path in level]
        return out

    def _wanted(self, root: str, path: str, kind: str | None) -> Iterator[tuple]:
        if not all(path.startswith(s) for s in self.starts) or (self.kinds is not None and kind is not None and kind not in self.kinds):
            return
        row = _entry(root, path, kind, self.columns)
        if self.kinds is None or kind is not None or (FORMATS.get(stat.S_IFMT(os.lstat(os.path.join(root, path)).st_mode)) in self.kinds):
            yield row

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        """A deep partition has its directory's whole subtree; another one the entries in its directory that are no
        directories.  Each directory is reported by the partition that is its own."""
        root = partition.root
        todo = [partition.path]
        while todo:
            path = todo.pop()
            if path:
                yield from self._wanted(root, path, "dir")
            try:
                children = self._children(root, path)
            except OSError as e:
                failed = {"root": root, "path": path, "kind": "dir", "skipped": e.strerror}
                yield tuple(failed.get(c) for c in self.columns)
                continue
            below = []
            for child, kind in children:
                if kind == "dir":
                    below.append(child)
                else:
                    yield from self._wanted(root, child, kind)
            if partition.deep:
                todo += reversed(below)


class _FilteredWalk(_Walk):
    """A walk that takes what a directory's listing can decide; Spark has no use for it unless the session lets Python sources
    have filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds = {f.value} if self.kinds is None else self.kinds & {f.value}
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.kinds = set(f.value) if self.kinds is None else self.kinds & set(f.value)
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.starts.append(f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("path",):
                self.starts.append(f.value)
                yield f
            else:
                yield f


class InventorySource(DataSource):
    """``spark.read.format("inventory")`` with the options roots (JSON list), exclude (JSON list) and levels; a schema of fewer
    columns spares the reader what they would need."""

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return (_FilteredWalk if self.options.get("filters") == "true" else _Walk)(self.options, schema.names)


def read_inventory(spark: SparkSession, roots: list[str], exclude: list[str] | None = None, levels: int = 1, columns: list[str] | None = None) -> DataFrame:
    """Entries of the trees under ``roots``; links are not followed; what cannot be read is a row with ``skipped``.

    ``columns`` are those that the plan needs (all by default): a file is looked at only if one of them asks for more than
    its directory says.  Filters on kind and on the start of the path reach the walk, where the session lets Python
    sources have filters."""
    import json

    spark.dataSource.register(InventorySource)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("inventory").options(roots=json.dumps(roots), exclude=json.dumps(exclude or []), levels=str(levels), filters=filters)
    return reader.schema(", ".join(KINDS[c] for c in columns)).load() if columns else reader.load()


def read_manifest(spark: SparkSession, roots: list[str], exclude: list[str] | None = None, levels: int = 1) -> DataFrame:
    """The entries that can be read, with ``id``, their number from 1 in walk order; of a path in several roots each has its own."""
    entries = read_inventory(spark, roots, exclude, levels).where("skipped is null")
    return number_entries(entries).withColumnRenamed("number", "id")


def hash_of(full: str, block: int = 1 << 18) -> str | None:
    """SHA-256 of a file, read in blocks; null if it cannot be read."""
    whole, buffer = hashlib.sha256(), bytearray(block)
    view = memoryview(buffer)
    try:
        with open(full, "rb", buffering=0) as file:
            while n := file.readinto(buffer):
                whole.update(view[:n])
    except OSError:
        return None
    return whole.hexdigest()


def hash_files(inventory: DataFrame, tasks: int | None = None) -> DataFrame:
    """(root, path, size, sha) of regular files (root, path, size), each read once as a stream of blocks.

    A hash reads its file in order, so a file is one task's work, and work is dealt by bytes: files are numbered from the
    largest down and go to the tasks to and fro, so that each gets one of the largest before any gets two."""
    tasks = tasks or int(inventory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = numbered(inventory.where("kind = 'file'").select("root", "path", "size"), [F.desc("size"), "root", "path"], "_rank")
    turn, place = F.expr(f"(_rank - 1) div {tasks}"), ((F.col("_rank") - 1) % tasks).cast("int")
    dealt = ranked.withColumn("_task", F.when(turn % 2 == 0, place).otherwise(tasks - 1 - place)).repartitionById(tasks, "_task")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas = [hash_of(os.path.join(root, path)) for root, path in zip(batch["root"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["root"], batch["path"], batch["size"], pa.array(shas, pa.string())], names=["root", "path", "size", "sha"])

    return dealt.select("root", "path", "size").mapInArrow(hashed, "root string, path string, size long, sha string")


def read_chunks(inventory: DataFrame, chunk_size: int | None = None, partitions: int | None = None) -> DataFrame:
    """(root, path, idx, off, len, sha, all_zero) of regular files.  The rows are byte ranges, dealt out by path and
    index, so that one large file is read by many tasks; a short read gives no row."""
    grid = grid_of(inventory.where("kind = 'file'").select("root", "path", "size"), chunk_size).select("root", "path", "idx", "off", "len")
    dealt = grid.repartition(partitions, "path", "idx") if partitions else grid.repartition("path", "idx")

    def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for root, path, idx, off, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with open(os.path.join(root, path), "rb") as file:
                        file.seek(off)
                        data = file.read(size)
                except OSError:
                    continue
                if len(data) == size:
                    rows.append((root, path, idx, off, size, hashlib.sha256(data).hexdigest(), not data.strip(b"\0")))
            names = ["root", "path", "idx", "off", "len", "sha", "all_zero"]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return dealt.mapInArrow(ranges, "root string, path string, idx long, off long, len long, sha string, all_zero boolean")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Whole small files: path, size, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), "content")


def compressibility(chunks: DataFrame, level: int = 3) -> DataFrame:
    """(path, idx, len, stored, how) of (path, idx, payload): all zero stores nothing, a smaller zstd frame replaces the
    bytes, anything else stays raw.  Levels go from 1 to 4."""
    level = min(max(level, 1), 4)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        codec = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            stored, how, sizes = [], [], []
            for data in batch["payload"].to_pylist():
                packed = len(codec.compress(data)) if data.strip(b"\0") else 0
                sizes.append(len(data))
                stored.append(min(packed, len(data)))
                how.append("zero" if packed == 0 else "zstd" if packed < len(data) else "raw")
            arrays = [batch["path"], batch["idx"], pa.array(sizes, pa.int64()), pa.array(stored, pa.int64()), pa.array(how, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["path", "idx", "len", "stored", "how"])

    return chunks.select("path", "idx", "payload").mapInArrow(measure, "path string, idx long, len long, stored long, how string")
