"""Inventory of drawing files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftweave.operators import inventory, skew

HEADER_BYTES = 8
LISTED = 10_000
ENTRIES = "name string, length long, folder boolean"
SCHEMA = "name string, length long, header binary"
Batches = Iterator[pa.RecordBatch]


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _entries(root: str) -> Callable[[Batches], Batches]:
    """Task that lists the folders it is given, each one level deep; names are relative to ``root``."""
    def run(batches: Batches) -> Batches:
        store, base = fs.FileSystem.from_uri(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                place = base + folder or "/"
                at = store.get_file_info(place)
                single = at.type == fs.FileType.File
                found = [at] if single else store.get_file_info(fs.FileSelector(place))
                found = [e for e in found if single or not _hidden(e.base_name)]
                for i in range(0, len(found), LISTED):
                    part = found[i:i + LISTED]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([e.path[len(base):] for e in part], pa.string()),
                        pa.array([e.size for e in part], pa.int64()),
                        pa.array([e.type == fs.FileType.Directory for e in part], pa.bool_()),
                    ], names=["name", "length", "folder"])
    return run


def _headers(root: str) -> Callable[[Batches], Batches]:
    """Task that opens each listed file for its first bytes; the rest of it is never read, an empty one not opened."""
    def run(batches: Batches) -> Batches:
        store, base = fs.FileSystem.from_uri(root)
        base = base.rstrip("/")

        def first(name: str, length: int) -> bytes:
            if length == 0:
                return b""
            with store.open_input_file(base + name) as source:
                return source.read(HEADER_BYTES)

        for batch in batches:
            names, lengths = batch.column(0), batch.column(1)
            found = [first(n, size) for n, size in zip(names.to_pylist(), lengths.to_pylist())]
            yield pa.RecordBatch.from_arrays([names, lengths, pa.array(found, pa.binary())], names=["name", "length", "header"])
    return run


def read_drawing_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and first bytes of every file under ``path`` (S-03).

    Tasks list the folders, level by level: the folders found on one level are
    the rows of the next, so the driver sees neither files nor folders and
    takes one round a level of depth. What a level holds is written to the
    shared folder. Files are then dealt by name to the tasks that open them. A
    single folder is listed by one task, which keeps the names of that folder.

    Names that begin with a dot or an underscore are passed over, folders of
    such names too, and ``pattern`` holds for the name of a file, both as in
    Spark's readers. Empty files have an empty header; an empty folder gives no
    rows. ``path`` may also be one file; a missing one raises. The file system
    has to be one that Arrow opens.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(conf)
    if not store.exists(top):
        raise FileNotFoundError(path)
    top = store.makeQualified(top)
    root = top.toUri().toString()
    # Reading and listing wait for the file system: more tasks than bytes would ask for.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    level, levels = spark.createDataFrame([("",)], "name string"), []
    while not levels or not level.isEmpty():
        levels.append(skew.written(level.mapInArrow(_entries(root), ENTRIES)))
        level = levels[-1].filter("folder").select("name").repartition(parts, "name")
    wanted = F.regexp_extract("name", "([^/]*)$", 1) if not store.getFileStatus(top).isFile() else F.lit(top.getName())
    glob = jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    files = reduce(DataFrame.unionByName, levels).filter(~F.col("folder") & wanted.rlike(f"^(?:{glob})$")).select("name", "length")
    opened = files.repartition(parts, "name").mapInArrow(_headers(root), SCHEMA)
    return opened.select(F.concat(F.lit(top.toString().rstrip("/")), "name").alias("path"), "length", "header")


def document_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Checked drawing files, bad ones with their reason."""
    return inventory.file_checks(read_drawing_files(spark, path))
