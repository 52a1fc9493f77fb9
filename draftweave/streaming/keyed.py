"""A table that grows by batches and is read by key.

Rows are laid out by the leading bits of a hash of their key: a folder for the
base and one for each batch since, and below it a folder a bucket. Whoever asks for some keys reads their buckets
only. A compaction writes the rows still wanted into a new generation, with as
many buckets as keep one at ``BUCKET_BYTES``, so a key costs a bounded number
of bytes however long the history is. A generation is current once it is whole;
the one before is kept for readers under way, older ones are removed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that a bucket should hold after a compaction.
BUCKET_BYTES = 32 << 20

#: Hash bits of a new table, and the most that a compaction chooses.
FIRST_BITS, MOST_BITS = 4, 16

_FOLDER = re.compile(r"gen-(\d+)-bits-(\d+)-base-(-?\d+)")


@dataclass(frozen=True)
class Generation:
    """Folder, number, hash bits, and the last batch that its base holds."""

    folder: str
    number: int
    bits: int
    base: int


def bucket_of(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int") if bits else F.lit(0)


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    folder: str
    schema: T.StructType
    key: str = "doc_id"
    form: str = "parquet"
    bucket_bytes: int = BUCKET_BYTES

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _generations(self) -> list[Generation]:
        """Whole generations, the newest first."""
        store, path = self._files()
        found = []
        if store.exists(path(self.folder)):
            for entry in store.listStatus(path(self.folder)):
                name = entry.getPath().getName()
                m = _FOLDER.fullmatch(name)
                if m and store.exists(path(f"{self.folder}/{name}.done")):
                    found.append(Generation(f"{self.folder}/{name}", *map(int, m.groups())))
        return sorted(found, key=lambda g: -g.number)

    def _opened(self, number: int, bits: int, base: int) -> Generation:
        return Generation(f"{self.folder}/gen-{number:06d}-bits-{bits:02d}-base-{base}", number, bits, base)

    def _finish(self, made: Generation) -> Generation:
        store, path = self._files()
        store.mkdirs(path(made.folder))
        store.create(path(f"{made.folder}.done"), True).close()
        return made

    def current(self) -> Generation:
        found = self._generations()
        return found[0] if found else self._finish(self._opened(0, FIRST_BITS, -1))

    def _write(self, rows: DataFrame, into: Generation, landing: int) -> None:
        bucket = bucket_of(F.col(self.key), into.bits)
        placed = rows.select(*self.schema.fieldNames(), F.col("batch_id").cast("long"), bucket.alias("bucket"))
        # A rebalance deals rows by bucket as an exchange does, and splits what is too large for one task.
        writer = placed.hint("rebalance", F.col("bucket")).write.mode("overwrite").format(self.form).partitionBy("bucket")
        (writer.option("compression", "gzip") if self.form == "json" else writer).save(f"{into.folder}/landing={landing}")

    def _read(self, kept: Generation) -> DataFrame:
        fields = [*self.schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("landing", T.LongType()), T.StructField("bucket", T.IntegerType())]
        return self.spark.read.schema(T.StructType(fields)).format(self.form).load(kept.folder)

    def append(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Write a batch, in place of what an earlier run of it left, and return its rows as stored."""
        into = self.current()
        self._write(rows.withColumn("batch_id", F.lit(batch_id)), into, batch_id)
        return self._read(into).filter(F.col("landing") == batch_id).drop("landing", "bucket")

    def rows(self, upto: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Rows with their ``batch_id``, of batches up to ``upto`` and of these keys only.

        The buckets of the keys, at most ``2 ** bits`` numbers, select folders.
        """
        kept = self.current()
        found = self._read(kept)
        if upto is not None:
            found = found.filter((F.col("landing") <= upto) & (F.col("batch_id") <= upto))
        if keys is not None:
            wanted = keys.select(bucket_of(F.col(self.key), kept.bits).alias("bucket")).distinct().collect()
            found = found.filter(F.col("bucket").isin([r.bucket for r in wanted])).join(keys.select(self.key), self.key, "left_semi")
        return found.drop("landing", "bucket")

    def compact(self, upto: int, keep: Callable[[DataFrame], DataFrame]) -> Generation:
        """Carry what ``keep`` leaves of the batches up to ``upto`` into a new generation.

        Call it for committed batches only: none of them may run again. Rows
        keep their ``batch_id``. Running it again, whole or after a break,
        gives the same table.
        """
        old = self.current()
        if old.base >= upto:
            return old
        store, path = self._files()
        size = store.getContentSummary(path(old.folder)).getLength()
        bits = min(MOST_BITS, max(old.bits, (max(1, size) // self.bucket_bytes).bit_length()))
        made = self._opened(old.number + 1, bits, upto)
        self._write(keep(self.rows(upto)), made, upto)
        for gone in self._generations()[1:]:
            store.delete(path(f"{gone.folder}.done"), False)
            store.delete(path(gone.folder), True)
        return self._finish(made)


def newest(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the newest batch of each key; one pre-aggregated row a key and batch decides."""
    last = rows.groupBy(*key).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(last, [*key, "batch_id"], "left_semi")
