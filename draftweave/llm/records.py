"""Token ids in files of length-delimited binary records, with an offset index.

A file holds records one after the other::

    length   unsigned 64-bit, bytes of the payload
    check    masked CRC-32 of the eight length bytes
    payload  token ids, unsigned, 16 or 32 bits each
    check    masked CRC-32 of the payload

all little-endian. A checksum ``c`` is masked as ``(c >> 15 | c << 17) +
0xA282EAD8`` modulo 2^32, so that checksums of data holding checksums stay
sound. Files are numbered in ``doc_id`` order. The index is a table beside
them, a row for each record, by which readers fetch records in any order.

A task writes its file under a name of its own and moves it into place when
it is whole, so a repeated or lost task leaves nothing half done. The folder's
file system has to be one that Arrow opens (local or mounted, HDFS, S3, GCS).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from draftweave.llm import tokens
from draftweave.llm.storage import stored

_FRAME = struct.Struct("<QI")
_CHECK = struct.Struct("<I")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + _CHECK.pack(masked(size)) + payload + _CHECK.pack(masked(payload))


def payload_of(record: bytes) -> bytes:
    """The payload of one record; raises when a checksum or length is wrong."""
    size, check = _FRAME.unpack_from(record)
    if check != masked(record[:8]) or len(record) != size + 16:
        raise ValueError("a record's length is damaged")
    payload = record[12:-4]
    if masked(payload) != _CHECK.unpack(record[-4:])[0]:
        raise ValueError("a record's payload is damaged")
    return payload


def _file(folder: str, number: int) -> str:
    return f"{folder}/part-{number:06d}.rec"


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write(
    docs: DataFrame, folder: str, vocabulary: str, end: int, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Encode every text, append ``end``, write files and index below ``folder``; returns the index.

    Rows are written in ascending ``doc_id``, null ids first, rows of one id
    by a fingerprint of their text; repeated rows give a record each. Null and
    empty texts give a record of the end id alone. An empty table gives an
    empty index. Other columns are not looked at. A text of any length is one
    record; a worker's memory grows with the longest one.
    """
    spark = docs.sparkSession
    shared = tokens.vocabulary(spark, vocabulary)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    data = f"{folder}/records"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        store, path = _opened(data)
        out, name, at, width = None, f"{path}/.{uuid.uuid4().hex}", 0, None
        for part, ids, bounds in tokens.encoded(batches, "text", shared, end):
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(name)
                width = np.uint16 if max(tokens.encoder(shared).tokenizer.get_vocab_size(True), end + 1) <= 1 << 16 else np.uint32
            raw = ids.astype(f"<u{np.dtype(width).itemsize}").tobytes()
            step = np.dtype(width).itemsize
            offsets, sizes = [], []
            pieces = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                record = framed(raw[a * step : b * step])
                offsets.append(at)
                sizes.append(len(record))
                at += len(record)
                pieces.append(record)
            out.write(b"".join(pieces))
            n = part.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int32()), pa.array(offsets, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array([step] * n, pa.int32()), part.column(0)],
                names=["file", "offset", "bytes", "width", "doc_id"],
            )
        if out is not None:
            out.close()
            store.move(name, _file(path, number))

    placed.mapInArrow(written, f"file int, offset long, bytes long, width int, doc_id {kind}").write.parquet(f"{folder}/index")
    return index(spark, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """``file, offset, bytes, width, doc_id`` of every record, in the file's order of ``offset``."""
    return spark.read.parquet(f"{folder}/index")


def read(entries: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """Records of these index entries, checked: the entry with ``ids, n_tokens, ids_crc32``.

    Entries may come in any order and number. ``ids_crc32`` is of the ids as
    little-endian unsigned 32-bit integers. With ``ids=False`` the list is left
    out.
    """
    data = f"{folder}/records"

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _opened(data)
        name, source = None, None
        for batch in batches:
            at = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("file", "offset", "bytes", "width")}
            lists, counts, sums = [], [], []
            buffer, base = b"", 0
            for i in range(batch.num_rows):
                wanted, offset, size = _file(path, int(at["file"][i])), int(at["offset"][i]), int(at["bytes"][i])
                if wanted != name:
                    if source is not None:
                        source.close()
                    name, source, buffer = wanted, store.open_input_file(wanted), b""
                if not (base <= offset and offset + size <= base + len(buffer)):
                    # Neighbours in the batch are mostly neighbours in the file: one read serves many.
                    base, buffer = offset, source.read_at(max(size, 1 << 20), offset)
                payload = payload_of(buffer[offset - base : offset - base + size])
                found = np.frombuffer(payload, f"<u{at['width'][i]}").astype("<u4")
                counts.append(len(found))
                sums.append(zlib.crc32(found.tobytes()))
                if ids:
                    lists.append(found.astype(np.int64))
            columns = [*batch.columns, *([pa.array(lists, pa.list_(pa.int64()))] if ids else []), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(["ids"] if ids else []), "n_tokens", "ids_crc32"])
        if source is not None:
            source.close()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema.fields)
    return entries.mapInArrow(fetched, fields + (", ids array<long>" if ids else "") + ", n_tokens long, ids_crc32 long")


def in_order(spark: SparkSession, folder: str) -> DataFrame:
    """All records in ``doc_id`` order: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all records before. Only one row for each file
    meets in one place; within a file, records number what a task has written.
    """
    entries = index(spark, folder).repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    rows = read(entries, folder, ids=False).drop("bytes", "width")
    rows = stored(rows.withColumn("inside", F.sum("n_tokens").over(W.partitionBy("file").orderBy("offset")) - F.col("n_tokens")))
    files = rows.groupBy("file").agg(F.max(F.col("inside") + F.col("n_tokens")).alias("n"))
    before = files.select("file", (F.sum("n").over(W.orderBy("file")) - F.col("n")).alias("before"))
    return rows.join(before, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
