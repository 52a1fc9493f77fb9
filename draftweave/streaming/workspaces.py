"""Workspaces of newly arriving extraction documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from draftweave import schemas
from draftweave.functions import scalars as sc
from draftweave.operators import skew
from draftweave.plans.workspace import Workspace, build_workspace
from draftweave.sinks import documents
from draftweave.sources import extractions
from draftweave.streaming.keyed import BUCKET_BYTES, KeyedTable, newest

#: Batches between two compactions.
COMPACT_EVERY = 50


def _landed(spark: SparkSession, out_dir: str, bucket_bytes: int = BUCKET_BYTES) -> KeyedTable:
    fields = T._parse_datatype_string(schemas.EXTRACTION).fields
    return KeyedTable(spark, f"{out_dir}/landed", T.StructType([*fields, T.StructField("file", T.StringType())]), bucket_bytes=bucket_bytes)


def _workspaces(spark: SparkSession, out_dir: str, bucket_bytes: int = BUCKET_BYTES) -> KeyedTable:
    return KeyedTable(spark, f"{out_dir}/workspaces", T._parse_datatype_string(schemas.WORKSPACE), form="json", bucket_bytes=bucket_bytes)


def _components(spark: SparkSession, out_dir: str, schema: T.StructType | None = None, bucket_bytes: int = BUCKET_BYTES) -> KeyedTable:
    if schema is None:
        nothing = spark.createDataFrame([], schemas.EXTRACTION)
        schema = build_workspace(extractions.bom_rows(nothing), extractions.callout_rows(nothing)).components.schema
    return KeyedTable(spark, f"{out_dir}/components", schema, bucket_bytes=bucket_bytes)


def stream_workspaces(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    catalog: DataFrame | None = None,
    threshold: float = 0.75,
    available_now: bool = False,
    files_per_batch: int = 1000,
    compact_every: int = COMPACT_EVERY,
    bucket_bytes: int = BUCKET_BYTES,
) -> StreamingQuery:
    """Workspaces of all documents that new records touch (R-01).

    A record is one page. A batch lands its records first; then every document
    it touches is built anew from the newest record of each of its pages,
    whenever they came. Landed records, components and workspaces are tables by
    document (:class:`KeyedTable`): a batch reads the buckets of the documents
    it touches, not the history. Every ``compact_every`` batches the records
    and results that newer ones replaced are dropped and buckets that grew
    beyond ``bucket_bytes`` split. Broken records become failed workspaces.
    :func:`current_workspaces` reads the newest workspace of each document. A
    replayed batch replaces its own rows and changes nothing.
    """
    arriving = extractions.with_file(
        spark.readStream.schema(schemas.EXTRACTION).option("maxFilesPerTrigger", files_per_batch).json(in_dir)
    )

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        landed, made = _landed(session, out_dir, bucket_bytes), _workspaces(session, out_dir, bucket_bytes)
        parts = _components(session, out_dir, bucket_bytes=bucket_bytes)
        if batch_id - landed.current().base > compact_every:
            # All batches before this one are committed and never run again.
            landed.compact(batch_id - 1, lambda rows: newest_pages(rows.filter("doc_id is not null and _corrupt_record is null")))
            parts.compact(batch_id - 1, lambda rows: _of_newest(rows, made.rows(batch_id - 1)))
            made.compact(batch_id - 1, lambda rows: newest(rows, ["doc_id"]))
        mine = landed.append(batch, batch_id)
        touched = mine.select("doc_id").filter("doc_id is not null").distinct()
        # A replay must not see batches that came after it the first time. The pages are
        # chosen once: large documents, links and runs all read them from here.
        working = f"{out_dir}/working"
        rows = skew.written(newest_pages(landed.rows(batch_id, touched)).drop("_corrupt_record", "file", "batch_id"), working)
        ws = build_workspace(extractions.bom_rows(rows), extractions.callout_rows(rows), catalog, threshold)
        components = parts.append(ws.components, batch_id).drop("batch_id")
        runs = rows.groupBy("doc_id").agg(
            F.count(F.lit(1)).alias("pages_processed"),
            *[F.min_by(F.when(F.col(n) != "", F.col(n)), F.when(F.col(n) != "", sc.place())).alias(n) for n in ("drawing_number", "revision")],
            F.first("extraction_source", ignorenulls=True).alias("extraction_source"),
        )
        good = Workspace(components, ws.threshold, ws.hot).documents_of(runs)
        failed = documents.failed_workspaces(extractions.broken_records(mine))
        made.append(good.unionByName(failed).withColumn("metadata", F.col("metadata").dropFields("generated_at")), batch_id)
        store, path = landed._files()
        store.delete(path(working), True)

    writer = arriving.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def newest_pages(records: DataFrame) -> DataFrame:
    """The newest record of each page: of the last batch, the last file by name, and the greatest digest of the whole record.

    Only records of one page, batch and file are told apart by their digest.
    """
    page = F.coalesce("page_id", F.lit("page_001"))
    whole = F.sha2(F.to_json(F.struct(*[c for c in records.columns if c not in ("batch_id", "file")])), 256)
    same = W.partitionBy("doc_id", page, "batch_id", "file")
    order = W.partitionBy("doc_id", page).orderBy(F.desc("batch_id"), F.desc("file"), F.desc("_whole"))
    rows = records.withColumn("_same", F.count(F.lit(1)).over(same)).withColumn("_whole", F.when(F.col("_same") > 1, whole))
    return rows.withColumns({"_n": F.row_number().over(order), "page_id": page}).filter("_n = 1").drop("_n", "_whole", "_same")


def _of_newest(components: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Components of the newest workspace of each document, which may have none."""
    last = workspaces.groupBy("doc_id").agg(F.max("batch_id").alias("batch_id"))
    return components.join(last, ["doc_id", "batch_id"], "left_semi")


def current_workspaces(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest workspace of each document of the stream."""
    return newest(_workspaces(spark, out_dir).rows(), ["doc_id"]).drop("batch_id")


def current_components(spark: SparkSession, out_dir: str) -> DataFrame:
    """The components of the newest workspace of each document."""
    return _of_newest(_components(spark, out_dir).rows(), _workspaces(spark, out_dir).rows()).drop("batch_id")
