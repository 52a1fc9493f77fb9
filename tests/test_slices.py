"""Tables written in slices: all rows, one slice's shuffle files at a time."""

import pytest
from pyspark.sql import functions as F

from draftweave.operators import skew
from draftweave.plans.workspace import build_workspace
from draftweave.sinks import documents
from draftweave.sources.workspaces import component_rows, read_workspace

from tests.conftest import rows


@pytest.fixture
def workspace(spark, tmp_path):
    some = spark.range(600).select(F.floor(F.col("id") / 6).alias("doc_id"), F.col("id").alias("ord"), (F.col("id") % 4).cast("string").alias("n"))
    bom = some.union(some.filter("doc_id = 7").withColumn("doc_id", F.lit(None).cast("bigint")))
    bom.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = spark.read.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.draftweave.sliceBytes", "1")
    size = skew.slices_of(read, read)
    spark.conf.set("spark.draftweave.sliceBytes", str(size // 3 + 1))
    yield build_workspace(read.select("doc_id", F.col("ord").alias("bom_ord"), F.col("n").alias("item_number")),
                          read.filter("ord % 3 = 0").select("doc_id", F.col("ord").alias("call_ord"), F.col("n").alias("bubble_number")))
    spark.conf.unset("spark.draftweave.sliceBytes")


def shuffles(spark):
    return {i for i in range(spark.sparkContext._jsc.sc().newShuffleId()) if spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().containsShuffle(i)}


def test_slices_hold_all_rows_and_leave_no_shuffle(spark, tmp_path, workspace):
    assert workspace.slices == 3
    names = ["doc_id", "seq", "item_number", "bubble_number", "status"]
    want = rows(workspace.components, *names)
    before = shuffles(spark)
    stored = workspace.stored(str(tmp_path / "c"))
    documents.write_workspace(workspace.documents, str(tmp_path / "w"), slices=workspace.slices)
    assert shuffles(spark) <= before
    assert rows(stored.components, *names) == want and (tmp_path / "c" / "_SUCCESS").exists()
    assert component_rows(read_workspace(spark, str(tmp_path / "w"))).count() == len(want)


def test_a_slice_reads_its_documents_only(workspace):
    plan = workspace.components.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") < plan.index("pmod(xxhash64")


def test_writing_that_stops_has_no_mark_of_success(spark, tmp_path, workspace):
    def stops(writer, mode):
        if mode == "append":
            raise RuntimeError
        writer.mode(mode).parquet(str(tmp_path / "c"))

    with pytest.raises(RuntimeError):
        skew.write_in_slices(workspace.components, "doc_id", 3, stops, "overwrite")
    assert not (tmp_path / "c" / "_SUCCESS").exists()
    assert spark.conf.get(skew._CLEANUP) == "false"


def test_inputs_that_take_work_are_read_once(spark):
    some = spark.range(10)
    assert skew.slices_of(some) == 1 and skew.slices_of(some.groupBy("id").count(), some) == 1
