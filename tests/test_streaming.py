"""The stream over many batches: what it reads, what it keeps, and what a replay changes."""

import hashlib
import json

from pyspark.sql import functions as F

from draftweave.operators import skew
from draftweave.streaming import keyed, workspaces
from draftweave.streaming.keyed import KeyedTable, newest
from draftweave.streaming.workspaces import _landed, current_components, current_workspaces, newest_pages, stream_workspaces

from tests.conftest import rows


def page(doc, number, item):
    return json.dumps({"doc_id": doc, "page_id": f"page_{number:03d}", "bom_items": [{"item_number": item, "description": hashlib.sha512(f"{doc} {number}".encode()).hexdigest() * 2}]})


def input_bytes(spark):
    """Bytes that all finished stages have read so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).inputBytes() for i in range(stages.size()))


def run(spark, base, **more):
    stream_workspaces(spark, str(base / "in"), str(base / "out"), str(base / "at"), available_now=True, **more).awaitTermination()


def test_a_batch_reads_the_documents_it_touches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    read = []
    for n in range(2):
        docs = [f"d{i}" for i in range(1000 * n, 1000 * (n + 1))]
        (tmp_path / "in" / f"{2 * n}.json").write_text("\n".join(page(d, 1, str(i % 5)) for i, d in enumerate(docs)))
        run(spark, tmp_path, compact_every=1, bucket_bytes=30_000)
        (tmp_path / "in" / f"{2 * n + 1}.json").write_text(page("d7", n + 2, "9"))
        before = input_bytes(spark)
        run(spark, tmp_path, compact_every=10**6, bucket_bytes=30_000)
        read.append(input_bytes(spark) - before)
    landed = _landed(spark, str(tmp_path / "out"), 30_000)
    assert landed.compact(3, newest_pages).bits > keyed.FIRST_BITS
    # The history is twice as long; one document still costs about the same.
    assert read[-1] < 1.4 * read[0]
    found = {r["doc_id"]: r["metadata"]["pages_processed"] for r in current_workspaces(spark, str(tmp_path / "out")).collect()}
    assert len(found) == 2000 and found.pop("d7") == 3 and set(found.values()) == {1}


#: Batches with late and replaced pages, a broken record and a document that loses its rows, and the items after each.
STEPS = [
    ([page("a", 1, "1"), page("b", 1, "2"), "{broken"], [("a", "1"), ("b", "2")]),
    ([page("a", 2, "3"), page("b", 1, "4"), page("c", 1, "5")], [("a", "1"), ("a", "3"), ("b", "4"), ("c", "5")]),
    ([json.dumps({"doc_id": "c", "page_id": "page_001"}), page("a", 1, "6"), page("d", 1, "7")], [("a", "3"), ("a", "6"), ("b", "4"), ("d", "7")]),
]


def test_workspaces_of_a_stream_are_compressed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text(page("a", 1, "1"))
    run(spark, tmp_path)
    parts = [f.name for f in (tmp_path / "out" / "workspaces").rglob("part-*")]
    assert parts and all(name.endswith(".json.gz") for name in parts)
    assert current_workspaces(spark, str(tmp_path / "out")).count() == 1


def outcome(spark, base):
    out = str(base / "out")
    parts = rows(current_components(spark, out), "doc_id", "item_number")
    return parts, sorted(r.metadata.pages_processed or 0 for r in current_workspaces(spark, out).collect())


def test_compaction_and_replays_change_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n, (lines, want) in enumerate(STEPS):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(lines))
        run(spark, tmp_path, compact_every=0)
        assert outcome(spark, tmp_path)[0] == want
    seen = outcome(spark, tmp_path)
    assert seen[1] == [0, 1, 1, 1, 2]
    # A batch whose commit was lost runs again.
    for f in (tmp_path / "at" / "commits").iterdir():
        if f.name in ("2", ".2.crc"):
            f.unlink()
    run(spark, tmp_path, compact_every=0)
    assert outcome(spark, tmp_path) == seen


def test_keyed_table(spark, tmp_path):
    some = spark.range(100).select(F.col("id").cast("string").alias("doc_id"), F.lit(1).alias("n"))
    table = KeyedTable(spark, str(tmp_path / "t"), some.schema, bucket_bytes=200)
    assert table.rows().count() == 0
    table.append(some, 0)
    table.append(some.limit(0), 1)
    table.append(some.filter("doc_id < 5").withColumn("n", F.lit(2)), 2)
    want = rows(newest(table.rows(), ["doc_id"]).drop("batch_id"))
    half = table._opened(1, 6, 1)
    some.write.parquet(f"{half.folder}/landing=0/bucket=0")  # a compaction that broke off
    first = table.compact(1, lambda r: newest(r, ["doc_id"]))
    assert table.current() == first and table.compact(1, lambda r: r.limit(0)) == first
    table.append(some.filter("doc_id < 5").withColumn("n", F.lit(2)), 2)
    assert rows(newest(table.rows(), ["doc_id"]).drop("batch_id")) == want
    assert table.rows(keys=some.filter("doc_id = '7'")).count() == 1 and table.rows(upto=1).count() == 100
    table.compact(2, lambda r: newest(r, ["doc_id"]))
    assert rows(table.rows().drop("batch_id")) == want and table.current().bits > keyed.FIRST_BITS


def test_a_batch_chooses_its_pages_once_and_leaves_no_working_rows(spark, tmp_path, monkeypatch):
    chosen = []

    def counted(records):
        chosen.append(records)
        return newest_pages(records)

    stored, written = [], skew.written
    monkeypatch.setattr(workspaces, "newest_pages", counted)
    monkeypatch.setattr(skew, "written", lambda rows, *path: stored.append(rows) or written(rows, *path))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join([page("a", 1, "1"), page("b", 1, "2")]))
    run(spark, tmp_path)
    assert len(chosen) == 1 and len(stored) == 1
    assert outcome(spark, tmp_path) == ([("a", "1"), ("b", "2")], [1, 1])
    assert not (tmp_path / "out" / "working").exists()


def test_records_of_one_file_are_told_apart_by_their_digest(spark):
    made = [("d", "p", 0, "f", "x"), ("d", "p", 0, "f", "y"), ("d", "p", 0, "e", "z"), ("d", "q", 0, "f", "v"), ("d", "q", 1, "a", "w"), (None, None, 0, "f", "u")]
    records = spark.createDataFrame(made, "doc_id string, page_id string, batch_id int, file string, text string")
    last = max("xy", key=lambda t: hashlib.sha256(f'{{"doc_id":"d","page_id":"p","text":"{t}"}}'.encode()).hexdigest())
    assert rows(newest_pages(records), "page_id", "text") == [("p", last), ("page_001", "u"), ("q", "w")]


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    some = spark.range(0, 40_000, 1, 8).select(F.lit("d").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("t"))
    table = KeyedTable(spark, str(tmp_path / "t"), some.schema)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300k")
    try:
        assert table.append(some, 0).count() == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t").rglob("part-*.parquet"))) > 1
