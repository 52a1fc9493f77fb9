"""Tables and files kept in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a folder of its own;
    any other session is refused, as its executors could not see that folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = "file://" + tempfile.mkdtemp(prefix="draftweave-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """Write ``frame`` once and read it back: lineage ends at the written files."""
    path = scratch(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def dropped(frame: DataFrame) -> None:
    """Delete the files behind a stored table that nothing reads any more."""
    jvm = frame.sparkSession.sparkContext._jvm
    conf = frame.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for file in frame.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(conf).delete(path, False)
