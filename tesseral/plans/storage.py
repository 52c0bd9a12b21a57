"""Written tables in the shared folder: the way iterated plans are cut.

A table that an iteration hands on is written as Parquet and read again with its
schema. This cuts the lineage, outlives lost executors, and gives the planner the
true size at each step; checkpointed frames keep estimates that multiply.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session. Only on one machine, where it is unset, a temporary folder is made and
    set as the checkpoint folder; on a cluster that raises ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tesseral-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_MADE: list[str] = []  # folders of this process


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tesseral-{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear_written(spark: SparkSession) -> None:
    """Delete all tables that this process has written and not dropped: once results
    that come from them are saved or collected."""
    while _MADE:
        _delete(spark, _MADE.pop())


def written(df: DataFrame, name: str, compact: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back. ``compact``:
    where many tasks make few rows each, in few files of the advisory size."""
    path = new_path(df.sparkSession, name)
    schema = df.schema
    df = df.hint("rebalance") if compact else df
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(spark, folder)
