"""Scripts that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tesseral.plans.solver import solve_scripts
from tesseral.sources.scripts import named_scripts


def watch_folder(spark: SparkSession, folder: str, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Solve each ``*.smt2`` file that appears in ``folder`` and append verdicts as
    Parquet to ``sink``. Each file is solved once, also over restarts; with ``once``
    the query ends when all present files are done."""
    files = spark.readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", "*.smt2").load(folder)
    scripts = named_scripts(files)

    def solve(batch: DataFrame, epoch: int) -> None:
        solve_scripts(batch).write.mode("append").parquet(sink)

    stream = scripts.writeStream.foreachBatch(solve).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
