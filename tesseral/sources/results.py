"""Result files and printed reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.functions.terms import PHASES, expected_verdict, timing_line


def report(solved: DataFrame, timing: bool = True) -> DataFrame:
    """The columns of a results file: file, result (upper-case ERROR for failures),
    wall seconds, the phases if asked for, and the error."""
    if timing:
        phases = [F.col(f"{p}_s") for p in PHASES if p != "total"]
        return solved.select(F.col("inst").alias("file"), F.col("verdict").alias("result"), F.col("total_s").alias("wall_s"), *phases, "error")
    return solved.select(F.col("inst").alias("file"), F.col("verdict").alias("result"), F.col("total_s").alias("time_secs"), "error")


def write_csv(results: DataFrame, path: str) -> None:
    """One CSV file with a header, in a folder; results are one short row a script."""
    results.coalesce(1).write.option("header", True).mode("overwrite").csv(path)


def timing_lines(solved: DataFrame) -> DataFrame:
    """(inst, line) of scripts that were solved."""
    return solved.filter("error IS NULL").select("inst", timing_line(*(F.col(f"{p}_s") for p in PHASES)).alias("line"))


def mismatches(solved: DataFrame) -> DataFrame:
    """(inst, verdict, expected) where the verdict isn't what the file's name states."""
    return solved.withColumn("expected", expected_verdict(F.col("inst"))).filter(~F.col("verdict").eqNullSafe(F.col("expected"))).select("inst", "verdict", "expected")
