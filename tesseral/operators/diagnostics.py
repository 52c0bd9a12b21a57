"""Counts, listings and summary statistics of class tables and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesseral.functions.terms import display
from tesseral.plans.storage import written


def class_counts(rep: DataFrame) -> DataFrame:
    """(inst, num_classes, num_enodes)."""
    return rep.groupBy("inst").agg(F.countDistinct("rep").alias("num_classes"), F.count("*").alias("num_enodes"))


def class_header(rep: DataFrame) -> DataFrame:
    """(inst, line): the first line of a listing, with the instance's counts."""
    return class_counts(rep).select("inst", F.format_string("%d classes, %d terms", "num_classes", "num_enodes").alias("line"))


def class_members(nodes: DataFrame, rep: DataFrame) -> DataFrame:
    """(inst, rep, id, member): the listing with a row for each term, for classes that
    are too large for a line."""
    return nodes.join(rep, ["inst", "id"]).select("inst", "rep", "id", display(F.col("op"), F.col("children")).alias("member"))


def class_listing(nodes: DataFrame, rep: DataFrame) -> DataFrame:
    """(inst, rep, line): ``class i: {n1, n2}``, members in order of their text. A line
    holds its whole class; see :func:`class_members`."""
    named = nodes.join(rep, ["inst", "id"]).select("inst", "rep", display(F.col("op"), F.col("children")).alias("member"))
    members = F.array_join(F.array_sort(F.collect_list("member")), ", ")
    return named.groupBy("inst", "rep").agg(F.format_string("class %d: {%s}", F.first("rep"), members).alias("line"))


def upper_medians(data: DataFrame, keys: list[str], value: str, name: str = "upper_median") -> DataFrame:
    """For each key the element at place floor(n / 2) of its n sorted values, nulls
    aside. Equal values are counted first, so ties shrink before they move; counts are
    dealt by ranges of key and value, and a key that spans many ranges is no single
    task's work: the sums of its ranges tell in which the element lies, and only that
    range is ranked."""
    counts = data.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    dealt = written(counts.repartitionByRange(*keys, value).withColumn("__range", F.spark_partition_id()), "ranges")
    in_order = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_key = Window.partitionBy(*keys)
    sums = dealt.groupBy(*keys, "__range").agg(F.sum("__n").alias("__here"))
    sums = sums.withColumn("__upto", F.sum("__here").over(in_order)).withColumn("__place", F.floor(F.sum("__here").over(of_key) / 2))
    there = sums.filter("__upto - __here <= __place AND __place < __upto").select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__range").alias("__r"), (F.col("__place") - F.col("__upto") + F.col("__here")).alias("__place"))
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = dealt.join(there, same).withColumn("__upto", F.sum("__n").over(inside))
    return ranked.filter("__upto - __n <= __place AND __place < __upto").select(*keys, F.col(value).alias(name))


def summary(data: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Total, least, greatest and upper median for each key."""
    rows = data.groupBy(*keys).agg(F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(value).alias("n"))
    return rows.join(upper_medians(data, keys, value), keys, "left")


def throughput(data: DataFrame, keys: list[str], operations: str, seconds: str) -> DataFrame:
    """Million operations a second in the fastest trial of each key."""
    return data.groupBy(*keys).agg((F.max(F.col(operations) / F.col(seconds)) / 1e6).alias("mops"))


def speedup(data: DataFrame, key: str, seconds: str, base) -> DataFrame:
    """Best seconds of each key, and how often they go into those of ``base``."""
    best = data.groupBy(key).agg(F.min(seconds).alias("best"))
    ref = best.filter(F.col(key) == base).select(F.col("best").alias("__base"))  # one row
    return best.join(F.broadcast(ref), how="cross").select(key, "best", (F.col("__base") / F.col("best")).alias("speedup"))
