"""Keyed batch aggregation.

Built-in aggregates give partial sums before the shuffle, which takes care of heavy
keys. An aggregate of one's own is a pair of functions: ``apply`` makes a state of a
run of values, ``combine`` one of several states; their result must not depend on
how values are split into runs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def with_empty_buckets(spark: SparkSession, reduced: DataFrame, buckets: int, key: str, zero: dict) -> DataFrame:
    """``reduced`` with a row for each key in [0, buckets); missing ones get ``zero``."""
    every = spark.range(buckets).select(F.col("id").alias(key))
    return every.join(reduced, key, "left").fillna(zero)


def collect_reduce(data: DataFrame, key: str, buckets: int | None = None, zero: dict | None = None, **aggregates: Column) -> DataFrame:
    """One row for each key: hash aggregation, partial before the shuffle. With
    ``buckets`` also keys without rows."""
    reduced = data.groupBy(key).agg(*(c.alias(n) for n, c in aggregates.items()))
    return reduced if buckets is None else with_empty_buckets(data.sparkSession, reduced, buckets, key, zero or dict.fromkeys(aggregates, 0))


def by_runs(apply: Callable[[pd.Series], object], combine: Callable[[list], object]) -> tuple[Callable, Callable]:
    """Reducers of sorted runs made of functions of one run: a call for each run."""

    def objects(found: list) -> np.ndarray:
        out = np.empty(len(found), object)
        out[:] = found
        return out

    cuts = lambda values, starts: zip(starts.tolist(), [*starts[1:].tolist(), len(values)])
    first = lambda values, starts: objects([apply(pd.Series(values[x:y])) for x, y in cuts(values, starts)])
    then = lambda states, starts: objects([combine(states[x:y].tolist()) for x, y in cuts(states, starts)])
    return first, then


def _runs(codes: np.ndarray) -> np.ndarray:
    """Where runs of equal codes begin."""
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)


def collect_reduce_sorted(data: DataFrame, key: str, value: str, apply: Callable[[pd.Series], object] | None = None, combine: Callable[[list], object] | None = None, name: str = "state", kind: str = "bigint", buckets: int | None = None, zero: object = 0, reduceat: Callable | None = None) -> DataFrame:
    """The same by sorting, for an aggregate of one's own over ``value``.

    Each task first reduces its own rows, a million at a time, to a state for each
    key, in sorted runs; the states are dealt by key, sorted and combined. So a key
    with a third of all rows sends few states a task. Null keys are a key.

    ``reduceat(values, starts)`` reduces the runs of an array that begin at
    ``starts`` (as ``np.add.reduceat``) at once, values and states alike; ``apply``
    and ``combine`` are called for each run instead."""
    key_type = data.schema[key].dataType.simpleString()
    first, then = (reduceat, reduceat) if reduceat is not None else by_runs(apply, combine)
    schema = f"k {key_type}, s {kind}"
    fields = T.StructType([T.StructField("k", data.schema[key].dataType), T.StructField("s", T._parse_datatype_string(kind))])
    state_type = to_arrow_type(fields["s"].dataType)

    def partial(batches):
        held, n = [], 0

        def reduced():
            table = pa.Table.from_batches(held).combine_chunks()
            code = table.column("k").combine_chunks().dictionary_encode(null_encoding="encode")
            index = code.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(index, kind="stable")
            starts = _runs(index[order])
            values = table.column("v").to_numpy()[order]
            keys = code.dictionary.take(pa.array(index[order][starts]))
            return pa.RecordBatch.from_arrays([keys, pa.array(first(values, starts), state_type)], names=["k", "s"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 1 << 20:
                yield reduced()
                held, n = [], 0
        if n:
            yield reduced()

    def final(batches):
        last = None  # key and state of a run that may go on in the next batch
        for batch in batches:  # sorted by key
            if not batch.num_rows:
                continue
            keys, states = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            if last is not None:
                keys = pa.concat_arrays([last[0], keys])
                states = np.concatenate([last[1], states])
            code = keys.dictionary_encode(null_encoding="encode")
            starts = _runs(code.indices.to_numpy(zero_copy_only=False))
            done, at = then(states, starts), keys.take(pa.array(starts))
            last = at.slice(len(at) - 1), done[-1:]
            if len(at) > 1:
                yield pa.RecordBatch.from_arrays([at.slice(0, len(at) - 1), pa.array(done[:-1], state_type)], names=["k", "s"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([last[0], pa.array(last[1], state_type)], names=["k", "s"])

    states = data.select(F.col(key).alias("k"), F.col(value).alias("v")).mapInArrow(partial, schema)
    reduced = states.repartition("k").sortWithinPartitions("k").mapInArrow(final, schema).withColumnsRenamed({"k": key, "s": name})
    return reduced if buckets is None else with_empty_buckets(data.sparkSession, reduced, buckets, key, {name: zero})


def collect_reduce_sequential(data: DataFrame, key: str, value: str, buckets: int, name: str = "total") -> DataFrame:
    """Sums for keys in [0, buckets) by one loop in one task: the baseline to which
    parallel runs compare, and nothing else."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(sums, batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(sums)], names=["k", "s"])

    rows = data.select(F.col(key).cast("bigint").alias("k"), F.col(value).cast("bigint").alias("v")).repartition(1)
    return rows.mapInArrow(run, "k bigint, s bigint").withColumnsRenamed({"k": key, "s": name})
