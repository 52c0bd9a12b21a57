"""Equivalence classes: union-find as connected components of an edge table.

The representative of a class is its smallest id. Each task first contracts its own
edges to a star forest, in arrays. Forests are merged by eights, as a tree, while
what a task gets is bounded (by counted rows). Where ids are too many for that, the
rest is rewired by alternating large and small stars until nothing changes: few
rounds (about log of the class size), each a grouped minimum with map-side
combination and one join, so a class that holds a third of all ids is no single
task's work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.plans.storage import drop_written, written
from tesseral.plans.workers import lean

SMALL_EDGES = 4_000_000
FOLD = 4_000_000


def singletons(spark: SparkSession, n: int) -> DataFrame:
    """(id, rep) of n classes of one id each."""
    return spark.range(n).select("id", F.col("id").alias("rep"))


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each element's class, for edges over 0 to n - 1: the larger
    root of an edge hooks onto the smaller, labels jump to their roots, and edges
    within a class are dropped."""
    label = np.arange(n)
    while True:
        a, b = label[a], label[b]
        live = a != b
        a, b = a[live], b[live]
        if not len(a):
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def star_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, reps): every id of the edges, ascending, with its class's smallest id.
    Ids that fill their range are places of an array; others are numbered first."""
    if not len(u):
        return u, v
    low, high = int(min(u.min(), v.min())), int(max(u.max(), v.max()))
    if high - low < 8 * len(u):
        a, b = u - low, v - low
        seen = np.zeros(high - low + 1, bool)
        seen[a] = seen[b] = True
        ids = np.flatnonzero(seen)
        return ids + low, least_labels(a, b, len(seen))[ids] + low
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    return ids, ids[least_labels(place[: len(u)], place[len(u) :], len(ids))]


def _folded(parts, most: int = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """The star forest of edges that come in arrays (u, v), ``most`` edges at a time."""
    held, n = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for u, v in parts:
        held.append((u, v))
        n += len(u)
        if n >= most:
            held, n = [star_forest(*map(np.concatenate, zip(*held)))], 0
    return star_forest(*map(np.concatenate, zip(*held)))


_PACKED = "part int, n bigint, ids binary, reps binary"


def _packed(ids: np.ndarray, reps: np.ndarray, part: int, rows: int = 1 << 18):
    for at in range(0, len(ids), rows):
        x, y = ids[at : at + rows], reps[at : at + rows]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["part", "n", "ids", "reps"])


def _unpacked(batches):
    for batch in batches:
        for x, y in zip(batch.column(2), batch.column(3)):
            yield np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)


def _forests(pairs: DataFrame) -> DataFrame:
    """Each task's edges as a star forest, packed: a row holds up to 2**18 ids."""

    def run(batches):
        edges = ((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches)
        yield from _packed(*_folded(edges), TaskContext.get().partitionId())

    return pairs.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).mapInArrow(lean(run), _PACKED)


def _merged(forests: DataFrame, groups: int) -> DataFrame:
    """Forests joined up in ``groups`` tasks."""

    def run(batches):
        yield from _packed(*_folded(_unpacked(batches)), TaskContext.get().partitionId())

    return forests.repartition(groups, F.col("part") % groups).mapInArrow(lean(run), _PACKED)


def _edges_of(forests: DataFrame, names: tuple[str, str]) -> DataFrame:
    def run(batches):
        for x, y in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=list(names))

    return forests.mapInArrow(lean(run), f"{names[0]} bigint, {names[1]} bigint")


def _joined(forests: DataFrame) -> DataFrame:
    """(id, rep) of all forests, joined up in one task and by one Python worker."""

    def run(batches):
        x, y = _folded(_unpacked(batches))
        for at in range(0, len(x), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 18)]), pa.array(y[at : at + (1 << 18)])], names=["id", "rep"])

    return forests.repartition(1, F.col("part") % 1).mapInArrow(lean(run), "id bigint, rep bigint")


def _one_task(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Classes of keyed edges, or of ids of other types, in one task's arrays."""
    kind = pairs.schema["u"].dataType

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        group = np.zeros(table.num_rows, np.int64)
        for k in keys:
            code = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            group = np.unique(group * len(code.dictionary) + code.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        both = pa.concat_arrays([table.column(c).combine_chunks() for c in ("u", "v")])
        if pa.types.is_integer(both.type):
            values, place = np.unique(both.to_numpy(), return_inverse=True)
            back = lambda i: pa.array(values[i], both.type)
        else:
            code = both.dictionary_encode()
            known = code.dictionary.to_pylist()
            order = sorted(range(len(known)), key=lambda i: tuple(known[i].values()) if isinstance(known[i], dict) else known[i])
            rank = np.empty(len(known), np.int64)
            rank[order] = np.arange(len(known))
            values, place = code.dictionary.take(pa.array(order)), rank[code.indices.to_numpy()]
            back = lambda i: values.take(pa.array(i))
        code = np.concatenate([group, group]) * len(values) + place
        known, first, index = np.unique(code, return_index=True, return_inverse=True)
        label = least_labels(index[: len(group)], index[len(group) :], len(known))
        of = pa.array(first % len(group))
        yield pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks().take(of) for k in keys), back(known % len(values)), back(known[label] % len(values))], names=[*keys, "id", "rep"])

    fields = [*(pairs.schema[k] for k in keys), T.StructField("id", kind), T.StructField("rep", kind)]
    return pairs.repartition(1).mapInArrow(lean(run), T.StructType(fields))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", keys: tuple[str, ...] = (), small: int = SMALL_EDGES, max_rounds: int = 60) -> DataFrame:
    """(keys..., id, rep) for every id in an edge, self edges included. ``keys``
    separate instances: edges link ids of one instance only, and null keys don't
    occur. Rows with a null end are left out. No task joins up more than about
    ``small`` edges. Raises RuntimeError if ``max_rounds`` don't suffice."""
    spark, keys = edges.sparkSession, list(keys)
    pairs = edges.select(*keys, F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    kind = pairs.schema["u"].dataType
    if keys or not isinstance(kind, T.IntegralType) or pairs.schema["v"].dataType != kind:
        pairs = written(pairs, "edges")
        return keyed_components(pairs, keys, pairs.count(), small, max_rounds)
    own = forests = written(_forests(pairs), "forests")
    while True:
        total, rows, parts = forests.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.countDistinct("part")).first()
        if parts <= 1 or total <= small:
            found = _edges_of(forests, ("id", "rep")) if parts <= 1 else _joined(forests)
            break
        # forests are merged by eights, as long as a task's share stays small and they shrink
        groups = max(-(-parts // 8), -(-total // max(small, 1)))
        merged = written(_merged(forests, groups), "forests") if groups < parts else None
        if merged is not None and 4 * merged.agg(F.sum("n")).first()[0] <= 3 * total:
            drop_written(spark, own)
            own = forests = merged
            continue
        found = _stars(written(_edges_of(forests if merged is None else merged, ("u", "v")), "edges"), [], max_rounds)
        break
    return found.select(F.col("id").cast(kind).alias("id"), F.col("rep").cast(kind).alias("rep"))


def keyed_components(pairs: DataFrame, keys: list[str], n: int, small: int = SMALL_EDGES, max_rounds: int = 60) -> DataFrame:
    """The same for ``n`` written edges (keys, u, v) without nulls."""
    return _one_task(pairs, keys) if n <= small else _stars(pairs, keys, max_rounds)


def _stars(pairs: DataFrame, keys: list[str], max_rounds: int) -> DataFrame:
    """The same for the written edges ``pairs`` (keys, u, v) of any size."""
    spark = pairs.sparkSession
    state, marks, own = pairs.filter("u <> v").distinct().select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), None, None
    for _ in range(max_rounds):
        both = state.union(state.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, [*keys, "u"]).filter("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        rest = large.join(least, [*keys, "u"]).filter("v <> m").select(*keys, F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        new = written(rest.union(least.select(*keys, "u", F.col("m").alias("v"))).distinct(), "stars")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())
        if own is not None:
            drop_written(spark, own)
        state = own = new
        if marks == now:
            break
        marks = now
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    found = state.select(*keys, F.col("u").alias("id"), F.col("v").alias("rep"))
    ends = pairs.select(*keys, F.col("u").alias("id")).union(pairs.select(*keys, F.col("v").alias("id"))).distinct()
    return ends.join(found, [*keys, "id"], "left").select(*keys, "id", F.coalesce("rep", "id").alias("rep"))


def sequential_classes(pairs: DataFrame, n: int, a: str = "a", b: str = "b") -> DataFrame:
    """(id, rep) of n elements by one loop over all pairs in one task: the baseline to
    which parallel runs compare, and nothing else."""

    def run(batches):
        parent = list(range(n))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(x), root(y)
                if x < y:
                    parent[y] = x
                else:
                    parent[x] = y
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([root(x) for x in range(n)], pa.int64())], names=["id", "rep"])

    return pairs.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).repartition(1).mapInArrow(run, "id bigint, rep bigint")


def union_all(rep: DataFrame, pairs: DataFrame, a: str = "a", b: str = "b", keys: tuple[str, ...] = ()) -> DataFrame:
    """The class table ``rep`` (keys, id, rep) after all unions of ``pairs``: classes,
    not ids, are joined, and each rep stays its class's smallest id."""
    keys = list(keys)
    named = find(find(pairs.select(*keys, F.col(a).alias("__a"), F.col(b).alias("__b")), rep, "__a", "a", keys), rep, "__b", "b", keys)
    moved = connected_components(named.filter("a <> b"), "a", "b", tuple(keys)).select(*keys, F.col("id").alias("rep"), F.col("rep").alias("__to"))
    return rep.join(moved, [*keys, "rep"], "left").select(*keys, "id", F.coalesce("__to", "rep").alias("rep"))


def find(rows: DataFrame, rep: DataFrame, column: str, name: str, keys: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """``rows`` with the representative of ``column`` as ``name``; an id that the
    class table lacks is its own."""
    keys = list(keys)
    right = rep.select(*keys, F.col("id").alias(column), F.col("rep").alias("__rep"))
    return rows.join(right, [*keys, column], "left").withColumn(name, F.coalesce("__rep", column)).drop("__rep")


def same_set(rows: DataFrame, rep: DataFrame, a: str, b: str, name: str = "same", keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with whether ``a`` and ``b`` are in one class."""
    both = find(find(rows, rep, a, "__ra", keys), rep, b, "__rb", keys)
    return both.withColumn(name, F.col("__ra") == F.col("__rb")).drop("__ra", "__rb")
