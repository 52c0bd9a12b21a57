"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast Hadamard pseudo-rotations (three rounds of random
signs and a Hadamard transform); a hash is the nearest signed axis, and a table
keys on a few such hashes, as many as give about as many buckets as vectors. The index
is made once and written: each vector with its codes in all tables. Of all tables'
buckets a query probes those with the largest sums of projections; vectors with a code
that is probed are candidates and ranked by their exact distance.

The probes of a block of queries, of bounded size, go to all tasks, which look up
the codes of their vectors; so no bucket is gathered anywhere, however many vectors
it holds, and each task returns no more than k rows a query. A join of probes with
codes by bucket was measured, too: as fast, but its rows are the candidate pairs, and
these were 16 times as many for 5 times the vectors, whose neighbours are hardly nearer
than the rest.

Equal vectors have equal codes: one vector stands for its copies, of which the k + 1
smallest ids can be in a result. How many buckets to probe is fitted: for a bounded
sample of queries the exact neighbours are found by a scan, and the number of probes is
the least that finds ``recall`` of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesseral.llm.common import block_number, drop_written, new_path, written


def hadamard(x: np.ndarray) -> np.ndarray:
    """Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


class CrossPolytope:
    """``tables`` tables of ``width`` hashes each, over vectors of ``dim`` numbers."""

    def __init__(self, dim: int, tables: int, width: int, seed: int = 11):
        self.dim, self.tables, self.width = dim, tables, width
        self.size = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (tables, width, 3, self.size))
        self.packed = np.uint16 if self.buckets <= 1 << 16 else np.uint32 if self.buckets <= 1 << 32 else np.int64
        self._dense: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"_dense": {}}

    def turned(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        """Short vectors by the rotation's matrix, which the transform makes of the axes."""
        if self.size <= 256:
            if (table, part) not in self._dense:
                self._dense[table, part] = self._transformed(np.eye(self.dim, dtype=np.float32), table, part)
            return x.astype(np.float32, copy=False) @ self._dense[table, part]
        return self._transformed(x, table, part)

    def _transformed(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        y = np.zeros((len(x), self.size), np.float32)
        y[:, : self.dim] = x
        for s in self.signs[table, part]:
            y = hadamard(y * s)
        return y / np.float32(self.size**1.5)

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for part in range(self.width):
            y = self.turned(x, table, part)
            at = np.abs(y).argmax(axis=1)
            out = out * (2 * self.size) + at * 2 + (y[np.arange(len(x)), at] < 0)
        return out

    def probes(self, x: np.ndarray, n: int, a_table: int = 64) -> np.ndarray:
        """The ``n`` best (table, bucket) of each row as places table * buckets + bucket,
        best first: those of the largest sums of the absolute projections on the axes
        chosen. Of one table at most ``a_table`` are looked at."""
        found, gained = [], []
        for table in range(self.tables):
            keys, gains = np.full((len(x), 1), 0, np.int64), np.zeros((len(x), 1), np.float32)
            for part in range(self.width):
                y = self.turned(x, table, part)
                m = min(a_table, self.size)
                at = np.argpartition(-np.abs(y), m - 1, axis=1)[:, :m] if m < self.size else np.argsort(-np.abs(y), axis=1)
                signed = np.take_along_axis(y, at, 1)
                more = (at * 2 + (signed < 0)).astype(np.int64)
                both = (gains[:, :, None] + np.abs(signed)[:, None, :]).reshape(len(x), -1)
                key = (keys[:, :, None] * (2 * self.size) + more[:, None, :]).reshape(len(x), -1)
                best = np.argsort(-both, axis=1, kind="stable")[:, :a_table]
                keys, gains = np.take_along_axis(key, best, 1), np.take_along_axis(both, best, 1)
            found.append(keys + table * self.buckets)
            gained.append(gains)
        keys, gains = np.concatenate(found, axis=1), np.concatenate(gained, axis=1)
        best = np.argsort(-gains, axis=1, kind="stable")[:, :n]
        return np.take_along_axis(keys, best, 1)

    @property
    def buckets(self) -> int:
        return (2 * self.size) ** self.width


def width_for(n: int, dim: int, least: int = 3) -> int:
    """Hashes a table so that a bucket of n vectors holds about ``least``."""
    axes = 2 << max(1, (dim - 1).bit_length())
    return max(1, round(math.log(max(n / least, 2)) / math.log(axes)))


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    y = x / big
    return (y / np.sqrt((y * y).sum(axis=1, keepdims=True))).astype(np.float32)


def _best(q: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k nearest, ties to the smaller id."""
    order = np.lexsort((ids, dist, q))
    sq = q[order]
    first = np.searchsorted(sq, sq, side="left")
    return order[np.arange(len(sq)) - first < k]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    diff = x - y
    return np.sqrt((diff * diff).sum(axis=1))


def _exact(vectors: DataFrame, dim: int, queries: np.ndarray, k: int) -> DataFrame:
    """(q, uid, score): of ``vectors`` (uid, v) the k nearest of each query of a bounded
    block (q is its place), k rows a query and task."""
    shipped = vectors.sparkSession.sparkContext.broadcast(queries)  # bounded by the block

    def run(batches):
        asked = shipped.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                uid, x = piece.column(0).to_numpy(zero_copy_only=False), _matrix(piece.column(1), dim)
                parts = [held]
                for q in range(len(asked)):
                    dist = _distances(x, asked[q])
                    best = np.lexsort((uid, dist))[:k]
                    parts.append((np.full(len(best), q), uid[best], dist[best]))
                both = [np.concatenate(c) for c in zip(*parts)]
                best = _best(*both, k)
                held = tuple(c[best] for c in both)
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(held[2])], names=["q", "uid", "score"])

    return vectors.select("uid", "v").mapInArrow(run, "q bigint, uid bigint, score double")


def fitted_probes(lsh: CrossPolytope, queries: np.ndarray, found: list[np.ndarray], recall: float) -> int:
    """The least number of probes (of all tables) with which ``recall`` of all true
    neighbours (``found``, vectors of each query) share a probed bucket."""
    if not sum(map(len, found)):
        return lsh.tables
    first = []
    for x, near in zip(queries, found):
        if not len(near):
            continue
        probed = lsh.probes(_unit(x[None]), lsh.tables * 64)[0]
        order = np.argsort(probed)
        place = np.full(len(near), len(probed) + 1)
        unit = _unit(near)
        for t in range(lsh.tables):
            codes = lsh.codes(unit, t) + t * lsh.buckets
            at = np.minimum(np.searchsorted(probed, codes, sorter=order), len(probed) - 1)
            hit = probed[order[at]] == codes
            place[hit] = np.minimum(place[hit], order[at][hit] + 1)
        first.append(place)
    first = np.sort(np.concatenate(first))
    return int(min(first[max(0, math.ceil(recall * len(first)) - 1)], lsh.tables * 64))


def _coded(vectors: DataFrame, dim: int, lsh: CrossPolytope) -> DataFrame:
    """``vectors`` (uid, first_id, v) with ``codes``, packed: one for each table."""
    kind = vectors.schema["v"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                x = _unit(_matrix(piece.column(2), dim))
                codes = np.stack([lsh.codes(x, t) for t in range(lsh.tables)], axis=1)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([c.tobytes() for c in codes.astype(lsh.packed)], pa.binary())], names=["uid", "first_id", "v", "codes"])

    return vectors.select("uid", "first_id", "v").mapInArrow(run, f"uid bigint, first_id bigint, v {kind}, codes binary")


def _probed(coded: DataFrame, dim: int, lsh: CrossPolytope, names: np.ndarray, queries: np.ndarray, probes: int, k: int) -> DataFrame:
    """(q, uid, first_id, score): of the candidates of a block of queries the k best
    in each task."""
    keys = lsh.probes(_unit(queries), probes).astype(np.int64)
    who = np.repeat(np.arange(len(queries), dtype=np.int32), keys.shape[1])
    order = np.argsort(keys, axis=None, kind="stable")
    shipped = coded.sparkSession.sparkContext.broadcast((keys.ravel()[order], who[order], names, queries))  # bounded by the block

    def run(batches):
        keys, who, names, queries = shipped.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                uid, first_id = (piece.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                x = _matrix(piece.column(2), dim)
                codes = np.frombuffer(b"".join(piece.column(3).to_pylist()), lsh.packed).reshape(len(x), -1).astype(np.int64) + np.arange(lsh.tables) * lsh.buckets
                a, b = np.searchsorted(keys, codes.ravel(), side="left"), np.searchsorted(keys, codes.ravel(), side="right")
                hit = np.flatnonzero(b > a)
                n = (b - a)[hit]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[hit], n)
                marked = np.zeros((len(queries), len(x)), bool)
                marked[who[place], np.repeat(hit // lsh.tables, n)] = True
                q, v = np.nonzero(marked)
                dist = np.empty(len(q))
                for p in range(0, len(q), 65536):
                    dist[p : p + 65536] = _distances(x[v[p : p + 65536]], queries[q[p : p + 65536]])
                both = [np.concatenate(c) for c in zip(held, (q, first_id[v], dist, uid[v]))]
                best = _best(*both[:3], k)
                held = tuple(c[best] for c in both)
        yield pa.RecordBatch.from_arrays([pa.array(names[held[0]]), pa.array(held[3]), pa.array(held[1]), pa.array(held[2])], names=["q", "uid", "first_id", "score"])

    return coded.select("uid", "first_id", "v", "codes").mapInArrow(run, "q bigint, uid bigint, first_id bigint, score double")


def _top(rows: DataFrame, key: str, k: int, *order) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, tables: int = 64, recall: float = 0.94, sample: int = 64, block: int = 4096) -> DataFrame:
    """The k nearest found (Euclidean) of each query: ``query_id``, ``rank`` from 1,
    ``vec_id``, ``score``; nearest first, ties to the smaller id.

    ``is_query`` is a condition on the id column. Vectors that are null, zero or hold
    null or non-finite numbers, and null ids, take no part. Vectors of different
    lengths have no distance: each length is a search of its own. Candidates are all
    rows with another id than the query; of repeated query ids the smallest vector
    asks. An empty table gives no row.

    Probes are fitted on at most ``sample`` queries (by a hash of the id) to find
    ``recall`` of their neighbours. A query for which the tables give fewer than k is
    searched again among all vectors, in blocks of ``block`` queries, so it gets k rows
    if there are as many."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    v = F.col(vector_col).cast(f"array<{kind if kind in ('float', 'double') else 'double'}>")
    good = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), is_query.alias("asks")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    good = good.filter(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0))
    lengths = sorted(r.d for r in good.select(F.size("v").alias("d")).distinct().collect())  # one, as a rule
    out = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for dim in lengths:
        out = out.unionByName(_nearest(good.filter(F.size("v") == dim), dim, k, tables, recall, sample, block))
    return out


def _nearest(good: DataFrame, dim: int, k: int, tables: int, recall: float, sample: int, block: int) -> DataFrame:
    spark = good.sparkSession
    # Rows get a number that is theirs; hashes of 128 bits tell equal vectors.
    base = written(good.select(F.monotonically_increasing_id().alias("uid"), "id", "v", "asks", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2")), "vectors")
    twins = written(base.groupBy("h1", "h2").agg(F.min("uid").alias("rep"), F.min("id").alias("first_id"), F.count("*").alias("c")).filter("c > 1").drop("c"), "twins")
    joined = base.join(twins, ["h1", "h2"], "left")
    index = joined.filter("rep IS NULL OR rep = uid").select("uid", F.coalesce("first_id", "id").alias("first_id"), "v")
    members = _top(base.select("h1", "h2", "id").join(twins, ["h1", "h2"]).select("rep", "id").distinct(), "rep", k + 1, "id").select(F.col("rep").alias("uid"), "id")
    asking = base.filter("asks").groupBy("id").agg(F.min(F.struct("v", "uid", "h1", "h2")).alias("a")).select("id", "a.*")
    asking = asking.join(twins.select("h1", "h2", "rep"), ["h1", "h2"], "left").select("id", F.coalesce("rep", "uid").alias("q"), "v")
    asking = written(asking, "asking")
    total = base.count()
    queries = asking.groupBy("q").agg(F.first("v").alias("qv"))  # copies have one vector
    lsh = CrossPolytope(dim, tables, width_for(total, dim))
    some = queries.orderBy(F.xxhash64("q", F.lit(7)), "q").limit(sample).collect()  # bounded
    if not some:
        drop_written(spark, base, twins, asking)
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    x = np.array([r.qv for r in some], np.float64)
    near = _top(_exact(index, dim, x, k + 1), "q", k + 1, "score", "uid").join(index.select("uid", "v"), "uid").select("q", "v").collect()  # sample * (k + 1) rows
    probes = fitted_probes(lsh, x, [np.array([r.v for r in near if r.q == i], np.float64).reshape(-1, dim) for i in range(len(some))], recall)
    coded = written(_coded(index, dim, lsh), "coded")

    def in_blocks(rows: DataFrame, search) -> DataFrame:
        """``search`` (names, vectors) block after block, each appended to a table."""
        path, blocks = new_path(spark, "searched"), max(1, -(-rows.count() // block))
        for b in range(blocks):
            got = rows.filter(block_number(blocks, F.col("q"), F.lit(5)) == b).orderBy("q").toPandas()  # about ``block`` rows
            for a in range(0, len(got), block):
                part = got.iloc[a : a + block]
                search(part["q"].to_numpy(np.int64), np.array(part["qv"].tolist(), np.float64).reshape(-1, dim)).write.mode("append").parquet(path)
        return spark.read.schema("q bigint, uid bigint, first_id bigint, score double").parquet(path)

    def best_of(rows: DataFrame) -> DataFrame:
        return _top(rows, "q", k + 1, "score", "first_id").select("q", "uid", "first_id", "score")

    def exact(names: np.ndarray, vectors: np.ndarray) -> DataFrame:
        named = F.element_at(F.lit(names.tolist()), (F.col("q") + 1).cast("int"))
        return best_of(_exact(index, dim, vectors, k + 1).join(index.select("uid", "first_id"), "uid").withColumn("q", named))

    def ranked(best: DataFrame) -> DataFrame:
        """Copies join their vector's place; a query's own row goes."""
        every = best.join(members, "uid", "left").select("q", "score", F.coalesce("id", "first_id").alias("vec_id"))
        own = asking.select(F.col("id").alias("query_id"), "q")
        return _top(own.join(every, "q").filter("vec_id <> query_id"), "query_id", k, "score", "vec_id").select("query_id", "rank", "vec_id", "score")

    scored = in_blocks(queries, lambda names, vectors: best_of(_probed(coded, dim, lsh, names, vectors, probes, k + 1)))
    found = written(ranked(scored), "neighbours")
    drop_written(spark, coded)
    full = found.groupBy("query_id").count().filter(F.col("count") >= k)
    short = written(asking.join(full, F.col("id") == F.col("query_id"), "left_anti").select(F.col("id").alias("query_id"), "q"), "short")
    if short.isEmpty():
        drop_written(spark, short)
        return found
    more = ranked(in_blocks(queries.join(short, "q", "left_semi"), exact)).join(short, "query_id", "left_semi")
    return found.join(short, "query_id", "left_anti").unionByName(more.select(*found.columns))
