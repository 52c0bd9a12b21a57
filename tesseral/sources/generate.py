"""Synthetic instances and workloads."""

from __future__ import annotations

import math
from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILIES = ("chain", "grid", "cube", "exp")


def balanced(symbol: str, terms: list[str]) -> str:
    """A binary tree of applications over the terms; the left half is the smaller."""
    if not terms:
        raise ValueError("a tree needs a term")

    def part(lo: int, hi: int) -> str:
        if hi - lo == 1:
            return terms[lo]
        mid = lo + (hi - lo) // 2
        return f"({symbol} {part(lo, mid)} {part(mid, hi)})"

    return part(0, len(terms))


class _Script:
    """Collects declarations and assertions of an instance."""

    def __init__(self, note: str):
        self.lines = [f"; {note}", "(set-logic QF_UF)", "(declare-sort U 0)"]

    def function(self, name: str, arity: int) -> None:
        self.lines.append(f"(declare-fun {name} ({' '.join(['U'] * arity)}) U)")

    def constants(self, *names: str) -> None:
        self.lines += [f"(declare-const {n} U)" for n in names]

    def equal(self, a: str, b: str) -> None:
        self.lines.append(f"(assert (= {a} {b}))")

    def text_with_goal(self, a: str, b: str) -> str:
        return "\n".join([*self.lines, f"(assert (not (= {a} {b})))", "(check-sat)", ""])


def chain(n: int) -> str:
    """Two towers of n applications over equal constants, named level by level."""
    s = _Script(f"chain of {n}")
    s.function("f", 1)
    for side in "ab":
        s.constants(*(f"{side}{i}" for i in range(n + 1)))
    s.equal("a0", "b0")
    for i in range(n):
        for side in "ab":
            s.equal(f"{side}{i + 1}", f"(f {side}{i})")
    return s.text_with_goal(f"a{n}", f"b{n}")


def _lattice(n: int, arity: int, name: str) -> str:
    if n < 1:
        raise ValueError(f"{name} needs n of 1 or more")
    s = _Script(f"{name} of {n}")
    s.function("f", arity)
    s.function("g", 2)
    for i in range(n):
        s.constants(f"a{i}", f"b{i}")
        s.equal(f"a{i}", f"b{i}")
    tree = lambda side: balanced("g", [f"(f {' '.join(f'{side}{i}' for i in at)})" for at in product(range(n), repeat=arity)])
    return s.text_with_goal(tree("a"), tree("b"))


def grid(n: int) -> str:
    """n equalities; all pairs under a binary function, in one tree for each side."""
    return _lattice(n, 2, "grid")


def cube(n: int) -> str:
    """n equalities; all triples under a ternary function."""
    return _lattice(n, 3, "cube")


def exp(n: int) -> str:
    """n layers of two unary functions over one constant a side; all named, the one
    base equality last."""
    s = _Script(f"exp of {n}")
    leaves = {}
    for layer in range(n):
        s.function(f"f{layer}_0", 1)
        s.function(f"f{layer}_1", 1)
    if n:
        s.function("g", 2)
    s.constants("a", "b")
    for side in "ab":
        below = [side]
        for layer in range(n):
            level = [f"t{side}{layer}_{k}" for k in range(2 * len(below))]
            s.constants(*level)
            for k, name in enumerate(level):
                s.equal(name, f"(f{layer}_{k % 2} {below[k // 2]})")
            below = level
        leaves[side] = below
    s.equal("a", "b")
    return s.text_with_goal(balanced("g", leaves["a"]), balanced("g", leaves["b"]))


def script_of(family: str, n: int) -> str:
    return {"chain": chain, "grid": grid, "cube": cube, "exp": exp}[family](n)


def file_name(family: str, n: int) -> str:
    return f"{family}_n{n}_unsat.smt2"


def instances(spark: SparkSession, sizes: list[tuple[str, int]]) -> DataFrame:
    """(inst, path, text) of the (family, n) asked for, made where they are needed."""
    rows = spark.createDataFrame(sizes, "family string, n int").repartition(max(1, min(len(sizes), 64)))

    def run(frames):
        for frame in frames:
            names = [file_name(f, int(n)) for f, n in zip(frame.family, frame.n)]
            yield frame.assign(inst=names, path=names, text=[script_of(f, int(n)) for f, n in zip(frame.family, frame.n)])[["inst", "path", "text"]]

    return rows.mapInPandas(run, "inst string, path string, text string")


def write_instances(folder: str, sizes: list[tuple[str, int]]) -> list[str]:
    """Write scripts to local files; their paths."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for family, n in sizes:
        path = Path(folder, file_name(family, n))
        path.write_text(script_of(family, n))
        out.append(str(path))
    return out


def zipfian(u: Column, n: int, z: float) -> Column:
    """A rank in [0, n) of Zipf's law with exponent z (not 1), from u uniform in
    [0, 1): the usual closed approximation of the inverse distribution."""
    zeta = lambda k: sum(1 / i**z for i in range(1, k + 1))
    zn, z2, alpha = zeta(n), zeta(min(n, 2)), 1 / (1 - z)
    eta = (1 - (2 / n) ** (1 - z)) / (1 - z2 / zn) if n > 2 else 1.0
    rank = F.floor(n * F.pow(eta * u - eta + 1, F.lit(alpha)))
    return F.when(u * zn < 1, 0).when(u * zn < 1 + math.pow(0.5, z), min(1, n - 1)).otherwise(F.least(rank, F.lit(n - 1))).cast("bigint")


def _keys(n: int, spread: str | float, seed: int) -> Column:
    if spread == "uniform":
        return F.floor(F.rand(seed) * n).cast("bigint")
    return F.lit(0).cast("bigint") if spread == "single" else zipfian(F.rand(seed), n, float(spread))


def key_values(spark: SparkSession, rows: int, buckets: int, spread: str | float = "uniform", seed: int = 42) -> DataFrame:
    """(key, val): keys uniform, ``single`` or Zipfian (the exponent); val 1 to 99."""
    return spark.range(rows).select(_keys(buckets, spread, seed).alias("key"), (F.floor(F.rand(seed + 1) * 99) + 1).cast("bigint").alias("val"))


def union_pairs(spark: SparkSession, rows: int, n: int, spread: str | float = "uniform", seed: int = 42) -> DataFrame:
    """(a, b): ``a`` as spread says, ``b`` uniform."""
    return spark.range(rows).select(_keys(n, spread, seed).alias("a"), F.floor(F.rand(seed + 1) * n).cast("bigint").alias("b"))


def operation_stream(spark: SparkSession, workers: int, each: int, n: int, update_rate: float, spread: str | float = "uniform", seed: int = 42) -> DataFrame:
    """(tid, seq, op, k1, k2): unions at ``update_rate``, else finds."""
    row = spark.range(workers * each)
    return row.select((F.col("id") / each).cast("int").alias("tid"), (F.col("id") % each).alias("seq"), F.when(F.rand(seed + 2) < update_rate, "union").otherwise("find").alias("op"), _keys(n, spread, seed).alias("k1"), _keys(n, spread, seed + 1).alias("k2"))


#: The five mixes of finds and unions, as update rate and spread.
MIXES = {"A": (0.5, 0.99), "B": (0.05, 0.99), "C": (0.0, 0.99), "D": (0.05, "uniform"), "E": (1.0, 0.99)}


def classes_after(stream: DataFrame, n: int, premerged: float = 0.3, seed: int = 42) -> DataFrame:
    """(id, rep) of n elements after a stream's unions, with a share of ``n`` random
    pairs merged before. Finds change nothing, and the order of unions doesn't matter."""
    from tesseral.operators.components import singletons, union_all

    first = union_pairs(stream.sparkSession, int(n * premerged), n, "uniform", seed)
    pairs = first.union(stream.filter("op = 'union'").select(F.col("k1").alias("a"), F.col("k2").alias("b")))
    return union_all(singletons(stream.sparkSession, n), pairs)
