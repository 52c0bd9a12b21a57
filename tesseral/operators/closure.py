"""Congruence closure: equal arguments make equal applications.

Two strategies with the same result. *Kernel*: each instance in one task, with
arrays and use lists; rounds cost nothing, so it suits many instances and long
cascades. *Rounds*: bulk-synchronous over DataFrames, for instances too large for a
task; a round canonicalizes, groups equal signatures and merges their classes.
"""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.operators.components import connected_components, keyed_components
from tesseral.plans.storage import drop_written, written


def hashcons(nodes: DataFrame) -> DataFrame:
    """(inst, op, children, id): each distinct term once, with its smallest id."""
    return nodes.groupBy("inst", "op", "children").agg(F.min("id").alias("id"))


def edge_table(nodes: DataFrame) -> DataFrame:
    """(inst, id, op, pos, child) of the terms that have children."""
    return nodes.filter(F.size("children") > 0).select("inst", "id", "op", F.posexplode("children").alias("pos", "child"))


FEW_CHILDREN = 3


def canonicalize(nodes: DataFrame, rep: DataFrame, arity: int | None = None) -> DataFrame:
    """(inst, id, op, children) of the terms with children, each child replaced by
    its class's representative; order and repeated children stay. With ``arity`` of
    at most :data:`FEW_CHILDREN`, the most children of any term, there is a join for each
    place and no regrouping."""
    if arity is not None and arity <= FEW_CHILDREN:
        return _renamed(nodes.filter(F.size("children") > 0), rep, arity).select("inst", "id", "op", "children")
    edges = edge_table(nodes).join(rep.select("inst", F.col("id").alias("child"), "rep"), ["inst", "child"], "left")
    part = F.struct("pos", F.coalesce("rep", "child").alias("rep"))
    sorted_parts = F.array_sort(F.collect_list(part))
    return edges.groupBy("inst", "id", "op").agg(F.transform(sorted_parts, lambda s: s["rep"]).alias("children"))


def _renamed(rows: DataFrame, rep: DataFrame, arity: int) -> DataFrame:
    """``rows``, which have children, with representatives in their places, and
    ``hit``: whether the class table has one of them."""
    kept = rows.columns
    for k in range(arity):
        # a place that a term lacks gets its own key: nulls would all meet in one task
        child = F.coalesce(F.get("children", F.lit(k)), F.xxhash64("id"))
        right = rep.select("inst", F.col("id").alias(f"__c{k}"), F.col("rep").alias(f"__r{k}"))
        rows = rows.withColumn(f"__c{k}", child).join(right, ["inst", f"__c{k}"], "left")
    new = F.slice(F.array(*(F.coalesce(f"__r{k}", F.get("children", F.lit(k))) for k in range(arity))), F.lit(1), F.size("children"))
    hit = F.lit(False)
    for k in range(arity):
        hit = hit | (F.col(f"__r{k}").isNotNull() & (F.size("children") > k))
    return rows.select(*(new.alias("children") if c == "children" else F.col(c) for c in kept), hit.alias("hit"))


def frontier(nodes: DataFrame, rep: DataFrame, changed: DataFrame) -> DataFrame:
    """(inst, id) of the terms with a child whose class, as ``rep`` has it now, is in
    ``changed`` (inst, rep)."""
    children = edge_table(nodes).select("inst", "id", F.col("child").alias("__child"))
    named = children.join(rep.select("inst", F.col("id").alias("__child"), "rep"), ["inst", "__child"])
    return named.join(changed.select("inst", "rep").distinct(), ["inst", "rep"], "left_semi").select("inst", "id").distinct()


def merge_pairs(signatures: DataFrame, rep: DataFrame) -> DataFrame:
    """(inst, a, b): classes, as pairs of representatives a > b, that hold terms of
    one signature; b is the least of them."""
    return _pairs(signatures.join(rep, ["inst", "id"]))


def _pairs(named: DataFrame) -> DataFrame:
    """The same for ``named`` (inst, op, children, rep). A grouped minimum and a join
    with the signatures that need one, so a signature that very many terms share is no
    single task's work."""
    least = named.groupBy("inst", "op", "children").agg(F.min("rep").alias("b"), F.max("rep").alias("__most")).filter("b <> __most")
    return named.join(least, ["inst", "op", "children"]).filter("rep <> b").select("inst", F.col("rep").alias("a"), "b").distinct()


def close_rounds(nodes: DataFrame, equalities: DataFrame, max_rounds: int = 200, spent: dict | None = None) -> tuple[DataFrame, int]:
    """((inst, id, rep), rounds with merges) of ``nodes`` under ``equalities`` (inst,
    a, b). Signatures, with their terms' classes, are a written table; a round groups
    those that the round before has changed, and applies the classes' moves to all.
    The first groups all, so terms needn't be hash-consed before. ``spent`` gets the
    seconds of ``merge_s`` (asserted equalities), ``build_s`` (first signatures) and
    ``rebuild_s`` (the rounds).

    Raises RuntimeError after ``max_rounds``: long cascades are for the kernel."""
    spark, marks = nodes.sparkSession, [time.perf_counter()]
    # ids that no equality names are their own class, so only the others need a row
    classes = written(connected_components(equalities, keys=("inst",)), "classes")
    of_class = lambda rows: rows.join(classes, ["inst", "id"], "left").withColumn("rep", F.coalesce("rep", "id"))
    marks.append(time.perf_counter())
    arity = nodes.agg(F.coalesce(F.max(F.size("children")), F.lit(0))).first()[0]
    signed = of_class(canonicalize(nodes, classes, arity)).select("inst", "id", "op", "children", "rep")
    # terms of one signature and class need one row
    signed = written(signed.groupBy("inst", "op", "children", "rep").agg(F.min("id").alias("id")), "signatures")
    marks.append(time.perf_counter())
    use, moves, rounds = signed, None, 0
    for _ in range(max_rounds):
        pairs = written(_pairs(use).withColumnsRenamed({"a": "u", "b": "v"}), "pairs")
        n = pairs.count()
        if not n:
            drop_written(spark, pairs, signed)
            break
        rounds += 1
        moved = written(keyed_components(pairs, ["inst"], n), "moved")  # of classes; those that stay as well
        to = moved.select("inst", F.col("id").alias("rep"), F.col("rep").alias("__to"))
        after = lambda rows, c: rows.join(to.withColumnRenamed("rep", c), ["inst", c], "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
        new = moved.filter("id <> rep").select("inst", F.col("id").alias("rep"), F.col("rep").alias("__to"))
        if moves is not None:
            old = moves
            moves = written(old.join(moved.select("inst", F.col("id").alias("__to"), F.col("rep").alias("__new")), ["inst", "__to"], "left").select("inst", "rep", F.coalesce("__new", "__to").alias("__to")).union(new), "moves")
            drop_written(spark, old)
        else:
            moves = new
        if arity <= FEW_CHILDREN:
            changed = _renamed(signed, moved, arity)
        else:
            hit = frontier(signed, moved, moved).withColumn("hit", F.lit(True))
            some = signed.join(hit, ["inst", "id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
            again = canonicalize(some.filter("hit"), moved).select("inst", "id", F.col("children").alias("__new"))
            changed = some.join(again, ["inst", "id"], "left").withColumn("children", F.coalesce("__new", "children")).drop("__new")
        table = written(after(changed, "rep").select("inst", "id", "op", "children", "rep", "hit"), "signatures")
        drop_written(spark, pairs, signed)
        signed, use = table.drop("hit"), table.filter("hit").drop("hit")
    else:
        raise RuntimeError(f"closure needs more than {max_rounds} rounds")
    if spent is not None:
        marks.append(time.perf_counter())
        spent |= {p: y - x for p, x, y in zip(("merge_s", "build_s", "rebuild_s"), marks, marks[1:])}
    rep = of_class(nodes.select("inst", "id")).select("inst", "id", "rep")
    if moves is not None:
        rep = rep.join(moves, ["inst", "rep"], "left").select("inst", "id", F.coalesce("__to", "rep").alias("rep"))
    return rep, rounds


def close_kernel(nodes: list[tuple[int, str, tuple[int, ...]]], equalities: list[tuple[int, int]], deadline: float | None = None, spent: dict | None = None) -> tuple[dict[int, int], int]:
    """({id: least id of its class}, rounds with merges), for one instance. Raises
    TimeoutError in a round after ``deadline`` (of time.monotonic). A child or an end
    of an equality needs no node of its own. ``spent`` gets the seconds of the phases
    ``build_s`` (parents and use lists), ``merge_s`` (asserted equalities) and
    ``rebuild_s`` (the rounds).

    A table keeps every signature's first term. The class with fewer users joins the
    other; only its users get new signatures, and are looked up in the next round, with
    the classes of its beginning."""
    marks = [time.perf_counter()]
    parent = {i: i for i, _, _ in nodes}
    for _, _, children in nodes:
        for c in children:
            parent.setdefault(c, c)
    for a, b in equalities:
        parent.setdefault(a, a)
        parent.setdefault(b, b)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    users: dict[int, list[int]] = {i: [] for i in parent}
    terms = {}
    for i, op, children in nodes:
        if children:
            terms[i] = (op, children)
            for c in set(children):
                users[c].append(i)

    def merge(a: int, b: int) -> list[int]:
        """The users whose signatures change; none if a and b are one class already."""
        a, b = root(a), root(b)
        if a == b:
            return []
        if len(users[a]) < len(users[b]):
            a, b = b, a
        parent[b] = a
        merged.append(a)
        users[a] += (moved := users.pop(b))
        return moved

    merged: list[int] = []  # one entry for each merge
    marks.append(time.perf_counter())
    for a, b in equalities:
        merge(a, b)
    marks.append(time.perf_counter())
    first: dict[tuple, int] = {}
    work, rounds = list(terms), 0
    while work:
        if deadline is not None and time.monotonic() > deadline:
            raise TimeoutError(f"no fixpoint after {rounds} rounds")
        pairs = []
        for i in dict.fromkeys(work):
            op, children = terms[i]
            other = first.setdefault((op, tuple(map(root, children))), i)
            if other != i:
                pairs.append((other, i))
        before = len(merged)
        work = [i for a, b in pairs for i in merge(a, b)]
        rounds += len(merged) > before
    if spent is not None:
        marks.append(time.perf_counter())
        spent |= {p: b - a for p, a, b in zip(("build_s", "merge_s", "rebuild_s"), marks, marks[1:])}
    least: dict[int, int] = {}
    for i in parent:
        r = root(i)
        least[r] = min(i, least.get(r, i))
    return {i: least[root(i)] for i in parent}, rounds


def close_grouped(nodes: DataFrame, equalities: DataFrame) -> DataFrame:
    """(inst, id, rep, rounds) by the kernel: one shuffle of each table, one task for
    each instance. ``inst`` may be of any type."""
    kind = nodes.schema["inst"].dataType.simpleString()

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        terms = list(zip(left["id"].to_pylist(), left["op"].to_pylist(), map(tuple, left["children"].to_pylist())))
        rep, rounds = close_kernel(terms, list(zip(right["a"].to_pylist(), right["b"].to_pylist())))
        ids = [i for i, _, _ in terms]
        return pa.table({"inst": pa.array([key[0].as_py()] * len(ids), key[0].type), "id": pa.array(ids, pa.int64()), "rep": pa.array([rep[i] for i in ids], pa.int64()), "rounds": pa.array([rounds] * len(ids), pa.int32())})

    left = nodes.select("inst", "id", "op", "children").groupBy("inst")
    right = equalities.select(F.col("inst").alias("inst"), "a", "b")  # a column of its own, if both come from one table
    return left.cogroup(right.groupBy("inst")).applyInArrow(run, f"inst {kind}, id bigint, rep bigint, rounds int")


def violated(constraints: DataFrame, rep: DataFrame) -> DataFrame:
    """(inst, violated): whether a disequality of the instance holds between equal
    terms. Instances without disequalities aren't listed."""
    side = lambda c: rep.select("inst", F.col("id").alias(c), F.col("rep").alias(f"r{c}"))
    both = constraints.filter("kind = 'neq'").join(side("a"), ["inst", "a"]).join(side("b"), ["inst", "b"])
    return both.groupBy("inst").agg(F.max(F.col("ra") == F.col("rb")).alias("violated"))


def verdicts(instances: DataFrame, constraints: DataFrame, rep: DataFrame) -> DataFrame:
    """(inst, verdict) for all ``instances``: unsat if a disequality is violated."""
    found = instances.select("inst").distinct().join(violated(constraints, rep), "inst", "left")
    return found.select("inst", F.when(F.coalesce("violated", F.lit(False)), "unsat").otherwise("sat").alias("verdict"))
