"""Components, closure and aggregation, against plain versions."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tesseral.operators import closure, collect_reduce, components, diagnostics
from tesseral.operators.termgraph import TermGraph
from tesseral.plans.storage import shared_dir, written
from tesseral.queries import QUERIES, SQL
from tesseral.sources import generate
from tesseral.streaming import watch_folder

SF = "/root/testdata/sf0.001"


def plain_classes(edges):
    rep = {}
    find = lambda x: x if rep.setdefault(x, x) == x else find(rep[x])
    for a, b in edges:
        a, b = find(a), find(b)
        rep[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(rep)}


@pytest.mark.parametrize("small", [components.SMALL_EDGES, 30, 0])
def test_components_of_plain_ids(spark, small):
    rng = random.Random(2)
    for low, step in ((-50, 1), (-(2**62), 2**55)):  # ids that fill their range, and ids that don't
        edges = [(low + step * rng.randrange(120), low + step * rng.randrange(120)) for _ in range(90)] + [(low, low), (7, None)]
        frame = spark.createDataFrame(edges, "a bigint, b bigint").repartition(9)
        got = {r.id: r.rep for r in components.connected_components(frame, small=small).collect()}
        assert got == plain_classes([e for e in edges if None not in e])
    narrow = frame.filter("false").select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    assert components.connected_components(narrow, small=small).schema["rep"].dataType.simpleString() == "int"
    words = spark.createDataFrame([("b", "c"), ("a", "c"), ("x", "x"), ("y", None)], "a string, b string")
    assert {r.id: r.rep for r in components.connected_components(words, small=max(small, 9)).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x"}


@pytest.mark.parametrize("small", [components.SMALL_EDGES, 0])
def test_components(spark, small):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500), (7, None)]
    frame = spark.createDataFrame([(k, a, b) for k in ("x", "y") for a, b in edges[:: 1 if k == "x" else 2]], "inst string, a bigint, b bigint")
    got = {(r.inst, r.id): r.rep for r in components.connected_components(frame, keys=("inst",), small=small).collect()}
    want = {}
    for k, step in (("x", 1), ("y", 2)):
        want |= {(k, i): r for i, r in plain_classes([e for e in edges[::step] if None not in e]).items()}
    assert got == want
    assert components.connected_components(frame.filter("false"), keys=("inst",), small=small).count() == 0


def test_union_find_over_tables(spark):
    rep = components.singletons(spark, 1000)
    pairs = spark.range(0, 998, 2).select(F.col("id").alias("a"), (F.col("id") + 2).alias("b"))
    joined = written(components.union_all(rep, pairs), "rep")
    assert joined.filter("id % 2 = 0 AND rep <> 0").count() == 0 and joined.filter("id % 2 = 1 AND rep <> id").count() == 0
    again = components.union_all(joined, pairs)
    assert again.exceptAll(joined).count() == 0
    asked = spark.createDataFrame([(0, 998), (0, 1), (5, 5), (7777, 7777), (7777, 1)], "a bigint, b bigint")
    assert sorted((r.a, r.b, r.same) for r in components.same_set(asked, joined, "a", "b").collect()) == sorted([(0, 998, True), (0, 1, False), (5, 5, True), (7777, 7777, True), (7777, 1, False)])


def test_sequential_baseline(spark):
    pairs = generate.union_pairs(spark, 60, 50, 0.99)
    alone = {r.id: r.rep for r in components.sequential_classes(pairs, 50).collect()}
    joined = components.union_all(components.singletons(spark, 50), pairs)
    assert alone == {r.id: r.rep for r in joined.collect()}


def test_least_labels_of_a_long_chain():
    n = 5000
    order = np.random.default_rng(0).permutation(n)
    assert (components.least_labels(order[:-1], order[1:], n) == 0).all()


def naive_closure(nodes, equal):
    rep = {i: i for i, _, _ in nodes}

    def join(a, b):
        a, b = rep[a], rep[b]
        for k in rep:
            if rep[k] == max(a, b):
                rep[k] = min(a, b)
        return a != b

    for a, b in equal:
        join(a, b)
    while any([join(i, j) for i, f, x in nodes for j, g, y in nodes if i < j and x and f == g and len(x) == len(y) and all(rep[p] == rep[q] for p, q in zip(x, y))]):
        pass
    return rep


def random_terms(rng):
    nodes = [(i, f"c{i}", ()) for i in range(5)]
    seen = {(op, ch) for _, op, ch in nodes}
    for _ in range(rng.randrange(4, 14)):
        term = (rng.choice("fg"), tuple(rng.randrange(len(nodes)) for _ in range(rng.choice([1, 2]))))
        if term not in seen:
            seen.add(term)
            nodes.append((len(nodes), *term))
    return nodes, [(rng.randrange(len(nodes)), rng.randrange(len(nodes))) for _ in range(rng.randrange(1, 5))]


def test_children_without_a_node_of_their_own(spark):
    nodes = spark.createDataFrame([(7, 10, "f", [1]), (7, 11, "f", [2]), (7, 12, "g", [10, 2, 1, 3])], "inst int, id bigint, op string, children array<bigint>")
    pairs = spark.createDataFrame([(7, 1, 2)], "inst int, a bigint, b bigint")
    for rep in (closure.close_rounds(nodes, pairs)[0], closure.close_grouped(nodes, pairs)):
        assert sorted((r.inst, r.id, r.rep) for r in rep.select("inst", "id", "rep").collect()) == [(7, 10, 10), (7, 11, 10), (7, 12, 12)]


def test_wide_terms_close_in_rounds(spark):
    rng, terms, equal, want = random.Random(9), [], [], {}
    for k in range(6):
        nodes, pairs = random_terms(rng)
        nodes += [(50 + j, "w", tuple(rng.randrange(5) for _ in range(5))) for j in range(4)] + [(60, "v", (50, 0, 0, 0)), (61, "v", (51, 0, 0, 0))]
        pairs += [(0, 1), (2, 3)]
        terms += [(f"i{k}", i, op, list(ch)) for i, op, ch in nodes]
        equal += [(f"i{k}", a, b) for a, b in pairs]
        want |= {(f"i{k}", i): r for i, r in closure.close_kernel(nodes, pairs)[0].items()}
    spent = {}
    got = closure.close_rounds(spark.createDataFrame(terms, "inst string, id bigint, op string, children array<bigint>"), spark.createDataFrame(equal, "inst string, a bigint, b bigint"), spent=spent)[0]
    assert {(r.inst, r.id): r.rep for r in got.collect()} == want and set(spent) == {"merge_s", "build_s", "rebuild_s"}


def test_kernel_equals_naive_closure():
    rng = random.Random(5)
    for _ in range(200):
        nodes, equal = random_terms(rng)
        rep, _ = closure.close_kernel(nodes, equal)
        assert rep == naive_closure(nodes, equal)
        rng.shuffle(equal)
        assert closure.close_kernel(nodes, equal)[0] == rep


def test_rounds_equal_kernel(spark):
    rng = random.Random(6)
    terms, equal, want = [], [], {}
    for k in range(25):
        nodes, pairs = random_terms(rng)
        terms += [(f"i{k}", i, op, list(ch)) for i, op, ch in nodes]
        equal += [(f"i{k}", a, b) for a, b in pairs]
        want |= {(f"i{k}", i): r for i, r in closure.close_kernel(nodes, pairs)[0].items()}
    nodes = spark.createDataFrame(terms, "inst string, id bigint, op string, children array<bigint>")
    pairs = spark.createDataFrame(equal, "inst string, a bigint, b bigint")
    for got in (closure.close_rounds(nodes, pairs)[0], closure.close_grouped(nodes, pairs)):
        assert {(r.inst, r.id): r.rep for r in got.collect()} == want


def test_rounds_are_bounded_and_stay_small(spark):
    from tesseral.sources.scripts import constraint_table, node_table, parse_scripts

    parsed = parse_scripts(generate.instances(spark, [("chain", 12)]))
    nodes, said = written(node_table(parsed), "nodes"), written(constraint_table(parsed), "said")
    rep, rounds = closure.close_rounds(nodes, said.filter("kind = 'eq'"))
    assert rounds == 12 and rep._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**40
    with pytest.raises(RuntimeError):
        closure.close_rounds(nodes, said.filter("kind = 'eq'"), max_rounds=3)


def test_hashcons_and_frontier(spark):
    nodes = spark.createDataFrame([("i", 0, "a", []), ("i", 1, "b", []), ("i", 2, "f", [0]), ("i", 5, "f", [0]), ("i", 3, "f", [1]), ("i", 4, "h", [0, 0])], "inst string, id bigint, op string, children array<bigint>")
    assert closure.hashcons(nodes).count() == 5
    rep = spark.createDataFrame([("i", i, 0 if i == 1 else i) for i in range(6)], "inst string, id bigint, rep bigint")
    changed = spark.createDataFrame([("i", 0)], "inst string, rep bigint")
    assert sorted(r.id for r in closure.frontier(nodes, rep, changed).collect()) == [2, 3, 4, 5]
    shown = {r.id: r.children for r in closure.canonicalize(nodes, rep).collect()}
    assert shown == {2: [0], 5: [0], 3: [0], 4: [0, 0]}


def test_keyed_aggregation(spark):
    rng = random.Random(7)
    rows = [(rng.choice([0, 0, 0, 1, 2, 9, None]), rng.randrange(100)) for _ in range(500)]
    data = spark.createDataFrame(rows, "k bigint, v bigint").repartition(7)
    want = {}
    for k, v in rows:
        want[k] = want.get(k, 0) + v
    assert {r.k: r.s for r in collect_reduce.collect_reduce(data, "k", s=F.sum("v")).collect()} == want
    own = collect_reduce.collect_reduce_sorted(data, "k", "v", lambda v: int(v.sum()), sum, "s", "bigint")
    assert {None if r.k is None else int(r.k): r.s for r in own.collect()} == want
    sums = collect_reduce.collect_reduce_sorted(data, "k", "v", name="s", kind="bigint", reduceat=np.add.reduceat)
    assert {r.k: r.s for r in sums.collect()} == want
    lists = collect_reduce.collect_reduce_sorted(data, "k", "v", lambda v: sorted(v.tolist()), lambda s: sorted(x for part in s for x in part), "s", "array<bigint>")
    assert {r.k: r.s for r in lists.collect()} == {k: sorted(v for q, v in rows if q == k) for k in want}
    assert collect_reduce.collect_reduce_sorted(data.filter("false"), "k", "v", name="s", kind="bigint", reduceat=np.add.reduceat).count() == 0
    alone = collect_reduce.collect_reduce_sequential(data.filter("k IS NOT NULL"), "k", "v", 12, "s")
    assert {r.k: r.s for r in alone.collect()} == {k: want.get(k, 0) for k in range(12)}
    full = collect_reduce.collect_reduce(data, "k", 12, s=F.sum("v"))
    assert {r.k: r.s for r in full.collect()} == {k: want.get(k, 0) for k in range(12)}


def test_statistics(spark):
    data = spark.createDataFrame([("a", float(x)) for x in (5, 1, 3, 2)] + [("b", 7.0), ("b", None)], "k string, v double")
    assert {r.k: r.upper_median for r in diagnostics.upper_medians(data, ["k"], "v").collect()} == {"a": 3.0, "b": 7.0}
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, rng.random() * 9])) for _ in range(400)]
    many = diagnostics.upper_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v")
    of = lambda k: sorted(v for q, v in rows if q == k and v is not None)
    assert {r.k: r.upper_median for r in many.collect()} == {k: of(k)[len(of(k)) // 2] for k in ("a", "b", None)}
    fast = diagnostics.speedup(data.filter("v IS NOT NULL"), "k", "v", "b")
    assert {r.k: r.speedup for r in fast.collect()} == {"a": 7.0, "b": 1.0}


def test_workloads(spark):
    for spread in ("uniform", "single", 0.99):
        got = generate.key_values(spark, 5000, 50, spread).agg(F.min("key"), F.max("key"), F.min("val"), F.max("val"), F.count_if(F.col("key") == 0)).first()
        assert got[0] >= 0 and got[1] < 50 and got[2] >= 1 and got[3] <= 99
        assert got[4] == 5000 if spread == "single" else got[4] < 300 if spread == "uniform" else got[4] > 700
    assert generate.union_pairs(spark, 100, 10).filter("a < 10 AND b < 10").count() == 100
    assert generate.operation_stream(spark, 2, 50, 10, 0.0).filter("op = 'find'").count() == 100


def test_classes_after_a_stream(spark):
    quiet = generate.classes_after(generate.operation_stream(spark, 2, 50, 100, 0.0), 100, 0.0)
    assert quiet.filter("id = rep").count() == 100
    busy = generate.classes_after(generate.operation_stream(spark, 4, 500, 100, 1.0), 100)
    assert busy.count() == 100 and busy.select("rep").distinct().count() < 10


@pytest.mark.parametrize("strategy", ["kernel", "rounds"])
def test_term_graph(spark, strategy):
    g = TermGraph(strategy, spark)
    a, b = g.add("a"), g.add("b")
    fa, fb = g.add("f", a), g.add("f", b)
    gfa, gfb = g.add("g", fa, a), g.add("g", fb, b)
    assert g.add("f", a) == fa and g.num_terms() == 6 and not g.equiv(a, b)
    g.merge(a, b)
    assert g.rebuild() == 2 and g.equiv(fa, fb) and g.equiv(gfa, gfb) and g.num_classes() == 3
    assert g.rebuild() == 2 and g.num_classes() == 3 and g.add("f", b) == fa
    assert g.lines() == ["3 classes, 6 terms", "class 0: {a, b}", "class 2: {f(0), f(1)}", "class 4: {g(2, 0), g(3, 1)}"]
    many = TermGraph(strategy, spark, reserved=3)
    leaves = [many.add(f"x{i}") for i in range(100)]
    assert leaves[0] == 3
    many.merge_all(zip(leaves, leaves[1:]))
    many.rebuild()
    assert many.num_classes() == 4 and many.equiv(leaves[0], leaves[99])


def test_term_graph_refuses():
    for wrong in (lambda: TermGraph("other"), lambda: TermGraph("rounds"), lambda: TermGraph().add("f", 0)):
        with pytest.raises(ValueError):
            wrong()


def test_stream_of_scripts(spark, tmp_path):
    generate.write_instances(str(tmp_path / "in"), [("chain", 2)])
    go = lambda: watch_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert go()
    generate.write_instances(str(tmp_path / "in"), [("grid", 2)])
    assert go()
    assert sorted(r.inst for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["chain_n2_unsat.smt2", "grid_n2_unsat.smt2"]


def test_shared_folder_is_the_session_s(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_tables_are_cleared(spark, tmp_path, monkeypatch):
    from tesseral.plans import storage

    monkeypatch.setattr(storage, "_MADE", [])
    monkeypatch.setattr(storage, "shared_dir", lambda s: f"file://{tmp_path}")
    assert written(spark.range(3), "some").count() == 3 and len(list(tmp_path.iterdir())) == 1
    storage.clear_written(spark)
    assert not list(tmp_path.iterdir()) and not storage._MADE


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(SQL[name]), QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted(str([value(r[c]) for c in cols]) for r in got.collect()) == sorted(str([value(dict(zip(want.columns, r))[c]) for c in cols]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_part_supplier_queries_over_all_line_items(spark, tmp_path):
    rng = random.Random(4)
    lines = [(20 * g + rng.randrange(9), 20 * g + rng.randrange(5), rng.choice([50.0, 7.0]), rng.choice([0.1, 0.0])) for g in range(6) for _ in range(8)]
    spark.createDataFrame(lines, "l_partkey bigint, l_suppkey bigint, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = sorted({(p * 2, s * 2 + 1) for p, s, _, _ in lines})
    rep = plain_classes(pairs)
    assert len(set(rep.values())) > 6
    rows = lambda name, *cols: sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).select(*cols).collect())
    assert rows("uf_part_supplier_components", "vertex", "component") == sorted(rep.items())
    assert rows("same_set_pairs", "a", "b", "same") == [(a, b, True) for a, b in pairs]
    assert rows("canonical_terms", "id", "shown") == sorted((a * 1_000_000 + b, f"supplies({rep[a]}, {rep[b]}, {rep[a]})") for a, b in pairs)
