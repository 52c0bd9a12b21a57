"""Queries over the star-schema tables, each with SQL of the same result.

Rows become terms: a key is a constant, and an application over classes of other
rows is tied to it. The engine that solves scripts also closes these terms.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesseral.functions.terms import PHASES, display, expected_verdict, timing_field, timing_line
from tesseral.operators import closure, collect_reduce, components, diagnostics
from tesseral.plans.solver import solve_scripts, totals
from tesseral.plans.storage import new_path, written
from tesseral.sources import generate
from tesseral.sources.scripts import constraint_table, declaration_table, node_table, parse_scripts, scan_scripts, write_scripts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by key among the customers of a nation and segment, and itself."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), F.coalesce(F.lag("c_custkey").over(w), F.col("c_custkey")).alias("b"))


def uf_customer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_components(_customer_edges(spark, sf_dir)).select(F.col("id").alias("c_custkey"), F.col("rep").alias("class_rep"))


def union_all_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singletons, then a batch of unions, in the table form of union-find."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("rep"))
    return components.union_all(own, _customer_edges(spark, sf_dir)).select(F.col("id").alias("c_custkey"), F.col("rep").alias("class_rep"))


def make_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.singletons(spark, 1000)


# Constants of customers are 3k, of orders 3k + 1, of parts 3k + 2; they never coincide.
def _order_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("id"), F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("op"), F.array().cast("array<bigint>").alias("children"))
    orders = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 3 + 1).alias("id"), F.concat("o_orderstatus", "o_orderpriority").alias("op"), F.array(F.col("o_custkey") * 3).alias("children"))
    nodes = customers.union(orders).withColumn("inst", F.lit("tables"))
    equal = _customer_edges(spark, sf_dir).select(F.lit("tables").alias("inst"), (F.col("a") * 3).alias("a"), (F.col("b") * 3).alias("b"))
    return nodes.select("inst", "id", "op", "children"), equal


def _part_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    w = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    nodes = part.select(F.lit("tables").alias("inst"), (F.col("p_partkey") * 3 + 2).alias("id"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("op"), F.array().cast("array<bigint>").alias("children"))
    equal = part.select(F.lit("tables").alias("inst"), (F.col("p_partkey") * 3 + 2).alias("a"), (F.coalesce(F.lag("p_partkey").over(w), F.col("p_partkey")) * 3 + 2).alias("b"))
    return nodes, equal


def cc_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of equal operator over equal customers are equal."""
    rep, _ = closure.close_rounds(*_order_terms(spark, sf_dir))
    return rep.filter("id % 3 = 1").select(F.expr("(id - 1) div 3").alias("o_orderkey"), F.expr("(rep - 1) div 3").alias("class_rep"))


def cc_orders_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a task for each instance: here the customers of a nation and
    segment with their orders, as equal customers share both."""
    nodes, equal = _order_terms(spark, sf_dir)
    home = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 3).alias("home"), F.concat_ws(" ", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("inst"))
    split = nodes.drop("inst").withColumn("home", F.coalesce(F.get("children", F.lit(0)), "id")).join(home, "home").select("inst", "id", "op", "children")
    pairs = equal.drop("inst").join(home.withColumnRenamed("home", "a"), "a").select("inst", "a", "b")
    rep = closure.close_grouped(split, pairs)
    return rep.filter("id % 3 = 1").select(F.expr("(id - 1) div 3").alias("o_orderkey"), F.expr("(rep - 1) div 3").alias("class_rep"))


def cc_lineitem_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items over orders and parts: a cascade of two levels. Line items have no
    key of their own; equal terms are counted."""
    nodes, equal = _order_terms(spark, sf_dir)
    parts, equal_parts = _part_terms(spark, sf_dir)
    rep, _ = closure.close_rounds(nodes.union(parts), equal.union(equal_parts))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))
    side = lambda c: rep.select(F.col("id").alias(c), F.col("rep").alias(f"{c}_rep"))
    named = lines.select((F.col("l_orderkey") * 3 + 1).alias("o"), (F.col("l_partkey") * 3 + 2).alias("p"), "n").join(side("o"), "o").join(side("p"), "p")
    return named.groupBy("o_rep", "p_rep").agg(F.sum("n").alias("n_lines")).select(F.expr("(o_rep - 1) div 3").alias("order_rep"), F.expr("(p_rep - 2) div 3").alias("part_rep"), "n_lines")


def _bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of parts and suppliers linked by any line item."""
    lines = table(spark, sf_dir, "lineitem")
    return components.connected_components(lines.select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")))


def uf_part_supplier_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bipartite(spark, sf_dir).select(F.col("id").alias("vertex"), F.col("rep").alias("component"))


def same_set_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are the part and the supplier of a line in one component."""
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b")).distinct()
    return components.same_set(asked, _bipartite(spark, sf_dir), "a", "b")


def same_set_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the customer of an order in one class with the customer a few keys on; ids
    beyond the table are alone."""
    rep = components.connected_components(_customer_edges(spark, sf_dir))
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.col("o_orderkey") % 7).alias("b")).distinct()
    return components.same_set(asked, rep, "a", "b")


def uf_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of operations, one for each order: urgent ones unite their customer with
    the nation's next one, others look theirs up. Classes after it, and look-ups in them."""
    customer = table(spark, sf_dir, "customer")
    after = F.lead("c_custkey").over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    stream = table(spark, sf_dir, "orders").join(customer.select(F.col("c_custkey").alias("k1"), F.coalesce(after, "c_custkey").alias("k2")), F.col("o_custkey") == F.col("k1"))
    stream = stream.select(F.when(F.col("o_orderpriority") == "1-URGENT", "union").otherwise("find").alias("op"), "k1", "k2")
    own = customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("rep"))
    rep = written(components.union_all(own, stream.filter("op = 'union'"), "k1", "k2"), "rep")
    finds = components.find(stream.filter("op = 'find'"), rep, "k1", "rep").groupBy("rep").agg(F.count("*").alias("n_finds"))
    return rep.groupBy("rep").agg(F.count("*").alias("n_members")).join(finds, "rep", "left").select(F.col("rep").alias("class_rep"), "n_members", F.coalesce("n_finds", F.lit(0)).alias("n_finds"))


def diseq_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An instance for each nation: customers two keys apart are said to differ."""
    customer = table(spark, sf_dir, "customer")
    nation = customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("inst"))
    rep = components.connected_components(_customer_edges(spark, sf_dir)).join(nation, "id").select("inst", "id", "rep")
    later = F.lead("c_custkey", 2).over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    said = customer.select(F.col("c_nationkey").cast("string").alias("inst"), F.lit("neq").alias("kind"), F.col("c_custkey").alias("a"), later.alias("b")).filter("b IS NOT NULL")
    every = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("inst"))
    return closure.verdicts(every, said, rep)


def hashcons_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _order_terms(spark, sf_dir)
    return closure.hashcons(nodes).select("op", F.array_join(F.transform("children", lambda c: c.cast("string")), ",").alias("children"), "id")


def num_classes_enodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = components.connected_components(_customer_edges(spark, sf_dir)).withColumn("inst", F.lit("customers"))
    return diagnostics.class_counts(rep)


def print_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").select(F.lit("customers").alias("inst"), F.col("c_custkey").alias("id"), F.col("c_name").alias("op"), F.array().cast("array<bigint>").alias("children"))
    rep = components.connected_components(_customer_edges(spark, sf_dir)).withColumn("inst", F.lit("customers"))
    return diagnostics.class_listing(nodes, rep).select("rep", "line")


def term_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = _order_terms(spark, sf_dir)
    return nodes.select("id", display(F.col("op"), F.col("children")).alias("shown"))


def canonical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms over parts and suppliers with representatives in place of children."""
    rep = _bipartite(spark, sf_dir).withColumn("inst", F.lit("x"))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("p"), (F.col("l_suppkey") * 2 + 1).alias("s")).distinct()
    nodes = lines.select(F.lit("x").alias("inst"), (F.col("p") * 1_000_000 + F.col("s")).alias("id"), F.lit("supplies").alias("op"), F.array("p", "s", "p").alias("children"))
    return closure.canonicalize(nodes, rep, 3).select("id", display(F.col("op"), F.col("children")).alias("shown"))


def frontier_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders over customers whose class has several members."""
    nodes, _ = _order_terms(spark, sf_dir)
    rep = written(components.connected_components(_customer_edges(spark, sf_dir)).select(F.lit("tables").alias("inst"), (F.col("id") * 3).alias("id"), (F.col("rep") * 3).alias("rep")), "rep")
    changed = rep.filter("id <> rep").select("inst", "rep")
    return closure.frontier(nodes, rep, changed).select(F.expr("(id - 1) div 3").alias("o_orderkey"))


def merge_pairs_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merges of one round over the orders."""
    nodes, _ = _order_terms(spark, sf_dir)
    customers = components.connected_components(_customer_edges(spark, sf_dir)).select((F.col("id") * 3).alias("id"), (F.col("rep") * 3).alias("rep"))
    rep = customers.union(nodes.filter("id % 3 = 1").select("id", F.col("id").alias("rep"))).withColumn("inst", F.lit("tables"))
    rep = written(rep.select("inst", "id", "rep"), "rep")
    return closure.merge_pairs(closure.canonicalize(nodes, rep), rep).select("a", "b")


def collect_reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum for each bucket, empty ones included."""
    data = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 5000).alias("key"), F.col("l_quantity").cast("bigint").alias("val"))
    return collect_reduce.collect_reduce(data, "key", 5000, total=F.sum("val"))


def collect_reduce_par_sort_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 5000).alias("key"), F.col("l_quantity").cast("bigint").alias("val"))
    return collect_reduce.collect_reduce_sorted(data, "key", "val", name="total", kind="bigint", buckets=5000, reduceat=np.add.reduceat)


def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.summary(table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("v")), ["event_type"], "v")


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") + 1).cast("double").alias("ops"), F.lit(2.0).alias("secs"))
    return diagnostics.throughput(data, ["event_type"], "ops", "secs")


def speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_orderkey") % 1000 + 1).cast("double").alias("secs"))
    return diagnostics.speedup(data, "o_orderstatus", "secs", "F")


_SIZES = [("chain", 0), ("chain", 4), ("chain", 50), ("grid", 1), ("grid", 4), ("grid", 16), ("cube", 2), ("cube", 6), ("exp", 0), ("exp", 3), ("exp", 8)]
_WIDE = [x for x in _SIZES if x not in (("chain", 50), ("exp", 8))]


def generated_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances of the four families with the counts of their closed forms."""
    return solve_scripts(generate.instances(spark, _SIZES)).select("inst", "verdict", "n_nodes", "n_classes", "rounds")


def generated_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by bulk-synchronous rounds, for those that take up to nine."""
    parsed = written(parse_scripts(generate.instances(spark, _WIDE)), "parsed")
    nodes, said = node_table(parsed), constraint_table(parsed)
    rep, _ = closure.close_rounds(nodes, said.filter("kind = 'eq'"))
    counts = diagnostics.class_counts(rep)
    return closure.verdicts(parsed.select("inst"), said, rep).join(counts, "inst").select("inst", "verdict", F.col("num_enodes").alias("n_nodes"), F.col("num_classes").alias("n_classes"))


_SCRIPTS = [
    ("congruence", "(declare-sort U 0)(declare-fun f (U) U)(declare-const a U)(declare-const b U)(assert (= a b))(assert (not (= (f a) (f b))))(check-sat)"),
    ("operators", "(declare-sort U 0)(declare-fun f (U) U)(declare-fun g (U) U)(declare-const a U)(declare-const b U)(assert (= a b))(assert (not (= (f a) (g b))))"),
    ("cycle", "(declare-sort U 0)(declare-fun f (U) U)(declare-const a U)(assert (= (f a) a))(assert (not (= (f (f a)) a)))"),
    ("reflexive", "(declare-sort U 0)(declare-const a U)(assert (not (= a a)))"),
    ("empty", "(set-logic QF_UF)(check-sat)"),
    ("order", "(declare-sort U 0)(declare-fun f (U U) U)(declare-const a U)(declare-const b U)(assert (not (= (f a b) (f b a))))"),
    ("opaque", "(assert (= true false))(check-sat)"),
    ("bare", "(declare-const p Bool)(assert p)"),
    ("negated", "(declare-const p Bool)(assert (not p))"),
    ("inner", "(declare-const p Bool)(declare-const q Bool)(assert (= p (and p q)))"),
    ("unclosed", "(assert (= a b)"),
    ("undeclared", "(assert (= a b))"),
    ("alias", "(declare-sort U 0)(define-sort V () U)(declare-const a U)(declare-const b V)(assert (= a b))(assert (not (= b a)))"),
    ("no_sort", "(declare-const a Nowhere)"),
    ("twice", "(declare-const p Bool)(declare-const p Bool)"),
    ("bound", "(declare-const p Bool)(assert (= x (let ((x p)) x)))"),
    ("binder", "(declare-const p Bool)(assert (let (((x) p)) p))"),
]


def _scripts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, n, t) for n, t in _SCRIPTS], "inst string, path string, text string")


def smt2_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    solved = solve_scripts(_scripts(spark))
    return solved.select("inst", "verdict", F.regexp_extract("error", "^([A-Z][a-z-]+(?: [a-z]+)*):", 1).alias("reason"))


def smt2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_table(parse_scripts(_scripts(spark))).select("inst", "id", display(F.col("op"), F.col("children")).alias("shown"))


def smt2_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraint_table(parse_scripts(_scripts(spark)))


def smt2_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = declaration_table(parse_scripts(_scripts(spark)))
    return found.select("inst", "symbol", F.array_join("arg_sorts", " ").alias("arg_sorts"), "ret_sort")


def smt2_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script file for each nation, written, scanned from its folder and solved:
    neighbours by key in a segment are equal, and a function is said to differ on the
    nation's first and last customer."""
    edges = _customer_edges(spark, sf_dir).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), "c_nationkey"), "a")
    said = F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), lambda e: F.format_string("(declare-const c%d U)", e["a"]))
    equal = F.transform(F.array_sort(F.collect_list(F.struct("a", "b"))), lambda e: F.format_string("(assert (= c%d c%d))", e["a"], e["b"]))
    differ = F.format_string("(assert (not (= (f c%d) (f c%d))))(check-sat)", F.min("a"), F.max("a"))
    head = F.lit("(set-logic QF_UF)(declare-sort U 0)(declare-fun f (U) U)")
    scripts = edges.groupBy("c_nationkey").agg(F.concat(head, F.array_join(said, ""), F.array_join(equal, "\n"), differ).alias("text"))
    folder = new_path(spark, "scripts")
    write_scripts(scripts.select(F.format_string("nation_%d.smt2", "c_nationkey").alias("inst"), "text"), folder)
    return solve_scripts(scan_scripts(spark, folder)).select("inst", "verdict", "n_nodes", "n_classes")


def print_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = components.connected_components(_customer_edges(spark, sf_dir)).withColumn("inst", F.lit("customers"))
    return diagnostics.class_header(rep).select("line")


def suite_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(solve_scripts(_scripts(spark))).select("n", "n_sat", "n_unsat", "n_error")


def timing_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timing line made of numbers, and the numbers read from it."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", timing_line(*(F.col("n_nationkey") / (k + 2.0) for k in range(len(PHASES)))).alias("line"))
    return rows.select("n_nationkey", "line", *(timing_field(F.col("line"), p).alias(f"{p}_s") for p in PHASES), timing_field(F.concat(F.lit("no "), F.substring("line", 1, 20)), "solve").alias("none"))


def expected_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "_unsat").otherwise("_sat"), F.lit(".smt2"))
    return table(spark, sf_dir, "nation").select(name.alias("file"), expected_verdict(name).alias("expected"))


QUERIES = {
    f.__name__: f
    for f in (
        uf_customer_classes, union_all_customers, make_sets, cc_orders, cc_orders_kernel, cc_lineitem_cascade, uf_part_supplier_components, same_set_pairs, same_set_customers, uf_operations,
        diseq_check, hashcons_dedup, num_classes_enodes, print_classes, print_header, smt2_scan, term_display, canonical_terms, frontier_orders, merge_pairs_round,
        collect_reduce_sum, collect_reduce_par_sort_sum, upper_median, throughput, speedup, generated_verdicts, generated_rounds, smt2_solve,
        smt2_terms, smt2_constraints, smt2_declarations, suite_totals, timing_round_trip, expected_verdicts,
    )
}
_CUSTOMERS = "SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS class_rep FROM customer"
_ORDERS = f"""WITH c AS ({_CUSTOMERS}), o AS (
    SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_orderstatus || o_orderpriority, c.class_rep) AS class_rep
    FROM orders JOIN c ON o_custkey = c_custkey)"""
# Suppliers of a part are one class; recursion is over suppliers, which are few.
_BIPARTITE = """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey * 2 AS p, l_suppkey * 2 + 1 AS s FROM lineitem),
    f AS (SELECT p, min(s) AS s FROM e GROUP BY p),
    d AS (SELECT DISTINCT e.s AS u, f.s AS v FROM e JOIN f ON e.p = f.p),
    n AS (SELECT u, v FROM d UNION SELECT v, u FROM d),
    r AS (SELECT u AS s, u AS o FROM n UNION SELECT r.s, n.v FROM r JOIN n ON r.o = n.u),
    g AS (SELECT s, min(o) AS o FROM r GROUP BY s),
    m AS (SELECT g.o, least(min(e.p), min(e.s)) AS component FROM e JOIN g ON e.s = g.s GROUP BY g.o),
    k AS (SELECT g.s AS vertex, m.component FROM g JOIN m ON g.o = m.o UNION ALL SELECT f.p, m.component FROM f JOIN g ON f.s = g.s JOIN m ON g.o = m.o)"""
_FORMS = {
    "chain": lambda n: (4 * n + 2, n + 1, n),
    "grid": lambda n: (4 * n**2 + 2 * n - 2, 2 * n**2 + n - 1, None),
    "cube": lambda n: (4 * n**3 + 2 * n - 2, 2 * n**3 + n - 1, None),
    "exp": lambda n: (10 * 2**n - 8 if n else 2, 3 * 2**n - 2 if n else 1, 2 * n),
}
#: Rounds of lattices: those of the comparison tree's height, and one for f.
_ROUNDS = {("grid", 1): 1, ("grid", 4): 5, ("grid", 16): 9, ("cube", 2): 4, ("cube", 6): 9}


def _counts(sizes, rounds: bool) -> str:
    rows = []
    for f, n in sizes:
        nodes, classes, r = _FORMS[f](n)
        rows.append(f"('{generate.file_name(f, n)}', 'unsat', {nodes}, {classes}" + (f", {_ROUNDS.get((f, n), r)})" if rounds else ")"))
    more = ", CAST(rounds AS INTEGER) AS rounds" if rounds else ""
    return f"SELECT inst, verdict, CAST(n_nodes AS BIGINT) AS n_nodes, CAST(n_classes AS BIGINT) AS n_classes{more} FROM (VALUES {', '.join(rows)}) t(inst, verdict, n_nodes, n_classes{', rounds' if rounds else ''})"


_SUM = """SELECT k.key, CAST(coalesce(s.total, 0) AS BIGINT) AS total FROM (SELECT range AS key FROM range(5000)) k
    LEFT JOIN (SELECT l_partkey % 5000 AS key, sum(CAST(l_quantity AS BIGINT)) AS total FROM lineitem GROUP BY 1) s ON k.key = s.key"""

SQL = {
    "uf_customer_classes": _CUSTOMERS,
    "union_all_customers": _CUSTOMERS,
    "make_sets": "SELECT range AS id, range AS rep FROM range(1000)",
    "cc_orders": f"{_ORDERS} SELECT o_orderkey, class_rep FROM o",
    "cc_orders_kernel": f"{_ORDERS} SELECT o_orderkey, class_rep FROM o",
    "cc_lineitem_cascade": f"""{_ORDERS}, p AS (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS part_rep FROM part)
        SELECT o.class_rep AS order_rep, part_rep, count(*) AS n_lines FROM lineitem JOIN o ON l_orderkey = o_orderkey JOIN p ON l_partkey = p_partkey GROUP BY 1, 2""",
    "uf_part_supplier_components": f"{_BIPARTITE} SELECT vertex, component FROM k",
    "same_set_pairs": f"""{_BIPARTITE}, q AS (SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem)
        SELECT q.a, q.b, coalesce(x.component, q.a) = coalesce(y.component, q.b) AS same FROM q LEFT JOIN k x ON q.a = x.vertex LEFT JOIN k y ON q.b = y.vertex""",
    "same_set_customers": f"""WITH c AS ({_CUSTOMERS}), q AS (SELECT DISTINCT o_custkey AS a, o_custkey + o_orderkey % 7 AS b FROM orders)
        SELECT q.a, q.b, coalesce(x.class_rep, q.a) = coalesce(y.class_rep, q.b) AS same FROM q LEFT JOIN c x ON q.a = x.c_custkey LEFT JOIN c y ON q.b = y.c_custkey""",
    "uf_operations": """WITH o AS (SELECT o_custkey AS k, bool_or(o_orderpriority = '1-URGENT') AS joined, count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS finds FROM orders GROUP BY 1),
        c AS (SELECT c_custkey, c_nationkey, coalesce(joined, false) AS joined, coalesce(finds, 0) AS finds FROM customer LEFT JOIN o ON c_custkey = k),
        b AS (SELECT *, CASE WHEN lag(joined) OVER w THEN 0 ELSE 1 END AS begins FROM c WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
        g AS (SELECT *, sum(begins) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS island FROM b)
        SELECT min(c_custkey) AS class_rep, count(*) AS n_members, CAST(sum(finds) AS BIGINT) AS n_finds FROM g GROUP BY c_nationkey, island""",
    "diseq_check": f"""WITH c AS ({_CUSTOMERS}), l AS (SELECT c_nationkey, c_custkey AS a, lead(c_custkey, 2) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b FROM customer),
        v AS (SELECT l.c_nationkey, bool_or(x.class_rep = y.class_rep) AS bad FROM l JOIN c x ON l.a = x.c_custkey JOIN c y ON l.b = y.c_custkey GROUP BY 1)
        SELECT CAST(n_nationkey AS VARCHAR) AS inst, CASE WHEN coalesce(bad, false) THEN 'unsat' ELSE 'sat' END AS verdict FROM nation LEFT JOIN v ON n_nationkey = c_nationkey""",
    "hashcons_dedup": """SELECT 'customer ' || c_custkey AS op, '' AS children, c_custkey * 3 AS id FROM customer
        UNION ALL SELECT o_orderstatus || o_orderpriority, CAST(o_custkey * 3 AS VARCHAR), min(o_orderkey * 3 + 1) FROM orders GROUP BY 1, 2""",
    "num_classes_enodes": f"SELECT 'customers' AS inst, count(DISTINCT class_rep) AS num_classes, count(*) AS num_enodes FROM ({_CUSTOMERS})",
    "print_classes": f"""SELECT class_rep AS rep, 'class ' || class_rep || ': {{' || string_agg(c_name, ', ' ORDER BY c_name) || '}}' AS line
        FROM ({_CUSTOMERS}) JOIN customer USING (c_custkey) GROUP BY class_rep""",
    "term_display": """SELECT c_custkey * 3 AS id, 'customer ' || c_custkey AS shown FROM customer
        UNION ALL SELECT o_orderkey * 3 + 1, o_orderstatus || o_orderpriority || '(' || (o_custkey * 3) || ')' FROM orders""",
    "canonical_terms": f"""{_BIPARTITE}, l AS (SELECT DISTINCT l_partkey * 2 AS p, l_suppkey * 2 + 1 AS s FROM lineitem)
        SELECT p * 1000000 + s AS id, 'supplies(' || coalesce(x.component, p) || ', ' || coalesce(y.component, s) || ', ' || coalesce(x.component, p) || ')' AS shown
        FROM l LEFT JOIN k x ON p = x.vertex LEFT JOIN k y ON s = y.vertex""",
    "frontier_orders": f"""WITH c AS ({_CUSTOMERS}), m AS (SELECT class_rep FROM c GROUP BY 1 HAVING count(*) > 1)
        SELECT o_orderkey FROM orders JOIN c ON o_custkey = c_custkey WHERE class_rep IN (SELECT class_rep FROM m)""",
    "merge_pairs_round": f"{_ORDERS} SELECT o_orderkey * 3 + 1 AS a, class_rep * 3 + 1 AS b FROM o WHERE o_orderkey <> class_rep",
    "collect_reduce_sum": _SUM,
    "collect_reduce_par_sort_sum": _SUM,
    "upper_median": """WITH e AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS v FROM events)
        SELECT event_type, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS greatest, count(v) AS n, list_sort(list(v))[len(list(v)) // 2 + 1] AS upper_median FROM e WHERE v IS NOT NULL GROUP BY 1""",
    "throughput": "SELECT event_type, max((event_id + 1) / 2.0) / 1e6 AS mops FROM events GROUP BY 1",
    "speedup": """WITH b AS (SELECT o_orderstatus, CAST(min(o_orderkey % 1000 + 1) AS DOUBLE) AS best FROM orders GROUP BY 1)
        SELECT o_orderstatus, best, (SELECT best FROM b WHERE o_orderstatus = 'F') / best AS speedup FROM b""",
    "generated_verdicts": _counts(_SIZES, True),
    "generated_rounds": _counts(_WIDE, False),
    "smt2_solve": """SELECT * FROM (VALUES ('congruence', 'unsat', NULL), ('operators', 'sat', NULL), ('cycle', 'unsat', NULL), ('reflexive', 'unsat', NULL), ('empty', 'sat', NULL), ('order', 'sat', NULL), ('opaque', 'sat', NULL),
        ('bare', 'ERROR', 'Unsupported assertion'), ('negated', 'ERROR', 'Unsupported negated assertion'), ('inner', 'ERROR', 'Unsupported term variant'), ('unclosed', 'ERROR', 'Parse error'), ('undeclared', 'ERROR', 'Type-check error'),
        ('alias', 'unsat', NULL), ('no_sort', 'ERROR', 'Type-check error'), ('twice', 'ERROR', 'Type-check error'), ('bound', 'ERROR', 'Type-check error'), ('binder', 'ERROR', 'Parse error')) t(inst, verdict, reason)""",
    "smt2_terms": """SELECT inst, CAST(id AS BIGINT) AS id, shown FROM (VALUES ('congruence', 0, 'a'), ('congruence', 1, 'b'), ('congruence', 2, 'f(0)'), ('congruence', 3, 'f(1)'),
        ('operators', 0, 'a'), ('operators', 1, 'b'), ('operators', 2, 'f(0)'), ('operators', 3, 'g(1)'), ('cycle', 0, 'a'), ('cycle', 1, 'f(0)'), ('cycle', 2, 'f(1)'), ('reflexive', 0, 'a'),
        ('order', 0, 'a'), ('order', 1, 'b'), ('order', 2, 'f(0, 1)'), ('order', 3, 'f(1, 0)'), ('opaque', 0, 'true'), ('opaque', 1, 'false'), ('alias', 0, 'a'), ('alias', 1, 'b')) t(inst, id, shown)""",
    "smt2_constraints": """SELECT inst, CAST(seq AS INTEGER) AS seq, kind, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM (VALUES ('congruence', 0, 'eq', 0, 1), ('congruence', 1, 'neq', 2, 3),
        ('operators', 0, 'eq', 0, 1), ('operators', 1, 'neq', 2, 3), ('cycle', 0, 'eq', 1, 0), ('cycle', 1, 'neq', 2, 0), ('reflexive', 0, 'neq', 0, 0), ('order', 0, 'neq', 2, 3), ('opaque', 0, 'eq', 0, 1),
        ('alias', 0, 'eq', 0, 1), ('alias', 1, 'neq', 1, 0)) t(inst, seq, kind, a, b)""",
    "smt2_declarations": """SELECT * FROM (VALUES ('congruence', 'f', 'U', 'U'), ('congruence', 'a', '', 'U'), ('congruence', 'b', '', 'U'), ('operators', 'f', 'U', 'U'), ('operators', 'g', 'U', 'U'), ('operators', 'a', '', 'U'), ('operators', 'b', '', 'U'),
        ('cycle', 'f', 'U', 'U'), ('cycle', 'a', '', 'U'), ('reflexive', 'a', '', 'U'), ('order', 'f', 'U U', 'U'), ('order', 'a', '', 'U'), ('order', 'b', '', 'U'), ('alias', 'a', '', 'U'), ('alias', 'b', '', 'U')) t(inst, symbol, arg_sorts, ret_sort)""",
    "smt2_scan": """WITH n AS (SELECT c_nationkey, count(*) AS c, count(DISTINCT c_mktsegment) AS s, min(c_custkey) = max(c_custkey) AS one, arg_min(c_mktsegment, c_custkey) = arg_max(c_mktsegment, c_custkey) AS same FROM customer GROUP BY 1)
        SELECT 'nation_' || c_nationkey || '.smt2' AS inst, CASE WHEN same THEN 'unsat' ELSE 'sat' END AS verdict, CAST(c + CASE WHEN one THEN 1 ELSE 2 END AS BIGINT) AS n_nodes, CAST(s + CASE WHEN same THEN 1 ELSE 2 END AS BIGINT) AS n_classes FROM n""",
    "print_header": f"SELECT count(DISTINCT class_rep) || ' classes, ' || count(*) || ' terms' AS line FROM ({_CUSTOMERS})",
    "suite_totals": "SELECT CAST(17 AS BIGINT) AS n, CAST(4 AS BIGINT) AS n_sat, CAST(4 AS BIGINT) AS n_unsat, CAST(9 AS BIGINT) AS n_error",
    "timing_round_trip": "SELECT n_nationkey, 'timing: ' || "
    + " || ' ' || ".join(f"printf('{p}=%.6f', n_nationkey / {k + 2}.0::DOUBLE)" for k, p in enumerate(PHASES))
    + " AS line, "
    + ", ".join(f"CAST(printf('%.6f', n_nationkey / {k + 2}.0::DOUBLE) AS DOUBLE) AS {p}_s" for k, p in enumerate(PHASES))
    + ", CAST(NULL AS DOUBLE) AS none FROM nation",
    "expected_verdicts": "SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN '_unsat' ELSE '_sat' END || '.smt2' AS file, CASE WHEN n_nationkey % 2 = 0 THEN 'unsat' ELSE 'sat' END AS expected FROM nation",
}
