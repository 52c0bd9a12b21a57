"""Scripts, terms and verdicts."""

import pytest
from pyspark.sql import functions as F

from tesseral.cli import main
from tesseral.functions.terms import application, display, expected_verdict, leaf, timing_field, timing_line
from tesseral.operators.diagnostics import class_counts, class_listing
from tesseral.plans.solver import solve_scripts, solve_terms, solve_text, totals
from tesseral.sources import generate
from tesseral.sources.results import mismatches, report, timing_lines, write_csv
from tesseral.sources.scripts import constraint_table, declaration_table, node_table, parse_script, parse_scripts, scan_scripts
from tesseral.sources.sexpr import Literal, ParseError, read_all, show

HEAD = "(set-logic QF_UF)(declare-sort U 0)(declare-fun f (U) U)(declare-fun g (U) U)(declare-fun h (U U) U)" + "".join(f"(declare-const {c} U)" for c in "abcdexyz")


def goal(equal, differ):
    return HEAD + "".join(f"(assert (= {p} {q}))" for p, q in equal) + "".join(f"(assert (not (= {p} {q})))" for p, q in differ) + "(check-sat)"


# (equalities, disequalities, verdict, nodes, classes, rounds), worked out by hand
CASES = [
    ([("a", "b")], [], "sat", 2, 1, 0),
    ([("a", "b")], [("a", "b")], "unsat", 2, 1, 0),
    ([("a", "b")], [("(f a)", "(f b)")], "unsat", 4, 2, 1),
    ([("a", "b")], [("(f a)", "(g b)")], "sat", 4, 3, 0),
    ([("a", "b")], [("(g (f a))", "(g (f b))")], "unsat", 6, 3, 2),
    ([("a", "b"), ("c", "d")], [("(h a c)", "(h b d)")], "unsat", 6, 3, 1),
    ([("a", "b")], [("(h a c)", "(h b d)")], "sat", 6, 5, 0),
    ([("a", "b"), ("b", "c"), ("c", "d")], [("(f a)", "(f d)")], "unsat", 6, 2, 1),
    ([("(f a)", "(f b)")], [("a", "b")], "sat", 4, 3, 0),
    ([("a", "b")], [("(f (f (f (f a))))", "(f (f (f (f b))))")], "unsat", 10, 5, 4),
    ([("a", "b"), ("c", "d")], [("a", "c"), ("x", "y"), ("a", "x")], "sat", 6, 4, 0),
    ([("x", "(f a)"), ("y", "(f b)"), ("a", "b")], [("x", "y")], "unsat", 6, 2, 1),
    ([("(f a)", "a")], [("(f (f a))", "a")], "unsat", 3, 1, 1),
    ([("a", "b")], [("(h a a)", "(h a b)")], "unsat", 4, 2, 1),
    ([], [("(h a b)", "(h b a)")], "sat", 4, 4, 0),
    ([], [("a", "a")], "unsat", 1, 1, 0),
    ([], [], "sat", 0, 0, 0),
    ([("a", "b")], [("(h (f a) a)", "(h (f b) b)")], "unsat", 6, 3, 2),
]


@pytest.mark.parametrize("case", CASES)
def test_verdicts_and_counts(case):
    out = solve_text(goal(*case[:2]))
    assert (out["verdict"], out["n_nodes"], out["n_classes"], out["rounds"]) == case[2:]


def test_strategies_agree(spark):
    rows = [(f"i{k}", f"i{k}", goal(*c[:2])) for k, c in enumerate(CASES)]
    scripts = spark.createDataFrame(rows, "inst string, path string, text string")
    parsed = parse_scripts(scripts).cache()
    nodes, said = node_table(parsed), constraint_table(parsed)
    want = {f"i{k}": c[2] for k, c in enumerate(CASES)}
    assert {r.inst: r.verdict for r in solve_scripts(scripts).collect()} == want
    for strategy in ("kernel", "rounds"):
        assert {r.inst: r.verdict for r in solve_terms(nodes, said, strategy, parsed).collect()} == want
    with pytest.raises(ValueError):
        solve_terms(nodes, said, "other")


ERRORS = [
    ("(declare-const p Bool)(assert p)", "Unsupported assertion: p"),
    ("(declare-const p Bool)(assert (and p p))", "Unsupported assertion: (and p p)"),
    ("(declare-const p Bool)(assert (let ((q p)) (= q p)))", "Unsupported assertion: (let"),
    ("(declare-const p Bool)(assert (not p))", "Unsupported negated assertion: (not p)"),
    ("(declare-const p Bool)(assert (= p (= p p)))", "Unsupported term variant: (= p p)"),
    ("(declare-const p Bool)(assert (= p (ite p p p)))", "Unsupported term variant: (ite p p p)"),
    ("(assert (= a b)", "Parse error"),
    ("(assert (= a b)))", "Parse error"),
    ("(frobnicate)", "Parse error"),
    ("assert", "Parse error"),
    ("(declare-fun)", "Parse error"),
    ("(assert (= a b))", "Type-check error: undeclared symbol"),
    ("(declare-sort U 0)(declare-sort V 0)(declare-const a U)(declare-const b V)(assert (= a b))", "Type-check error: ="),
    ("(declare-sort U 0)(declare-fun f (U) U)(declare-const a U)(assert (= (f a a) a))", "Type-check error: f takes (U)"),
    ("(declare-sort U 0)(declare-const a U)(declare-const b U)(declare-const c U)(assert (= a b c))", "Unsupported assertion"),
]


@pytest.mark.parametrize(("text", "error"), ERRORS)
def test_errors_are_rows(text, error):
    out = solve_text(text)
    assert out["verdict"] == "ERROR" and out["error"].startswith(error)


CHECKED = [
    ("(declare-const a Nowhere)", "Type-check error: undeclared sort Nowhere"),
    ("(declare-sort U 1)(declare-const a U)", "Type-check error: undeclared sort U"),
    ("(declare-sort U 0)(declare-sort U 0)", "Type-check error: sort U is declared twice"),
    ("(declare-sort Bool 0)", "Type-check error: sort Bool is declared twice"),
    ("(declare-sort U 0)(declare-const a U)(declare-fun a (U) U)", "Type-check error: a is declared twice"),
    ("(declare-const p Bool)(assert (= x (let ((x p)) x)))", "Type-check error: undeclared symbol x"),
    ("(declare-const p Bool)(assert (let (((x) p)) p))", "Parse error: malformed let"),
    ("(declare-const p Bool)(assert (let x p))", "Parse error: malformed let"),
    ("(declare-const p Bool)(assert (forall ((x Nowhere)) (= x x)))", "Type-check error: undeclared sort"),
    ("(push 1)(declare-const p Bool)(pop 1)(assert (= p p))", "Type-check error: undeclared symbol p"),
    ("(pop 1)", "Type-check error: pop of 1"),
    ("(push x)", "Parse error: malformed push"),
    ("(declare-const p Bool)(assert (= p p))(reset)(assert (= p p))", "Type-check error: undeclared symbol p"),
    ("(declare-const 5 Bool)", "Parse error: malformed declare-const"),
    ("(define-fun f ((x Bool)) Bool (= x y))", "Type-check error: undeclared symbol y"),
]


@pytest.mark.parametrize(("text", "error"), CHECKED)
def test_sorts_scopes_and_binders(text, error):
    out = solve_text(text)
    assert out["verdict"] == "ERROR" and out["error"].startswith(error), out["error"]


def test_defined_sorts_and_scopes():
    assert solve_text("(declare-sort U 0)(define-sort V () U)(declare-const a U)(declare-const b V)(assert (= a b))")["verdict"] == "sat"
    assert solve_text("(declare-sort P 2)(declare-sort U 0)(define-sort D (X) (P X X))(declare-const a (D U))(declare-const b (P U U))(assert (= a b))(assert (not (= b a)))")["verdict"] == "unsat"
    assert solve_text("(push 1)(declare-const p Bool)(assert (= p p))(pop 1)(declare-const p Int)(assert (= p 1))")["verdict"] == "sat"
    assert solve_text("(declare-const v (_ BitVec 8))(assert (= v #xff))(assert (not (= #xff v)))")["verdict"] == "unsat"


def test_no_text_fails_the_job(spark, monkeypatch):
    import random

    rng = random.Random(11)
    parts = ["(", ")", "(assert", "(= a b)", "(let", "((x a))", "((x", "declare-fun", "(declare-const a U)", "(declare-sort U 0)", "a", "b", "x", "not", "(_ f 1)", "12", '"s"', "|q|", "(push 1)", "(pop 1)", "!", ":named", "forall", "define-sort", "(as a U)", "#x", "()"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["((" * 50_000, "(declare-const a " + "(P " * 5_000 + ")" * 5_001]
    assert {solve_text(t)["verdict"] for t in texts} <= {"sat", "unsat", "ERROR"}
    from tesseral.plans import solver

    monkeypatch.setattr(solver, "close_kernel", lambda *a: 1 / 0)
    out = solver.solve_text(goal([("a", "b")], []))
    assert (out["verdict"], out["error"][:33]) == ("ERROR", "Internal error: ZeroDivisionError")


def test_phases_are_apart():
    out = solve_text(generate.grid(12))
    assert min(out["parse_s"], out["build_s"], out["merge_s"], out["rebuild_s"]) > 0 and out["solve_s"] <= out["total_s"]


def test_odd_scripts():
    assert solve_text(None)["verdict"] == solve_text("; nothing")["verdict"] == "sat"
    assert solve_text("(assert (= true false))")["verdict"] == "sat"  # constants are opaque
    assert solve_text("(assert (= 1 2))(assert (not (= 1 2)))")["verdict"] == "unsat"
    assert solve_text("(declare-sort U 0)(declare-const |a b| U)(assert (= |a b| |a b|))")["n_nodes"] == 1
    deep = "(f " * 10_000 + "a" + ")" * 10_000
    out = solve_text(goal([("a", "(f a)")], [("a", deep)]))
    assert out["verdict"] == "unsat" and out["n_nodes"] == 10_001
    assert solve_text("(declare-sort U 0)(declare-const a U)(push 1)(assert (= a a))(pop 1)(check-sat)(exit)")["verdict"] == "sat"


def test_time_limit():
    out = solve_text(generate.chain(50), limit_s=-1.0)
    assert out["verdict"] == "TIMEOUT" and out["error"] and out["total_s"] >= 0


def test_reader():
    assert read_all('(a |b c| "x ""y" 12 #xF) ; tail\nd') == [["a", "b c", '"x ""y"', "12", "#xF"], "d"]
    assert isinstance(read_all("12")[0], Literal) and show(["f", ["g", "a"], "b"]) == "(f (g a) b)"
    for bad in ("(", ")", '"open', "|open"):
        with pytest.raises(ParseError):
            read_all(bad)


def test_nodes_are_shared_and_in_post_order():
    row = parse_script(goal([("(h (f a) (f a))", "(f a)")], []))
    assert [(n["op"], n["children"]) for n in row["nodes"]] == [("a", []), ("f", [0]), ("h", [1, 1])]
    assert row["constraints"] == [{"seq": 0, "kind": "eq", "a": 2, "b": 1}]


CLOSED = {
    ("chain", 0): (2, 1, 0), ("chain", 1): (6, 2, 1), ("chain", 10): (42, 11, 10), ("grid", 1): (4, 2, 1), ("grid", 2): (18, 9, 3), ("grid", 8): (270, 135, 7),
    ("cube", 1): (4, 2, 1), ("cube", 3): (112, 56, 6), ("exp", 0): (2, 1, 0), ("exp", 1): (12, 4, 2), ("exp", 5): (312, 94, 10),
}


@pytest.mark.parametrize(("family", "n"), CLOSED)
def test_families(family, n):
    out = solve_text(generate.script_of(family, n))
    assert out["verdict"] == "unsat" and (out["n_nodes"], out["n_classes"], out["rounds"]) == CLOSED[family, n]


def test_empty_lattices_are_refused():
    for family in ("grid", "cube"):
        with pytest.raises(ValueError):
            generate.script_of(family, 0)
    with pytest.raises(ValueError):
        generate.balanced("g", [])
    assert generate.balanced("g", list("abcde")) == "(g (g a b) (g c (g d e)))"


def test_files_and_reports(spark, tmp_path):
    generate.write_instances(str(tmp_path / "in"), [("chain", 3), ("grid", 2)])
    (tmp_path / "in" / "bad_sat.smt2").write_text("(assert")
    (tmp_path / "in" / "note.txt").write_text("no script")
    (tmp_path / "in" / "deeper").mkdir()
    (tmp_path / "in" / "deeper" / "x_sat.smt2").write_text("")
    scripts = scan_scripts(spark, str(tmp_path / "in"))
    solved = solve_scripts(scripts).cache()
    assert {r.inst: r.verdict for r in solved.collect()} == {"chain_n3_unsat.smt2": "unsat", "grid_n2_unsat.smt2": "unsat", "bad_sat.smt2": "ERROR"}
    assert [r.inst for r in mismatches(solved).collect()] == ["bad_sat.smt2"]
    lines = timing_lines(solved).collect()
    assert len(lines) == 2 and lines[0].line.startswith("timing: parse=") and lines[0].line.count("=") == 7
    assert report(solved).columns == ["file", "result", "wall_s", "parse_s", "build_s", "merge_s", "rebuild_s", "check_s", "solve_s", "error"]
    assert report(solved, False).columns == ["file", "result", "time_secs", "error"]
    write_csv(report(solved), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    assert totals(solved).first()[:4] == (3, 0, 2, 1)
    assert declaration_table(parse_scripts(scripts)).filter("symbol = 'f'").count() == 2


def test_command_line(tmp_path, capsys):
    path = tmp_path / "x.smt2"
    path.write_text(generate.chain(3))
    assert main(["solve", str(path), "-t"]) == 0
    got = capsys.readouterr()
    assert got.out == "unsat\n" and got.err.startswith("timing: parse=")
    path.write_text("(assert")
    assert main(["solve", str(path)]) == 1 and main(["solve", str(tmp_path / "none")]) == 1
    assert "Parse error" in capsys.readouterr().err
    assert main(["generate", "grid", "2"]) == 0 and capsys.readouterr().out == generate.grid(2)
    assert main(["generate", "sweep:chain", "1", "3", "1", "--out", str(tmp_path / "g")]) == 0
    assert sorted(p.name for p in (tmp_path / "g").iterdir()) == [f"chain_n{k}_unsat.smt2" for k in (1, 2, 3)]
    assert main(["generate", "all", "2", "--out", str(tmp_path / "h")]) == 0 and len(list((tmp_path / "h").iterdir())) == 4


def test_expressions(spark):
    one = spark.range(1)
    t = one.select(leaf(F.lit("a")).alias("l"), application(F.lit("f"), F.lit(1), F.lit(2)).alias("p"))
    assert t.select(display(F.col("l.op"), F.col("l.children")), display(F.col("p.op"), F.col("p.children"))).first()[:] == ("a", "f(1, 2)")
    line = one.select(timing_line(*(F.lit(x / 8) for x in range(7))).alias("x"))
    assert line.select(timing_field(F.col("x"), "merge"), timing_field(F.lit("other"), "merge")).first()[:] == (0.25, None)
    assert one.select(expected_verdict(F.lit("x_unsat_sat"))).first()[0] == "unsat"
    with pytest.raises(Exception, match="no expected verdict"):
        one.select(expected_verdict(F.lit("x"))).collect()


def test_listing(spark):
    nodes = spark.createDataFrame([("i", 0, "a", []), ("i", 1, "b", []), ("i", 2, "f", [0])], "inst string, id bigint, op string, children array<bigint>")
    rep = spark.createDataFrame([("i", 0, 0), ("i", 1, 0), ("i", 2, 2)], "inst string, id bigint, rep bigint")
    assert [r.line for r in class_listing(nodes, rep).orderBy("rep").collect()] == ["class 0: {a, b}", "class 2: {f(0)}"]
    assert class_counts(rep).first()[:] == ("i", 2, 3)
