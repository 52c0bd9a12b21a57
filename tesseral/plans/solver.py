"""From scripts or term tables to verdicts."""

from __future__ import annotations

import signal
import threading
import time
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.functions.terms import PHASES
from tesseral.operators.closure import close_grouped, close_kernel, close_rounds, verdicts
from tesseral.sources.scripts import parse_script

SOLVED = "inst string, path string, verdict string, error string, n_nodes bigint, n_classes bigint, rounds int, parse_s double, build_s double, merge_s double, rebuild_s double, check_s double, solve_s double, total_s double"


class _Late(BaseException):
    """The time limit of a script; no handler of errors takes it for one."""


@contextmanager
def _limit(seconds: float):
    """Interrupt what runs within after ``seconds``, by a timer of the process. Only a
    main thread (as a worker's) can have one; elsewhere just the closure's rounds look
    at the time."""
    if threading.current_thread() is not threading.main_thread() or not 0 < seconds < 1e8:
        yield
        return

    def late(*_):
        raise _Late

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def solve_text(text: str | None, limit_s: float = 300.0) -> dict:
    """One script in this process. ``verdict`` is sat, unsat, or ERROR with the
    reason in ``error`` (of whatever kind: no script fails the job), or TIMEOUT if it
    takes over ``limit_s`` from reading to verdict; phases in seconds: ``build_s`` is
    terms and use lists, ``merge_s`` the asserted equalities, ``rebuild_s`` the rounds
    of congruence, ``check_s`` the disequalities."""
    out = {"verdict": "ERROR", "error": None, "n_nodes": None, "n_classes": None, "rounds": None} | {f"{p}_s": 0.0 for p in PHASES}
    began = time.perf_counter()
    try:
        with _limit(limit_s):
            _solve(text, out, time.monotonic() + limit_s)
    except (TimeoutError, _Late) as e:
        out |= {"verdict": "TIMEOUT", "error": str(e) or f"over {limit_s:g} seconds"}
    except Exception as e:
        out |= {"verdict": "ERROR", "error": f"Internal error: {type(e).__name__}: {e}"[:500]}
    out["solve_s"] = out["build_s"] + out["merge_s"] + out["rebuild_s"] + out["check_s"]
    out["total_s"] = time.perf_counter() - began
    return out


def _solve(text: str | None, out: dict, deadline: float) -> None:
    row = parse_script(text)
    out |= {"error": row["error"], "parse_s": row["parse_s"], "build_s": row["build_s"]}
    if row["error"] is not None:
        return
    began = time.perf_counter()
    nodes = [(n["id"], n["op"], tuple(n["children"])) for n in row["nodes"]]
    equal = [(c["a"], c["b"]) for c in row["constraints"] if c["kind"] == "eq"]
    out["build_s"] += time.perf_counter() - began
    spent: dict = {}
    rep, rounds = close_kernel(nodes, equal, deadline, spent)
    out |= {"build_s": out["build_s"] + spent["build_s"], "merge_s": spent["merge_s"], "rebuild_s": spent["rebuild_s"]}
    closed = time.perf_counter()
    bad = any(rep[c["a"]] == rep[c["b"]] for c in row["constraints"] if c["kind"] == "neq")
    out |= {"check_s": time.perf_counter() - closed, "n_nodes": len(nodes), "n_classes": len(set(rep.values())), "rounds": rounds, "verdict": "unsat" if bad else "sat"}


def solve_scripts(scripts: DataFrame, limit_s: float = 300.0) -> DataFrame:
    """``scripts`` (inst, path, text) to one row (:data:`SOLVED`) each, without a
    shuffle: a script is parsed, closed and checked where it lies, in ``limit_s``
    seconds at most."""
    names = [c.split()[0] for c in SOLVED.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    types = [kinds[c.split()[1]] for c in SOLVED.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [solve_text(t, limit_s) for t in batch.column(2).to_pylist()]
            cols = [pa.array([r[n] for r in rows], t) for n, t in zip(names[2:], types[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=names)

    return scripts.select("inst", "path", "text").mapInArrow(run, SOLVED)


def close_terms(nodes: DataFrame, equalities: DataFrame, strategy: str = "kernel") -> DataFrame:
    """(inst, id, rep) for term tables. ``kernel``: a task for each instance;
    ``rounds``: all tasks for all instances, for instances beyond a task's memory."""
    if strategy == "rounds":
        return close_rounds(nodes, equalities)[0]
    if strategy == "kernel":
        return close_grouped(nodes, equalities).select("inst", "id", "rep")
    raise ValueError("strategy is kernel or rounds")


def solve_terms(nodes: DataFrame, constraints: DataFrame, strategy: str = "kernel", instances: DataFrame | None = None) -> DataFrame:
    """(inst, verdict) for term tables; ``instances`` also names those without terms."""
    rep = close_terms(nodes, constraints.filter("kind = 'eq'"), strategy)
    every = nodes.select("inst").union(constraints.select("inst"))
    return verdicts(every if instances is None else every.union(instances.select("inst")), constraints, rep)


def phase(session, name: str):
    """Mark the jobs that follow, for profilers and the event log."""
    session.sparkContext.setJobDescription(name)


def totals(results: DataFrame) -> DataFrame:
    """Number of scripts by verdict, and the sums of solve and total seconds."""
    return results.agg(F.count("*").alias("n"), *(F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("sat", "unsat", "ERROR")), F.sum("solve_s").alias("solve_s"), F.sum("total_s").alias("total_s"))
