"""Expressions over terms, file names, timing lines and measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHASES = ("parse", "build", "merge", "rebuild", "check", "solve", "total")


def leaf(op: Column) -> Column:
    """A term without children."""
    return F.struct(op.alias("op"), F.array().cast("array<bigint>").alias("children"))


def application(op: Column, *children: Column) -> Column:
    return F.struct(op.alias("op"), F.array(*children).cast("array<bigint>").alias("children"))


def is_leaf(children: Column) -> Column:
    return F.size(children) == 0


def display(op: Column, children: Column) -> Column:
    """``f(1, 2)``; a leaf is its bare name."""
    inner = F.array_join(F.transform(children, lambda c: c.cast("string")), ", ")
    return F.when(is_leaf(children), op).otherwise(F.concat(op, F.lit("("), inner, F.lit(")")))


def expected_verdict(name: Column) -> Column:
    """The verdict that a file's name states; an error if it states none."""
    return F.when(name.contains("_unsat"), "unsat").when(name.contains("_sat"), "sat").otherwise(F.raise_error(F.concat(F.lit("no expected verdict in "), name)).cast("string"))


def timing_line(*phases: Column) -> Column:
    """Seven phases in seconds as one line, six decimals each."""
    return F.format_string("timing: " + " ".join(f"{p}=%.6f" for p in PHASES), *phases)


def timing_field(line: Column, phase: str) -> Column:
    """One phase of a timing line; null if the line isn't one."""
    pattern = "timing: " + " ".join(f"{p}=({'' if p == phase else '?:'}[0-9]+[.][0-9]+)" for p in PHASES)
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).cast("double")
