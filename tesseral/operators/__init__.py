"""Equivalence, congruence and keyed aggregation over DataFrames."""
