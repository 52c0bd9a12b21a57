"""Equality reasoning and data preparation on Spark."""
