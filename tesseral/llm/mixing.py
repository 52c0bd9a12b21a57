"""Mixing sources to target weights by entropy balancing; DataFrame operations only.

Each source has a token target. Rates stay as close to 1 as they can (in relative
entropy) while the tokens of each source meet its target and no rate exceeds the
cap: rate = min(cap, exp(lambda * size / mean size)), one lambda for each source.
The lambdas are found by safeguarded Newton steps on the convex dual, all sources
at once, over counts by (source, size). Rates then become whole copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesseral.llm.common import WORD_RE, block_number, drop_written, written


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` (source, size) to (source, sid, n, source_size, target).

    Sources by code point, null last, take the weights in turn and share
    ``share`` times all sizes; a target stops at ``cap`` times its source's size and
    the excess goes to the others by weight. In closed form: with sources ordered by
    cap / weight, those at their caps come first, and one level serves the rest."""
    by = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("sid", F.row_number().over(order))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights)) + 1)).withColumn("most", F.col("source_size") * cap)
    level = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before, after, every = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing), level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("here", (F.sum("source_size").over(every) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    by = by.withColumn("level", F.first(F.when(F.col("most") / F.col("weight") > F.col("here"), F.col("here")), ignorenulls=True).over(every))
    return by.select("source", "sid", "n", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _rate(cap: float) -> Column:
    """Of a row with size, mean, lam, target and source_size."""
    tilted = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(math.log(cap) + 1e-9))))
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    return F.when((F.col("size") == 0) | (F.col("target") <= 0), 0.0).when(full, float(cap)).otherwise(tilted)


def solve_dual(counts: DataFrame, targets: DataFrame, cap: float = 2.0, steps: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """``counts`` (sid, size, n) and ``targets`` to (sid, target, source_size, mean,
    lam). One job a step over the counts; only the largest relative residual comes
    to the driver. Newton's step is taken within a bracket, else the bracket halves."""
    state = targets.select("sid", "target", "source_size", (F.greatest("source_size", F.lit(1)) / F.greatest("n", F.lit(1))).alias("mean"), F.lit(0.0).alias("lam"), F.lit(-1e3).alias("low"), F.lit(1e6).alias("high"), F.lit(1.0).alias("off"))
    keys = ["sid", "target", "source_size", "mean", "lam", "low", "high"]
    last = None
    for _ in range(steps):
        rate = _rate(cap)
        sums = counts.join(state.select(*keys), "sid").groupBy(*keys).agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"),
            F.sum(F.when(rate < cap, F.col("n") * F.col("size") * F.col("size") / F.col("mean") * rate).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - gap / F.nullif(F.col("slope"), F.lit(0.0))
        inside = F.coalesce((F.col("slope") > 0) & (step > low) & (step < high), F.lit(False))
        halved = F.when(high > 1e5, F.greatest(F.col("lam") * 4, F.lit(4.0))).when(low < -999, F.least(F.col("lam") * 4, F.lit(-4.0))).otherwise((low + high) / 2)
        off = F.abs(gap) / F.greatest("target", F.lit(1.0))
        done = (off <= tolerance) | (F.col("target") <= 0) | (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12))
        new = sums.select("sid", "target", "source_size", "mean", F.when(done, F.col("lam")).when(inside, step).otherwise(halved).alias("lam"), low.alias("low"), high.alias("high"), F.when(done, 0.0).otherwise(off).alias("off"))
        state = written(new, "dual")
        if last is not None:
            drop_written(counts.sparkSession, last)
        last = state
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= 0:
            break
    else:
        if worst > 1e-6:
            raise RuntimeError(f"the dual is off by {worst:.2g} after {steps} steps")
    return state.select("sid", "target", "source_size", "mean", F.round("lam", 12).alias("lam"))


def whole_copies(counts: DataFrame, dual: DataFrame, cap: int = 2, rounds: int = 12) -> DataFrame:
    """(sid, size, n, copies): copies of all documents of a source and size together.

    Rates are summed from the largest size down, in millionths, and cut at whole
    numbers; this keeps each prefix within one copy. What a source then lacks or has
    too much is made up by the largest size that fits, again and again, until none fits or
    ``rounds`` are over; what is left then is less than the smallest size used last."""
    rows = counts.join(dual, "sid").select("sid", "size", "n", "target", F.round(_rate(cap) * F.col("n") * 1_000_000).cast("bigint").alias("part"))
    w = Window.partitionBy("sid").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total, half = F.sum("part").over(w), F.lit(500_000)
    cut = lambda c: F.floor((c + half) / 1_000_000)
    state = written(rows.withColumn("total", total).select("sid", "size", "n", "target", F.greatest(F.lit(0), F.least(F.col("n") * cap, cut(F.col("total")) - cut(F.col("total") - F.col("part")))).cast("bigint").alias("copies")), "copies")
    for _ in range(rounds):
        rest = state.groupBy("sid").agg(F.floor(F.first("target") - F.sum(F.col("copies") * F.col("size"))).cast("bigint").alias("rest"))
        room = F.when(F.col("rest") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
        fits = state.join(rest, "sid").filter((F.col("size") > 0) & (F.col("size") <= F.abs("rest")) & (room > 0))
        step = fits.select("sid", "size", (F.signum("rest") * F.least(room, F.floor(F.abs("rest") / F.col("size")))).cast("bigint").alias("step"))
        step = step.groupBy("sid").agg(F.max(F.struct("size", "step")).alias("s")).select("sid", "s.size", "s.step")
        step = written(step, "step")
        if step.isEmpty():
            drop_written(state.sparkSession, step)
            break
        new = written(state.join(step, ["sid", "size"], "left").select("sid", "size", "n", "target", (F.col("copies") + F.coalesce("step", F.lit(0))).alias("copies")), "copies")
        drop_written(state.sparkSession, state, step)
        state = new
    return state.select("sid", "size", "n", "copies")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: int = 2, block_rows: int = 1_000) -> DataFrame:
    """One row for each document: the id, ``size`` (words), ``source_size``,
    ``target`` (its source's), ``copies`` (0 to ``cap``) and ``taken`` (copies times
    size). Null texts have size 0 and no copies; a null source is a source of its
    own; repeated rows are documents of their own. Reruns agree: sums that decide
    are of whole numbers and order is by hashes of the id.

    The texts are read once; an empty table gives no row. Copies of documents of one
    source and size are dealt in blocks of about ``block_rows`` by a hash of the id, and
    rows that share even the id in blocks by row, so no task holds all of a hot group."""
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("row")), "sizes")
    targets = written(source_targets(sized.select("source", "size"), weights, share, cap), "targets")
    keyed = sized.join(targets.select(F.col("source").alias("of"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    counts = written(keyed.groupBy("sid", "size").agg(F.count("*").alias("n")), "counts")
    copies = whole_copies(counts, solve_dual(counts, targets, cap), cap)
    blocks = max(1, -(-sized.count() // block_rows))
    # Rows of one id, source and size are alike, so it doesn't matter which of them are taken.
    many = keyed.groupBy("sid", "size", "id").agg(F.count("*").alias("alike")).filter(F.col("alike") > block_rows).withColumnRenamed("id", "of")
    many = written(many.withColumnsRenamed({"sid": "of_sid", "size": "of_size"}), "alike")
    keyed = keyed.join(many, (F.col("sid") == F.col("of_sid")) & (F.col("size") == F.col("of_size")) & F.col("id").eqNullSafe(F.col("of")), "left").drop("of", "of_sid", "of_size")
    own = F.col("alike").isNotNull()
    name = F.when(own, F.coalesce(F.concat(F.lit("id "), F.col("id").cast("string")), F.lit("null"))).otherwise("")
    part = F.when(own, F.pmod(F.xxhash64("row"), F.ceil(F.col("alike") / block_rows))).otherwise(0).cast("int")
    keyed = keyed.select("id", "sid", "size", "source_size", "target", F.when(own, blocks).otherwise(block_number(blocks, F.col("id"), F.lit(3))).alias("block"), name.alias("name"), part.alias("part"))
    place = ["block", "name", "part"]
    w = Window.partitionBy("sid", "size").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    extra, base = F.pmod("copies", "n"), F.floor(F.col("copies") / F.col("n"))
    cut = lambda c: F.floor(c * extra / F.col("n"))
    dealt = keyed.groupBy("sid", "size", *place).agg(F.count("*").alias("nb")).join(copies, ["sid", "size"]).withColumn("upto", F.sum("nb").over(w))
    dealt = dealt.select("sid", "size", *place, base.alias("base"), (cut(F.col("upto")) - cut(F.col("upto") - F.col("nb"))).alias("extra"))
    rank = F.row_number().over(Window.partitionBy("sid", "size", *place).orderBy(F.xxhash64("id", F.lit(4)), "id"))
    out = keyed.join(dealt, ["sid", "size", *place]).withColumn("copies", (F.col("base") + (rank <= F.col("extra")).cast("int")).cast("int"))
    return out.select(F.col("id").alias(id_col), "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))
