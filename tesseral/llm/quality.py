"""Quality classifier: an additive model with pairwise interactions.

Shallow regression trees are boosted one feature at a time, round robin, so that
each feature ends up with one lookup table over its bins; a second stage boosts
trees over a few pairs of features. A score is then a sum of table entries: for a
batch of texts one ``searchsorted`` and one gather per table.

The trees are grown on the driver from a sample of labelled rows whose size is
bounded by ``max_rows``; texts are scored where they lie, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.plans.workers import lean

FEATURES = (
    "log_words", "mean_word_length", "distinct_words", "adjacent_repeats", "distinct_pairs", "upper_share",
    "symbol_share", "bang_share", "pipe_share", "digit_share", "stop_share", "comma_share", "repeated_lines",
    "short_lines", "other_bytes_share", "long_words",
)

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#$%&*@^~<>{}[]\\+=_"
_OTHER = bytes(range(128, 256))


def text_features(text: str | None) -> list[float]:
    """The features of one whole text; a null text counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, size = len(words), max(len(raw), 1)
    lines = text.split("\n")
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    per = max(n, 1)
    return [
        float(np.log1p(n)),
        len(raw) / per,
        len(set(words)) / per,
        sum(map(eq, words, words[1:])) / per,
        len(set(zip(words, words[1:]))) / per,
        share(_UPPER),
        share(_SYMBOL),
        raw.count(b"!") / size,
        raw.count(b"|") / size,
        share(_DIGIT),
        raw.count(b".") / per,
        raw.count(b",") / per,
        1 - len(set(lines)) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines),
        share(_OTHER),
        sum(len(x) > 25 for x in words) / per,
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of binned gradients; (0, 0) if none."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < least) | (hr < least)] = 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 1.0, least: float = 2.0) -> np.ndarray:
    """A tree of at most ``leaves`` leaves over bins, as one value for each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*_split(g[a:b], h[a:b], ridge, least), k) for k, (a, b) in enumerate(parts)), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        a, b = parts.pop(best[2])
        parts += [(a, a + best[1]), (a + best[1], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


@dataclass
class AdditiveModel:
    """Intercept, bin edges and tables; ``pairs`` maps (i, j) to a 2-D table over
    coarse bins. ``scores`` needs nothing else."""

    intercept: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    pairs: dict = field(default_factory=dict)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], side="right")]
        for (i, j), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return _sigmoid(total)


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, rate: float = 0.15, pair_bins: int = 8, n_pairs: int = 6, pair_rounds: int = 40) -> AdditiveModel:
    """Boost the tables. With no rows, or one class only, the score is constant:
    the smoothed share of ones."""
    model = AdditiveModel()
    share = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return model
    d = x.shape[1]
    model.edges = [_quantiles(x[:, k], bins) for k in range(d)]
    fine = [np.searchsorted(model.edges[k], x[:, k], side="right") for k in range(d)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for k in range(d):
            p = _sigmoid(total)
            size = len(model.tables[k])
            step = rate * _tree(np.bincount(fine[k], y - p, size), np.bincount(fine[k], p * (1 - p), size))
            model.tables[k] += step
            total += step[fine[k]]
    model.coarse = [_quantiles(x[:, k], pair_bins) for k in range(d)]
    coarse = [np.searchsorted(model.coarse[k], x[:, k], side="right") for k in range(d)]
    p = _sigmoid(total)
    gains = {}
    for i in range(d):
        for j in range(i + 1, d):
            flat, size = coarse[i] * (len(model.coarse[j]) + 1) + coarse[j], (len(model.coarse[i]) + 1) * (len(model.coarse[j]) + 1)
            g, h = np.bincount(flat, y - p, size), np.bincount(flat, p * (1 - p), size)
            gains[i, j] = float((g**2 / (h + 5)).sum())
    for i, j in sorted(gains, key=gains.get, reverse=True)[:n_pairs]:
        model.pairs[i, j] = np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            p = _sigmoid(total)
            flat = coarse[i] * table.shape[1] + coarse[j]
            g, h = (np.bincount(flat, v, table.size).reshape(table.shape) for v in (y - p, p * (1 - p)))
            at = _split(g.sum(1), h.sum(1), 1.0, 2.0)[1]
            step = np.zeros(table.shape)
            for part in (slice(0, at), slice(at, None)):
                if g[part].size:
                    step[part] = rate * _tree(g[part].sum(0), h[part].sum(0), 2)
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def _appended(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


def score_texts(docs: DataFrame, model: AdditiveModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with one more column, the score of the whole text (0 to 1). All
    columns pass through untouched; an old column ``score_col`` is replaced."""
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            x = np.array([text_features(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x), pa.float64())], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(lean(run), _appended(docs.schema, T.StructField(score_col, T.DoubleType())))


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 16_000) -> AdditiveModel:
    """Fit on at most about ``max_rows`` labelled rows, chosen by a hash of the id.

    ``labels`` may hold null ids or labels (left out) and repeated ids (their mean
    label counts, at 0.5 and above as 1). Documents that share an id all count."""
    chosen = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).dropna().groupBy("__id").agg((F.avg("__y") >= 0.5).cast("double").alias("__y"))
    n = chosen.count()
    if n > max_rows:
        chosen = chosen.filter(F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    # at most about max_rows rows of 16 bytes: safe to broadcast
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id").select("__text", "__y")

    def run(batches):
        for batch in batches:
            x = np.array([text_features(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(len(FEATURES))), batch.column(1)], names=[*FEATURES, "y"])

    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in (*FEATURES, "y")])
    got = rows.mapInArrow(lean(run), schema).toPandas().sort_values(list(FEATURES)).to_numpy(float)  # bounded by max_rows
    return fit_additive(got[:, :-1], got[:, -1])


def held_out(id_col: str = "doc_id"):
    """crc32(id as text) mod 5 = 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 16_000) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (1 at ``threshold``
    and above). Only labels of rows that are not held out are learned from. One
    row out for each row in, repeated ones too; empty and null texts get a score like all
    others, an empty table gives no row. Old columns of these three names are replaced,
    others pass through. A text is read whole, and one text at a time."""
    model = learn_quality(docs, labels.filter(~held_out(id_col)), id_col, text_col, label_col, max_rows)
    scored = score_texts(docs, model, text_col)
    return scored.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
