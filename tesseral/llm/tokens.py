"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. Token byte lengths give byte offsets, these
give character spans, and the spans are joined with the sections' intervals. A
token that crosses a boundary goes where the rule says:

``first``  to the section of its first character
``last``   to the section of its last character
``most``   to the section with most of its characters, at a tie to the earlier
``split``  to all it touches, by their shares of its characters (fractions)
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("first", "last", "most", "split")
#: Fixed value: the published pattern that splits text before the rank file's merges.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_LOADED: dict = {}


def encoder(ranks: bytes, pattern: str):
    """The tokenizer and the byte length of each token; kept for each process."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _LOADED:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        sizes = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            sizes[rank] = len(token)
        _LOADED[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), sizes
    return _LOADED[key]


def token_spans(text: str, encoding, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token in characters. A token that begins or ends
    within a character counts the whole character."""
    ids = np.array(encoding.encode_ordinary(text), np.int64)
    ends = np.cumsum(sizes[ids])
    starts = ends - sizes[ids]
    if len(ids) and ends[-1] != len(text):  # some characters have several bytes
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        starts, ends = char[starts], char[ends - 1] + 1
    return starts, ends


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens that touch it cross a
    boundary. bounds: the sections' ends, ascending; the last is the text's."""
    n = len(bounds)
    a, b = np.searchsorted(bounds, starts, side="right"), np.searchsorted(bounds, ends - 1, side="right")
    crossing = np.flatnonzero(a != b)
    to = (b if rule == "last" else a).copy()
    counts = np.zeros(n)
    touched = np.zeros(n, np.int64)
    for k in crossing:
        cuts = np.concatenate([[starts[k]], bounds[a[k] : b[k]], [ends[k]]])
        parts = np.diff(cuts)
        touched[a[k] : b[k] + 1] += parts > 0
        if rule == "most":
            to[k] = a[k] + int(parts.argmax())
        elif rule == "split":
            counts[a[k] : b[k] + 1] += parts / parts.sum()
    if rule == "split":
        to = np.delete(to, crossing)
    return counts + np.bincount(to, minlength=n), touched


def line_bounds(text: str) -> np.ndarray:
    """Ends of the lines, each with its newline; at least one section."""
    ends = [m.end() for m in re.finditer("\n", text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array(ends, np.int64)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "most", rank_file: str = RANK_FILE, pattern: str = SPLIT_PATTERN) -> DataFrame:
    """One row for each section: the id, ``section`` (from 0), ``start`` and ``end``
    in characters, ``n_tokens`` (double), ``n_crossing`` (tokens that touch it and
    another section) and ``doc_tokens``.

    Sections are the lines, or those whose ends ``sections_col`` (array of ints,
    ascending; ends beyond the text are cut, the rest of the text is a last section)
    gives. A null or empty text is one empty section of no tokens; a repeated row
    gives its sections again. Nothing is shuffled; one document is in memory."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    spark = docs.sparkSession
    with open(rank_file, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a file of fixed size
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.col(sections_col).cast("array<bigint>") if sections_col else F.lit(None).cast("array<bigint>")).alias("ends"))
    names = [id_col, "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches):
        encoding, sizes = encoder(ranks.value, pattern)
        for batch in batches:
            rows, parts = [], []
            for i, (text, given) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                text = text or ""
                if given is None:
                    bounds = line_bounds(text)
                else:
                    inner = [x for x in given if x is not None and 0 < x < len(text)]
                    bounds = np.array([*sorted(set(inner)), len(text)], np.int64)
                starts, ends = token_spans(text, encoding, sizes)
                counts, touched = attribute(starts, ends, bounds, rule)
                n = len(bounds)
                rows.append(np.full(n, i))
                parts.append((np.arange(n), np.concatenate([[0], bounds[:-1]]), bounds, counts, touched, np.full(n, len(starts))))
            if rows:
                cols = [np.concatenate(x) for x in zip(*parts)]
                types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                ids = batch.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types))], names=names)

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {id_type}, section int, start bigint, `end` bigint, n_tokens double, n_crossing bigint, doc_tokens bigint")
