"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tesseral.plans.storage import drop_written, new_path, shared_dir, written

#: ASCII white space as the contracts define it: blank and U+0009 to U+000D.
WORD_RE = r"[^\x20\x09-\x0D]+"
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def block_number(blocks: int, *cols):
    """A stable block in [0, blocks) from the columns' values; nulls included."""
    return F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int")


def bitmap_of(hashes, bits: int = 26) -> np.ndarray:
    """A bitmap of fixed size (8 MB) with the slots of all hashes of column ``h``: it
    says of a hash that it may be there, or that it isn't."""
    slot = F.shiftrightunsigned("h", 64 - bits)
    words = hashes.select(F.shiftright(slot, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(h, {64 - bits}) & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    got = words.toPandas()  # at most 2**20 rows of 12 bytes
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray, bits: int = 26) -> np.ndarray:
    slot = hashes >> np.uint64(64 - bits)
    return ((bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (wraps on purpose)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of the hash base, wrapping at 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS))
        out = np.full(size, _BASE, np.uint64)
        out[0] = 1
        _POWERS = np.multiply.accumulate(out)
    return _POWERS[:n]


_INVERSE_BASE = np.uint64(pow(int(_BASE), -1, 2**64))
_INVERSES = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        out = np.full(max(n, 2 * len(_INVERSES)), _INVERSE_BASE, np.uint64)
        out[0] = 1
        _INVERSES = np.multiply.accumulate(out)
    return _INVERSES[:n]


_SEGMENT = 1 << 20


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z only) words of all texts, one after
    the other, and the number of words of each text. None counts as empty.

    Works on UTF-8 bytes: a polynomial hash of each word from one running sum, so no
    Python code runs per word; in segments that end between words, so the arrays
    stay small however long the texts are."""
    data = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum(np.fromiter((len(d) + 1 for d in data), np.int64, len(data)))
    raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    hashes, begun, at = [], [], 0
    while at < len(raw):
        to = min(at + _SEGMENT, len(raw))
        while to < len(raw):  # on to the next separator
            gap = _SEPARATOR[raw[to : to + 4096]]
            if gap.any():
                to += int(gap.argmax())
                break
            to += len(gap)
        part = _LOWER[raw[at:to]]
        edges = np.diff((~_SEPARATOR[part]).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        running = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[part] * powers(len(part)), out=running[1:])
        sums = (running[stops] - running[starts]) * inverse_powers(len(part) + 1)[starts]
        hashes.append(mix(sums + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        begun.append(starts + at)
        at = to
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    place = np.searchsorted(np.concatenate(begun), ends) if begun else np.zeros(len(data), np.int64)
    return words, np.diff(place, prepend=0)


def slices(texts: list, rows: int = 4096, chars: int = 6_000_000):
    """(from, to) of runs of texts of bounded number and length (one at least)."""
    at, held = 0, 0
    for k, t in enumerate(texts):
        size = 0 if t is None else len(t)
        if k > at and (held + size > chars or k - at >= rows):
            yield at, k
            at, held = k, 0
        held += size
    if at < len(texts):
        yield at, len(texts)


def text_slices(column: pa.Array, rows: int = 1024, size: int = 1_500_000):
    """(from, texts) of an Arrow column of texts, few at a time: at most ``rows`` and
    about ``size`` bytes, one text at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    at, held = 0, 0
    for k, n in enumerate(sizes):
        if k > at and (held + n > size or k - at >= rows):
            yield at, column.slice(at, k - at).to_pylist()
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield at, column.slice(at).to_pylist()


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles of each text and the text's number.
    A text with fewer words than ``size``, but some, has one shingle of all."""
    n, doc = len(words), np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(n) if n else np.zeros(0, np.int64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        here = np.zeros(n, np.uint64)
        if n > k:
            here[: n - k] = words[k:]
        inside = left > k
        out = np.where(inside, mix(out * np.uint64(0x9E3779B97F4A7C15) + here), out)
    first = np.arange(n) == np.repeat(ends - counts, counts) if n else np.zeros(0, bool)
    keep = (left >= size) | (first & (left < size))
    return out[keep], doc[keep]


def distinct_per_doc(hashes: np.ndarray, docs: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each document and their number by document."""
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return hashes[keep], np.bincount(docs[keep], minlength=n_docs)


__all__ = ["WORD_RE", "bitmap_of", "block_number", "distinct_per_doc", "drop_written", "in_bitmap", "mix", "new_path", "shared_dir", "shingle_hashes", "slices", "text_slices", "word_hashes", "written"]
