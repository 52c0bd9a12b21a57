"""Benchmark decontamination: passages of a benchmark in documents, up to edits.

Texts are sequences of word hashes. A window of the size of an item is embedded by
CGK random walks: at each step the current word is written, and a random bit of the
step and the word says whether the walk moves on. Close windows in edit distance
become close in Hamming distance, so samples of a few written places, many times
over, retrieve items. The exact edit distance of words then decides.

Windows are embedded only where a lossless count allows a match: each edit breaks
at most two of an item's word pairs, so a window within k edits of an item of n words
has n - 1 - 2k of them at least. Of the item's pairs that differ from the pair
before, r in number, an edit can also make one more equal to it, so r - 3k such pairs
are there at least. Windows that begin at consecutive words form a region. If any
window of a region shares a sample with an item, the item is verified exactly at
all places of the region. So an item is missed only if all of the windows about it miss
all samples, not just the best one.

Walks that part meet again the later the longer the item and the more edits are of
one kind, so the number of walks grows with the item (:func:`walks_for`), and that of
samples with the walks. Measured with a quarter of the words deleted, inserted, or cut
as a block, in the middle or at the front, where the text ends with the passage (so
that few windows are about it): of 48 items each of 24, 60 and 100 words and 24 of 200
words all were found under each kind of edit. Samples of two places miss up to half
of the long items that lack their front; so ``width`` is 1, and the lossless count, for each
window and item, keeps the exact check from pairs that just share frequent words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesseral.llm.common import block_number, mix, slices, word_hashes
from tesseral.plans.workers import lean

_PAD = np.uint64(0x5851F42D4C957F2D)


def cgk(words: np.ndarray, lengths: np.ndarray, steps: int, walks: int, seed: int = 101) -> np.ndarray:
    """Embeddings (steps, walks, rows) of the rows of ``words``, of which ``lengths``
    words count; a walk that is through writes a filler. What a step writes doesn't
    depend on how many follow."""
    n, width = words.shape
    padded = np.full((n, width + 1), _PAD)
    padded[:, :width] = words
    begin = np.arange(n) * (width + 1)
    padded[np.arange(width + 1) >= lengths[:, None]] = _PAD
    flat, stop = padded.ravel(), begin + lengths
    at = np.repeat(begin[None], walks, axis=0)
    out = np.empty((steps, walks, n), np.uint64)
    bits = np.random.default_rng([seed, walks]).integers(1, 2**63, (steps, walks, 1), dtype=np.uint64) | np.uint64(1)
    for j in range(steps):
        symbol = flat.take(at, out=out[j])
        at += ((symbol * bits[j]) >> np.uint64(63)).astype(np.int64) & (at < stop)
    return out


def walks_for(n: int) -> int:
    """Walks for items of n words: 32 for each 128 words begun."""
    return 32 * -(-n // 128)


def edit_distance(items: np.ndarray, windows: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """For each row the least edit distance of the item (all of one length) to a
    prefix of its window, of which ``lengths`` words count; over ``most``: most + 1.
    Only the band of ``most`` on each side of the diagonal is computed."""
    m, n = items.shape
    far = most + 1
    offs = np.arange(-most, most + 1)  # column = row + offset
    prev = np.full((m, len(offs)), far, np.int32)
    prev[:, most:] = np.minimum(np.arange(most + 1), far)  # prefixes of the window against nothing
    prev[(offs[None, :] > lengths[:, None]) & (offs[None, :] > 0)] = far
    for i in range(1, n + 1):
        cur = np.full_like(prev, far)
        for b, o in enumerate(offs):
            col = i + o
            if col < 0 or col > windows.shape[1]:
                continue
            best = prev[:, b + 1] + 1 if b + 1 < len(offs) else np.full(m, far)
            if col > 0:
                best = np.minimum(best, prev[:, b] + (items[:, i - 1] != windows[:, col - 1]))
                if b:
                    best = np.minimum(best, cur[:, b - 1] + 1)
            cur[:, b] = np.where(col <= lengths, np.minimum(best, far), far)
        prev = cur
    return prev.min(axis=1)


class Matcher:
    """One block of items, ready to search batches of texts."""

    def __init__(self, texts: list, rate: float, min_words: int, samples: int = 16, width: int = 1):
        """``samples`` of ``width`` places for each walk."""
        words, counts = word_hashes(texts)
        starts = np.cumsum(counts) - counts
        self.rate, self.by_size = rate, {}
        pairs, groups = [], []
        for q, n in enumerate(sorted({int(c) for c in counts if c >= min_words})):
            which = np.flatnonzero(counts == n)
            rows = np.stack([words[starts[i] : starts[i] + n] for i in which])
            pairs.append(mix(rows[:, :-1] * np.uint64(3) + rows[:, 1:]).ravel())
            groups.append(np.full(len(pairs[-1]), 1 << (q % 64), np.uint64))
            rng, walks = np.random.default_rng([n, 23]), walks_for(n)
            places = np.stack([rng.choice(2 * n, min(width, 2 * n), replace=False) for _ in range(walks * samples)]).reshape(walks, samples, -1)
            keys = self._keys(cgk(rows, np.full(len(rows), n), 2 * n, walks), places)
            order = np.argsort(keys, axis=None, kind="stable")
            fresh = pairs[-1].reshape(len(rows), -1)
            fresh = 1 + (fresh[:, 1:] != fresh[:, :-1]).sum(axis=1).min() if n > 1 else 1
            self.by_size[n] = which, rows, int(fresh), places, keys.ravel()[order], order % len(rows)
        # All word pairs of items, the sizes (a bit each, mod 64) of the items that have
        # them, and a table that tells most other pairs apart by 18 bits.
        self.pairs, where = np.unique(np.concatenate(pairs), return_inverse=True) if pairs else (np.zeros(0, np.uint64), np.zeros(0, int))
        self.groups = np.zeros(len(self.pairs), np.uint64)
        np.bitwise_or.at(self.groups, where, np.concatenate(groups) if groups else np.zeros(0, np.uint64))
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.pairs >> np.uint64(46)] = True

    @staticmethod
    def _keys(embedded: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Keys (samples of all walks, rows) from embeddings; the sample is part of the key."""
        walks, samples, width = places.shape
        walk = np.arange(walks)[:, None]
        out = np.arange(1, walks * samples + 1, dtype=np.uint64).reshape(walks, samples, 1)
        for p in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + embedded[places[:, :, p], walk])
        return out.reshape(walks * samples, -1)

    def find(self, texts: list) -> tuple[np.ndarray, ...]:
        """(text, item, first word, distance), the best place of each text and item."""
        parts = [(a, self._find(texts[a:b])) for a, b in slices(texts)] or [(0, self._find([]))]
        return (np.concatenate([a + p[0] for a, p in parts]), *(np.concatenate([p[k] for _, p in parts]) for k in (1, 2, 3)))

    def _find(self, texts: list) -> tuple[np.ndarray, ...]:
        words, counts = word_hashes(texts)
        none = tuple(np.zeros(0, np.int64) for _ in range(4))
        if not len(words) or not self.by_size:
            return none
        doc = np.repeat(np.arange(len(texts)), counts)
        end = np.repeat(np.cumsum(counts), counts)
        pair = mix(words[:-1] * np.uint64(3) + words[1:])
        live = np.flatnonzero(self.maybe[pair >> np.uint64(46)])
        at = np.minimum(np.searchsorted(self.pairs, pair[live]), len(self.pairs) - 1)
        good = (self.pairs[at] == pair[live]) & (doc[live] == doc[live + 1])
        live, groups = live[good], self.groups[at[good]]
        place = np.full(len(words), len(self.pairs))  # of each word's pair in self.pairs
        place[live] = at[good]
        fresh_here = np.ones(len(live), bool)
        fresh_here[live > 0] = (pair[live[live > 0]] != pair[live[live > 0] - 1]) | (doc[live[live > 0]] != doc[live[live > 0] - 1])
        found, live_sizes = [], []
        for q, (n, (_, _, fresh, *_)) in enumerate(self.by_size.items()):
            k = int(self.rate * n)
            need = n - 1 - 2 * k
            if need > 0:
                # The first pair that no edit breaks is 2k words into a match at most.
                mine = ((groups >> np.uint64(q % 64)) & np.uint64(1)).astype(bool)
                here = live[mine]
                upto = np.searchsorted(here, np.minimum(here + n + k - 1, end[here] - 1))
                sums = np.concatenate([[0], np.cumsum(fresh_here[mine])])
                i = np.arange(len(here))
                near = here[(upto - i >= need) & (1 + sums[upto] - sums[i] >= fresh - 3 * k)]
                starts = np.unique((near[:, None] - np.arange(2 * k + 1)).ravel())
                starts = starts[starts >= 0]
            else:
                starts = np.arange(len(words))
            starts = starts[end[starts] - starts >= n - k]
            if len(starts):
                region = np.cumsum(np.concatenate([[True], (np.diff(starts) > 1) | (end[starts[1:]] != end[starts[:-1]])])) - 1
                live_sizes.append((n, starts, region))
        met: dict[int, list] = {}
        # windows of all sizes that have as many walks are embedded together, as many at once as fit 16 MB
        for walks in sorted({walks_for(n) for n, _, _ in live_sizes}):
            mine = [x for x in live_sizes if walks_for(x[0]) == walks]
            longest = max(n for n, _, _ in mine)
            size = np.concatenate([np.full(len(starts), n) for n, starts, _ in mine])
            starts, region = np.concatenate([x[1] for x in mine]), np.concatenate([x[2] for x in mine])
            step = max(1, 2_000_000 // (2 * longest * walks))
            for a in range(0, len(starts), step):
                here, n = starts[a : a + step], size[a : a + step]
                windows = words[np.minimum(here[:, None] + np.arange(n.max()), len(words) - 1)]
                embedded = cgk(windows, np.minimum(end[here] - here, n), 2 * int(n.max()), walks)
                for m in np.unique(n).tolist():
                    _, _, _, places, keys, item = self.by_size[m]
                    got = self._keys(embedded[:, :, n == m], places)
                    lo, hi = np.searchsorted(keys, got.ravel(), side="left"), np.searchsorted(keys, got.ravel(), side="right")
                    c = hi - lo
                    hit = np.flatnonzero(c)
                    c, lo = c[hit], lo[hit]
                    place_in = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo, c)
                    of = region[a : a + step][n == m][hit % got.shape[1]]
                    met.setdefault(m, []).append(np.unique(np.repeat(of, c) * len(self.by_size[m][1]) + item[place_in]))
        for n, starts, region in live_sizes:
            which, rows = self.by_size[n][:2]
            pairs_met = np.unique(np.concatenate(met[n]))
            first = np.searchsorted(region, np.arange(region[-1] + 2))  # of each region, in starts
            for a, b in slices_of(np.diff(first)[pairs_met // len(rows)], 20_000):
                r, item = pairs_met[a:b] // len(rows), pairs_met[a:b] % len(rows)
                size = first[r + 1] - first[r]
                at = np.repeat(first[r] - np.cumsum(size) + size, size) + np.arange(size.sum())
                item = np.repeat(item, size)
                for x in range(0, len(at), 20_000):
                    found += self._verify(words, place, end, starts[at[x : x + 20_000]], item[x : x + 20_000], n, int(self.rate * n), which, rows)
        if not found:
            return none
        start, item, dist = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, dist, item, doc[start]))
        start, item, dist = start[order], item[order], dist[order]
        first = np.ones(len(start), bool)
        first[1:] = (doc[start][1:] != doc[start][:-1]) | (item[1:] != item[:-1])
        start, item, dist = start[first], item[first], dist[first]
        return doc[start], item, start - (end - np.repeat(counts, counts))[start], dist

    def _verify(self, words, place, end, starts, item, n, k, which, rows) -> list:
        """Windows at ``starts`` against the items beside them: those of enough common
        word pairs by their exact distance."""
        pairs = place[np.minimum(starts[:, None] + np.arange(n + k), len(words) - 1)]
        lengths = np.minimum(end[starts] - starts, n + k)
        pairs[np.arange(n + k) >= lengths[:, None] - 1] = len(self.pairs)
        enough = np.zeros(len(starts), bool)
        for i in np.unique(item).tolist():
            row, at = rows[i], np.flatnonzero(item == i)
            own = np.unique(np.searchsorted(self.pairs, mix(row[:-1] * np.uint64(3) + row[1:])))
            enough[at] = np.isin(pairs[at], own).sum(axis=1) >= n - 1 - 2 * k
        starts, item, lengths = starts[enough], item[enough], lengths[enough]
        if not len(starts):
            return []
        windows = words[np.minimum(starts[:, None] + np.arange(n + k), len(words) - 1)]
        windows[np.arange(n + k) >= lengths[:, None]] = _PAD
        dist = edit_distance(rows[item], windows, lengths, k)
        good = dist <= k
        return [(starts[good], which[item[good]], dist[good])]


def slices_of(sizes: np.ndarray, most: int):
    """(from, to) of runs whose sizes sum up to about ``most`` (one at least)."""
    at, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def _matchers(items: DataFrame, id_col: str, text_col: str, block: int, **how):
    """Item ids and matcher of each block of about ``block`` items."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    blocks = max(1, -(-rows.count() // block))
    for b in range(blocks):
        got = rows.filter(block_number(blocks, "id", "text") == b).orderBy("id", "text").collect()
        yield [r.id for r in got], Matcher([r.text for r in got], **how)


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.25, min_words: int = 5, block: int = 5_000) -> DataFrame:
    """One row for each document and item of which the document holds a window within
    ``rate`` times the item's words, rounded down, in edits of words (case of A-Z
    aside): the id, the item's id, ``distance``, ``item_words`` and ``first_word``
    (of the best window, the earliest at a tie).

    Items are searched in blocks of ``block``; documents are not shuffled. Null and
    empty texts give no row, nor do items of fewer than ``min_words`` words; repeated
    rows and repeated items each give theirs."""
    out = None
    for ids, matcher in _matchers(items, item_col, item_text_col, block, rate=rate, min_words=min_words):
        part = _find_block(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ids, matcher, items.schema[item_col].dataType)
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def _find_block(source: DataFrame, ids: list, matcher: Matcher, item_type: T.DataType) -> DataFrame:
    sizes = {int(w): n for n, (which, *_) in matcher.by_size.items() for w in which}

    def run(batches):
        for batch in batches:
            row, item, first, dist = matcher.find(batch.column(1).to_pylist())
            if len(row):
                cols = [pa.array([sizes[i] for i in item.tolist()], pa.int64()), pa.array(first, pa.int64()), pa.array(dist, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([ids[i] for i in item.tolist()]), *cols], names=["id", "item", "item_words", "first_word", "distance"])

    fields = [T.StructField("id", source.schema["id"].dataType), T.StructField("item", item_type), *(T.StructField(c, T.LongType()) for c in ("item_words", "first_word", "distance"))]
    return source.mapInArrow(lean(run), T.StructType(fields))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = 0.25, min_words: int = 5, block: int = 5_000) -> DataFrame:
    """``docs``, with all their columns, without the rows in which an item is found."""
    at = docs.columns.index(text_col)
    for _, matcher in _matchers(items, item_col, item_text_col, block, rate=rate, min_words=min_words):

        def run(batches, matcher=matcher):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[matcher.find(batch.column(at).to_pylist())[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
