"""Exact Jaccard join of word-shingle sets, by prefix filters under several orders.

Two sets with Jaccard similarity of 3/4 or more share an element among the first
n - ceil(3n/4) + 1 of each, whatever global order the elements are sorted by. Orders
here put frequent ("heavy") elements last and sort the rest by a hash; the two
orders differ in the hash. A pair is a candidate if its prefixes meet under both.

1. Document frequencies of all elements are counted; the heavy ones set bits in a
   bitmap of fixed size. Wrong bits cost time, never links: any bitmap is an order.
2. Each distinct set sends its light prefix elements, in blocks, to tasks by
   element; these list the pairs (a light element is in few sets, so lists are
   short). Pairs found under both orders stay. That loses no link: if one of two
   sets has only light elements in its prefixes, so has their common element.
3. Two sets that have heavy elements in their prefixes may share these only. They
   meet through hubs, one for each element, in grouped maxima without any list.
4. Candidates whose odd sketches (a bit turned over for each element) differ too much
   are dropped, which is sound, and the others verified exactly. For components not
   all pairs of a cluster are needed: first one pair for each set, then, again and
   again, pairs between sets that aren't yet connected, until none is left untested.

Elements are 50-bit hashes, equal sets are recognised by a 64-bit sum of hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm.common import bitmap_of, drop_written, in_bitmap, mix, shingle_hashes, text_slices, word_hashes, written
from tesseral.operators.components import connected_components
from tesseral.plans.workers import lean, lean_groups

_BITS = 50
_LOW = np.uint64((1 << _BITS) - 1)
_TURN = np.uint64(0x2545F4914F6CDD1D & ((1 << _BITS) - 1) | 1)  # makes the second order
_SLOTS = 24  # bits that number a slot of the bitmap of heavy elements
_HEAVY = 32  # sets that share it


def _u(x) -> np.uint64:
    return np.uint64(x)


def text_sets(texts: list, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements sorted within each text, the text's number for each, set sizes and
    64-bit keys of the sets. At most 2**14 texts."""
    hashes, doc = shingle_hashes(*word_hashes(texts), size)
    x = (doc.astype(np.uint64) << _u(_BITS)) | (hashes >> _u(64 - _BITS))
    x.sort()
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    x = x[keep]
    doc, element = (x >> _u(_BITS)).astype(np.int64), x & _LOW
    n = np.bincount(doc, minlength=len(texts))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(element + _u(1)))])
    ends = np.cumsum(n)
    keys = mix(sums[ends] - sums[ends - n] + n.astype(np.uint64) * _u(0x9E3779B97F4A7C15)).view(np.int64)
    return element, doc, n, keys


def odd_sketches(element: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set a bit vector, of the least power of two of bits that is 2n or more
    (64 at least); each element turns one bit over. Two vectors, the longer folded to
    the shorter one's length, differ in no more bits than the sets in elements."""
    words = np.ones(len(n), np.int64)
    big = n > 32
    words[big] = 1 << np.ceil(np.log2(n[big] / 32)).astype(np.int64)
    begin = np.cumsum(words) - words
    place = (mix(element * _u(3)) >> _u(8)) & (words[doc] * 64 - 1).astype(np.uint64)
    out = np.zeros(int(words.sum()), np.uint64)
    np.bitwise_xor.at(out, begin[doc] + (place >> _u(6)).astype(np.int64), _u(1) << (place & _u(63)))
    return out.view(np.int64), words


def prefix_length(n):
    """Elements of a set's prefix: n - ceil(3n/4) + 1."""
    return n - (3 * n + 3) // 4 + 1


def _packed(values: np.ndarray, counts: np.ndarray, base: int) -> tuple[bytes, bytes]:
    """Ascending values as 16-bit gaps (65535: add and go on); counts over 1 apart."""
    gaps = np.diff(values, prepend=_u(base)).astype(np.int64)
    big, rest = gaps // 65535, gaps % 65535
    out = np.full(int((big + 1).sum()), 65535, np.uint16)
    out[np.cumsum(big + 1) - 1] = rest
    more = np.flatnonzero(counts > 1)
    return out.tobytes(), np.stack([more, counts[more]]).astype(np.uint32).tobytes()


def _unpacked(gaps: bytes, more: bytes, base: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(gaps, np.uint16)
    values = (np.cumsum(raw.astype(np.uint64)) + _u(base))[raw != 65535]
    counts = np.ones(len(values), np.uint64)
    at, extra = np.frombuffer(more, np.uint32).reshape(2, -1)
    counts[at] = extra
    return values, counts


def heavy_bitmap(texts: DataFrame, size: int, bits: int, least: int = _HEAVY) -> np.ndarray:
    """Bits for the slots of all elements that ``least`` documents or more hold.
    Counts are of 32-bit prints of the elements, summed over all documents; each of
    2**bits tasks' worth of prints is sent packed. The result has 2 MB, always."""

    def count(batches):
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                element = text_sets(texts, size)[0] >> _u(_BITS - 32)
                element.sort()
                first = np.flatnonzero(np.diff(element, prepend=_u(2**40)) != 0)
                values, counts = element[first], np.diff(first, append=len(element))
                cuts = np.searchsorted(values >> _u(32 - bits), np.arange(2**bits + 1, dtype=np.uint64))
                full = np.flatnonzero(np.diff(cuts))
                if len(full):
                    parts = [_packed(values[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]], k << (32 - bits)) for k in full.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([p for p, _ in parts], pa.binary()), pa.array([m for _, m in parts], pa.binary())], names=["bucket", "gaps", "more"])

    def add(table: pa.Table) -> pa.Table:
        base = table.column(0)[0].as_py() << (32 - bits)
        parts = [_unpacked(g.as_py(), m.as_py(), base) for g, m in zip(table.column(1), table.column(2))]
        x = (np.concatenate([v for v, _ in parts]) << _u(32)) | np.concatenate([c for _, c in parts])
        x.sort()
        values, counts = x >> _u(32), x & _u(0xFFFFFFFF)
        first = np.flatnonzero(np.diff(values, prepend=_u(2**40)) != 0)
        slot = values[first][np.add.reduceat(counts, first) >= least] >> _u(32 - _SLOTS)
        words, where = np.unique(slot >> _u(6), return_inverse=True)
        bit = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(bit, where, _u(1) << (slot & _u(63)))
        return pa.table({"word": pa.array(words, pa.int32()), "bits": pa.array(bit.view(np.int64))})

    words = texts.mapInArrow(lean(count), "bucket int, gaps binary, more binary").groupBy("bucket").applyInArrow(lean_groups(add), "word int, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bitmap = np.zeros(1 << (_SLOTS - 6), np.uint64)
    got = words.toPandas()  # at most 2**18 rows
    bitmap[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def _in_order(x: np.ndarray, doc: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Positions of the first ``most[d]`` entries of each d (doc is ascending)."""
    first = np.searchsorted(doc, np.arange(len(most)))
    return np.flatnonzero(np.arange(len(doc)) - first[doc] < most[doc])


def prefix_blocks(texts: DataFrame, size: int, bitmap, bits: int) -> DataFrame:
    """Prefix elements of the distinct sets, packed by block: light ones under both
    orders, heavy ones under the first. Each task sends equal sets once."""

    def run(batches):
        heavy_bits, seen = bitmap.value, set()
        for batch in batches:
            for _, texts in text_slices(batch.column(0), 4096, 4_000_000):
                element, doc, n, keys = text_sets(texts, size)
                fresh = np.zeros(len(n), bool)
                fresh[np.unique(keys, return_index=True)[1]] = True
                fresh &= (n > 0) & np.fromiter((k not in seen for k in keys.tolist()), bool, len(n))
                seen.update(keys[fresh].tolist())
                element, doc = element[fresh[doc]], doc[fresh[doc]]
                slot = element >> _u(_BITS - _SLOTS)
                heavy = ((heavy_bits[slot >> _u(6)] >> (slot & _u(63))) & _u(1)).astype(bool)
                most = prefix_length(n)
                light, ldoc = element[~heavy], doc[~heavy]
                n_light, n_heavy = np.bincount(ldoc, minlength=len(n)), np.bincount(doc[heavy], minlength=len(n))
                turned = (ldoc.astype(np.uint64) << _u(_BITS)) | (light * _TURN & _LOW)
                turned.sort()
                rows = []
                for k, (e, d) in enumerate(((light, ldoc), (turned & _LOW, ldoc))):
                    at = _in_order(e, d, most)
                    e, d = e[at], d[at]
                    block = (e >> _u(_BITS - bits)).astype(np.int64) + (k << bits)
                    rows.append((block, (e >> _u(_BITS - bits - 32)) & _u(0xFFFFFFFF), d))
                hdoc = doc[heavy]
                at = _in_order(element[heavy], hdoc, np.maximum(most - n_light, 0))
                rows.append((np.full(len(at), -1) - (keys[hdoc[at]] & ((1 << bits) - 1)), element[heavy][at], hdoc[at]))
                out = []
                for block, e, d in rows:
                    by = np.argsort(block, kind="stable")
                    block, e, d = block[by], e[by], d[by]
                    first = np.flatnonzero(np.diff(block, prepend=-(2**40)) != 0)
                    for x, y in zip(first.tolist(), [*first[1:].tolist(), len(block)]):
                        docs, local = np.unique(d[x:y], return_inverse=True)
                        share = n_heavy[docs] / np.maximum(n[docs], 1)
                        out.append((int(block[x]), keys[docs].tobytes(), n[docs].astype(np.int32).tobytes(), share.astype(np.float32).tobytes(), e[x:y].astype(np.uint32 if block[x] >= 0 else np.uint64).tobytes(), local.astype(np.uint16).tobytes()))
                if out:
                    kinds = (pa.int32(), *[pa.binary()] * 5)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["block", "keys", "ns", "shares", "elements", "local"])

    return texts.mapInArrow(lean(run), "block int, keys binary, ns binary, shares binary, elements binary, local binary")


def _gathered(table: pa.Table, kind) -> tuple[np.ndarray, ...]:
    cols = [[x.as_py() for x in table.column(c)] for c in range(1, 6)]
    key, n, share, element = [], [], [], []
    for k, m, s, e, at in zip(*cols):
        at = np.frombuffer(at, np.uint16)
        key.append(np.frombuffer(k, np.int64)[at])
        n.append(np.frombuffer(m, np.int32)[at])
        share.append(np.frombuffer(s, np.float32)[at])
        element.append(np.frombuffer(e, kind))
    return tuple(map(np.concatenate, (element, key, n, share)))


def candidates(blocks: DataFrame, bits: int) -> DataFrame:
    """kind 1: pairs (a, b) of sets that share a light prefix element, m the order's
    bit; kind 2: heavy prefix elements a of set b, m the set's size, s the share of
    its elements that is heavy."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column(0)[0].as_py()
        element, key, n, share = _gathered(table, np.uint32 if block >= 0 else np.uint64)
        if block < 0:
            by = np.lexsort((key, element))
            element, key, n, share = (x[by] for x in (element, key, n, share))
            keep = np.ones(len(key), bool)
            keep[1:] = (element[1:] != element[:-1]) | (key[1:] != key[:-1])
            return pa.table({"kind": pa.array(np.full(keep.sum(), 2), pa.int32()), "a": pa.array(element[keep].astype(np.int64)), "b": pa.array(key[keep]), "m": pa.array(n[keep], pa.int32()), "s": pa.array(share[keep], pa.float32())})
        by = np.lexsort((key, element))
        element, key, n = element[by], key[by], n[by]
        keep = np.ones(len(key), bool)
        keep[1:] = (element[1:] != element[:-1]) | (key[1:] != key[:-1])
        element, key, n = element[keep], key[keep], n[keep]
        same = element[1:] == element[:-1]
        near = np.zeros(len(element), bool)
        near[1:] |= same
        near[:-1] |= same
        element, key, n = element[near], key[near], n[near].astype(np.int64)
        found, step = [], 1
        while step < len(element):
            hit = np.flatnonzero(element[step:] == element[:-step])
            if not len(hit):
                break
            x, y = n[hit], n[hit + step]
            hit = hit[4 * np.minimum(x, y) >= 3 * np.maximum(x, y)]
            found.append(np.stack([key[hit], key[hit + step]]))
            step += 1
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        pairs.sort(axis=0)
        by = np.lexsort(pairs)
        pairs = pairs[:, by]
        keep = np.ones(pairs.shape[1], bool)
        keep[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
        pairs = pairs[:, keep]
        m = pairs.shape[1]
        return pa.table({"kind": pa.array(np.ones(m), pa.int32()), "a": pa.array(pairs[0]), "b": pa.array(pairs[1]), "m": pa.array(np.full(m, 1 + (block >> bits)), pa.int32()), "s": pa.array(np.zeros(m), pa.float32())})

    return blocks.groupBy("block").applyInArrow(lean_groups(run), "kind int, a bigint, b bigint, m int, s float")


def _set_table(texts: DataFrame, size: int, wanted) -> DataFrame:
    """(key, tokens) of the texts whose hash ``h`` is in the bitmap."""

    def run(batches):
        bitmap, seen = wanted.value, set()
        for batch in batches:
            some = np.flatnonzero(in_bitmap(bitmap, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            for _, texts in text_slices(batch.column(0).take(pa.array(some))):
                element, _, n, keys = text_sets(texts, size)
                ends = np.cumsum(n)
                new = [i for i, k in enumerate(keys.tolist()) if n[i] and not (k in seen or seen.add(k))]
                if new:
                    values = np.concatenate([element[ends[i] - n[i] : ends[i]] for i in new]).astype(np.int64)
                    offsets = np.concatenate([[0], np.cumsum(n[new])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["key", "tokens"])

    return texts.mapInArrow(lean(run), "key bigint, tokens array<bigint>")


def _plausible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose odd sketches allow a similarity of 3/4: then the sets differ in
    a seventh of the sum of their sizes at most."""
    side = lambda c: sketches.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    fold = lambda x: F.transform(F.sequence(F.lit(0), (F.size(x) / 2 - 1).cast("int")), lambda i: F.get(x, i).bitwiseXOR(F.get(x, i + (F.size(x) / 2).cast("int"))))
    short = lambda x, y: F.when(F.size(x) > F.size(y), fold(x)).otherwise(F.col(x))
    bits = F.aggregate(F.zip_with(short("sa", "sb"), short("sb", "sa"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return both.filter((F.least("na", "nb") * 4 >= F.greatest("na", "nb") * 3) & (bits * 7 <= F.col("na") + F.col("nb"))).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have 100 * |a and b| >= 75 * |a or b|."""
    left = sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    return both.filter(F.col("common") * 100 >= (F.size("ta") + F.size("tb") - F.col("common")) * 75).select("a", "b").distinct()


def _ordered(x: str, y: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _compared(element: np.ndarray, key: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray, sketches: list, across: np.ndarray) -> np.ndarray:
    """Pairs (2, m) of keys under one element whose labels differ, sizes fit and
    sketches allow a similarity of 3/4. Rows ascend by element; where ``across`` is
    set only rows of different sides meet."""
    found = [np.zeros((2, 0), np.int64)]
    words = np.fromiter(map(len, sketches), np.int64, len(sketches))

    def matrix(lo: int, hi: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose sketches have ``size`` or twice as many words, folded to it."""
        at = lo + np.flatnonzero((words[lo:hi] == size) | (words[lo:hi] == 2 * size))
        out = np.zeros((len(at), size), np.uint64)
        for r, k in enumerate(at.tolist()):
            v = sketches[k].view(np.uint64)
            out[r] = v if len(v) == size else v[:size] ^ v[size:]
        return at, out

    bounds = np.flatnonzero(np.diff(element, prepend=-1, append=-1)).tolist()
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if label[lo:hi].min() == label[lo:hi].max():
            continue
        for size in np.unique(words[lo:hi]).tolist():
            at, bits = matrix(lo, hi, size)
            small = np.flatnonzero(words[at] == size)  # each pair at the size of its shorter sketch
            for r in small.tolist():
                x = at[r]
                rest = np.flatnonzero((label[at] != label[x]) & ((words[at] > size) | (at > x)) & (4 * np.minimum(n[at], n[x]) >= 3 * np.maximum(n[at], n[x])) & (~across[x] | (side[at] != side[x])))
                if len(rest):
                    apart = np.bitwise_count(bits[rest] ^ bits[r]).sum(axis=1, dtype=np.int64)
                    hit = at[rest[7 * apart <= n[at[rest]] + n[x]]]
                    found.append(np.stack([np.full(len(hit), key[x]), key[hit]]))
    out = np.concatenate(found, axis=1)
    out.sort(axis=0)
    return np.unique(out, axis=1)


def _crossed(named: DataFrame, sketches: DataFrame, chunk: int = 4096, rows: int = 20_000) -> DataFrame:
    """Distinct plausible pairs (a, b) of different labels that share an element of
    ``named`` (element, key, n, label). Lists of more than ``chunk`` sets are cut, and
    each two of their parts meet in a task of their own."""
    sizes = named.groupBy("element").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("key", F.lit(8)), F.col("parts")).cast("int")
    dealt = named.join(sizes, "element").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("element", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "key", "n", "label")
    # One task's rows: all of some (element, i, j); their number is bounded by chunk.
    blocks = max(1, named.count() // rows)
    dealt = dealt.join(sketches.select("key", "sketch"), "key").withColumn("block", F.pmod(F.xxhash64("element", "i", "j"), F.lit(blocks)))

    def run(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).to_numpy()
        order = np.lexsort((col("key"), col("j"), col("i"), col("element")))
        element, i, j = col("element")[order], col("i")[order], col("j")[order]
        new = np.ones(len(order), bool)
        new[1:] = (element[1:] != element[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        lists = table.column("sketch").combine_chunks()
        values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        found = _compared(np.cumsum(new), col("key")[order], col("n")[order].astype(np.int64), col("label")[order], col("part")[order], [values[at[k] : at[k + 1]] for k in order.tolist()], i != j)
        return pa.table({"a": pa.array(found[0]), "b": pa.array(found[1])})

    return dealt.groupBy("block").applyInArrow(lean_groups(run), "a bigint, b bigint").distinct()


def _links(spark: SparkSession, pairs: DataFrame, heavy: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, label): sets that a chain of verified links connects share a label.

    pairs (a, b) and heavy (element, key, n, share) hold all candidates."""
    fits = lambda x, y: F.least(x, y) * 4 >= F.greatest(x, y) * 3

    def star(rows: DataFrame, hub) -> DataFrame:
        hubs = rows.groupBy("element").agg(F.max(F.struct(hub.alias("w"), "key", "n")).alias("h")).select("element", F.col("h.key").alias("hub"), F.col("h.n").alias("hub_n"))
        return _ordered("key", "hub", rows.join(hubs, "element").filter((F.col("key") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"))))

    # One pair for each set: with its smallest partner, or with the hubs of its heavy elements; the
    # set with the largest share of heavy elements is the likeliest original of near copies.
    fit = lambda rows: written(_plausible(rows, sketches), "plausible")
    tested = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(star(heavy, F.col("share"))).distinct()
    tested = written(tested, "tested")
    links = written(_verified(fit(tested), sets), "links")
    for turn in range(1, 9):
        labels = written(connected_components(links).select(F.col("id").alias("key"), F.col("rep").alias("label")), "labels")
        at = lambda df, c, name: df.join(labels.select(F.col("key").alias(c), F.col("label").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
        apart = at(at(pairs, "a", "la"), "b", "lb").filter("la <> lb").select("a", "b")
        named = at(heavy, "key", "label")
        mixed = named.groupBy("element").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("element")
        named = named.join(mixed, "element")
        if turn == 1:  # another hub for each element, then all that is left
            more = star(named, F.xxhash64("key"))
        else:
            more = _crossed(named.select("element", "key", "n", "label"), sketches)
        new = written(apart.union(more).distinct().join(tested, ["a", "b"], "left_anti"), "untested")
        if new.isEmpty() and turn > 1:
            return labels
        if not new.isEmpty():
            links = written(links.union(_verified(fit(new), sets)), "links")
            tested = written(tested.union(new), "tested")
    raise RuntimeError("pairs are left untested")  # turn 2 tests all that turn 1 leaves


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """One row for each document: the id, ``n_shingles`` (of its set) and
    ``component_id``, the smallest id that links reach. Two documents link if the
    Jaccard similarity of their sets of ``size``-word shingles is 0.75 or more.

    A text with fewer words is one shingle; null and empty texts, or white space
    only, have no shingle and are their own component. Null ids are never a
    component's id unless it has no other. Repeated rows give repeated rows, an empty
    table none. Long texts are hashed in segments; a task holds one text's elements."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def digest(batches):
        for batch in batches:
            for a, texts in text_slices(batch.column(1)):
                element, doc, n, keys = text_sets(texts, size)
                bits, words = odd_sketches(element, doc, n)
                sketch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(words)]), pa.int32()), pa.array(bits))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array(n, pa.int64()), pa.array(keys), sketch], names=["id", "n", "key", "sketch"])

    digests = written(source.mapInArrow(lean(digest), f"id {id_type}, n bigint, key bigint, sketch array<bigint>"), "digests", compact=True)
    ids = digests.select("id", "n", "key")
    total = ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(18, max(4, int(total // 2_000_000).bit_length()))
    texts = source.select("text").filter("text IS NOT NULL")
    bitmap = spark.sparkContext.broadcast(heavy_bitmap(texts, size, bits + 2))
    found = written(candidates(prefix_blocks(texts, size, bitmap, bits), bits), "candidates", compact=True)
    pairs = written(found.filter("kind = 1").groupBy("a", "b").agg(F.bit_or("m").alias("m")).filter("m = 3").select("a", "b"), "met")
    heavy = found.filter("kind = 2").select(F.col("a").alias("element"), F.col("b").alias("key"), F.col("m").alias("n"), F.col("s").alias("share")).distinct()
    several = heavy.groupBy("element").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x <> y").select("element")
    heavy = written(heavy.join(several, "element"), "heavy")
    drop_written(spark, found)
    classes = written(ids.filter("n > 0").groupBy("key").agg(F.min("id").alias("rep")), "classes")
    met = written(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).union(heavy.select("key")).distinct(), "keys")
    # equal sets have equal sketches; one of each is kept
    sketches = written(digests.join(met, "key", "left_semi").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    pairs = written(_plausible(pairs, sketches), "pairs")
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).union(heavy.select("key")).distinct()
    wanted = spark.sparkContext.broadcast(bitmap_of(wanted.join(classes, "key").select(F.xxhash64("rep").alias("h"))))
    sets = written(_set_table(source.select("text", F.xxhash64("id").alias("h")), size, wanted), "sets", compact=True)
    labels = _links(spark, pairs, heavy, sketches, sets)
    drop_written(spark, sets)
    named = classes.join(labels, "key", "left")
    least = named.filter("label IS NOT NULL").groupBy("label").agg(F.min("rep").alias("least"))
    named = written(named.join(least, "label", "left").select("key", F.coalesce("least", "rep").alias("component_id")), "components")
    # ids may hold one key in a third of its rows: a join that Spark may split, not a window
    return ids.join(named, "key", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
