"""Removal of repeated byte strings across all documents, by merging sorted shards.

A byte goes if a string of ``length`` bytes (a window) that covers it also starts
elsewhere. Sorting all suffixes of a corpus is needless for that: the suffixes that
matter are those at *anchors*. The anchor of a window is the least hashed 16-gram in
it (the leftmost, at a tie), so equal windows have equal anchors at equal places.
Windows that follow one another and share their anchor form a run, about two in
each ``length`` bytes.

1. Runs are counted by 128-bit hashes of their content, with the anchor's hash. Equal
   runs would be equal rows of the transform, one next to the other: they count as one
   row that occurs several times, and are repeats throughout. Runs with an anchor of
   their own aren't.
2. What is left are anchors with several contents, mostly where copies begin, end
   or differ. Each task makes the transform of its shard: the contexts to the right of
   its anchors in sorted order, each with what comes before it, and the order of these
   left sides. Shards' rows go to blocks by the anchor, in their order.
3. A block merges its shards by interleave refinement: all rows start in one interval,
   and each step splits intervals by the next symbol (4 bytes). A shard's rows ascend
   within an interval, so a step merges runs and sorts nothing anew; the step at which
   two neighbours part gives their common prefix, and only intervals of several rows go
   on.
4. A window at distance o from its anchor is a repeat if another row lies in the
   same interval to the right, for length - o bytes, and to the left, for o bytes.
5. Anchors with more contents than fit one task (``many``) are refined to the end at
   once: their windows are counted by 128-bit hashes, which any number of tasks share.
   The result is the same.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.llm.common import _BYTE_CODE, bitmap_of, in_bitmap, inverse_powers, mix, powers, text_slices, written

GRAM = 16
_POS = np.uint64((1 << 24) - 1)
_SECOND_CODE = np.random.default_rng(29).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


KEY = ["gram", "content", "second"]


def window_runs(data: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """The runs of all texts: text's number, anchor, first and last window (places in
    the text), hash of the anchor, hashes of the content (two columns). At most 16 MB
    in all."""
    none = (*(np.zeros(0, np.int64) for _ in range(5)), np.zeros((0, 2), np.int64))
    body = b"".join(data)
    raw = np.frombuffer(body, np.uint8)
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    n, starts = len(raw), np.cumsum(sizes) - sizes
    if not len(data) or sizes.max() < length:
        return none
    eight = np.empty(n - 7, np.uint64)  # the 8 bytes from each place on
    for r in range(8):
        part = np.frombuffer(body, "<u8", (n - r) // 8, r)
        eight[r::8] = part
    grams = eight[: n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) + eight[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    wide = length - GRAM + 1
    key = np.full(-(-(n - GRAM + 1) // wide) * wide, np.uint64(2**64 - 1))
    np.bitwise_and(grams, ~_POS, out=key[: n - GRAM + 1])
    key[: n - GRAM + 1] |= np.arange(n - GRAM + 1, dtype=np.uint64)
    table = key.reshape(-1, wide)  # window minima from prefix and suffix minima of blocks
    upto = np.minimum.accumulate(table, axis=1).ravel()
    since = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    least = np.minimum(since[:m], upto[wide - 1 : wide - 1 + m])
    new = np.zeros(m, bool)
    new[1:] = least[1:] != least[:-1]
    some = np.flatnonzero(sizes >= length)
    for s, size in zip(starts[some].tolist(), sizes[some].tolist()):
        new[s] = True
        new[s + size - length + 1 : s + size] = False  # windows that cross the text's end
    for s, size in zip(starts[sizes < length].tolist(), sizes[sizes < length].tolist()):
        new[s : s + size] = False
    lo = np.flatnonzero(new)
    doc = np.searchsorted(starts, lo, side="right") - 1
    hi = np.minimum(np.append(lo[1:], n) - 1, (starts + sizes - length)[doc])
    a = (least[lo] & _POS).astype(np.int64)
    content = np.empty((len(lo), 2), np.uint64)
    for k, code in enumerate((_BYTE_CODE, _SECOND_CODE)):
        running = np.zeros(n + 1, np.uint64)
        np.cumsum(code[raw] * powers(n), out=running[1:])
        content[:, k] = mix((running[hi + length] - running[lo]) * inverse_powers(n)[lo] + (hi - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix((a - lo + k).astype(np.uint64)))
    # grams of anchors are small, as minima; mixed again they spread over all bits
    return doc, a - starts[doc], lo - starts[doc], hi - starts[doc], mix(grams[a]).view(np.int64), content.view(np.int64)


def pieces(column: pa.Array, length: int, most: int = 1 << 19):
    """(number of the text, place in it, bytes): texts as bytes, several in a list of
    about ``most`` bytes; longer ones in pieces that overlap by length - 1 bytes. Runs
    may then end with a piece; what is found doesn't depend on that."""
    out, held = [], 0
    for i, data in ((at + k, t) for at, texts in text_slices(column.cast(pa.binary()), size=most) for k, t in enumerate(texts)):
        data = data or b""
        for at in range(0, max(len(data) - length + 1, 0), most):
            part = data[at : at + most + length - 1]
            out.append((i, at, part))
            held += len(part)
            if held >= most:
                yield out
                out, held = [], 0
    if out:
        yield out


def _runs(texts: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            for part in pieces(batch.column(1), length):
                doc, a, lo, hi, gram, content = window_runs([d for _, _, d in part], length)
                text, at = np.array([i for i, _, _ in part])[doc], np.array([x for _, x, _ in part])[doc]
                # Text that repeats a pattern has one content very often; its places go in one row.
                order = np.lexsort((content[:, 1], content[:, 0], gram, text))
                text, gram, content, lo, span = text[order], gram[order], content[order], (lo + at)[order], (hi - lo)[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1]) | (content[1:] != content[:-1]).any(axis=1)
                first = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(lo)), pa.int32()), pa.array(lo))
                cols = (pa.array(uid[text[first]]), pa.array(gram[first]), *(pa.array(content[first, k]) for k in (0, 1)), pa.array(span[first], pa.int32()), places)
                yield pa.RecordBatch.from_arrays(list(cols), names=["uid", *KEY, "span", "places"])

    return texts.mapInArrow(run, "uid bigint, gram bigint, content bigint, second bigint, span int, places array<bigint>")


_SHARD = "block int, n int, numbers binary, sizes binary, bodies binary, before binary"


def _sides(left: np.ndarray, body: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """What stands to the right of each anchor, and to the left of it, backwards, as rows
    of 8-byte words."""
    wide_r, wide_l = -(-length // 8), -(-(length - GRAM) // 8)
    right, before = np.zeros((len(body), 8 * wide_r), np.uint8), np.zeros((len(body), 8 * wide_l), np.uint8)
    for i, b in enumerate(body):
        raw = np.frombuffer(b, np.uint8)
        r = raw[left[i] : left[i] + length]
        right[i, : len(r)] = r
        before[i, : left[i]] = raw[: left[i]][::-1]
    return tuple(table.view(">u8").astype(np.uint64) for table in (right, before))


def _transforms(texts: DataFrame, length: int, wanted, hot, blocks: int, shard: int = 8192) -> DataFrame:
    """Transforms of shards (:data:`_SHARD`): the runs whose anchors are in the bitmap
    ``wanted``, each once for each task, cut by block. Rows are in the order of their
    right sides; ``before`` is the order of their left sides. Anchors in ``hot`` have
    negative blocks."""

    def packed(rows):
        gram, content, second, left, span = (np.concatenate(c) for c in list(zip(*rows))[:5])
        body = [b for r in rows for b in r[5]]
        right, before = _sides(left, body, length)
        print_of = gram.view(np.uint64)
        block = (print_of % np.uint64(blocks)).astype(np.int64)
        if hot is not None:
            block = np.where(in_bitmap(hot.value, print_of), -1 - (content.view(np.uint64) % np.uint64(blocks)).astype(np.int64), block)
        sizes = np.fromiter(map(len, body), np.int64, len(body))
        out = []
        for at in np.split(np.argsort(block, kind="stable"), np.flatnonzero(np.diff(np.sort(block))) + 1):
            at = at[_sorted_shard(right[at], np.arange(len(at)))]
            order = _sorted_shard(before[at], np.arange(len(at)))
            numbers = np.stack([gram[at], content[at], second[at], left[at], span[at]])
            out.append((int(block[at[0]]), len(at), numbers.tobytes(), sizes[at].astype(np.int32).tobytes(), b"".join(body[i] for i in at), order.astype(np.int32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=["block", "n", "numbers", "sizes", "bodies", "before"])

    def run(batches):
        seen, rows, held = set(), [], 0
        for batch in batches:
            for part in pieces(batch.column(0), length):
                data = [d for _, _, d in part]
                doc, a, lo, hi, gram, content = window_runs(data, length)
                some = np.flatnonzero(in_bitmap(wanted.value, gram.view(np.uint64)))
                some = [i for i in some.tolist() if (k := (int(gram[i]), int(content[i, 0]), int(content[i, 1]))) not in seen and not seen.add(k)]
                if some:
                    rows.append((gram[some], content[some, 0], content[some, 1], (a - lo)[some], (hi - lo)[some], [data[doc[i]][lo[i] : hi[i] + length] for i in some]))
                    held += len(some)
                if held >= shard:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    return texts.mapInArrow(run, _SHARD)


def _unpacked(row) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Numbers (gram, content, second, left, span), bodies and left order of a shard's row."""
    n, numbers, sizes, bodies, before = row
    ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
    return np.frombuffer(numbers, np.int64).reshape(5, n), [bodies[x:y] for x, y in zip([0, *ends], ends)], np.frombuffer(before, np.int32).astype(np.int64)


def merge_shards(words: np.ndarray, shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of all rows of ``words`` (rows, 8-byte symbols), and the number of leading
    bytes that each row shares with the row before it in that order.

    ``shards`` lists rows, each in its sorted order. Interleave refinement: the rows of
    an interval agree on all symbols so far. Rows stay shard by shard, and a shard's
    rows ascend by interval and next symbol; the stable pass merges these runs and
    thus splits the intervals. Only intervals of several rows are looked at again."""
    n, depth = words.shape
    order, common = np.empty(n, np.int64), np.full(n, 8 * depth, np.int64)
    common[:1] = 0
    active = np.concatenate(shards) if shards else np.zeros(0, np.int64)
    start = np.zeros(n, np.int64)  # where each active row's interval begins in the order
    for d in range(2 * depth):
        if not len(active):
            break
        half = (words[active, d // 2] >> np.uint64(32 * (1 - d % 2))) & np.uint64(0xFFFFFFFF)
        key = (start.astype(np.uint64) << np.uint64(32)) | half
        by = np.argsort(key, kind="stable")
        merged, begun = key[by], start[by]
        new = np.ones(len(by), bool)
        new[1:] = merged[1:] != merged[:-1]
        fresh = np.ones(len(by), bool)
        fresh[1:] = begun[1:] != begun[:-1]
        index = np.arange(len(by))
        place = begun + index - np.maximum.accumulate(np.where(fresh, index, 0))
        split = np.flatnonzero(new & ~fresh)
        apart = (merged[split] ^ merged[split - 1]) & np.uint64(0xFFFFFFFF)
        lead = np.zeros(len(split), np.int64)
        for k in range(1, 4):
            lead += (apart >> np.uint64(8 * k)) == 0
        common[place[split]] = 4 * d + lead
        group = np.cumsum(new) - 1
        alone = np.bincount(group)[group] == 1
        order[place[alone]] = active[by[alone]]
        keep, begins = np.empty(len(by), bool), np.empty(len(by), np.int64)
        keep[by], begins[by] = ~alone, place[new][group]
        active, start = active[keep], begins[keep]
    if len(active):  # equal rows, shard by shard
        by = np.argsort(start, kind="stable")
        fresh = np.ones(len(by), bool)
        fresh[1:] = start[by][1:] != start[by][:-1]
        index = np.arange(len(by))
        order[start[by] + index - np.maximum.accumulate(np.where(fresh, index, 0))] = active[by]
    return order, common


def _sorted_shard(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort(words[rows].T[::-1])]


def repeated_windows(left: np.ndarray, span: np.ndarray, body: list[bytes], length: int, shards: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each run (``left`` bytes before the anchor, ``span`` + 1 windows) the
    windows, from 0, that are in another run, too. The runs' contents differ.
    ``shards``: rows in the order of their right sides, and of their left sides."""
    n, sides = len(body), []
    for k, words in enumerate(_sides(left, body, length)):
        order, common = merge_shards(words, [s[k] for s in shards])
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        sides.append((rank, common))
    (rank_r, common_r), (rank_l, common_l) = sides
    # A row shares no more with any other than with a neighbour in the order, so windows
    # that need more on a side are in no other row.
    most = []
    for rank, common in sides:
        after = np.append(common[1:], 0)
        most.append(np.maximum(common, after)[rank])
    low = np.maximum(left - span, length - most[0])
    high = np.minimum(left, most[1])
    live = np.flatnonzero(low <= high)
    rows, windows = [], []
    for o in range(int(low[live].min()), int(high[live].max()) + 1) if len(live) else ():
        some = live[(low[live] <= o) & (o <= high[live])]
        if len(some) < 2:
            continue
        pair = np.cumsum(common_r < length - o)[rank_r[some]] * (n + 1)
        if o:
            pair += np.cumsum(common_l < o)[rank_l[some]]
        by = np.argsort(pair, kind="stable")
        pair = pair[by]
        equal = pair[1:] == pair[:-1]
        same = np.zeros(len(pair), bool)
        same[1:] = equal
        same[:-1] |= equal
        hit = some[by[same]]
        rows.append(hit)
        windows.append(left[hit] - o)
    if rows:
        rows, windows = np.concatenate(rows), np.concatenate(windows)
        by = np.lexsort((windows, rows))
        rows, windows = rows[by], windows[by]
        cuts = np.searchsorted(rows, np.arange(n + 1))
        return [windows[cuts[i] : cuts[i + 1]] for i in range(n)]
    return [np.zeros(0, np.int64)] * n


_SPANS = "gram bigint, content bigint, second bigint, `from` int, `to` int"


def _merged(shards: DataFrame, length: int) -> DataFrame:
    """Spans of windows (from, to, within the run) that other contents of the anchor
    hold, for blocks of anchors."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpacked(row) for row in zip(*(table.column(c).to_pylist() for c in ("n", "numbers", "sizes", "bodies", "before")))]
        numbers, body = np.concatenate([p[0] for p in parts], axis=1), [b for p in parts for b in p[1]]
        # runs that several shards hold count once: the first shard's row stays
        first = np.zeros(len(body), bool)
        first[np.unique(numbers[:3], axis=1, return_index=True)[1]] = True
        name, at, shards = np.cumsum(first) - 1, 0, []
        for p in parts:
            own = np.arange(at, at + len(p[1]))
            shards.append(tuple(name[x[first[x]]] for x in (own, own[p[2]])))
            at += len(own)
        numbers, body = numbers[:, first], [b for b, f in zip(body, first.tolist()) if f]
        found = repeated_windows(numbers[3], numbers[4], body, length, shards)
        rows, a, b = [], [], []
        for i, w in enumerate(found):
            if len(w):
                cut = np.flatnonzero(np.diff(w) > 1)
                a.append(w[np.concatenate([[0], cut + 1])])
                b.append(w[np.concatenate([cut, [len(w) - 1]])])
                rows.append(np.full(len(cut) + 1, i))
        rows, a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, a, b))
        return pa.table([*(pa.array(numbers[k, rows]) for k in range(3)), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=[*KEY, "from", "to"])

    return shards.groupBy("block").applyInArrow(run, _SPANS)


def _counted(shards: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many contents, by counting hashes of windows."""

    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(1, 6))):
                numbers, body, _ = _unpacked(row)
                for i, b in enumerate(body):
                    raw = np.frombuffer(b, np.uint8)
                    m, hashes = len(raw) - length + 1, []
                    for code in (_BYTE_CODE, _SECOND_CODE):
                        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code[raw] * powers(len(raw)))])
                        hashes.append(mix((running[length:] - running[:m]) * inverse_powers(m)).view(np.int64))
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(m, numbers[k, i])) for k in range(3)), pa.array(np.arange(m), pa.int32()), *map(pa.array, hashes)], names=[*KEY, "w", "h", "h2"])

    # A run that several tasks send counts more than once; it is a repeat as a whole anyway.
    rows = shards.mapInArrow(run, "gram bigint, content bigint, second bigint, w int, h bigint, h2 bigint")
    shared = rows.groupBy("h", "h2").agg(F.count("*").alias("c")).filter("c > 1").select("h", "h2")
    return rows.join(shared, ["h", "h2"]).select(*KEY, F.col("w").alias("from"), F.col("w").alias("to")).distinct()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, many: int = 20_000, block_runs: int = 4_000) -> DataFrame:
    """One row for each row of ``docs``: the id, ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs), ``kept_sha256`` (lower-case hex, of the remaining bytes)
    and ``kept`` (binary, these bytes).

    Texts are UTF-8 bytes, null is empty, strings never cross documents, overlaps count
    and everything is judged on the input. ``docs`` must give the same rows in the same
    partitions each time it is read (as files do). The bitmaps that are broadcast
    have a fixed size; wrong bits in them cost time only. An empty table gives no row;
    texts are handled in pieces, however long they are."""
    spark = docs.sparkSession
    uid = F.monotonically_increasing_id().alias("uid")
    texts = docs.select(uid, F.col(text_col).alias("text"))
    runs = written(_runs(texts, length), "runs", compact=True)
    kinds = runs.groupBy(*KEY).agg(F.sum(F.size("places")).alias("c"))
    kinds = written(kinds, "kinds")
    # contents of an anchor that need a closer look: several, and not all of them repeats as a whole
    mixed = kinds.groupBy("gram").agg(F.count("*").alias("nd"), F.sum((F.col("c") == 1).cast("int")).alias("ones")).filter("nd > 1 AND ones > 0").select("gram", "nd")
    mixed = written(mixed, "mixed")
    wanted = spark.sparkContext.broadcast(bitmap_of(mixed.select(F.col("gram").alias("h"))))
    total, most = mixed.agg(F.coalesce(F.sum("nd"), F.lit(0)), F.coalesce(F.max("nd"), F.lit(0))).first()
    blocks = max(1, -(-total // block_runs))
    hot = spark.sparkContext.broadcast(bitmap_of(mixed.filter(F.col("nd") > many).select(F.col("gram").alias("h")))) if most > many else None
    shards = _transforms(texts.select("text"), length, wanted, hot, blocks)
    if hot is None:
        spans = _merged(shards, length)
    else:
        shards = written(shards, "shards")
        spans = _merged(shards.filter("block >= 0"), length).unionByName(_counted(shards.filter("block < 0"), length))
    spans = written(spans, "spans", compact=True)
    whole = runs.join(kinds.filter("c > 1").select(*KEY), KEY).select("uid", "places", F.lit(0).alias("from"), F.col("span").alias("to"))
    parts = runs.join(spans, KEY).join(kinds.filter("c = 1").select(*KEY), KEY, "left_semi").select("uid", "places", "from", "to")
    gone = whole.unionByName(parts).groupBy("uid").agg(F.collect_list(F.struct("places", "from", "to")).alias("gone"))  # of one document
    both = docs.select(F.col(id_col).alias("id"), uid, F.col(text_col).alias("text")).join(gone, "uid", "left").select("id", "text", "gone")
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def cut(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2)):
                data = b"" if text is None else text.encode("utf-8", "surrogatepass")
                kept, n_spans = data, 0
                if spans.is_valid and len(spans):
                    places, low, high = (spans.values.field(k) for k in range(3))
                    times = places.value_lengths().to_numpy(zero_copy_only=False)
                    a = places.flatten().to_numpy()
                    a, b = a + np.repeat(low.to_numpy(), times), a + np.repeat(high.to_numpy(), times) + length
                    by = np.argsort(a, kind="stable")
                    a, b = a[by], np.maximum.accumulate(b[by])
                    new = np.concatenate([[True], a[1:] > b[:-1]])
                    first = np.flatnonzero(new)
                    a, b = a[first], b[np.concatenate([first[1:] - 1, [len(b) - 1]])]
                    n_spans = len(a)
                    ends, begins = [0, *b.tolist()], [*a.tolist(), len(data)]
                    kept = b"".join(data[x:y] for x, y in zip(ends, begins))
                rows.append((len(data), len(data) - len(kept), n_spans, sha256(kept).hexdigest(), kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], names=names)

    kind = both.schema["id"].dataType.simpleString()
    return both.mapInArrow(cut, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)
