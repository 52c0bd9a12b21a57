"""Operators that compare rows, against brute force on small tables."""

import re
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesseral.llm import decontaminate, jaccard, neighbours, repeats, warc
from tesseral.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit("clash")).withColumn("n", F.lit(1))


def plain_removal(rows, length):
    starts = {}
    for _, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            starts[b[p : p + length]] = starts.get(b[p : p + length], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if starts[b[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), sha256(kept).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("many", [20_000, 2])
def test_removal_of_repeats(spark, many):
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared, rows = word(150), []
    for i in range(40):
        rows.append((i, word(int(rng.integers(0, 300))) + shared[int(rng.integers(0, 40)) : int(rng.integers(60, 150))] + word(int(rng.integers(0, 200)))))
    rows += [(50, "ab" * 300), (51, "x" * 90), (52, None), (53, ""), (54, "short"), (3, rows[3][1]), (55, rows[5][1][:200] + "!" + rows[5][1][200:]), (None, "q" * 64), (56, "q" * 63)]
    for length in (64, 41):
        got = repeats.remove_repeats(docs_of(spark, rows), length=length, many=many, block_runs=30)
        assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got.collect()) == plain_removal(rows, length)
        assert all(len(r.kept) == r.n_bytes - r.n_removed for r in got.collect())
    assert repeats.remove_repeats(docs_of(spark, rows).filter("false")).count() == 0


def test_merged_order_and_common_prefixes():
    rng = np.random.default_rng(8)
    table = rng.integers(0, 2, (200, 24)).astype(np.uint8)
    table[:, :14] = 0
    words = table.view(">u8").astype(np.uint64)
    order, common = repeats.merge_shards(words, [repeats._sorted_shard(words, np.arange(a, min(a + 30, 200))) for a in range(0, 200, 30)])
    rows = [bytes(table[i]) for i in order]
    assert rows == sorted(rows)
    for k in range(1, 200):
        same = next((q for q in range(24) if rows[k][q] != rows[k - 1][q]), 24)
        assert common[k] == same


def test_texts_longer_than_a_piece():
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("abcd"), 5000))
    import pyarrow as pa

    runs = set()
    for part in repeats.pieces(pa.array([text, None, "x"]), 50, most=700):
        doc, a, lo, hi, _, _ = repeats.window_runs([d for _, _, d in part], 50)
        for d, x, y in zip(doc, lo, hi):
            at = part[d][1]
            runs |= set(range(int(at + x), int(at + y) + 1))
    assert runs == set(range(5000 - 49))


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(str((i, len(s), i if not s else least.get(g))) for (i, _), s, g in zip(rows, sets, group))


def jaccard_rows():
    rng = np.random.default_rng(10)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    rows, passage = [], text(40)
    for base in range(6):
        words = text(int(rng.integers(30, 200)))
        for copy in range(int(rng.integers(1, 9))):
            w = list(words)
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(len(w)))] = f"e{rng.integers(10**6)}"
            rows.append((base * 100 + copy, " ".join(w)))
    rows += [(1000 + k, " ".join(text(20) + passage + text(25))) for k in range(12)]
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  b"), (2004, "a b c"), (2005, " "), (7, rows[4][1]), (None, rows[5][1]), (3000, "the " * 400), (3001, "the " * 300)]
    return rows


@pytest.mark.parametrize("heavy", [32, 3])
def test_jaccard_components(spark, heavy, monkeypatch):
    bitmap = jaccard.heavy_bitmap
    monkeypatch.setattr(jaccard, "heavy_bitmap", lambda *a: bitmap(*a, heavy))
    rows = jaccard_rows()
    got = jaccard.jaccard_components(docs_of(spark, rows))
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got.collect()) == plain_components(rows)


def test_jaccard_of_long_texts(spark):
    words = [f"w{k}" for k in range(50_000)]
    other = [*words[:25_000], "changed", *words[25_001:]]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "x" * 500_000), (4, "x" * 500_001), (5, "y " * 100_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs_of(spark, rows)).collect()}
    assert got == {1: (49_996, 1), 2: (49_996, 1), 3: (1, 3), 4: (1, 4), 5: (1, 5)}


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_components(docs_of(spark, [(1, "x")]).filter("false")).count() == 0


def test_odd_sketches_bound_the_difference():
    rng = np.random.default_rng(12)
    a = np.sort(rng.choice(2**40, 300, replace=False)).astype(np.uint64)
    b = np.sort(np.concatenate([a[:250], rng.choice(2**40, 40).astype(np.uint64)]))
    bits, words = jaccard.odd_sketches(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]))
    x, y = bits[: words[0]].view(np.uint64), bits[words[0] :].view(np.uint64)
    y = y if len(y) == len(x) else y[: len(x)] ^ y[len(x) :]
    assert int(np.bitwise_count(x ^ y).sum()) <= len(set(a.tolist()) ^ set(b.tolist()))


def word_distance(item, words):
    """Least edit distance of item to a prefix of words."""
    row = list(range(len(words) + 1))
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_finds_edited_items(spark):
    rng = np.random.default_rng(13)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 400, n)]
    items = [text(int(n)) for n in rng.integers(6, 30, 12)]
    rows, planted = [], []
    for i in range(60):
        w = text(int(rng.integers(0, 120)))
        if i % 2:
            k = int(rng.integers(len(items)))
            q = list(items[k])
            for _ in range(int(rng.integers(0, len(q) // 4 + 1))):
                at = int(rng.integers(len(q)))
                q[at : at + int(rng.integers(0, 2))] = text(int(rng.integers(0, 2)))
            at = int(rng.integers(len(w) + 1))
            w[at:at] = q
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, ""), (102, " ".join(items[0]).upper()), (102, " ".join(items[0]).upper()), (103, "the " * 20_000)]
    bench = spark.createDataFrame([(k, " ".join(q)) for k, q in enumerate(items)] + [(50, None), (51, ""), (52, "a b")], "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_items(docs_of(spark, rows), bench, block=5).collect()}
    want = {}
    for i, t in rows:
        w = (t or "").lower().split()
        for k, q in enumerate(items):
            most = len(q) // 4
            best = min((word_distance(q, w[a : a + len(q) + most]) for a in range(max(1, len(w)))), default=99) if len(w) < 1000 else 99
            if best <= most:
                want[i, k] = best
    assert want and got == want
    left = {r.doc_id for r in decontaminate.drop_contaminated(docs_of(spark, rows), bench).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.find_items(docs_of(spark, rows).filter("false"), bench).count() == 0
    assert decontaminate.find_items(docs_of(spark, rows), bench.filter("false")).count() == 0


def test_the_earliest_of_equal_places_counts():
    item = "one two three four five six seven eight"
    matcher = decontaminate.Matcher([item], rate=0.25, min_words=5)
    near = item.replace("four", "4")
    _, _, first, dist = matcher.find([f"a b {near} c {near} d", f"{near} x {item} y {item}", "z " * 9 + item.upper() + " " + item])
    assert first.tolist() == [2, 9, 9] and dist.tolist() == [1, 0, 0]


@pytest.mark.parametrize("n", [60, 100, 200])
def test_long_items_with_edits_of_one_kind_are_found(n):
    rng = np.random.default_rng(n)
    items = [[f"w{x}" for x in rng.integers(0, 5000, n)] for _ in range(12)]
    matcher = decontaminate.Matcher([" ".join(q) for q in items], rate=0.25, min_words=5)
    texts = []
    for q in items:
        places = rng.choice(n, n // 4, replace=False)
        at = int(rng.integers(n - n // 4))
        added = [x for k, w in enumerate(q) for x in ([f"x{k}", w] if k in places else [w])]
        for edited in ([w for k, w in enumerate(q) if k not in places], added, q[:at] + q[at + n // 4 :]):
            texts.append(" ".join(["before", *edited, "behind"]))
    text, item, _, dist = matcher.find(texts)
    assert sorted(zip(text.tolist(), item.tolist())) == [(t, t // 3) for t in range(len(texts))] and (dist <= n // 4).all()


def test_neighbours_recall_and_order(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = neighbours.nearest(table, F.col("vec_id") % 20 == 0).toPandas()
    rows = table.toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    hits = total = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 11)) and (np.diff(g.score) >= 0).all()
        assert g.score.to_numpy() == pytest.approx(d[[np.flatnonzero(ids == v)[0] for v in g.vec_id]], rel=1e-12)
        hits, total = hits + len(set(best) & set(g.vec_id)), total + 10
    assert total == 10 * (ids % 20 == 0).sum() and hits >= 0.9 * total


def test_fitted_probes_reach_their_recall_with_few_candidates():
    rng = np.random.default_rng(16)
    x = neighbours._unit(rng.normal(size=(20_000, 64)))  # no vector has a near neighbour
    nearest = lambda q: np.argsort(-(x @ x[q]))[1:11]
    lsh = neighbours.CrossPolytope(64, 64, neighbours.width_for(len(x), 64))
    n = neighbours.fitted_probes(lsh, x[:60], [x[nearest(q)] for q in range(60)], 0.94)
    codes = np.stack([lsh.codes(x, t) + t * lsh.buckets for t in range(64)], axis=1)
    hits, share = 0, 0.0
    for q in range(100, 140):  # queries that the fit hasn't seen
        candidate = np.isin(codes, lsh.probes(x[q : q + 1], n)[0]).any(axis=1)
        hits, share = hits + candidate[nearest(q)].sum(), share + candidate.mean() / 40
    assert hits >= 0.9 * 400 and share < 0.12


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 2.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]), (6, [1.0, None, 0.0]), (7, [inf, 1.0, 0.0]), (8, [1.0]), (None, [1.0, 1.0, 1.0]), (9, [-1.0, 0.0, 0.0]), (100, [0.9, 0.1, 0.0]), (200, None), (300, [3.0]), (11, [4.0]), (12, [2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("uid", F.lit("clash"))
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert sorted(got) == sorted(got_by_distance(rows))
    assert neighbours.nearest(table.filter("false"), F.col("vec_id") % 100 == 0).count() == 0


def got_by_distance(rows):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, x in good:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(x))
            out += [(q, k + 1, i) for k, (_, i) in enumerate(near[:10])]
    return out


def test_neighbours_among_copies(spark):
    rng = np.random.default_rng(15)
    centre = rng.normal(size=16)
    rows = [(i, centre.tolist()) for i in range(0, 300)] + [(i, (centre + rng.normal(size=16) / 50).tolist()) for i in range(300, 700)] + [(i, rng.normal(size=16).tolist()) for i in range(700, 1200)]
    rows.append((40, rng.normal(size=16).tolist()))  # a repeated id
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(7)
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 1200, 50)) and all(len(g) == 10 for g in got.values())
    assert got[0] == [*range(1, 11)] and got[50] == [*range(10)] and got[250] == [*range(10)]
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows[:1200]}
    hits = 0
    for q in range(300, 1200, 50):
        near = sorted((float(((x[q] - y) ** 2).sum()), i) for i, y in x.items() if i != q)[:10]
        hits += len({i for _, i in near} & set(got[q]))
    assert hits >= 0.9 * 10 * len(range(300, 1200, 50))


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(14).normal(size=(5, 64)).astype(np.float32)
    y = neighbours.CrossPolytope(64, 1, 1).turned(x, 0, 0)
    assert np.linalg.norm(y, axis=1) == pytest.approx(np.linalg.norm(x, axis=1), rel=1e-4)


def test_warc_round_trip(spark):
    long = "<p>é🙂\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>" * 5
    rows = [(1, "http://a/ b\r\nX: y", long), (2, None, long), (3, "http://c", ""), (4, "http://d", None), (5, "http://e", "short"), (6, "http://e", "short"), (7, "u", "z" * 100), (7, "u", "z" * 100), (8, "v", "z" * 100), (None, "w", "z" * 100), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    nested = warc.captures(pages)
    got = nested.collect()
    assert len(got) == len(rows) and all(r.request and r.response and r.metadata for r in got)
    kept = [bytes(r.response.payload).decode() for r in got if r.response.kind == "response"]
    assert sorted(kept) == sorted(["", "", "", "short", "short", long, "z" * 100])
    facts = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in warc.capture_facts(nested).collect())
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == b and j is not None]
        first = len(b) < 100 or i == min(same)
        want.append((i or 0, len(b), sha256(b).hexdigest(), "response" if first else "revisit", 0 if first else min(same)))
    fixed = sorted(want)
    at = [k for k, w in enumerate(fixed) if w[0] == 7][0]  # of repeated rows one is the response
    fixed[at + 1] = (7, 100, fixed[at][2], "revisit", 7)
    assert facts == sorted(fixed)
    assert warc.capture_facts(warc.captures(pages.filter("false"))).count() == 0


def test_archives_of_many_files_and_long_pages(spark, tmp_path):
    import gzip

    rng = np.random.default_rng(17)
    rows = [(i, f"http://p/{i}", rng.bytes(60).hex() * (1 + i % 7)) for i in range(60)] + [(100, "http://long", "é" * 3_000_000), (101, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    pages.write.parquet(f"{tmp_path}/pages")
    folder = warc.write_archives(spark.read.parquet(f"{tmp_path}/pages"), f"file://{tmp_path}/warc", file_bytes=2_000)
    files = sorted((tmp_path / "warc").glob("*.warc.gz"))
    assert len(files) > 20 and not list((tmp_path / "warc").glob(".part-*"))
    assert files[0].read_bytes().count(b"\x1f\x8b\x08") >= 3  # a member for each record
    records = warc.read_archives(spark, folder)
    assert records.count() == 3 * len(rows)
    found = {r.page_id: r.payload_bytes for r in warc.capture_facts(warc.assemble(records)).collect()}
    assert found == {i: len((h or "").encode()) for i, _, h in rows}
    data = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    whole = [(h["warc-record-id"], b) for h, b in warc.parse_records(data)]
    packed = gzip.compress(data)
    for pieces in ([packed], [packed[i : i + 1000] for i in range(0, len(packed), 1000)], [data[i : i + 777] for i in range(0, len(data), 777)]):
        assert [(h["warc-record-id"], b) for h, b in warc.stream_records(pieces)] == whole
    more = records.filter("kind = 'metadata'").withColumn("record_id", F.concat("record_id", F.lit("-b")))
    nested = warc.assemble(records.union(more).union(records)).collect()
    assert len(nested) == len(rows) and all(len(r.metadata) == 2 and len(r.request) == 1 and r.response for r in nested)


def test_members_behind_a_long_one():
    head = lambda n: f"WARC/1.1\r\nWARC-Record-ID: <{n}>\r\nContent-Length: {n}\r\n\r\n".encode()
    sizes = [10, 3_000_000, 20, 1 << 20, 30, 5_000_000, 40]  # unpacked in several steps, all within one window
    data = b"".join(warc._gzipped(head(n) + b"x" * n) for n in sizes)
    for step in (len(data), 100, 7):
        got = warc.stream_records([data[i : i + step] for i in range(0, len(data), step)])
        assert [(int(h["content-length"]), len(b)) for h, b in got] == [(n, n) for n in sizes]


def test_parser_refuses_other_bytes():
    with pytest.raises(ValueError):
        list(warc.parse_records(b"HTTP/1.1 200 OK\r\n\r\n"))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(tuple(dict(zip(want.columns, r))[c] for c in cols)) for r in want.fetchall())
