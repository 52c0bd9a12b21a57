"""The pipeline's stages, each on what its predecessor kept."""

import numpy as np
import psutil
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tesseral.llm.common import written
from tesseral.llm.decontaminate import find_items
from tesseral.llm.jaccard import jaccard_components
from tesseral.llm.secrets import base_spans
from tesseral.operators.components import connected_components, star_forest
from tesseral.plans.workers import give_back, lean, lean_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, steps = [docs.count()], {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "step")
        steps[name] = docs
        sizes.append(docs.count())
    names = [n for n, _ in corpus_pipeline.STAGES]
    for n in names[:-1]:
        assert steps[n].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] == sizes[-3]
    kept = jaccard_components(steps[names[0]]).filter("n_shingles = 0 OR component_id = doc_id").select("doc_id")
    assert {r.doc_id for r in steps[names[1]].collect()} == {r.doc_id for r in kept.collect()}
    assert find_items(steps[names[2]], spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert not [r for r in steps[names[3]].collect() if base_spans(r.text or "")]
    assert steps[names[3]].filter(F.length("text") != F.col("n_chars")).count() == 0
    assert steps[names[4]].agg(F.sum("taken")).first()[0] > 0


def test_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "some words that make up a good sentence, repeated in no other place."
    rows = [(None, text, "en", None, 1), (1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0)]
    docs = written(spark.createDataFrame(rows, schema), "odd")
    one = corpus_pipeline.one_of_each_group(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in one) == ["1", "2", "3"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0


def test_own_columns_and_long_texts(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, Score string, predicted string, held_out int, spans string, n_hex string, id int, key int, uid string, word string"
    prose = "the weather in the valley was mild and the river ran slow past the old mill while farmers brought in hay."
    token = "0123456789abcdef0123456789abcdef"
    rows = [(i, f"{prose} Story number {i} tells of {i * 7} sheep, {i * 3} goats and a dog called Rex{i}.", "en", "a", 0) for i in range(6)]
    rows += [(10, "long " + " ".join(f"w{k}" for k in range(60_000)) + f" token = {token}", "en", "b", 0), (11, "x" * 400_000, "en", "b", 0), (12, f"see {token} there", "en", "a", 0)]
    own = ("s", "p", 3, "sp", "h", 4, 5, "u", "w")
    docs = written(spark.createDataFrame([(*r, *own) for r in rows], schema), "own")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found or name == "quality classifier"
        assert all(tuple(r)[5:] == own for r in found), name
        if name == "secret scans":
            text = {r.doc_id: r.text for r in found}
            assert text[12] == "see [SECRET] there" and text[10].endswith("w59999 [SECRET]") and token not in text[10]
            assert all(r.n_chars == len(r.text) for r in found)
        if name == "benchmark decontamination":
            assert len(found) == len(rows)
    mixed = {r.doc_id: r for r in corpus_pipeline.mix(spark, docs, SF).collect()}
    assert mixed[10]["size"] == 60_004 and len(mixed) == len(rows)


def test_workers_give_memory_back():
    held = []

    def run(batches):
        for n in batches:
            some = [np.ones(12_500) for _ in range(n)]  # too small for mappings of their own
            held.append(some[-1])  # the end of the heap stays in use
            yield pa.RecordBatch.from_arrays([pa.array([len(some)])], names=["n"])

    def kept(f):
        before = psutil.Process().memory_info().rss
        assert [b.column(0)[0].as_py() for b in f(iter([2_000]))] == [2_000]
        return (psutil.Process().memory_info().rss - before) / 1e6

    give_back()
    assert kept(lean(run)) < 60  # of 200 MB
    groups = lean_groups(lambda table: next(run([2_000])))
    before = psutil.Process().memory_info().rss
    assert groups(None).num_rows == 1
    assert (psutil.Process().memory_info().rss - before) / 1e6 < 60


def test_components_need_one_worker_for_each_task(spark):
    edges = spark.range(0, 4_000, 1, 8).select(F.col("id").alias("a"), (F.col("id") * 7 % 4_000).alias("b"))
    found = connected_components(edges)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r.id: r.rep for r in found.collect()} == {i: r for i, r in zip(*map(np.ndarray.tolist, star_forest(np.arange(4_000), np.arange(4_000) * 7 % 4_000)))}
