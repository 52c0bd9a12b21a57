"""A corpus pipeline: each stage takes the documents that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir). Stages
are written as Parquet and read again by the next one. All but the last return the
columns of ``documents``; the last returns the mix. Columns of the documents that are
named like an operator's keep their own values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm.common import written
from tesseral.llm.decontaminate import drop_contaminated
from tesseral.llm.jaccard import jaccard_components
from tesseral.llm.mixing import mix_sources
from tesseral.llm.quality import classify_quality
from tesseral.llm.secrets import learn_field, scan_secrets


def _beside(docs: DataFrame, names: tuple[str, ...], operator) -> DataFrame:
    """The rows that ``operator`` makes of ``docs``, with the columns of ``docs``: those
    named like one of the operator's (``names``) step aside while it runs."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in names}
    made = operator(docs.withColumnsRenamed(own)).drop(*names)
    return made.withColumnsRenamed({b: a for a, b in own.items()}).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.3 and above)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _beside(docs, ("held_out", "score", "predicted"), lambda rows: classify_quality(rows, labels, threshold=0.3).filter("predicted = 1"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.75 connect, that with the
    smallest doc_id (null last; of repeated rows one). Empty texts all stay."""
    uid = F.monotonically_increasing_id()  # docs is a table of files: the same ids each time
    tagged = docs.withColumn("__uid", uid)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("__uid").alias("uid"))
    groups = jaccard_components(tagged.select(own.alias("id"), "text"), "id")
    stay = groups.filter("n_shingles = 0 OR id = component_id").select(F.col("id.uid").alias("__uid"))
    return tagged.join(stay, "__uid", "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, up to edits."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] in place of secrets; n_chars follows the text."""
    field = learn_field(docs)
    clean = _beside(docs, ("n_assign", "n_access", "n_hex", "base_sha256", "spans"), lambda rows: scan_secrets(rows, field, redacted_col="text"))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: copies, and taken words."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix),
]

#: No stage before the last can be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
