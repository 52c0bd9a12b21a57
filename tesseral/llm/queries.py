"""The queries opN_* over the whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.llm.decontaminate import find_items
from tesseral.llm.jaccard import jaccard_components
from tesseral.llm.licenses import NOTICES, scan_licenses
from tesseral.llm.mixing import mix_sources
from tesseral.llm.neighbours import nearest
from tesseral.llm.quality import classify_quality
from tesseral.llm.repeats import remove_repeats
from tesseral.llm.secrets import learn_field, scan_secrets
from tesseral.llm.tokens import count_tokens
from tesseral.llm.warc import capture_facts, captures


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return classify_quality(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items that they hold."""
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also ``text``: what is left of each text, where a cut may part a character."""
    left = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", left)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capture_facts(captures(table(spark, sf_dir, "pages")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_secrets(docs, learn_field(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_quality": op1_quality, "op2_mixing": op2_mixing, "op3_decontamination": op3_decontamination, "op4_tokens": op4_tokens, "op5_repeats": op5_repeats, "op6_neighbours": op6_neighbours, "op7_licenses": op7_licenses, "op8_warc": op8_warc, "op9_secrets": op9_secrets, "op10_jaccard": op10_jaccard}
_SHINGLES = "list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))"
_FORMS = ", ".join("('{}', {}, '{}')".format(n, i, t.replace("'", "''")) for i, (n, t) in enumerate(NOTICES))
_WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"

SQL = {
    "op7_licenses": f"""
        WITH t AS (SELECT license, form, {_WORDS.format("notice")} AS ws FROM (VALUES {_FORMS}) v(license, form, notice)),
        ts AS (SELECT DISTINCT license, form, unnest({_SHINGLES}) AS g FROM t),
        tn AS (SELECT form, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS INTEGER) AS k FROM ts GROUP BY 1),
        d AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
        ds AS (SELECT doc_id, len(ws) - 4 AS n, unnest({_SHINGLES}) AS g, unnest(range(0, len(ws) - 4)) AS pos FROM d WHERE len(ws) >= 5),
        h AS (SELECT doc_id, license, form, tn.n AS tn, ts.g, unnest(range(greatest(0, (pos - 2 * k + greatest(1, k // 2)) // greatest(1, k // 2)), pos // greatest(1, k // 2) + 1)) * greatest(1, k // 2) AS start
            FROM ds JOIN ts ON ds.g = ts.g JOIN tn USING (form)),
        c AS (SELECT doc_id, license, form, start, count(DISTINCT g) / CAST(any_value(tn) AS DOUBLE) AS containment FROM h GROUP BY 1, 2, 3, 4)
        SELECT doc_id, license, max(containment) AS containment, CAST(arg_min(start, (-containment, start)) AS INTEGER) AS first_shingle
        FROM c WHERE containment >= 0.75 GROUP BY 1, 2""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op10_jaccard": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id AS v, doc_id AS o FROM documents UNION SELECT r.v, e.y FROM r JOIN e ON r.o = e.x)
        SELECT v AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o) AS component_id FROM r LEFT JOIN n ON n.doc_id = v GROUP BY v""",
}
