"""One registered query for each corpus operator, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, linededup, maxent, neardup, packing, pii, tokencounts, topk, toxicity
from .shared import tidy

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy(spark, executors=True)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = linededup.drop_boilerplate(docs, F.col("source"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.char_length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("text_md5"))


OP1_SQL = r"""
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
pages AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
counts AS (SELECT source, line, count(DISTINCT doc_id) AS pages FROM lines WHERE trim(line) <> '' GROUP BY source, line),
boiler AS (SELECT c.source, c.line FROM counts c JOIN pages p USING (source) WHERE c.pages >= 5 AND c.pages > 0.1 * p.host_pages),
marked AS (SELECT l.doc_id, l.i, l.line, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN boiler b ON l.source = b.source AND l.line = b.line),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, length(text) AS n_chars_kept, md5(text) AS text_md5 FROM kept
"""


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


OP2_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, md5_number_lower(x) AS h, md5_number_upper(x) AS g FROM (SELECT doc_id, s, unnest(s) AS x FROM sets)),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n + b.n AS total, count(*) AS c FROM each a JOIN each b ON a.h = b.h AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2, 3),
links AS (SELECT u, v FROM pairs WHERE 100 * c >= 80 * (total - c)),
either AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach(u, v) AS (SELECT u, v FROM either UNION SELECT r.u, e.v FROM reach r JOIN either e ON e.u = r.v),
low AS (SELECT u, least(min(v), u) AS m FROM reach GROUP BY u)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.m, s.doc_id) AS component_id, coalesce(l.m, s.doc_id) = s.doc_id AS kept FROM sets s LEFT JOIN low l ON l.u = s.doc_id
"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), BYTE_BPE, PATTERN)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), WORD_BPE)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"), BYTE_BPE, PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin([k.name for k in pii.BASE]))
    return found.select("doc_id", *(n(k.name) for k in pii.BASE), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op10_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_fingerprints": op4_fingerprints,
    "op5_packing": op5_packing,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_personal_data": op8_personal_data,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_maxent_scores": op10_maxent_scores,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op2_near_duplicates": OP2_SQL,
    "op9_exact_top_k": OP9_SQL,
}
