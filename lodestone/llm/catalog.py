"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.exact_topk import exact_topk
from lodestone.llm.html_text import extract_html
from lodestone.llm.merkle import verified_manifest
from lodestone.llm.mixing import label_domains, mixing_rates
from lodestone.llm.oracles import MANIFEST, SUBSTRINGS, VECTOR_CODES
from lodestone.llm.pii import pii_spans
from lodestone.llm.prefix_forest import forest_search
from lodestone.llm.secrets import secret_spans
from lodestone.llm.sentencepieces import encode_documents
from lodestone.llm.simhash import near_duplicates
from lodestone.llm.substring_dedup import dedup_substrings
from lodestone.llm.suffix_dedup import repeated_passages
from lodestone.llm.toxicity import score_documents
from lodestone.llm.vector_codes import vector_codes

#: Token shares of the labelled domains: quality 0 or 1, toxic 0 or 1.
MIX_TARGETS = {"q1t0": 0.82, "q0t0": 0.10, "q1t1": 0.06, "q0t1": 0.02}

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), MIX_TARGETS)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_simhash_near_dedup, op3_pii, op4_exact_topk, op5_prefix_forest, op6_suffix_dedup, op7_toxicity, op8_html_extraction, op9_mixing, op10_secret_scan,
        op11_merkle_manifest, op12_substring_dedup, op13_vector_codes,
    )
}

_PLAIN = "regexp_replace(x, '<[^>]*>', '', 'g')"
for _reference, _character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_reference}', '{_character}')"

#: Cosines differ in their last bits between engines, so op5 has no SQL; its recall is tested against brute force.
ORACLES: dict[str, str] = {
    "op4_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS z
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.z, c.z) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.z) = len(q.z)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    # The tables' pages have one layout; its tags can be read by patterns.
    "op8_html_extraction": f"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
b AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(h, '<br>', ' '), '</?h1>|</?p>'),
    lambda x: trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text
  FROM a)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM b
""",
    "op11_merkle_manifest": MANIFEST,
    "op12_substring_dedup": SUBSTRINGS,
    "op13_vector_codes": VECTOR_CODES,
}
