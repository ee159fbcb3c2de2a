"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import (bpe, decontamination, fingerprints, html_extraction, language, lexical_search, line_dedup, ngram_join, pii, quality,
                          token_files, toxicity, whitening)
from assaykit.llm.common import documents
from assaykit.session import workspace


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file: below ASSAYKIT_TOKENIZERS, or where the installed package has it."""
    folder = os.environ.get("ASSAYKIT_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, folder)))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(documents(spark, folder), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """Documents (doc_id) and pages (page_id): language and its posterior probability."""
    docs = documents(spark, folder)
    rows = language.of_documents(docs).unionByName(language.of_pages(spark.read.parquet(f"{folder}/pages.parquet")))
    found = language.identify(rows, docs.select("doc_id", F.col("lang").alias("label"), "text"))
    return found.select(F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"),
                        F.when(F.col("kind") == "page", F.col("id")).alias("page_id"), "lang", "posterior")


def op5_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, folder))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = workspace(spark, "token-files")
    token_files.write(documents(spark, folder), path, vocabulary("byte_bpe_50k.json"))
    return token_files.catalogue(spark, path)


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "distance")


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(documents(spark, folder), vocabulary("byte_bpe_50k.tiktoken"), pattern())


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.dedup(documents(spark, folder).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "removed_lines", F.sha2("text", 256).alias("text_sha256"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "source", "lang")
    found = quality.scored(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return found.select("doc_id", "quality_evidence", "quality_site", "quality_score", "quality_kept")


def op11_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract(spark.read.parquet(f"{folder}/pages.parquet"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op13_search(spark: SparkSession, folder: str) -> DataFrame:
    path = workspace(spark, "lexical-index")
    lexical_search.build(documents(spark, folder), path)
    return lexical_search.search(spark, path, spark.read.parquet(f"{folder}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_pii, op2_toxicity, op3_ngram_join, op4_language, op5_fingerprints, op6_token_files,
                            op7_decontamination, op8_bpe, op9_line_dedup, op10_quality, op11_html, op12_whitening,
                            op13_search)}
SEARCH = r"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
items AS (SELECT row_number() OVER () AS item, item_id, coalesce(text, '') AS text FROM benchmark),
doc_terms AS (
    SELECT doc, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
item_terms AS (
    SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items),
tf AS (SELECT doc, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT doc, count(*) AS n FROM doc_terms GROUP BY doc),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
m AS (SELECT doc, 100 - 75 + (75 * n * n_docs) // n_terms AS m FROM n, total),
wanted AS (SELECT item, any_value(item_id) AS item_id, term, count(*) AS times FROM item_terms GROUP BY item, term),
weighted AS (SELECT item, item_id, term, times * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS weight
             FROM wanted JOIN df USING (term), total),
scored AS (SELECT item, any_value(item_id) AS item_id, doc, any_value(doc_id) AS doc_id,
                  sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM weighted JOIN tf USING (term) JOIN m USING (doc) GROUP BY item, doc)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
#: The others can't be said in SQL over whole tables; tests hold them against brute force, round trips or held-out rows.
TWINS: dict[str, str] = {"op13_search": SEARCH}
