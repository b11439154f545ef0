"""Registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import cascade, decontam, ebayes, lbl, licenses, packing, quotes, rans, resample, secret_scan, shared, simhash, spelling, token_counts

Query = Callable[[SparkSession, str], DataFrame]
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(_table(spark, sf_dir, "conversations"))


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "rans")
    rans.write_tokens(_table(spark, sf_dir, "documents"), path, WORD_BPE, end_id=2)
    return rans.read_tokens(spark, path)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "n_items", "similarity", F.col("first_word").cast("long"), F.col("n_words").cast("long"))


def op4_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op5_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.score(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=4, shingle=4)


def op8_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ebayes.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE, end_id=1, capacity=4096)


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return cascade.quality(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(*few)


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(_table(spark, sf_dir, "documents"), WORD_BPE)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_quotation_linking": op1_quotation_linking,
        "op2_rans_tokens": op2_rans_tokens,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_secret_linking": op4_secret_linking,
        "op5_log_bilinear": op5_log_bilinear,
        "op6_license_scan": op6_license_scan,
        "op7_simhash_components": op7_simhash_components,
        "op8_empirical_bayes": op8_empirical_bayes,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_quality_cascade": op10_quality_cascade,
        "op11_target_resampling": op11_target_resampling,
        "op12_token_counts": op12_token_counts,
        "op13_spelling_variants": op13_spelling_variants,
    }


#: The quality rules in SQL; the order of the rules changes no verdict.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '\P{L}+', '', 'g')) AS letters, length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS capitals
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS n FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND NOT (n_symbols * 10 > n * 3 OR word_chars / n NOT BETWEEN 1.5 AND 40.0 OR n_dup_lines * 10 > n_lines * 4 OR letters * 2 < word_chars OR capitals * 10 > letters * 6) AS kept FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_quality_cascade": OP10_SQL}
