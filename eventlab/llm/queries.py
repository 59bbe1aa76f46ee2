"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlab.llm import bpe, filteraudit, licenses, linededup, media, mixing, periodic, quality, substrings, unigram, urlrep, warc
from eventlab.llm.simhash import simhash_components

#: The vocabulary of op7; any rank file and pattern can be given to the operator.
BPE_FILE = "byte_bpe_multi_50k.tiktoken"
#: The vocabulary of op3, scored by Zipf's law; any pieces and scores can be given to the operator.
PIECE_FILE = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_media(_table(spark, sf_dir, "documents"))


def op3_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(_table(spark, sf_dir, "documents"), unigram.zipf_scores(public_tokenizers.path(PIECE_FILE)))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), licenses.document_path())


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN, keep_ids=False)


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrep.judge_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents")).drop("distance2")


def _planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, by its doc_id, repeats from some word on with some period; a null doc_id stays as it is."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_table(spark, sf_dir, "documents"), prepare=_planted_period)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.withColumn("best", periodic.longest_run(F.col("runs")))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cube_mix": op1_cube_mix,
    "op2_media_chunks": op2_media_chunks,
    "op3_unigram_counts": op3_unigram_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_simhash_components": op6_simhash_components,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_warc_salvage": op8_warc_salvage,
    "op9_url_reputation": op9_url_reputation,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_filter_audit": op12_filter_audit,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": linededup.ORACLE_SQL,
    "op5_license_scan": licenses.ORACLE_SQL,
    "op8_warc_salvage": warc.ORACLE_SQL,
    "op9_url_reputation": urlrep.ORACLE_SQL,
    "op10_quality_rules": quality.ORACLE_SQL,
    "op12_filter_audit": filteraudit.ORACLE_SQL,
    "op13_substring_dedup": substrings.ORACLE_SQL,
}
