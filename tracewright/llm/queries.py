"""Registered queries of the text operators and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import digest, hamming, hmm, langid, lexical, licenses, mixing, pieces, quality, rules, runs, simhash, suffixes
from .common import doc_hash_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query()
def op6_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held_out = doc_hash_remainder(4) == 2
    found = langid.identify(docs, langid.train(docs, ~held_out), ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op10_sentencepiece(spark, sf_dir):
    found = pieces.encode(documents(spark, sf_dir), tokenizer_path(), ["doc_id"])
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


@query(mixing.ORACLE)
def op9_mix(spark, sf_dir):
    return mixing.mixed(mixing.sized(documents(spark, sf_dir)))


@query()
def op8_suffix_dedup(spark, sf_dir):
    return suffixes.cut(documents(spark, sf_dir), ["doc_id"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query()
def op3_license_scan(spark, sf_dir):
    return licenses.labelled(documents(spark, sf_dir))


@query()
def op4_digest(spark, sf_dir):
    return digest.with_next(documents(spark, sf_dir))


@query(hamming.ORACLE)
def op7_hamming_top_k(spark, sf_dir):
    rows = hamming.codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hamming.top_k(rows, rows.where("vec_id % 20 = 0"))


@query()
def op5_hmm_score(spark, sf_dir):
    return hmm.score(documents(spark, sf_dir))


@query()
def op1_quality(spark, sf_dir):
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query(lexical.ORACLE)
def op11_lexical_search(spark, sf_dir):
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query()
def op12_quality_rules(spark, sf_dir):
    found = rules.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        "anomaly", "threshold")


@query()
def op13_periodic_runs(spark, sf_dir):
    found = runs.collapse(runs.with_planted_runs(documents(spark, sf_dir)), ["doc_id"])
    best = runs.longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(best[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
