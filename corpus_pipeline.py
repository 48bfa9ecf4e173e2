"""From raw documents to an encoded training mix: STAGES in order, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.llm import langid, mixing, pieces, simhash, suffixes
from tracewright.llm.queries import documents, tokenizer_path
from tracewright.session import fresh_path


def identified(spark, docs, sf_dir):
    """Documents with a language; those without a letter, or with no likely language, go."""
    return langid.accepted(docs, langid.train(docs, F.lit(True)))


def deduplicated(spark, docs, sf_dir):
    """One document of each group of near copies."""
    return simhash.one_of_each(docs)


def without_repeats(spark, docs, sf_dir):
    """Texts without byte strings that an earlier text, or an earlier place, has; a text with nothing left goes."""
    kept = suffixes.cut(docs).where((F.col("n_removed") == 0) | (F.trim("kept_text") != ""))
    texts = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select(*(texts.alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def mixed(spark, docs, sf_dir):
    """Sources at their target weights; a document that is taken twice comes twice."""
    return mixing.mix(docs)


def encoded(spark, docs, sf_dir):
    """Piece ids, their ends in the source, and the decoded text of every document."""
    return pieces.encode(docs, tokenizer_path())


STAGES = [("language_id", identified), ("simhash_dedup", deduplicated), ("suffix_dedup", without_repeats),
          ("source_mix", mixed), ("sentencepiece", encoded)]
ORACLE_SQL = None  # naive Bayes, fingerprints, suffixes and piece encoding are not SQL; tests compare with brute force


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
