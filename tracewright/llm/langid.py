"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training adds up n-gram counts per language and hash bucket in the tasks and sums them in one shuffle; what reaches
the driver is at most `languages x buckets` numbers. The matrix of log probabilities is broadcast, and a document is
scored by a sparse product of its bucket counts with that matrix.

Defined cases: a null text or one without a letter is `und` with score 0; rows with null `lang` are not learned from;
a language needs one training row; without training rows every document is `und`. Ties go to the first language in
code point order. Repeated rows are scored alike; long texts are worked on in pieces with nothing left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from .common import add_columns, blocks, quoted, texts_of, unused

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
MAX_LANGUAGES = 1024  # bounds the matrix: 1,024 x 16,384 numbers of four bytes are 64 MB
PIECE = 1 << 20  # characters of a text hashed at a time
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    prior: np.ndarray  # log share of training rows per language
    weights: np.ndarray  # log probability per bucket and language


def bucket_counts(text: str, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Counts of the hashed n-grams of a lower-cased text with a blank at either end; ASCII non-letters are blanks."""
    total = np.zeros(buckets, np.int64)
    text, longest = f" {text.lower()} ", max(orders)
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at:at + PIECE + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < 128, _PLAIN[codes & 127], codes).astype(np.uint64)
        state = np.zeros(len(codes), np.uint64)
        for n in range(1, longest + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            state = (state[:m] + codes[n - 1:] + np.uint64(n)) * _MIX[0]
            state ^= state >> np.uint64(29)
            if n in orders:
                own = state[:PIECE]  # what begins in the next piece is counted there
                total += np.bincount(((own * _MIX[1]) >> np.uint64(40)) % np.uint64(buckets), minlength=buckets)
    return total


def train(docs: DataFrame, where: Column, buckets: int = BUCKETS) -> LanguageModel:
    """Learn from `text` and `lang` of the rows of `docs` that satisfy `where` and have both."""
    rows = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        rows_of: dict[str, int] = {}
        for block in blocks(batches):
            for lang, text in zip(block.column("lang").to_pylist(), texts_of(block)):
                if lang not in sums:
                    sums[lang] = np.zeros(buckets, np.int64)
                sums[lang] += bucket_counts(text, buckets)
                rows_of[lang] = rows_of.get(lang, 0) + 1
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            at, n = np.append(used, -1).astype(np.int32), np.append(total[used], rows_of[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n)], ["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).toPandas()["lang"])
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = sums.toArrow().to_pydict() if languages else {"lang": [], "bucket": [], "n": []}
    place = {lang: i for i, lang in enumerate(languages)}
    counts, priors = np.zeros((buckets, len(languages))), np.ones(len(languages))
    where_lang = np.array([place[x] for x in found["lang"]], np.int64)
    at, n = np.array(found["bucket"], np.int64), np.array(found["n"], np.float64)
    counts[at[at >= 0], where_lang[at >= 0]] = n[at >= 0]
    priors[where_lang[at < 0]] = n[at < 0]
    weights = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * buckets))
    return LanguageModel(languages, np.log(priors / priors.sum()), weights)


def best_language(model: LanguageModel, text: str | None) -> tuple[str, float]:
    """The most probable language of a text and its posterior probability."""
    if not text or not model.languages or not LETTER.search(text):
        return UNKNOWN, 0.0
    counts = bucket_counts(text, len(model.weights))
    used = np.flatnonzero(counts)
    scores = model.prior + counts[used] @ model.weights[used]
    top = int(scores.argmax())
    return model.languages[top], float(1.0 / np.exp(scores - scores[top]).sum())


def identify(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None,
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`keep` columns (all if not given) with the language and its score; these replace columns of the same name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(block):
        found = [best_language(shared.value, t) for t in block.column("text").to_pylist()]
        return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
    return add_columns(docs, docs.columns if keep is None else keep,
                       [StructField(names[0], StringType()), StructField(names[1], DoubleType())], predict)


def accepted(docs: DataFrame, model: LanguageModel, min_score: float = 0.5) -> DataFrame:
    """The rows of `docs` that have a language: some letter, and a posterior of at least `min_score`."""
    lang, score = unused(docs, "lang_pred", "lang_score")
    found = identify(docs, model, names=(lang, score))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).select(*map(quoted, docs.columns))
