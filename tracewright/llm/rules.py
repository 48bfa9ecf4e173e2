"""Quality rules: counts of every text, base rules on them, and an isolation forest on the rule statistics.

`statistics` counts, in one pass over the texts and without a shuffle, what quality rules ask for. The forest sees shares
from these counts (`features`). Each of its `TREES` trees cuts `SAMPLE` rows of a pool by random features at random places;
a document that few cuts set apart is anomalous. Its score is 2 ** (-mean path length / path length of a random search).

The pool is the `POOL` rows with the least hashes among all that pass the base rules (a documented bound: a forest
needs no more), so it has every source and language in proportion. The threshold comes from all labelled rows that pass
the base rules, by a histogram of their scores: of the thresholds that lose at most `LOST` of the good ones (quality 1,
not toxic) the one that best parts rows of quality 0 from good ones. With few labels it is drawn towards `PRIOR`, as
if 1 / LOST more good rows had spoken for that; without any it is `PRIOR`.

Defined cases: null, empty and blank texts have no words, fail the base rules and are not kept; repeated rows have equal
results; a null doc_id has no label; an id labelled more than once counts as bad or toxic if any of its labels is;
equal scores share a verdict; texts of any length are read whole; an empty table gives no rows. `classify` returns its
own columns only; `statistics` puts its counts in the place of input columns of the same names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from ..session import cut_lineage
from .common import add_columns

WINDOW = 8  # words of a window that counts as repeated
FEWEST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")

TREES = 100
SAMPLE = 256
POOL = 1 << 14
DEPTH = 8  # log2(SAMPLE)
SEED = 12
BINS = 1 << 13  # scores of labelled rows are counted in so many bins
LOST = 0.005
PRIOR = 0.7
EVEN = 300

_BLANKS = b" \t\n\x0b\x0c\r"
_NOT_CHARS = _BLANKS + bytes(range(0x80, 0xC0))  # bytes that begin no character of a word
_UPPER = bytes(range(65, 91))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in SYMBOLS)


def repeated_words(words: np.ndarray, size: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Of texts that lie end to end in `words` (numbers): words of each in windows that it holds twice or more.

    Windows of twice the width are pairs of windows; only pairs of repeated ones can be repeated. `width` is a power of 2.
    """
    text = np.repeat(np.arange(len(size)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(words))  # words from here to the end of the text
    again, name = np.ones(len(words), bool), words.astype(np.int64)
    bits, span = int(words.max(initial=0)).bit_length(), 1
    while span < width:
        at = np.flatnonzero(left >= 2 * span)
        at = at[again[at] & again[at + span]]
        key = name[at] << bits | name[at + span]
        if span == 1:
            key |= text[at] << 2 * bits
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        names = np.concatenate([[0], np.cumsum(~same)])[:len(at)]
        again, name = np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        again[at], name[at[order]] = twice, names
        bits, span = max(1, int(names[-1]).bit_length()) if len(names) else 1, 2 * span
    start = np.flatnonzero(again)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[start] += 1
    edge[start + width] -= 1
    covered = np.cumsum(edge)[:-1] > 0
    return np.bincount(text[covered], minlength=len(size))


def _without(data: bytes, drop: bytes) -> int:
    return len(data.translate(None, drop))


def count_block(texts: list[bytes]) -> list[np.ndarray]:
    """The arrays of `COUNTS`."""
    split = [t.split() for t in texts]  # bytes: ASCII blanks only
    size = np.fromiter(map(len, split), np.int64, len(split))
    numbers: dict[bytes, int] = {}
    get = numbers.setdefault
    words = np.fromiter((get(w, len(numbers)) for row in split for w in row), np.int64, size.sum())
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]

    def each(fn, of=texts):
        return np.fromiter(map(fn, of), np.int64, len(texts))
    length = each(len)
    return [size, each(lambda t: _without(t, _NOT_CHARS)), length - each(lambda t: _without(t, SYMBOLS)),
            each(len, lines) - each(lambda x: len(set(x)), lines), repeated_words(words, size),
            length - each(lambda t: _without(t, _UPPER)), length - each(lambda t: _without(t, _MARKS))]


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all if not given) with the counts of `COUNTS`: n_words, word_chars (code points in words),
    n_symbols (of `SYMBOLS`), n_dup_lines (lines with a word that equal an earlier one), n_repeat_words (in windows of
    `WINDOW` words that the text has twice or more), ASCII capitals, and other ASCII marks."""
    def run(block):
        return count_block([(t or "").encode("utf-8", "surrogatepass") for t in block.column("text").to_pylist()])
    return add_columns(docs, docs.columns if keep is None else keep, [StructField(c, LongType()) for c in COUNTS], run)


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row per document: mean length of words, and roots of the shares of symbols, capitals and other marks, all as
    if the text had `EVEN` more characters in words of five, so that a short text's few words don't set it apart.

    Repetition is the base rules' matter: it is so rare that a forest would see little else.
    """
    words, chars = counts["n_words"] + EVEN / 5, counts["word_chars"] + float(EVEN)
    shares = [np.sqrt(counts[c] / chars) for c in ("n_symbols", "n_upper", "n_marks")]
    return np.stack([chars / words, *shares], axis=1)


FEATURES = 4


def search_length(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows in a random tree."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n, 2)
    return np.where(n <= 1, 0.0, 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m)


def grow(rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree as a heap: feature of each node (-1: a leaf), cut, and path length at a leaf."""
    nodes = (1 << (DEPTH + 1)) - 1
    feature, cut, path = np.full(nodes, -1, np.int32), np.zeros(nodes), np.zeros(nodes)
    todo = [(0, 0, rows)]
    while todo:
        v, depth, x = todo.pop()
        low, high = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(FEATURES), np.zeros(FEATURES))
        varied = np.flatnonzero(high > low)
        if depth == DEPTH or not len(varied):
            path[v] = depth + search_length(len(x))
            continue
        f = varied[rng.integers(len(varied))]
        at = rng.uniform(low[f], high[f])
        feature[v], cut[v] = f, at
        right = x[:, f] > at
        todo += [(2 * v + 1, depth + 1, x[~right]), (2 * v + 2, depth + 1, x[right])]
    return feature, cut, path


class Forest:
    def __init__(self, feature: np.ndarray, cut: np.ndarray, path: np.ndarray, sample: int):
        self.feature, self.cut, self.path, self.sample = feature, cut, path, sample

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Near 1: set apart by few cuts; 0.5 and below: like most."""
        if not len(self.feature) or self.sample < 2:
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, path in zip(self.feature, self.cut, self.path):
            v = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[v]
                v = np.where(f < 0, v, 2 * v + 1 + (x[rows, f] > cut[v]))
            total += path[v]
        return 2.0 ** (-total / len(self.feature) / float(search_length(self.sample)))


def pool_of(rows: DataFrame, size: int = POOL) -> np.ndarray:
    """Features of the `size` rows with the least hashes that pass the base rules; only these reach the driver.

    Hashes above a bound that about `2 * size` rows stay below are left out first, so few rows of each task are ordered.
    """
    passed = rows.where(~base_failed()).select(*COUNTS, F.xxhash64(F.lit(SEED), "doc_id", *COUNTS).alias("key"))
    n = passed.count()
    if n > 4 * size:
        passed = passed.where(F.col("key") < int(2 ** 64 * (2 * size / n)) - 2 ** 63)
    found = passed.orderBy("key", *COUNTS).limit(size).toArrow()
    return features({c: found[c].to_numpy() for c in COUNTS})


def forest(spark, pool: np.ndarray, trees: int = TREES) -> Forest:
    """Trees are grown in tasks, each from its own `SAMPLE` rows of the pool."""
    sample = min(SAMPLE, len(pool))
    shape = (trees, (1 << (DEPTH + 1)) - 1)
    if not sample:
        return Forest(*(np.zeros((0, shape[1])) for _ in range(3)), 0)

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for t in ids.tolist():
                rng = np.random.default_rng([SEED, t])
                grown = grow(pool[rng.choice(len(pool), sample, replace=False)], rng)
                yield pa.RecordBatch.from_arrays([pa.array([t]), *(pa.array([x.tolist()]) for x in grown)], ["id", "feature", "cut", "path"])
    made = spark.range(trees, numPartitions=min(trees, 16)).mapInArrow(
        run, "id long, feature array<long>, cut array<double>, path array<double>").orderBy("id").toArrow()
    return Forest(*(np.array(made[c].combine_chunks().flatten()).reshape(shape) for c in ("feature", "cut", "path")), sample)


def scored(rows: DataFrame, trees: Forest) -> DataFrame:
    """`rows` with `anomaly`, the forest's score."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, anomaly double"

    def run(batches):
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in COUNTS})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees.scores(x))], names=[*batch.schema.names, "anomaly"])
    return rows.mapInArrow(run, schema)


def threshold_of(good: np.ndarray, bad: np.ndarray, lost: float = LOST, prior: float = PRIOR) -> float:
    """Score above which a document is anomalous, from counts of labelled scores per bin (bin b: about b / BINS)."""
    n = good.sum()
    if not n:
        return prior
    above_good, above_bad = n - np.cumsum(good), bad.sum() - np.cumsum(bad)
    gain = above_bad / max(1, bad.sum()) - above_good / n
    best = int(np.argmax(np.where(above_good <= lost * n, gain, -np.inf)))
    return float((n * (best + 0.5) / BINS + prior / lost) / (n + 1 / lost))


def calibrated(rows: DataFrame, labels: DataFrame) -> float:
    """Threshold from the labelled rows; `BINS` counts of each kind reach the driver at most."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    bin_ = F.floor(F.col("anomaly") * BINS + 0.5).cast("int")
    some = rows.where(~base_failed()).groupBy("doc_id", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    kind = F.when(good, 1).when(F.col("quality") == 0, 0)
    found = some.join(known, "doc_id").groupBy("bin", kind.alias("kind")).agg(F.sum("n").alias("n")).where("kind is not null").toArrow()
    at, kinds, n = (found[c].to_numpy() for c in ("bin", "kind", "n"))
    return threshold_of(*(np.bincount(at[kinds == k], n[kinds == k], BINS + 1) for k in (1, 0)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts of `COUNTS`, base_failed, anomaly, threshold and kept of every row of `docs`."""
    rows = cut_lineage(statistics(docs, ["doc_id"]))
    rows = cut_lineage(scored(rows, forest(docs.sparkSession, pool_of(rows))))
    limit = calibrated(rows, labels)
    return rows.select("doc_id", *COUNTS, base_failed().alias("base_failed"), "anomaly", F.lit(limit).alias("threshold"),
                       (~base_failed() & (F.col("anomaly") <= limit)).alias("kept"))
