"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Trusted are documents labelled good and not toxic. Counts of five-character grams of their text are summed in one
shuffle; lower orders are continuation counts of the order above. Discounts come from the counts of counts, and joins
of the count tables (gram with its history, gram with its suffix) give every seen gram's interpolated probability and
every history's weight for what it has not seen.

A document's log probability is a sum of such table entries. All entries that a place in a text can need share the two
characters before the predicted one, so the model is cut into shards by those two; a shard has a bounded size and is
broadcast, the texts are joined to it in their tasks, and the shards' sums are added by document. (Joining every gram
of every text by a shuffle would move several times the text.)

A document is kept if its perplexity per character is at most the given quantile of that of trusted documents of its
language that were not trained on (of all languages if its own has none; with no trusted documents all are kept).

Defined cases: null and empty texts have no characters, a perplexity of null, and are not kept once there is a
threshold; repeated rows give repeated rows; null is a language of its own; characters beyond the `SYMBOLS` most
frequent ones share a symbol; texts of any length are read whole; equal perplexities share a verdict; an empty table
gives no rows, and one without labels keeps all; only doc_id, text and lang are read, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import blocks, doc_hash_remainder, texts_of

ORDER = 5
BITS = 12
SYMBOLS = (1 << BITS) - 2  # 0 stands before a text, 1 for every other character
SHARD_ROWS = 2_000_000  # grams and histories in a broadcast shard: 32 MB
SMALL_LABELS = 4_000_000  # labels up to so many rows are broadcast, more are joined by key
QUANTILE = 0.995
_LOW = np.uint64((1 << BITS) - 1)


def trusted_ids(labels: DataFrame) -> DataFrame:
    ids = labels.where("quality = 1 and toxic = 0 and doc_id is not null").select("doc_id").distinct()
    return F.broadcast(ids) if ids.count() <= SMALL_LABELS else ids


def alphabet(texts: DataFrame) -> np.ndarray:
    """Symbol of every code point: the most frequent ones of the text have their own (SYMBOLS rows reach the driver)."""
    def run(batches):
        total = np.zeros(0x110000, np.int64)
        for block in blocks(batches):
            for text in texts_of(block):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                found = np.bincount(codes)
                total[:len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])
    counts = texts.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    common = counts.orderBy(F.desc("n"), "code").limit(SYMBOLS).toArrow()["code"].to_numpy()
    symbols = np.ones(0x110000, np.uint16)
    symbols[common] = np.arange(2, len(common) + 2)
    return symbols


def _keys(texts: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The five symbols that end at every character, in one number, and the texts' lengths."""
    pad = "\0" * (ORDER - 1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    line = symbols[codes].astype(np.uint64)
    starts = np.cumsum(sizes + ORDER - 1) - sizes
    line[(starts[:, None] - np.arange(1, ORDER)).ravel()] = 0
    keys = np.zeros(len(line) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        keys = keys << np.uint64(BITS) | line[i:i + len(keys)]
    at = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes - ORDER + 1, sizes)
    return keys[at], sizes


def gram_counts(texts: DataFrame, symbols: np.ndarray) -> DataFrame:
    """(key, c): the grams of the highest order with their counts."""
    shared = texts.sparkSession.sparkContext.broadcast(symbols)

    def run(batches):
        for block in blocks(batches):
            keys, c = np.unique(_keys(texts_of(block), shared.value)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(c.astype(np.int64))], ["key", "c"])
    return texts.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> list[float]:
    """What is taken off counts of one, two, and three or more; half of each where the counts of counts say nothing."""
    row = counts.agg(*[F.count_if(F.col("c") == i) for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (float(x) for x in row)
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(found)]


def model(counts: DataFrame, n_symbols: int) -> tuple[DataFrame, DataFrame, float]:
    """Grams (n, key, logp), histories (n, key, logp: weight of the unseen; n is the order it serves), and log10 of an
    unknown symbol's probability."""
    tables = {ORDER: cut_lineage(counts)}
    for n in range(ORDER - 1, 0, -1):
        suffix = F.col("key").bitwiseAND(F.lit((1 << BITS * n) - 1))
        tables[n] = cut_lineage(tables[n + 1].groupBy(suffix.alias("key")).agg(F.count(F.lit(1)).alias("c")))
    grams, histories, lower, unknown = [], [], None, 0.0
    for n in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(tables[n])
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        table = tables[n].withColumn("history", F.shiftright("key", BITS))
        per = table.groupBy("history").agg(F.sum("c").alias("total"), F.sum(off).alias("off"))
        per = per.select("history", "total", (F.col("off") / F.col("total")).alias("weight"))
        if n == 1:
            first = per.first()
            unknown = float(np.log10((first["weight"] if first else 1.0) / (n_symbols + 2)))
        joined = table.join(per, "history").withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1)))
        below = F.lit(1.0 / (n_symbols + 2))
        if lower is not None:
            joined, below = joined.join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("below")), "suffix"), F.col("below")
        lower = cut_lineage(joined.select("key", ((F.col("c") - off) / F.col("total") + F.col("weight") * below).alias("p")))
        grams.append(lower.select(F.lit(n).alias("n"), "key", F.log10("p").alias("logp")))
        histories.append(per.select(F.lit(n).alias("n"), F.col("history").alias("key"), F.log10("weight").alias("logp")))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(union(parts[1:]))
    return union(grams), union(histories), unknown


def _pair(symbol_from_end: int):
    return F.shiftright("key", BITS * symbol_from_end).bitwiseAND(F.lit((1 << 2 * BITS) - 1))


def shards(grams: DataFrame, histories: DataFrame) -> list[dict]:
    """Broadcast-sized parts: sorted keys and values by order, for grams and histories."""
    found = cut_lineage(grams.select(F.lit(0).alias("kind"), "*", F.when(F.col("n") > 2, _pair(1)).alias("pair")).union(
        histories.select(F.lit(1), "*", F.when(F.col("n") > 2, _pair(0)))))
    n = max(1, -(-found.where("pair is not null").count() // SHARD_ROWS))
    out = []
    for i in range(n):
        rows = found.where(F.col("pair").isNull() | (F.pmod("pair", F.lit(n)) == i)).select("kind", "n", "key", "logp").toArrow()
        kind, order, key, value = (rows[c].to_numpy() for c in ("kind", "n", "key", "logp"))
        part = {"of": (i, n)}
        for k in (0, 1):
            for o in range(1, ORDER + 1):
                own = (kind == k) & (order == o)
                by = np.argsort(key[own])
                part[k, o] = key[own][by].astype(np.uint64), value[own][by]
        out.append(part)
    return out


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    known, values = table
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, values[at]


def log_probabilities(keys: np.ndarray, shard: dict, unknown: float) -> np.ndarray:
    """log10 of each place's probability, 0 for places of other shards."""
    out = np.zeros(len(keys))
    i, n = shard["of"]
    pair = keys >> np.uint64(BITS) & np.uint64((1 << 2 * BITS) - 1)
    left = np.arange(len(keys)) if n == 1 else np.flatnonzero(pair % np.uint64(n) == i)
    for order in range(ORDER, 0, -1):
        now = keys[left] & np.uint64((1 << BITS * order) - 1)
        hit, value = _find(shard[0, order], now)
        out[left[hit]] += value[hit]
        left, now = left[~hit], now[~hit]
        if not len(left):
            return out
        if order > 1:
            seen, weight = _find(shard[1, order], now >> np.uint64(BITS))
            out[left] += np.where(seen, weight, 0.0)
    out[left] += unknown
    return out


def perplexities(docs: DataFrame, symbols: np.ndarray, parts: list[dict], unknown: float) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity of every row of `docs`, written once."""
    read, sc = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("mark")), docs.sparkSession.sparkContext
    known = sc.broadcast(symbols)

    def scored(part):
        shared = sc.broadcast(part)

        def run(batches):
            for block in blocks(batches):
                keys, sizes = _keys(texts_of(block), known.value)
                ends = np.cumsum(sizes)
                logp = np.concatenate([[0.0], np.cumsum(log_probabilities(keys, shared.value, unknown))])
                total = np.round((logp[ends] - logp[ends - sizes]) * 1e6).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), block.column("lang"), block.column("mark"), pa.array(total), pa.array(sizes)],
                    ["doc_id", "lang", "mark", "logp", "n"])
        return read.mapInArrow(run, "doc_id long, lang string, mark long, logp long, n long")
    sums = scored(parts[0])
    for part in parts[1:]:
        sums = sums.union(scored(part))
    rows = sums.groupBy("doc_id", "lang", "mark").agg(
        F.sum("logp").alias("logp"), F.max("n").alias("n"), F.count(F.lit(1)).alias("times"), F.sum("n").alias("all_n"))
    # `times` rows of each shard for repeated rows: sums of the shards over sums of their lengths are the same for one.
    ratio = F.col("logp") / 1e6 * len(parts) / F.col("all_n")
    return cut_lineage(rows.withColumn("again", F.explode(F.array_repeat(F.lit(1), (F.col("times") / len(parts)).cast("int")))).select(
        "doc_id", "lang", F.col("n").alias("n_symbols"), F.when(F.col("n") > 0, F.pow(F.lit(10.0), -ratio)).alias("perplexity")))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold and keep of every row of `docs`."""
    trusted = trusted_ids(labels)
    held = doc_hash_remainder(5) == 1
    good = docs.select("doc_id", "text").join(trusted, "doc_id", "left_semi").where(~held).select("text")
    symbols = alphabet(good)
    grams, histories, unknown = model(gram_counts(good, symbols), int(symbols.max()) - 1)
    rows = perplexities(docs, symbols, shards(grams, histories), unknown)
    sample = rows.join(trusted, "doc_id", "left_semi").where(held & F.col("perplexity").isNotNull())
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    per = sample.groupBy(F.col("lang").alias("of")).agg(limit.alias("own"))
    overall = sample.agg(limit.alias("any_lang")).first()["any_lang"]
    found = rows.join(F.broadcast(per) if per.count() <= 10_000 else per, F.col("lang").eqNullSafe(F.col("of")), "left")
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    keep = F.when(threshold.isNull(), True).otherwise(F.coalesce(F.col("perplexity") <= threshold, F.lit(False)))
    return found.select("doc_id", "lang", "n_symbols", "perplexity", threshold.alias("threshold"), keep.alias("keep"))
