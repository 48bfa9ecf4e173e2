"""Ranked lexical search: exact best documents of every item, by norm buckets of impact vectors.

A document's vector holds, for each term that any item has, its impact on a score: a whole number from the term's weight,
its count in the document and the document's length. An item's score is the inner product with its own term counts.

Vectors are ordered by length (norm), longest first, with a range partitioning, and searched in rounds of `GROWTH` times
as many each. A round knows every item's k-th score so far. By Cauchy and Schwarz no vector of a bucket can reach it if
the item's norm times the bucket's largest norm does not; a search ends when that holds for all that is left. Inside a
bucket of `BUCKET` vectors an item's `FOCUS` weightiest terms are looked up first: their part of the product, and the norms
of what is left on both sides, bound the score from above. Documents whose bound reaches the k-th score are scored exactly,
in whole numbers. A task keeps k documents per item, so what is shuffled is k rows per item and task.

Items are searched in blocks of about `BLOCK_TERMS` terms, so what is broadcast is bounded however many items there are:
a block's terms and weights, its items' terms, and their k-th scores.

Defined cases: a null text has no terms, nor has one of marks and blanks only: it is not counted and not found, and as an
item finds nothing; repeated documents are found each; repeated items are answered each; equal scores go by ascending
doc_id, null last; texts of any length are read whole; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import blocks

K = 10
BUCKET = 2048  # vectors of a bucket
FOCUS = 8  # terms of an item whose part of the product is known before the others
HEAD = 1 << 14  # vectors of the first round
GROWTH = 8
BLOCK_TERMS = 1 << 17  # different terms per item, summed over the items of a block
SLACK = 1 + 1e-9  # bounds are doubles
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal stretches of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def item_terms(items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """(item, item_id, term, times): one row per different term of every row of `items`, which has the number `item`."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches):
        for block in blocks(batches):
            rows, terms, times = [], [], []
            for i, text in enumerate(block.column("text").to_pylist()):
                for term, n in Counter(terms_of(text)).items():
                    rows.append(i)
                    terms.append(term)
                    times.append(n)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([block.column("item").take(at), block.column("item_id").take(at),
                                              pa.array(terms, pa.binary()), pa.array(times, pa.int64())], ["item", "item_id", "term", "times"])
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), "text")
    return numbered.mapInArrow(run, f"item long, item_id {kind}, term binary, times long")


class Items:
    """A block of items: their term numbers and counts as one sparse matrix, and the numbers of all their terms."""

    def __init__(self, table: pa.Table):
        item, term, self.times = (table[c].combine_chunks() for c in ("item", "term", "times"))
        self.times = self.times.to_numpy()
        codes = term.dictionary_encode()
        self.number = {t: i for i, t in enumerate(codes.dictionary.to_pylist())}
        self.ids, rows = np.unique(item.to_numpy(), return_inverse=True)
        order = np.argsort(rows, kind="stable")
        self.term, self.times = codes.indices.to_numpy()[order].astype(np.int64), self.times[order]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(self.ids)))])
        self.weight = np.zeros(len(self.number), np.int64)

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        self.weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        self.norm = np.sqrt(np.add.reduceat(self.times.astype(np.float64) ** 2, self.ends[:-1])) if len(self.ids) else np.zeros(0)
        for a, b in zip(self.ends, self.ends[1:]):  # weightiest first
            order = a + np.argsort(-self.weight[self.term[a:b]] * self.times[a:b], kind="stable")
            self.term[a:b], self.times[a:b] = self.term[order], self.times[order]


def vectors(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of every document with a term: its length, and the counts of its numbered terms."""
    def run(batches):
        get = number.get
        for block in blocks(batches):
            size, ids, tf, ends, rows = [], [], [], [0], []
            for i, text in enumerate(block.column("text").to_pylist()):
                found = terms_of(text)
                if found:
                    known = Counter(map(get, found))
                    known.pop(None, None)
                    rows.append(i)
                    size.append(len(found))
                    ids.extend(known.keys())
                    tf.extend(known.values())
                    ends.append(len(ids))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, tf)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(size, pa.int64()), *lists],
                                             ["doc_id", "n", "terms", "tf"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n long, terms array<int>, tf array<int>")


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Whole-number impact of terms of the given weights and counts in documents of the given lengths."""
    m = 25 + 75 * n * n_docs // n_terms
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of each entry of the batch's vectors."""
    terms, tf = batch.column("terms"), batch.column("tf")
    row = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
    return row, terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64)


def by_norm(rows: DataFrame, items: Items, n_docs: int, n_terms: int) -> DataFrame:
    """`rows` with `norm`, written in its order, longest first; rows of norm 0 can't score and go.

    The row's place is part of the key, so copies of one document are spread over many tasks.
    """
    weight = items.weight

    def run(batches):
        for batch in batches:
            row, term, tf = flat(batch)
            p = impacts(weight[term], tf, batch.column("n").to_numpy()[row], n_docs, n_terms).astype(np.float64)
            norm = np.sqrt(np.bincount(row, p * p, minlength=batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm)], names=[*batch.schema.names, "norm"])
    made = rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>, norm double").where("norm > 0")
    order = [F.desc("norm"), F.asc("doc_id"), F.col("place")]
    spread = made.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(spread.drop("place"))


class Best:
    """The k best documents of each item of a block that a task has seen."""

    def __init__(self, items: Items, kth: np.ndarray, k: int):
        self.items, self.kth, self.k = items, kth.astype(np.int64), k
        self.held: dict[int, list[np.ndarray]] = {}

    def add(self, q: int, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        new = [score, none, ids]
        if q in self.held:
            new = [np.concatenate(x) for x in zip(self.held[q], new)]
        order = np.lexsort((new[2], new[1], -new[0]))[:self.k]
        self.held[q] = new = [x[order] for x in new]
        if len(order) == self.k:
            self.kth[q] = max(self.kth[q], new[0][-1])

    def bucket(self, batch: pa.RecordBatch, n_docs: int, n_terms: int) -> None:
        items = self.items
        norm = batch.column("norm").to_numpy()
        asked = np.flatnonzero(items.norm * norm.max() * SLACK >= self.kth)  # Cauchy and Schwarz
        if not len(asked):
            return
        row, term, tf = flat(batch)
        p = impacts(items.weight[term], tf, batch.column("n").to_numpy()[row], n_docs, n_terms)
        order = np.argsort(term, kind="stable")
        row, term, p = row[order], term[order], p[order]
        ids = batch.column("doc_id")
        none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        all_first, all_last = (np.searchsorted(term, items.term, side) for side in ("left", "right"))
        square, whole = norm * norm, p.astype(np.float64)
        for q in asked.tolist():
            a, b = items.ends[q], items.ends[q + 1]
            first, last, times = all_first[a:b], all_last[a:b], items.times[a:b]
            focus = min(FOCUS, b - a)
            at, t = _entries(first[:focus], last[:focus], times[:focus])
            known = np.bincount(row[at], whole[at] * t, minlength=len(norm))
            left = np.sqrt(np.maximum(square - np.bincount(row[at], whole[at] ** 2, minlength=len(norm)), 0))
            rest = float(np.sqrt((times[focus:].astype(np.float64) ** 2).sum()))
            likely = (known + rest * left) * SLACK >= max(self.kth[q], 1)
            if not likely.any():
                continue
            at, t = _entries(first, last, times)
            keep = likely[row[at]]
            at, t = at[keep], t[keep]
            score = np.zeros(len(norm), np.int64)
            np.add.at(score, row[at], p[at] * t)
            good = np.flatnonzero(likely & (score >= max(self.kth[q], 1)))
            if len(good):
                self.add(q, score[good], none[good], ids[good])


def _entries(first: np.ndarray, last: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places first to last of each term, one after the other, with the term's count in the item."""
    size = last - first
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size), np.repeat(times, size)


def searched(rows: DataFrame, items: Items, kth: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): in each task the k best documents of an item that reach its k-th score so far."""
    def run(batches):
        best = Best(items, kth, k)
        for batch in batches:
            for a in range(0, batch.num_rows, BUCKET):
                best.bucket(batch.slice(a, BUCKET), n_docs, n_terms)
        for q, (score, none, ids) in best.held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), items.ids[q])), pa.array(ids, mask=none), pa.array(score)],
                                             ["item", "doc_id", "score"])
    return rows.mapInArrow(run, "item long, doc_id long, score long")


def search_block(docs: DataFrame, items: Items, k: int = K) -> DataFrame:
    """(item, doc_id, score, rank) of one block of items."""
    rows = cut_lineage(vectors(docs, items.number))
    n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counts = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(items.number), np.int64)
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    items.weigh(n_docs, df)
    ordered = by_norm(rows, items, n_docs, n_terms)
    n = ordered.count()
    parts, seen = [], HEAD
    while seen < n:
        parts.append(1 - seen / n)
        seen *= GROWTH
    cuts = ordered.agg(F.percentile_approx("norm", parts, 10_000)).first()[0] if parts else []
    kth, best, above = np.zeros(len(items.ids), np.int64), None, None
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for low in [*cuts, 0.0]:
        part = ordered.where(F.col("norm") > low)
        if above is not None:
            if not (items.norm * above * SLACK >= np.maximum(kth, 1)).any():
                break
            part = part.where(F.col("norm") <= above)
        found = searched(part, items, kth, n_docs, n_terms, k)
        found = found if best is None else found.unionByName(best)
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = cut_lineage(found.select("item", "doc_id", "score"))
        last = best.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).toArrow()
        kth[np.searchsorted(items.ids, last["item"].to_numpy())] = last["kth"].to_numpy()
        above = low
    return best.withColumn("rank", F.row_number().over(order))


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents (doc_id, text) of every row of `items` (item_id, text)."""
    asked = cut_lineage(item_terms(items))
    n_blocks = max(1, -(-asked.count() // block_terms))
    found = None
    for i in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == i)
        part = search_block(docs, Items(mine.select("item", "term", "times").toArrow()), k)
        found = part if found is None else found.unionByName(part)
    names = asked.groupBy("item").agg(F.first("item_id").alias("item_id"))
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS row, terms FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents)
  WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS terms FROM docs),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term),
asked AS (
  SELECT item, item_id, unnest(terms) AS term FROM (
    SELECT item_id, row_number() OVER () AS item,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark)),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term) CROSS JOIN totals),
sized AS (SELECT row, doc_id, 25 + (75 * len(d.terms) * t.docs) // t.terms AS m FROM docs d CROSS JOIN totals t),
scores AS (
  SELECT item, item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sized USING (row)
  GROUP BY item, item_id, doc_id, row)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
