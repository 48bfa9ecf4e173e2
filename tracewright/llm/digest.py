"""Document fingerprints: quartile bucket digests.

Six kinds of byte triplets from every window of five bytes are hashed to 256 buckets and counted. The digest holds,
for every bucket, the quarter of all buckets that its count lies in (two bits), the logarithm of the length, and the
ratios of the quartiles. Two digests are compared by a bounded difference score, which gives a likeness from 0 to 1.

Defined cases: a null text is the empty text; texts under five bytes have empty buckets and differ by length only;
equal texts have equal digests, and likeness 1. Rows of equal id follow each other by the hash of their text; null ids
come last; with one row the next document is the row itself; which of rows with equal id and text comes first makes no difference.
Texts of any length are read whole, in pieces; an empty table gives no rows; only doc_id and text are read, whatever other
columns there are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import blocks, texts_of

BUCKETS = 256
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
PIECE = 1 << 20
BOUND = 600  # differences from here on mean likeness 0
_TABLES = np.random.default_rng(40).integers(0, 1 << 32, (3, 256), np.uint64).astype(np.uint32)
_KINDS = np.random.default_rng(41).integers(0, 1 << 32, len(TRIPLETS), np.uint64).astype(np.uint32)


def bucket_counts(data: bytes) -> np.ndarray:
    """Triplets per bucket, over all windows of five bytes."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(data) - 4, 0), PIECE):
        codes = np.frombuffer(data[at:at + PIECE + 4], np.uint8)
        m = len(codes) - 4
        first, second, third = (t[codes] for t in _TABLES)
        for (i, j, k), kind in zip(TRIPLETS, _KINDS):
            h = (first[i:i + m] + second[j:j + m] + third[k:k + m] + kind) * np.uint32(0x9E3779B1)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(text: str) -> str:
    """Hexadecimal: one byte of length, one of quartile ratios, and two bits for each bucket."""
    data = text.encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    body = (codes << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    ratios = (15 * q1 // q3) << 4 | (15 * q2 // q3) if q3 else 0
    return bytes([min(255, int(10 * math.log1p(len(data)))), ratios]).hex() + body.tobytes().hex()


def _codes(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 from a difference of `BOUND`: quarters apart (opposite ends count double), length, ratios."""
    if a == b:
        return 1.0
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    apart = np.abs(_codes(x[2:]).astype(np.int8) - _codes(y[2:]).astype(np.int8))
    score = int(apart.sum()) + 3 * int(np.count_nonzero(apart == 3)) + min(abs(x[0] - y[0]), 20)
    score += 2 * (abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15)))
    return 1.0 - min(score, BOUND) / BOUND


def edited(text: str, following: str) -> str:
    """The last floor(n/2) characters replaced by the first as many of `following`."""
    n = len(text) // 2
    return text[:len(text) - n] + following[:n]


ROW = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _result(doc_id, text, own, following, other) -> tuple:
    new = edited(text, following)
    changed = digest(new)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, changed,
            likeness(own, changed), likeness(own, other))


def with_next(docs: DataFrame) -> DataFrame:
    """ROW for every row of `docs`; the next document is the one with the next smaller id, after the last the first.

    One range partitioning by id; tasks stream through their sorted rows. Of every task the first and the last text
    are written with the results, and the pairs that lie across tasks are made from them.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark")]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).repartitionByRange(
        partitions, *order).sortWithinPartitions(*order)

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        for block in blocks(batches):
            rows, edges = [], []
            for doc_id, text in zip(block.column("doc_id").to_pylist(), texts_of(block)):
                own = digest(text)
                if last is None:
                    edges.append((1, doc_id, own, text))
                else:
                    rows.append(_result(*last, text, own))
                last = (doc_id, text, own)
            yield _table(part, rows, edges)
        if last is not None:
            yield _table(part, [], [(2, last[0], last[2], last[1])])

    def _table(part, rows, edges):
        full = [(part, 0, *r, None) for r in rows] + [
            (part, kind, i, None, None, fp, None, None, None, text) for kind, i, fp, text in edges]
        types = [pa.int32(), pa.int32(), *_TYPES, pa.string()]
        columns = list(zip(*full)) if full else [[] for _ in types]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "edge", *ROW, "text"])

    found = cut_lineage(ranged.mapInArrow(run, f"part int, edge int, {_DDL}, text string"))
    firsts, lasts = found.where("edge = 1"), found.where("edge = 2")
    by_part = Window.orderBy("part")  # one row per task, no texts
    parts = firsts.select("part").withColumn("next", F.coalesce(
        F.lead("part").over(by_part), F.first("part").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    across = lasts.select("part", "doc_id", "fingerprint", "text").join(parts, "part").join(
        firsts.select(F.col("part").alias("next"), F.col("text").alias("following"), F.col("fingerprint").alias("other")), "next")

    def pair(batches):
        for batch in batches:
            rows = [_result(r["doc_id"], r["text"] or "", r["fingerprint"], r["following"] or "", r["other"]) for r in batch.to_pylist()]
            columns = list(zip(*rows)) if rows else [[] for _ in ROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], ROW)
    return found.where("edge = 0").select(*ROW).union(across.mapInArrow(pair, _DDL))
