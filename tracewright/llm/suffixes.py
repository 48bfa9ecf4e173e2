"""Removal of repeated byte strings with sorted suffixes.

A byte goes if a string of `length` bytes over it also starts earlier (in a row before, or earlier in the same text).
Rows are ordered by doc_id, then by a hash of the text; `numbered` writes them once, each with its own number in that
order, and all steps know a row by its number. Sorting a suffix for every byte would shuffle a hundred times the text, so the array is a sparse one: of
the 24-byte grams in a window of `length` bytes the one with the least hash is the window's anchor. Windows with equal
bytes have equal anchors at equal places, so nothing is lost, and about one suffix in forty is left.

1. Each anchor's suffix goes through a range partitioning by its leading bytes: two of them, then a fingerprint of the
   gram, then the hash of the bytes that its windows cover. Spark samples the splitters; id and place are the last part
   of the key, so a passage that is in a third of all documents is spread over many tasks. Buckets are sorted locally,
   and neighbours compared. A suffix that covers the same bytes as the one before it repeats it in all its windows. One
   that shares the anchor but not all bytes, and every suffix at the edge of a bucket, goes to step 2.
2. The covered bytes of those are gathered by anchor, and equal windows found among them by 128 bits of their bytes. An
   anchor with more than `HOT` different surroundings does not go to one task: its windows are range-partitioned like
   the suffixes, and compared with neighbours and across the edges of buckets.
3. The repeated windows of a document are laid over its bytes. Texts are shuffled compressed.

Whole texts are read; windows never reach over documents. Spark's local sort stands where a multikey quicksort would:
the key's columns (leading bytes with the gram, covered bytes, place) are compared one after the other.

Defined cases: a null text is empty; a text shorter than `length` bytes loses nothing; a null doc_id counts as the
smallest; every row is a document of its own, whether its doc_id is null, repeated or neither (of repeated rows one is
first, and the others are copies of it); an empty table gives no rows; new columns take the place of input columns of
their names, and no other column is touched, whatever it is called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ..session import cut_lineage
from .common import blocks, quoted

LENGTH = 100
GRAM = 24
BLOCK = 1 << 19
HOT = 2_000  # contexts of one anchor that a task may get
ROWS = 256  # texts unpacked at a time
_BYTES = np.random.default_rng(20).integers(1, 1 << 64, (2, 256), np.uint64, endpoint=False) | np.uint64(1)
_FACTORS = np.random.default_rng(21).integers(1, 1 << 64, (2, 64), np.uint64, endpoint=False) | np.uint64(1)


def rolling(data: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """A 64-bit hash of every `width` bytes, put together from hashes of 1, 2, 4, ... bytes."""
    part, size, out, done, bit = _BYTES[family][data], 1, None, 0, 0
    while True:
        if width & size:
            if out is None:
                out, done = part, size
            else:
                m = len(data) - done - size + 1
                out, done = out[:m] * _FACTORS[family][bit + 32] + part[done:done + m], done + size
        if size * 2 > width:
            break
        m = len(part) - size
        part = part[:m] * _FACTORS[family][bit] + part[size:size + m]
        part = part ^ (part >> np.uint64(31))
        size, bit = size * 2, bit + 1
    out = out * _FACTORS[family][63]
    return out ^ (out >> np.uint64(32))


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every `width` consecutive hashes (by their upper half; the first on a tie)."""
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    size, out, done = 1, None, 0
    while True:
        if width & size:
            m = len(h) - done - size + 1
            out = key if out is None else np.minimum(out[:m], key[done:done + m])
            done += size
        if size * 2 > width:
            break
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return (out & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _anchor_rows(ids: list[int], raw: list[bytes], length: int, gram: int):
    data, bounds = b"".join(raw), np.cumsum([0, *map(len, raw)])
    if len(data) < length:
        return None
    codes = np.frombuffer(data, np.uint8)
    h = rolling(codes, gram)
    place = least_places(h, length - gram + 1)
    left = np.maximum(np.diff(bounds) - length + 1, 0)  # windows of each document
    doc = np.repeat(np.arange(len(left)), left)
    if not len(doc):
        return None
    start = np.arange(len(doc)) - np.repeat(np.cumsum(left) - left, left) + bounds[doc]
    at = place[start]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(first, len(at)))
    s, at, doc = start[first], at[first], doc[first]
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    covered = np.fromiter((digest(view[a:b]) for a, b in zip(s.tolist(), (s + n - 1 + length).tolist())), np.uint64, len(s))
    key = codes[at].astype(np.uint64) << np.uint64(56) | codes[at + 1].astype(np.uint64) << np.uint64(48) | h[at] >> np.uint64(16)
    key ^= np.uint64(1 << 63)  # the order of signed numbers is then that of the bytes
    return [key.view(np.int64), covered.view(np.int64), np.array(ids, np.int64)[doc], (s - bounds[doc]).astype(np.int32),
            n.astype(np.int32)]


PLACES = ["key", "covered", "id", "s", "n"]


def anchors(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per anchor of the numbered `rows`: keys, row, first window and number of windows."""
    def pieces(batches):
        unpack, ids, raw, size = zstandard.ZstdDecompressor().decompress, [], [], 0
        for batch in batches:
            for i, zipped in zip(batch.column("_id").to_pylist(), batch.column("_zip")):
                if zipped.is_valid:
                    ids.append(i)
                    raw.append(unpack(zipped.as_py()))
                    size += len(raw[-1])
                if size >= BLOCK:
                    yield ids, raw
                    ids, raw, size = [], [], 0
        yield ids, raw

    def run(batches):
        for ids, raw in pieces(batches):
            found = _anchor_rows(ids, raw, length, gram)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(r) for r in found], PLACES)
    return rows.select("_id", "_zip").mapInArrow(run, "key long, covered long, id long, s int, n int")


def _sorted_rows(rows: DataFrame, *keys: str) -> DataFrame:
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)


def _columns(batches, names):
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(n).to_numpy() for n in names]


def compared(rows: DataFrame) -> DataFrame:
    """(key, id, s, n, repeats): rows that repeat all windows of an earlier one, and those to be compared by window."""
    names = ["key", "id", "s", "n", "repeats"]

    def run(batches):
        pending: list[np.ndarray] | None = None  # the first row of the last run, until the next run's key is known
        last = None
        for cols in _columns(batches, PLACES):
            key, covered, ids, s, n = cols
            if last is None:
                key_same, same, new_place = True, False, True  # what comes before the bucket is not known
            else:
                key_same = key[0] == last[0]
                same = key_same and covered[0] == last[1]
                new_place = not (same and ids[0] == last[2] and s[0] == last[3])
            g = np.concatenate([[key_same], key[1:] == key[:-1]])
            e = np.concatenate([[same], g[1:] & (covered[1:] == covered[:-1])])
            p = np.concatenate([[new_place], ~(e[1:] & (ids[1:] == ids[:-1]) & (s[1:] == s[:-1]))])
            last = [c[-1] for c in cols]
            repeat, heads = np.flatnonzero(e & p), np.flatnonzero(~e)
            out, flags = [[c[repeat] for c in (key, ids, s, n)]], [np.ones(len(repeat), bool)]
            if len(heads):
                if pending is not None and (pending[4] or g[heads[0]]):
                    out.append(pending[:4])
                    flags.append(np.zeros(1, bool))
                inner = heads[:-1][g[heads[:-1]] | g[heads[1:]]]
                out.append([c[inner] for c in (key, ids, s, n)])
                flags.append(np.zeros(len(inner), bool))
                k = heads[-1]
                pending = [*(c[k:k + 1] for c in (key, ids, s, n)), bool(g[k])]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in zip(*out)), pa.array(np.concatenate(flags))], names)
        if pending is not None:  # its run may go on in the next bucket
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in pending[:4]), pa.array([False])], names)
    return _sorted_rows(rows, *PLACES[:4]).mapInArrow(run, "key long, id long, s int, n int, repeats boolean")


def packed(docs: DataFrame) -> DataFrame:
    """The rows with `_zip`, the compressed bytes, in place of `text`."""
    schema = StructType([*(f for f in docs.schema if f.name != "text"), StructField("_zip", BinaryType())])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for block in blocks(batches):
            zipped = [None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(block.column(c) for c in schema.names[:-1]), pa.array(zipped, pa.binary())], names=schema.names)
    return docs.mapInArrow(run, schema)


def numbered(docs: DataFrame) -> DataFrame:
    """The packed rows, written once, with `_id`: every row's own number, in the order of doc_id and the text's hash.

    The row's place in the input is the last part of the range key, so that any number of equal rows is spread.
    """
    read = packed(docs.withColumn("_hash", F.xxhash64("text")).withColumn("_at", F.monotonically_increasing_id()))
    order = [F.asc_nulls_first("doc_id"), F.col("_hash"), F.col("_at")]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = read.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return cut_lineage(rows.withColumn("_id", F.monotonically_increasing_id()).drop("_hash", "_at"))


def contexts(packs: DataFrame, rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, id, s, bytes): what the windows of `rows` cover, read from the numbered `packs`."""
    wanted = rows.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("key", "s", "n")).alias("_spans"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i, zipped, spans in zip(batch.column("_id").to_pylist(), batch.column("_zip").to_pylist(), batch.column("_spans")):
                data = unpack(zipped) if zipped else b""
                keys, s, n = (spans.values.field(f).to_numpy() for f in ("key", "s", "n"))
                inside = s + length <= len(data)
                keys, s, n = keys[inside], s[inside], n[inside]
                cut_ = [data[a:a + m - 1 + length] for a, m in zip(s.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(s), i)), pa.array(s), pa.array(cut_, pa.binary())],
                                                 ["key", "id", "s", "bytes"])
    return packs.join(wanted, "_id").select("_id", "_zip", "_spans").mapInArrow(
        run, "key long, id long, s int, bytes binary")


def _hashed(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every window of the parts, the part it is in, and its place there."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    left = sizes - length + 1
    part = np.repeat(np.arange(len(parts)), left)
    place = np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
    at = place + np.repeat(np.cumsum(sizes) - sizes, left)
    return rolling(data, length, 0)[at].view(np.int64), rolling(data, length, 1)[at].view(np.int64), part, place


def repeats_by_anchor(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, s, n) of windows that repeat an earlier one of the same anchor; anchors are worked on many at a time."""
    def some(keys, ids, s, parts):
        keys, ids, s = np.array(keys), np.array(ids), np.array(s)
        other = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]) | (s[1:] != s[:-1])]))
        ids, s, parts = ids[other], s[other], [parts[i] for i in other.tolist()]
        a, b, part, place = _hashed(parts, length)
        order = np.lexsort((b, a))  # stable: of equal windows the earliest comes first
        a, b = a[order], b[order]
        again = np.zeros(len(a), bool)
        again[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        at = np.flatnonzero(again)
        first = np.concatenate([[True], (np.diff(at) > 1) | (part[at[1:]] != part[at[:-1]])])[:len(at)]
        heads = np.flatnonzero(first)
        n = np.diff(np.append(heads, len(at)))
        at = at[heads]
        return pa.RecordBatch.from_arrays([pa.array(ids[part[at]]), pa.array((s[part[at]] + place[at]).astype(np.int32)), pa.array(n.astype(np.int32))],
                                          ["id", "s", "n"])

    def run(batches):
        held, size = [[], [], [], []], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BLOCK and row[0] != held[0][-1]:
                    yield some(*held)
                    held, size = [[], [], [], []], 0
                for column, value in zip(held, row):
                    column.append(value)
                size += len(row[3])
        if held[0]:
            yield some(*held)
    order = ["key", "id", "s"]
    return found.select(*order, "bytes").repartition("key").sortWithinPartitions(*order).mapInArrow(run, "id long, s int, n int")


def windows(found: DataFrame, length: int = LENGTH) -> DataFrame:
    """(a, b, id, s): two hashes of the bytes of every window."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b, part, place = _hashed(batch.column("bytes").to_pylist(), length)
                ids, s = batch.column("id").to_numpy(), batch.column("s").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ids[part]), pa.array((s[part] + place).astype(np.int32))],
                                                 ["a", "b", "id", "s"])
    return found.select("id", "s", "bytes").mapInArrow(run, "a long, b long, id long, s int")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(id, s, n = 1) of windows whose bytes also start earlier."""
    names = ["a", "b", "id", "s"]

    def run(batches):
        part, last, first = TaskContext.get().partitionId(), None, None
        for a, b, ids, s in _columns(batches, names):
            if last is None:
                first, e, p = [a[0], b[0], ids[0], s[0]], np.array([False]), np.array([True])
            else:
                e = np.array([a[0] == last[0] and b[0] == last[1]])
                p = np.array([ids[0] != last[2] or s[0] != last[3]])
            e = np.concatenate([e, (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
            p = np.concatenate([p, (ids[1:] != ids[:-1]) | (s[1:] != s[:-1])])
            last = [a[-1], b[-1], ids[-1], s[-1]]
            k = np.flatnonzero(e & p)
            yield _marked(part, 0, a[k], b[k], ids[k], s[k])
        if last is not None:
            yield _marked(part, 1, *([x] for x in first))
            yield _marked(part, 2, *([x] for x in last))
    schema = "part int, edge int, a long, b long, id long, s int"
    found = cut_lineage(_sorted_rows(rows, *names).mapInArrow(run, schema))
    # Two rows per bucket: the first row of a bucket repeats the last one of the bucket before if the bytes are equal.
    order = Window.orderBy("part", "edge")
    before = [F.lag(c).over(order).alias(f"last_{c}") for c in names]
    edges = found.where("edge > 0").select("*", *before).where(
        "edge = 1 and a = last_a and b = last_b and not (id = last_id and s = last_s)")
    return found.where("edge = 0").select("id", "s").union(edges.select("id", "s")).withColumn("n", F.lit(1))


def _marked(part, edge, a, b, ids, s):
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, edge, np.int32)), *(pa.array(x, pa.int64()) for x in (a, b, ids)),
         pa.array(s, pa.int32())], ["part", "edge", "a", "b", "id", "s"])


def repeated(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, s, n): runs of window starts whose bytes start earlier; id is the number of one of the numbered `rows`."""
    found = cut_lineage(compared(anchors(rows, length)))
    unsure = found.where("not repeats")
    hot = cut_lineage(unsure.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("key"))
    covered = cut_lineage(contexts(rows, unsure, length))
    by_anchor = repeats_by_anchor(covered.join(hot, "key", "left_anti"), length)
    by_window = repeated_windows(windows(covered.join(hot, "key", "left_semi"), length))
    return found.where("repeats").select("id", "s", "n").union(by_anchor).union(by_window)


def cut(docs: DataFrame, keep: list[str] | None = None, length: int = LENGTH) -> DataFrame:
    """`keep` columns (all if not given) with n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    A cut can split a character; the text leaves out what is left of it, the digest is that of all bytes left.
    """
    keep = docs.columns if keep is None else keep
    fields = [*(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
              StructField("kept_sha256", StringType()), StructField("kept_text", StringType())]
    names = {f.name for f in fields}
    keep = [c for c in dict.fromkeys(keep) if c not in names]
    # Kept columns travel under names that no step uses.
    aliases = {c: "text" if c == "text" else f"kept{i}" for i, c in enumerate(keep)}
    read = docs.select("doc_id", "text", *(quoted(c).alias(a) for c, a in aliases.items() if c != "text"))
    rows = numbered(read)
    spans = repeated(rows, length).groupBy(F.col("id").alias("_id")).agg(
        F.collect_list(F.shiftleft(F.col("s").cast("long"), 32) + F.col("n")).alias("_spans"))
    schema = StructType([*(read.schema[a] for a in aliases.values()), *fields])

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                yield piece(batch.slice(i, ROWS), unpack)

    def piece(batch, unpack):
        texts, out = [], [[], [], [], [], []]
        for zipped, spans in zip(batch.column("_zip").to_pylist(), batch.column("_spans")):
            data = unpack(zipped) if zipped else b""
            texts.append(None if zipped is None else data.decode("utf-8", "surrogatepass"))
            left, runs = data, 0
            if spans.is_valid:
                at = spans.values.to_numpy()
                s, n = at >> 32, at & 0xFFFFFFFF
                s, e = np.minimum(s, len(data)), np.minimum(s + n - 1 + length, len(data))
                depth = np.cumsum(np.bincount(s, minlength=len(data) + 1) - np.bincount(e, minlength=len(data) + 1))[:-1]
                gone = depth > 0
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                left = np.frombuffer(data, np.uint8)[~gone].tobytes()
            for column, value in zip(out, (len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest(),
                                           left.decode("utf-8", "ignore"))):
                column.append(value)
        made = [*(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.string()) for c in out[3:])]
        kept = [pa.array(texts, pa.string()) if a == "text" else batch.column(a) for a in aliases.values()]
        return pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)
    columns = [a for a in aliases.values() if a != "text"]
    found = rows.join(spans, "_id", "left").select(*columns, "_zip", "_spans").mapInArrow(run, schema)
    return found.select(*(F.col(a).alias(c) for c, a in aliases.items()), *(f.name for f in fields))
