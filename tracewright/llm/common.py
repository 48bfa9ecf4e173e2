"""Helpers that several text operators share: Arrow blocks, sorted groups, components of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ..session import cut_lineage

BLOCK_BYTES = 1 << 20  # text bytes that a task works on at a time; a longer text is a block of its own


def quoted(name: str) -> Column:
    """The column of this very name."""
    return F.col(f"`{name}`")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of the frame's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def doc_hash_remainder(parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the named text column of a piece has about `limit` bytes at most."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(size) // limit
        edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(block: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a block; null is the empty text."""
    return [t or "" for t in block.column(column).to_pylist()]


def add_columns(docs: DataFrame, keep: list[str], fields: list[StructField],
                fn: Callable[[pa.RecordBatch], list], limit: int = BLOCK_BYTES) -> DataFrame:
    """`keep` columns and those that `fn` computes from blocks of rows with `text`.

    A new column takes the place of a kept one of the same name.
    """
    names = {f.name for f in fields}
    keep = [c for c in dict.fromkeys(keep) if c not in names]
    read = docs.select(*map(quoted, dict.fromkeys([*keep, "text"])))
    schema = StructType([*(read.schema[c] for c in keep), *fields])

    def run(batches):
        for block in blocks(batches, limit=limit):
            made = [x if isinstance(x, pa.Array) else pa.array(x) for x in fn(block)]
            yield pa.RecordBatch.from_arrays([*(block.column(c) for c in keep), *made], names=schema.names)
    return read.mapInArrow(run, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Consecutive rows with equal keys (whole numbers, no nulls), joined across batches."""
    held: list[dict[str, np.ndarray]] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            change |= cols[k][1:] != cols[k][:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(cols[k][a].item() for k in keys)
            if current is not None and key != current:
                yield current, {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                held = []
            current = key
            held.append({n: c[a:b] for n, c in cols.items()})
    if held:
        yield current, {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node on an edge (a, b); the root is the smallest node reachable.

    Alternating star contraction: every round points the larger neighbours of a node, then the node itself,
    to its smallest neighbour, until only stars are left. Rounds grow with the logarithm of the longest chain.
    A round ends in a written table; only two numbers per round reach the driver.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, last = cut_lineage(edges), None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == last or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        last = mark
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
            .alias("e")).select("e.a", "e.b")
        edges = cut_lineage(small.where("a != b").distinct())
