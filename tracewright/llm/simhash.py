"""SimHash near-duplicates: 64-bit fingerprints, linked within a radius by BK-trees over shards.

Two fingerprints within `radius` bits agree in full on at least `equal` of `radius + equal` bands, whatever the bits.
So every distinct fingerprint goes to one shard for each choice of `equal` bands, keyed by the bits in them, and a
shard finds its links with a BK-tree: children are keyed by their whole-number Hamming distance to the parent, and a
search follows only edges within the radius of its own distance. `equal` is taken from the number of distinct
fingerprints so that a shard stays small; every layout finds the same links. A shard above `SHARD` fingerprints (a
large group of near copies) is cut into parts, and a tree is built for every pair of parts.

A search also leaves out subtrees that lie wholly in its own component, so a group of near copies costs about one
visit each, and a shard emits one edge per linked fingerprint, to the smallest one of its component, never all pairs.
Components over shards come from joins (`common.components`). Exact copies are one fingerprint throughout.

Defined cases: null and blank texts have fingerprint zero, linked like any other; fewer words than a shingle are one
shingle; repeated rows share fingerprint and component; a component id is the smallest non-null doc_id in it (null if
there is none); texts of any length are read whole; an empty table gives no rows; `near_duplicates` returns its own
columns only, and `one_of_each` those of its input, whatever they are called.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from ..session import cut_lineage
from .common import add_columns, components, quoted, sorted_groups, unused

WORDS = 4
RADIUS = 4
SEED = 42
SHARD = 2048
SHARD_MEAN = 64  # fingerprints wanted per shard
PIECE = 1 << 17  # shingles of a text hashed at a time
MAX_EQUAL = 4


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bits set in more than half of the shingles' XXH64 values."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not tokens:
        return 0
    line = b" ".join(tokens)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    width = min(words, len(tokens))
    starts, ends = (ends - size)[:len(tokens) - width + 1], ends[width - 1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), PIECE):
        a, b = starts[at:at + PIECE].tolist(), ends[at:at + PIECE].tolist()
        h = np.fromiter((digest(line[x:y], SEED) for x, y in zip(a, b)), np.uint64, len(a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None, words: int = WORDS) -> DataFrame:
    """`keep` columns (all if not given) with `fp`, the fingerprint's bits as a signed number."""
    def run(block):
        made = np.fromiter((fingerprint(t, words) for t in block.column("text").to_pylist()), np.uint64, block.num_rows)
        return [pa.array(made.view(np.int64))]
    return add_columns(docs, docs.columns if keep is None else keep, [StructField("fp", LongType())], run)


class Tree:
    """BK-tree over distinct codes that links each new code to those within the radius."""

    def __init__(self, radius: int):
        self.radius = radius
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []  # union-find over nodes
        self.whole: list[int] = []  # a node of the component that the subtree lies in, or -1

    def find(self, v: int) -> int:
        parent = self.parent
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    def add(self, code: int) -> None:
        codes, children, whole, radius = self.codes, self.children, self.whole, self.radius
        me = len(codes)
        codes.append(code)
        children.append({})
        self.parent.append(me)
        whole.append(me)
        if not me:
            return
        mine, todo = me, [0]
        while todo:
            v = todo.pop()
            if whole[v] >= 0 and self.find(whole[v]) == mine:
                continue
            d = (codes[v] ^ code).bit_count()
            if d <= radius:
                other = self.find(v)
                if other != mine:
                    self.parent[mine] = other
                    mine = other
            for edge, child in children[v].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        v = 0
        while True:
            if whole[v] >= 0 and self.find(whole[v]) != mine:
                whole[v] = -1
            d = (codes[v] ^ code).bit_count()
            child = children[v].get(d)
            if child is None:
                children[v][d] = me
                return
            v = child

    def edges(self) -> tuple[list[int], list[int]]:
        """One edge per linked code, to the smallest code of its component."""
        least: dict[int, int] = {}
        roots = [self.find(v) for v in range(len(self.codes))]
        for code, r in zip(self.codes, roots):
            least[r] = min(code, least.get(r, code))
        pairs = [(code, least[r]) for code, r in zip(self.codes, roots) if code != least[r]]
        return [p[0] for p in pairs], [p[1] for p in pairs]


def band_masks(radius: int, equal: int) -> list[int]:
    """Bit masks of every choice of `equal` out of `radius + equal` bands, as signed numbers."""
    bands = radius + equal
    cuts = [64 * i // bands for i in range(bands + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    chosen = (sum(c) for c in combinations(masks, equal))
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def links(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect the distinct `fp` of `codes` exactly as all links within the radius do."""
    n = codes.count()
    equal = 1
    while equal < MAX_EQUAL and n > SHARD_MEAN << (64 * equal // (radius + equal)):
        equal += 1
    masks = band_masks(radius, equal)
    keyed = codes.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("band", "mask")).select(
        "fp", "band", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
    sizes = keyed.groupBy("band", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = keyed.join(sizes, ["band", "bits"]).withColumn("parts", F.ceil(F.col("n") / (SHARD // 2)).cast("int"))
    own = F.pmod(F.hash("fp"), F.col("parts"))
    keyed = keyed.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("n") <= SHARD, F.array(F.col("own") * 0)).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("own")))))
    whole = F.col("n") <= SHARD
    keyed = keyed.select(
        "fp", "band", "bits", F.when(whole, 0).otherwise(F.least("own", "other")).alias("i"),
        F.when(whole, 0).otherwise(F.greatest("own", "other")).alias("j"))
    keys = ["band", "bits", "i", "j"]

    def run(batches):
        for _, cols in sorted_groups(batches, keys):
            if len(cols["fp"]) > 1:
                tree = Tree(radius)
                for code in cols["fp"].view(np.uint64).tolist():
                    tree.add(code)
                a, b = tree.edges()
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])
    return keyed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def groups(rows: DataFrame, first: Column, radius: int = RADIUS) -> DataFrame:
    """(fp, root, first) of every distinct `fp` of `rows`: its component, and the least `first` of its rows."""
    codes = cut_lineage(rows.groupBy("fp").agg(F.min(first).alias("first")))
    linked = cut_lineage(components(links(codes.select("fp"), radius)))
    return codes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = cut_lineage(fingerprints(docs, ["doc_id"], words))
    grouped = groups(rows, F.col("doc_id"), radius)
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` without near copies: of each component one row stays.

    That is the first by doc_id (nulls last), then by a hash of all columns, so null and repeated ids follow the same
    rule as others; of rows that are equal in every column one stays. The groups are found on narrow rows; the texts are
    shuffled once, by that hash, to meet the rows that stay.
    """
    names = unused(docs, "a", "b")
    cells = [F.struct(c.isNull(), c) for c in map(quoted, docs.columns)]
    marked = docs.withColumns({n: F.xxhash64(F.lit(seed), *cells) for seed, n in enumerate(names)})
    rows = cut_lineage(fingerprints(marked, ["doc_id", *names], words))
    grouped = groups(rows, F.struct(F.col("doc_id").isNull(), "doc_id", *(F.col(n) for n in names)), radius)
    first = cut_lineage(grouped.groupBy("root").agg(F.min("first").alias("first")).select(*(f"first.{n}" for n in names)))
    return marked.join(first, names, "left_semi").dropDuplicates(names).select(*map(quoted, docs.columns))
