"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is as wide as the vectors and held in 64-bit words. Every word is cut into segments of about log2(number of codes)
bits, never fewer, and every segment is an index. After a first round over equal segments, a round probes one segment j
for the entries exactly s bits away, for each unanswered query: s = 1 for one segment after the other, then s = 2, and so
on (few probes are made for all segments at once). After it every code within `segments * s + j` bits has been seen: one not seen is s + 1 or more away in segments 0 to
j and s or more in the others. A query is answered when its kth verified distance lies within that bound. Equal codes
are one index entry that carries its k smallest ids, so copies neither swell an entry nor a result.

A probe carries its query's kth distance so far, and only entries that beat it leave the join.

Defined cases: a row without a vector (null or empty) has no code: it is not found and as a query gets no rows; a vector
narrower than the widest counts as not above zero where it ends; ties in distance go to the smaller id; fewer than k
rows in all give as many; rows that repeat an id count as rows each; an empty table gives no rows; other columns are not
read. A query is a row like any other, and finds itself.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

K = 10
WORD = 64
PROBES = 1 << 21  # made at once


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id and code: bit i of the code's words (array of long) is set if element i is above zero."""
    some = vectors.where("embedding is not null and size(embedding) > 0")
    word = """aggregate(transform(slice(embedding, cast(64 * w + 1 as int), 64), (x, i) -> if(x > 0, shiftleft(1L, i), 0L)),
                        0L, (a, b) -> a | b)"""
    return some.select("vec_id", F.expr(f"transform(sequence(0, (size(embedding) - 1) div {WORD}), w -> {word})").alias("code"))


def segments(n_words: int, n_codes: int) -> list[tuple[int, int, int]]:
    """(word, first bit, width) of every segment."""
    m = max(1, min(16, math.floor(WORD / max(1.0, math.log2(max(n_codes, 2))))))
    cuts = [WORD * i // m for i in range(m + 1)]
    return [(w, a, b - a) for w in range(n_words) for a, b in zip(cuts, cuts[1:])]


def _part(words: list[Column], segment: tuple[int, int, int]) -> Column:
    word, first, width = segment
    part = F.shiftrightunsigned(words[word], first)
    return part if width == WORD else part.bitwiseAND(F.lit((1 << width) - 1))


def _flips(width: int, radius: int) -> list[int]:
    masks = (sum(1 << b for b in c) for c in combinations(range(width), radius))
    return [m - (1 << WORD) if m >> (WORD - 1) else m for m in masks]


def _named(prefix: str, n_words: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(n_words)]


def _keyed(df: DataFrame, names: list[str], parts, only: list[int], prefix: str = "", radius: int = 0) -> DataFrame:
    """One row per segment of `only`, and per flip of `radius` bits in it, with `seg` and `value`."""
    words = [F.col(c) for c in names]
    by = F.explode(F.array(*[F.struct(F.lit(j).alias("seg"), _part(words, parts[j]).alias("value"), F.lit(parts[j][2]).alias("width"))
                             for j in only]))
    out = df.withColumn("by", by).select(*df.columns, F.col("by.seg").alias(f"{prefix}seg"), F.col("by.value").alias(f"{prefix}value"),
                                         F.col("by.width").alias("width"))
    if not radius:
        return out.drop("width")
    masks = F.coalesce(*(F.when(F.col("width") == w, F.expr(f"cast(array({', '.join(map(str, _flips(w, radius)))}) as array<long>)"))
                         for w in sorted({parts[j][2] for j in only})))
    return out.withColumn("mask", F.explode(masks)).withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask", "width")


def _rounds(parts, radius: int, n_open: int) -> list[list[int]]:
    """Segments to probe one after the other; all at once where that makes few probes."""
    able = [j for j, p in enumerate(parts) if p[2] >= radius]
    flips = sum(math.comb(parts[j][2], radius) for j in able)
    return [able] if able and n_open * flips <= PROBES else [[j] for j in able]


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest rows of every query; both tables have vec_id and code."""
    n_words = rows.select("code").union(queries.select("code")).agg(F.max(F.size("code"))).first()[0] or 1
    mine, theirs = _named("q", n_words), _named("w", n_words)

    def worded(df, names, *more):
        return df.select(*more, *(F.coalesce(F.get("code", F.lit(i)), F.lit(0)).cast("long").alias(c) for i, c in enumerate(names)))
    per_code = Window.partitionBy(*theirs).orderBy("vec_id")
    few = worded(rows, theirs, "vec_id").withColumn("nth", F.row_number().over(per_code)).where(F.col("nth") <= k)
    index = cut_lineage(few.groupBy(*theirs).agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))  # k ids at most
    n = index.count()
    asked = cut_lineage(worded(queries, mine).distinct())
    parts, best = segments(n_words, n), None
    every = list(range(len(parts)))
    open_ = asked.withColumns({"kth": F.lit(n_words * WORD + 1), "kth_first": F.lit(None).cast("long")})
    stored = _keyed(index.select(*theirs, F.col("ids")[0].alias("first")), theirs, parts, every, "s_")
    left, n_open = [(0, every)], asked.count()
    while left and n_open:
        radius, only = left.pop(0)
        probes = _keyed(open_, mine, parts, only, radius=radius)
        gaps = [F.col(q).bitwiseXOR(F.col(w)) for q, w in zip(mine, theirs)]
        distance = reduce(lambda a, b: a + b, map(F.bit_count, gaps)).cast("int")
        # Seen in an earlier round, or in this one by an earlier segment: counted once.
        new = F.lit(True)
        for j, d in enumerate(F.bit_count(_part(gaps, p)) for p in parts):
            new = new & F.when(F.col("seg") > j, d > radius).otherwise(d >= radius)
        better = (distance < F.col("kth")) | ((distance == F.col("kth")) & (F.col("first") < F.col("kth_first")))
        equal = (F.col("seg") == F.col("s_seg")) & (F.col("value") == F.col("s_value"))
        # The planner takes flips for a small table, and would broadcast them.
        hits = probes.hint("merge").join(stored, equal & new & better).select(*mine, *theirs, "first", distance.alias("distance"))
        if best is not None:
            hits = hits.unionByName(best.join(open_, mine, "left_semi"))
        nearest = Window.partitionBy(*mine).orderBy("distance", "first")
        now = hits.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k).drop("nth")
        best = cut_lineage(now if best is None else now.unionByName(best.join(open_, mine, "left_anti")))
        seen = len(parts) * radius + only[-1]
        worst = best.groupBy(*mine).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("distance", "first")).alias("last")).where(
            F.col("n") >= min(k, n))
        kept = asked.join(worst, mine, "left").select(
            *mine, F.coalesce(F.col("last.distance"), F.lit(n_words * WORD + 1)).alias("kth"), F.col("last.first").alias("kth_first"))
        open_ = cut_lineage(kept.where(F.col("kth") > seen))
        n_open = open_.count()
        if not left and radius < max(p[2] for p in parts):
            left = [(radius + 1, some) for some in _rounds(parts, radius + 1, n_open)]
    if best is None:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).alias("distance")).limit(0)
    found = best.join(index, theirs).select(*mine, "distance", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy(*mine).orderBy("distance", "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return worded(queries, mine, F.col("vec_id").alias("query_id")).join(found, mine).select("query_id", "rank", "vec_id", "distance")


ORACLE = """
WITH codes AS (
  SELECT vec_id, array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN embedding], '') AS bits FROM embeddings WHERE len(embedding) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id,
    hamming(q.bits, r.bits)::INTEGER AS distance
  FROM codes q JOIN codes r ON q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
WHERE rank <= 10
"""
