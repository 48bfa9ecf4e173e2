"""Mixing sources to target weights: hash-threshold histograms, DataFrame functions only.

Every document has a size (words) and a hash. A source takes whole copies of everything plus the documents whose hash
lies below the source's threshold. The threshold is found without sorting: sizes are summed by source and leading hash
bits, the bucket in which the budget ends is found from running sums over at most 4,096 buckets, and only that bucket
is split by the next bits. After five levels a bucket is one hash value; it is taken if that brings the source nearer
to its target. So thresholds are nested: a larger budget takes a superset.

Defined cases: a null text has size 0; null is a source of its own, after all others; rows with equal id and text have
equal hashes and are taken or left together; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import quoted, unused

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEAT = 2
HASH_BITS, LEVEL_BITS = 60, 12
SMALL_SOURCES = 50_000  # per-source tables up to so many rows are broadcast, larger ones joined by key


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """60 bits of an md5 of id and text, the same in every engine."""
    own = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(own), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash of every row, written once: the texts are not read again."""
    return cut_lineage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"),
                                   hash_of(F.col("doc_id"), F.col("text")).alias("h")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """source, source_size, target per source: shares of `share` times all words by weight, at most `repeat` times the
    source; what a full source cannot take is shared by the others by weight.

    The level to which sources fill up follows from running sums over sources ordered by how soon they are full. The
    windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                           (F.row_number().over(by_name) - 1) % len(weights) + 1))
    full = F.lit(float(repeat)) * F.col("source_size")
    soonest = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("full_at", full / F.col("w")).withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
    level = (F.col("budget") - F.coalesce(F.sum(full).over(soonest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
             ) / F.sum("w").over(soonest.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level)
    reached = F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")),
                       F.when(F.col("level") <= F.col("full_at"), F.col("full_at"))).over(everything)
    return per.select("source", "source_size",
                      F.least(F.col("w") * F.coalesce(reached, F.lit(0.0)), full).alias("target"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_SOURCES else df


def plan(sizes: DataFrame, **shares) -> tuple[DataFrame, int]:
    """Per source: source_size, target, whole copies, and `below`: hashes under it are taken once more."""
    goal = cut_lineage(targets(sizes, **shares))
    rows = goal.count()
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    at = goal.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for left in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = sizes.join(_small(at, rows), sizes["source"].eqNullSafe(at["s"])
                            & (F.shiftright(sizes["h"], left + LEVEL_BITS) == at["prefix"]))
        buckets = inside.groupBy("s", "rest", "before", F.shiftright("h", left).alias("bucket")).agg(F.sum("size").alias("n"))
        running = Window.partitionBy("s").orderBy("bucket")
        buckets = buckets.withColumn("after", F.col("before") + F.sum("n").over(running))
        edge = buckets.where(F.col("after") > F.col("rest")).groupBy("s").agg(
            F.min_by(F.struct("bucket", "after", "n", "rest"), "bucket").alias("e"))
        at = edge.select("s", F.col("e.rest").alias("rest"), F.col("e.bucket").alias("prefix"),
                         (F.col("e.after") - F.col("e.n")).alias("before"), F.col("e.n").alias("n"))
        if left:
            at = at.drop("n")
    nearer = 2 * F.col("before") + F.col("n") <= 2 * F.col("rest")
    found = at.select("s", (F.col("prefix") + nearer.cast("long")).alias("below"))
    # A source without an edge (no words) takes its rows' nothing whatever the threshold is.
    return cut_lineage(goal.join(found, goal["source"].eqNullSafe(found["s"]), "left").select(
        "source", "source_size", "target", "copies", F.coalesce("below", F.lit(0)).alias("below"))), rows


def mixed(sizes: DataFrame, **shares) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of `sized` documents."""
    goal, rows = plan(sizes, **shares)
    goal = goal.withColumnRenamed("source", "s")
    times = F.col("copies") + (F.col("h") < F.col("below")).cast("long")
    return sizes.join(_small(goal, rows), sizes["source"].eqNullSafe(goal["s"])).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mix(docs: DataFrame, **shares) -> DataFrame:
    """The rows of the mix with the columns of `docs`; a row that is taken twice comes twice."""
    goal, rows = plan(sized(docs), **shares)
    source, copies, below, again = unused(docs, "mix_source", "mix_copies", "mix_below", "mix_again")
    goal = goal.select(F.col("source").alias(source), F.col("copies").alias(copies), F.col("below").alias(below))
    times = (F.col(copies) + (hash_of(docs["doc_id"], docs["text"]) < F.col(below)).cast("long")).cast("int")
    return docs.join(_small(goal, rows), docs["source"].eqNullSafe(goal[source])).withColumn(
        again, F.explode(F.array_repeat(F.lit(1), times))).select(*map(quoted, docs.columns))


ORACLE = """
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w
  FROM sizes GROUP BY source),
filling AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS full_at FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY full_at, source ASC NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER (ORDER BY full_at, source ASC NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM filling),
goal AS (
  SELECT source, source_size, least(w * coalesce(
    (SELECT arg_min(level, full_at) FROM levels WHERE level <= full_at), 0), cap) AS target FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM goal),
running AS (
  SELECT s.*, p.source_size, p.target, p.copies, p.target - p.copies * p.source_size AS rest,
    (sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS after,
    (sum(size) OVER (PARTITION BY s.source, h))::BIGINT AS n
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  size * (copies + CASE WHEN 2 * (after - n) + n <= 2 * rest THEN 1 ELSE 0 END) AS taken
FROM running
"""
