"""Exact global numbering and rank statistics that never sort one whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.vectors import let
from ..session import cut_lineage

HASH_BITS = 32
BUCKET_BITS = 12
SALTS = 32


def seeded_hash(*parts: Column, seed: int = 0) -> Column:
    """Uniform 32-bit integer from md5, the same in every SQL engine."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_row_number(df: DataFrame, keys: list[str], seed: int = 0, within: list[str] | None = None,
                    order: list[str] | None = None, out: str = "row_no") -> DataFrame:
    """Dense 0-based row number in seeded-hash order of the unique `keys`, optionally per `within` group.

    `order` names columns of few distinct non-NULL values that are sorted by first. The hash cuts each group
    into 4096 equal buckets. Numbers run inside a bucket and are shifted by the sizes of the buckets before, so
    even a group with most of the rows is numbered by many tasks. `row_total` is the size of the group.
    """
    within, order = within or [], order or []
    hashed = df.withColumn("_h", seeded_hash(*[F.col(k) for k in keys], seed=seed)).withColumn(
        "_bucket", F.shiftright("_h", HASH_BITS - BUCKET_BITS))
    place = [*within, *order, "_bucket"]
    sizes = hashed.groupBy(*place).agg(F.count(F.lit(1)).alias("_size"))
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = group.orderBy(*order, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *place, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(group).alias("row_total"))
    inside = Window.partitionBy(*place).orderBy("_h", *keys)
    return (hashed.join(offsets, place)
            .withColumn(out, F.row_number().over(inside) - 1 + F.col("_offset"))
            .drop("_h", "_bucket", "_offset"))


def ordered_index(df: DataFrame, order: list[str], out: str = "idx", parts: int | None = None) -> DataFrame:
    """Dense 0-based index in global sort order of the unique `order` columns.

    Rows are range-partitioned once and written to the checkpoint folder with their partition number:
    range bounds come from a sample, so both uses below must see the same materialised split.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")).select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return placed.join(offsets, "_part").withColumn(
        out, F.row_number().over(inside) - 1 + F.col("_offset")).drop("_part", "_offset")


def score_counts(df: DataFrame, cells: list[str], score: str, label: str, weight: Column | None = None) -> DataFrame:
    """Positives and negatives per distinct score; NULL and NaN scores do not take part."""
    weight = F.lit(1).cast("long") if weight is None else weight
    usable = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    zero = F.lit(0).cast("long")
    return usable.groupBy(*cells, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, weight).otherwise(zero)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, zero).otherwise(weight)).alias("neg"))


def score_edges(counts: DataFrame, cells: list[str], fan: int = 8) -> DataFrame:
    """Approximate score quantiles that cut each cell into fan^2 buckets, and every fan-th of them.

    They only balance the work: any edges give exact results. Reading both counts keeps the input identical to
    its other use, so it is aggregated and shuffled once.
    """
    cuts = [F.lit(i / fan ** 2) for i in range(1, fan ** 2)]
    score = F.when(F.col("pos") + F.col("neg") > 0, F.col("score"))
    edges = counts.groupBy(*cells).agg(F.percentile_approx(score, F.array(*cuts), F.lit(1000)).alias("_edges"))
    return edges.withColumn("_coarse", F.array(*[F.col("_edges")[fan * i - 1] for i in range(1, fan)]))


def bucket_of(score: Column, edges: Column, coarse: Column, fan: int = 8) -> Column:
    """Number of edges below the score, found in two steps of `fan` comparisons."""
    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda e: e < score))
    return let(below(coarse), lambda c: c * fan + below(F.slice(edges, c * fan + 1, F.lit(fan - 1))))


def wins_from_buckets(counts: DataFrame, cells: list[str]) -> DataFrame:
    """Won pairs per cell from (cell, _bucket, score, pos, neg); a tie counts one half.

    Pairs inside one bucket come from a running count there; pairs across buckets need only the bucket
    totals. No task holds more than one bucket of a cell.
    """
    inside = Window.partitionBy(*cells, "_bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0)).cast("double")
    ties = (F.col("pos") + F.col("neg")).cast("double")
    per_bucket = counts.select(
        *cells, "_bucket", "pos", "neg",
        (F.col("pos") * (below + 0.5 * F.col("neg"))).alias("won"),
        (ties * ties * ties - ties).alias("tied"),
    ).groupBy(*cells, "_bucket").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"),
        F.sum("tied").alias("tied"))
    lower = Window.partitionBy(*cells).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    neg_below = F.coalesce(F.sum("neg").over(lower), F.lit(0)).cast("double")
    return per_bucket.select(*cells, "pos", "neg", "tied", (F.col("won") + F.col("pos") * neg_below).alias("won")) \
        .groupBy(*cells).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
                             F.sum("won").alias("wins"), F.sum("tied").alias("tie_term"))


def exact_medians(df: DataFrame, cells: list[str], value: str) -> DataFrame:
    """(cells, median) without gathering a cell in one task.

    A mergeable sketch gives a bracket that is sure to hold the middle ranks (its rank error is a tenth of the
    bracket's margin). What lies below is only counted; the distinct values inside are ordered by running counts.
    """
    usable = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*cells, F.col(value).cast("double").alias("v"))
    ends = F.percentile_approx("v", F.array(F.lit(0.499), F.lit(0.501)), F.lit(10_000))
    brackets = usable.groupBy(*cells).agg(ends.alias("ends"), F.count(F.lit(1)).alias("n"))
    placed = usable.join(brackets, cells).select(
        *cells, "n", (F.col("v") < F.col("ends")[0]).alias("below"),
        F.when(F.col("v") >= F.col("ends")[0], F.col("v")).alias("v"), F.col("ends")[1].alias("high")).where(
        F.col("below") | (F.col("v") <= F.col("high")))
    counts = placed.groupBy(*cells, "n", "v").agg(F.count(F.lit(1)).alias("c"))  # the row without v: all that lies below
    upto = F.sum("c").over(Window.partitionBy(*cells).orderBy(F.col("v").asc_nulls_first()))
    ranked = counts.withColumn("upto", upto)
    held = [(F.col("upto") >= r) & (F.col("upto") - F.col("c") < r) for r in (F.expr("(n + 1) div 2"), F.expr("(n + 2) div 2"))]
    return ranked.groupBy(*cells).agg(
        ((F.max(F.when(held[0], F.col("v"))) + F.max(F.when(held[1], F.col("v")))) / 2).alias("median"))


def pair_wins(df: DataFrame, cells: list[str], score: str, label: str, weight: Column | None = None,
              fan: int = 8) -> DataFrame:
    """Per cell: class sizes, the number of (positive, negative) pairs ranked right, and the tie term."""
    keys = cells or ["_all"]
    source = df if cells else df.withColumn("_all", F.lit(0))
    counts = score_counts(source, keys, score, label, weight)
    # salted: a plain join on the cell would gather a hot cell, and the windows would keep that placement
    edges = score_edges(counts, keys, fan).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # never NULL, so that no inferred filter makes this branch differ from the one below the edges
    salt = F.coalesce(F.pmod(F.xxhash64("score"), F.lit(SALTS)).cast("int"), F.lit(0))
    salted = counts.withColumn("_salt", salt)
    placed = salted.join(edges, [*keys, "_salt"]).withColumn(
        "_bucket", bucket_of(F.col("score"), F.col("_edges"), F.col("_coarse"), fan)).drop("_edges", "_coarse", "_salt")
    out = wins_from_buckets(placed, keys)
    return out if cells else out.drop("_all")


def auc(df: DataFrame, cells: list[str], score: str, label: str, fan: int = 8) -> DataFrame:
    """ROC AUC per cell with half credit for ties; NULL where a class is missing."""
    return pair_wins(df, cells, score, label, fan=fan).withColumn(
        "auc", F.try_divide(F.col("wins"), F.col("n_pos").cast("double") * F.col("n_neg"))) \
        .drop("wins", "tie_term")
