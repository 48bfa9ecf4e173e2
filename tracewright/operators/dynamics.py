"""Dynamics metrics of a trajectory: step size, tortuosity, direction, settling, spread, self-similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.arrow import matrix, one_row
from ..functions.vectors import distance, unit
from ..params import DEFAULTS, EvalParams
from ..schemas import TRAJECTORY
from ..session import cut_lineage
from .pairwise import pairwise_metrics
from .ranking import exact_medians, pair_wins
from .states import BLOCK_ROWS, GROUP_ROWS, block_of, spread, spread_over_blocks, with_halo

# The names of the metrics.
METRICS = ["mean_step_norm", "tortuosity", "mean_consec_cos", "longrange_selfsim", "settle_frac", "spread",
           "nearest_revisit", "intrinsic_dim"]


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is zero."""
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def _walked(x: np.ndarray, home: int, last: np.ndarray, centroid: np.ndarray, settle_cosine: float) -> tuple:
    """Over the first `home` of consecutive samples (those after them are the next block's first two): number and sum of the
    steps' lengths, number and sum of the turns' cosines, the last place without the direction of `last`, and the sum of the
    distances from the centroid."""
    step = np.diff(x[:home + 2], axis=0)
    length = _lengths(step)
    turn = _ratio(np.einsum("ij,ij->i", step[:-1], step[1:]), length[:-1] * length[1:])[:home]
    turn, length = turn[~np.isnan(turn)], length[:home]
    own = x[:home]
    towards = _ratio(own @ last, _lengths(own) * np.sqrt(last @ last))
    unsettled = np.flatnonzero(~(towards > settle_cosine))
    return (len(length), float(length.sum()), len(turn), float(turn.sum()), int(unsettled[-1]) if len(unsettled) else None,
            float(_lengths(own - centroid).sum()))


WALK = ["steps", "path", "turns", "turn", "unsettled", "off"]
WALK_TYPES = [pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.float64()]
WALK_SCHEMA = "steps long, path double, turns long, turn double, unsettled long, off double"


def _by_position(group: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    group = group.sort_by("pos")
    return group.column("pos").to_numpy(), matrix(group.column("vec")), group


def linear_metrics(states: DataFrame, settle_cosine: float = 0.9, rows: int = BLOCK_ROWS) -> DataFrame:
    """The metrics that need neighbours, end points and the centroid of a trajectory.

    A trajectory of up to `rows` samples is walked by one task. A longer one is reduced block by block to its ends and
    centroid first, which then meet each block of `rows` samples (and two of the next), so many tasks share its walk.
    Trajectories of fewer than three samples get NULLs.
    """
    ids = ", ".join(f"{c} {states.schema[c].dataType.simpleString()}" for c in TRAJECTORY)
    needed = states.select(*TRAJECTORY, "pos", "n_steps", "vec")
    head = ["n", "norms", "net"]
    head_types = [pa.int64(), pa.float64(), pa.float64()]
    schema = f"{ids}, n long, norms double, net double, {WALK_SCHEMA}"

    def whole(key: tuple, group: pa.Table) -> pa.Table:
        _, x, group = _by_position(group)
        net = float(np.sqrt(((x[-1] - x[0]) ** 2).sum()))
        parts = [group.column("n_steps")[0].as_py(), float(_lengths(x).sum()), net]
        return one_row(key, [*TRAJECTORY, *head, *WALK], [*head_types, *WALK_TYPES],
                       [*parts, *_walked(x, len(x), x[-1], x.mean(axis=0), settle_cosine)])

    def reduced(key: tuple, group: pa.Table) -> pa.Table:
        _, x, group = _by_position(group)
        vector = pa.list_(pa.float64())
        return one_row(key, [*TRAJECTORY, "block", "n", "norms", "first", "last", "total"],
                       [pa.int64(), pa.float64(), vector, vector, vector],
                       [group.column("n_steps")[0].as_py(), float(_lengths(x).sum()), x[0].tolist(), x[-1].tolist(), x.sum(axis=0).tolist()])

    def part(key: tuple, group: pa.Table, ends: pa.Table) -> pa.Table:
        pos, x, group = _by_position(group)
        home = int(group.column("home").to_numpy(zero_copy_only=False).sum())
        last, centroid = (matrix(ends.column(c))[0] for c in ("last", "centroid"))
        found = list(_walked(x, home, last, centroid, settle_cosine))
        found[4] = None if found[4] is None else int(pos[found[4]])
        return one_row(key[:-1], [*TRAJECTORY, *head, *WALK], [*head_types, *WALK_TYPES],
                       [ends.column("n")[0].as_py(), ends.column("norms")[0].as_py(), ends.column("net")[0].as_py(), *found])

    short = spread(needed.where(F.col("n_steps") <= rows), TRAJECTORY).groupBy(*TRAJECTORY).applyInArrow(whole, schema)
    # planned in any case, as looking for long trajectories would read the input once more
    long = needed.where(F.col("n_steps") > rows)
    keys = [*TRAJECTORY, "block"]
    blocks = spread(long.withColumn("block", block_of(rows=rows)), keys).groupBy(*keys).applyInArrow(
        reduced, f"{ids}, block int, n long, norms double, first array<double>, last array<double>, total array<double>")
    ends = blocks.groupBy(*TRAJECTORY).agg(
        F.max("n").alias("n"), F.sum("norms").alias("norms"), F.min_by("first", "block").alias("first"),
        F.max_by("last", "block").alias("last"), Summarizer.sum(array_to_vector(F.col("total"))).alias("total"))
    ends = ends.select(*TRAJECTORY, "n", "norms", "last", distance(F.col("first"), F.col("last")).alias("net"),
                       F.transform(vector_to_array("total"), lambda v: v / F.col("n")).alias("centroid"))
    walked = spread(with_halo(long, 2, rows), keys).groupBy(*keys).cogroup(
        spread(spread_over_blocks(ends, "n", rows), keys).groupBy(*keys)).applyInArrow(part, schema)
    folded = short.unionByName(walked).groupBy(*TRAJECTORY).agg(
        F.max("n").cast("int").alias("n"), F.max("norms").alias("norms"), F.max("net").alias("net"),
        F.sum("steps").alias("steps"), F.sum("path").alias("path"), F.sum("turns").alias("turns"), F.sum("turn").alias("turn"),
        F.max("unsettled").alias("unsettled"), F.sum("off").alias("off"))
    long_enough = F.col("n") >= 3
    settle = F.least(F.col("n") - 1, F.coalesce(F.col("unsettled") + 1, F.lit(0)))
    mean_norm = F.col("norms") / F.col("n")
    return folded.select(
        *TRAJECTORY, F.col("n").alias("n_steps"),
        F.when(long_enough, F.try_divide(F.try_divide("path", "steps"), mean_norm)).alias("mean_step_norm"),
        F.when(long_enough, F.try_divide("path", "net")).alias("tortuosity"),
        F.when(long_enough, F.try_divide("turn", "turns")).alias("mean_consec_cos"),
        F.when(long_enough, F.try_divide(settle.cast("double"), (F.col("n") - 1).cast("double"))).alias("settle_frac"),
        F.when(long_enough, F.try_divide(F.col("off") / F.col("n"), mean_norm)).alias("spread"))


def _lagged_sums(at: np.ndarray, is_target: np.ndarray, unit: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Within one block: the sum of u_source . u_target over pairs at <= at, and both vector sums."""
    source_at, target_at = at[~is_target], at[is_target]
    order = np.argsort(source_at)
    sources, targets = unit[~is_target][order], unit[is_target]
    running = np.cumsum(sources, axis=0)
    # sources are dense, so the sample at offset k is the k-th of its block
    within = float((targets * running[target_at - source_at[order[0]]]).sum()) if len(targets) else 0.0
    return within, sources.sum(axis=0), targets.sum(axis=0)


def long_range_similarity(states: DataFrame, lag_fraction: float = 0.25, rows: int = GROUP_ROWS) -> DataFrame:
    """Mean cosine over all step pairs at least max(1, floor(n * lag_fraction)) apart, without the pairs.

    The sum over i <= j - lag of u_i . u_j is u_j . P(j - lag) with P the running sum of unit vectors. Sample
    j travels to the block of j - lag; running sums inside a block are local, and the sums of earlier blocks
    are added per vector element on block level. NULL when some vector has zero length.
    """
    lag = F.greatest(F.lit(1), F.floor(F.col("n_steps") * F.lit(float(lag_fraction)))).cast("int")
    units = states.where(F.col("n_steps") >= 3).select(
        *TRAJECTORY, "pos", "n_steps", lag.alias("lag"), F.forall("vec", lambda x: x == 0).alias("null_vec"),
        unit(F.col("vec")).alias("unit"))
    source = F.struct(F.col("pos").alias("at"), F.lit(False).alias("is_target"))
    target = F.struct((F.col("pos") - F.col("lag")).alias("at"), F.lit(True).alias("is_target"))
    roles = F.when(F.col("pos") >= F.col("lag"), F.array(source, target)).otherwise(F.array(source))
    placed = units.withColumn("role", F.explode(roles)).select(
        *TRAJECTORY, "n_steps", "null_vec", "unit", "role.at", "role.is_target").withColumn(
        "block", block_of("at", rows))

    id_type = states.schema["qid"].dataType.simpleString()
    names = [*TRAJECTORY, "block", "null_vec", "within", "pairs", "src", "tgt"]
    floats = pa.list_(pa.float64())

    def block_sums(key: tuple, group: pa.Table) -> pa.Table:
        at = group.column("at").to_numpy()
        is_target = group.column("is_target").to_numpy(zero_copy_only=False).astype(bool)
        within, src, tgt = _lagged_sums(at, is_target, matrix(group.column("unit")))
        null_vec = bool(group.column("null_vec").to_numpy(zero_copy_only=False).any())
        return one_row(key, names, [pa.bool_(), pa.float64(), pa.float64(), floats, floats],
                       [null_vec, within, float((at[is_target] + 1).sum()), src, tgt])

    def blocks(part: DataFrame) -> DataFrame:
        keys = [*TRAJECTORY, "block"]
        return spread(part, keys).groupBy(*keys).applyInArrow(
            block_sums, f"qid {id_type}, sample_idx int, layer int, block int, null_vec boolean, within double, "
                        "pairs double, src array<double>, tgt array<double>")

    sums = ["within", "pairs", "null_vec"]
    parts = blocks(placed.where(F.col("n_steps") <= rows)).select(*TRAJECTORY, *sums)
    # one row per block from here on; planned in any case, as looking for long trajectories would read the input once more
    long = blocks(placed.where(F.col("n_steps") > rows))
    earlier = Window.partitionBy(*TRAJECTORY, "dim").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    across = long.select(*TRAJECTORY, "block", F.posexplode(F.arrays_zip("src", "tgt")).alias("dim", "v")).select(
        *TRAJECTORY, (F.col("v.tgt") * F.coalesce(F.sum("v.src").over(earlier), F.lit(0.0))).alias("within"),
        F.lit(0.0).alias("pairs"), F.lit(False).alias("null_vec"))
    parts = parts.unionByName(long.select(*TRAJECTORY, *sums)).unionByName(across)
    return parts.groupBy(*TRAJECTORY).agg(
        F.sum("within").alias("s"), F.sum("pairs").alias("p"), F.max("null_vec").alias("z")).select(
        *TRAJECTORY, F.when(~F.col("z"), F.try_divide("s", "p")).alias("longrange_selfsim"))


def trajectory_metrics(states: DataFrame, rows: int = BLOCK_ROWS, params: EvalParams = DEFAULTS) -> DataFrame:
    """All eight metrics, one row per trajectory. The input is read by three passes: persist it if costly."""
    return (linear_metrics(states, params.settle_cosine, rows)
            .join(long_range_similarity(states, params.long_range_lag, min(rows, GROUP_ROWS)), TRAJECTORY, "left")
            .join(pairwise_metrics(states, params.theiler_window), TRAJECTORY, "left")
            .select(*TRAJECTORY, "n_steps", *METRICS))


def metrics_long(metrics: DataFrame) -> DataFrame:
    """(trajectory, metric, value) rows; undefined values are dropped."""
    present = [m for m in METRICS if m in metrics.columns]
    ids = [c for c in TRAJECTORY if c in metrics.columns]
    return metrics.unpivot(ids, present, "metric", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value"))


def group_tests(long: DataFrame, labels: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Mann-Whitney U, its normal score and both group medians per layer and metric.

    Fewer than two values in a group leave the statistics NULL. `z` is signed towards the shared-hard group
    and carries no continuity correction.
    """
    on = on or ["qid", "sample_idx"]
    cells = ["layer", "metric"]
    # a few numbers per trajectory; both uses below would otherwise repeat the passes over the vectors
    joined = cut_lineage(long.join(labels.select(*on, "label"), on).select(*cells, "value", "label"))
    medians = exact_medians(joined.where(F.col("label").isNotNull()), [*cells, "label"], "value").groupBy(*cells).agg(
        F.max(F.when(F.col("label") == 1, F.col("median"))).alias("shared_hard_median"),
        F.max(F.when(F.col("label") == 0, F.col("median"))).alias("salvageable_median"))
    stats = pair_wins(joined, cells, "value", "label")
    n1, n0 = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    n = n1 + n0
    var = n1 * n0 / 12.0 * ((n + 1.0) - F.try_divide(F.col("tie_term"), n * (n - 1.0)))
    defined = (F.col("n_pos") >= 2) & (F.col("n_neg") >= 2)
    out = stats.select(
        *cells, "n_pos", "n_neg", "tie_term",
        F.when(defined, F.col("wins")).alias("mannwhitney_u"),
        F.when(defined, F.try_divide(F.col("wins") - n1 * n0 / 2.0, F.sqrt(F.greatest(var, F.lit(0.0))))).alias("z"))
    return out.join(medians, cells).select(
        *cells, F.col("n_pos").alias("n_shared_hard"), F.col("n_neg").alias("n_salvageable"), "mannwhitney_u", "z",
        "tie_term",
        F.when(defined, F.col("shared_hard_median")).alias("shared_hard_median"),
        F.when(defined, F.col("salvageable_median")).alias("salvageable_median"))


def with_p_values(tests: DataFrame) -> DataFrame:
    from ..functions.pvalues import mann_whitney_p
    return tests.withColumn("p_value", mann_whitney_p("mannwhitney_u", "n_shared_hard", "n_salvageable", "tie_term"))


def chance_summary(tests_with_p: DataFrame, alpha: float = 0.05) -> DataFrame:
    """How many cells are significant, and how many would be by chance."""
    return tests_with_p.agg(
        F.count_if(F.col("p_value") < alpha).alias("n_significant"), F.count(F.lit(1)).alias("n_tests"),
        (F.count(F.lit(1)) * F.lit(float(alpha))).alias("expected_by_chance"))
