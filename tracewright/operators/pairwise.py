"""Nearest revisits and intrinsic dimension: statistics over all distant step pairs of a trajectory.

A trajectory that fits one tile of the distance matrix is finished by one task. A longer one is cut into blocks of steps
that lie close together: around the nearest of a few pivots, in rings of its distance. A block's nearest and farthest
distance to every pivot bound the distances of a tile, that is of two blocks, from both sides (triangle inequality).

* The two nearest neighbours of a step come from its own block first. Of the other tiles only those are read whose lower
  bound is within the second nearest distance found so far, for any step of either block.
* The median of all distances starts from the bounds: they give a bracket of the middle ranks without any distance.
  Tiles that reach into it are read twice, whatever the length: once for a sketch (`SLICES` runs of consecutive values,
  whose ends and counts are bounds again, for all tiles together), and once to count what lies below the sketch's bracket
  and keep what lies inside. The others are only counted, and what is kept is searched by value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.arrow import keyed_rows, matrix, one_row, vectors
from ..schemas import TRAJECTORY
from ..session import cut_lineage
from .states import GROUP_ROWS, spread

BINS = 4096
PIVOTS = 16
RINGS = 64  # of a ball, at most
SLICES = 1024
SLACK = 1e-9  # of rounding in bounds


def distance_tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between two sets of rows; near-equal rows are recomputed by difference."""
    sq_a, sq_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    scale = sq_a[:, None] + sq_b[None, :]
    squared = np.maximum(scale - 2.0 * (a @ b.T), 0.0)
    for i, j in zip(*np.nonzero(squared < 1e-5 * scale)):
        diff = a[i] - b[j]
        squared[i, j] = diff @ diff
    return np.sqrt(squared)


def _far_tile(pos_a, a, pos_b, b, theiler: int) -> np.ndarray:
    """Distances with too-near steps set to infinity."""
    d = distance_tile(a, b)
    d[np.abs(pos_a[:, None] - pos_b[None, :]) <= theiler] = np.inf
    return d


def _two_smallest(d: np.ndarray) -> np.ndarray:
    if d.shape[1] < 2:
        d = np.pad(d, ((0, 0), (0, 2 - d.shape[1])), constant_values=np.inf)
    return np.partition(d, 1, axis=1)[:, :2]


def _finish(r1: np.ndarray, r2: np.ndarray, median: float) -> tuple[float | None, float | None]:
    near = r1[np.isfinite(r1)]
    revisit = float(near.mean() / median) if near.size and median > 0 else None
    ok = (r1 > 0) & np.isfinite(r2)
    ratio = r2[ok] / r1[ok]
    ratio = ratio[ratio > 1.0]
    return revisit, (float(ratio.size / np.log(ratio).sum()) if ratio.size else None)


def _short(states: DataFrame, theiler: int) -> DataFrame:
    names = [*TRAJECTORY, "nearest_revisit", "intrinsic_dim"]

    def whole(key: tuple, group: pa.Table) -> pa.Table:
        pos, vec = _ordered(group)
        d = _far_tile(pos, vec, pos, vec, theiler)
        upper = d[pos[:, None] < pos[None, :]]
        upper = upper[np.isfinite(upper)]
        revisit = dim = None
        if upper.size:
            two = _two_smallest(d)
            revisit, dim = _finish(two[:, 0], two[:, 1], float(np.median(upper)))
        return one_row(key, names, [pa.float64(), pa.float64()], [revisit, dim])

    return spread(states.select(*TRAJECTORY, "pos", "vec"), TRAJECTORY).groupBy(*TRAJECTORY).applyInArrow(
        whole, _ids(states) + ", nearest_revisit double, intrinsic_dim double")


def _ids(states: DataFrame) -> str:
    return ", ".join(f"{c} {states.schema[c].dataType.simpleString()}" for c in TRAJECTORY)


def _ordered(group: pa.Table):
    pos = group.column("pos").to_numpy()
    order = np.argsort(pos, kind="stable")
    return pos[order], matrix(group.column("vec"))[order]


def _placed(states: DataFrame, ids: str, rows: int) -> DataFrame:
    """Every step with `block`, its number among the trajectory's blocks, and `far`, its distances to the pivots."""
    n_blocks = F.expr(f"cast((n_steps - 1) div {rows} as int) + 1")
    by_time = states.select(*TRAJECTORY, "pos", "vec", F.expr(f"cast(pos div {rows} as int)").alias("part"), F.lit(False).alias("pivot"))
    copies = states.join(_pivots(states), [*TRAJECTORY, "pos"]).select(
        *TRAJECTORY, "pos", "vec", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("part"), F.lit(True).alias("pivot"))

    def distances(key: tuple, group: pa.Table) -> pa.Table:
        pivot = group.column("pivot").to_numpy(zero_copy_only=False)
        _, pivots = _ordered(group.filter(pa.array(pivot)))
        pos, vec = _ordered(group.filter(pa.array(~pivot)))
        far = distance_tile(vec, pivots)
        return keyed_rows(key[:-1], TRAJECTORY, {
            "pos": pos, "ball": far.argmin(axis=1).astype(np.int32), "radius": far.min(axis=1), "far": vectors(far)})
    seen = cut_lineage(spread(by_time.unionByName(copies), [*TRAJECTORY, "part"]).groupBy(*TRAJECTORY, "part").applyInArrow(
        distances, ids + ", pos int, ball int, radius double, far array<double>"))
    balls = seen.groupBy(*TRAJECTORY, "ball").agg(
        F.expr(f"cast((count(*) - 1) div {rows} as int) + 1").alias("rings"),
        F.percentile_approx("radius", [i / RINGS for i in range(1, RINGS)], 10 * RINGS).alias("cuts"))
    # Equal radii can fill a ring beyond its size: then it is dealt to parts.
    ring = F.expr(f"cast(floor(size(filter(cuts, c -> c < radius)) * rings / {RINGS}) as int)")
    ringed = seen.join(balls, [*TRAJECTORY, "ball"]).withColumn("ring", F.least(ring, F.col("rings") - 1)).drop("cuts", "rings", "radius")
    sizes = ringed.groupBy(*TRAJECTORY, "ball", "ring").agg(F.expr(f"cast((count(*) - 1) div {2 * rows} as int) + 1").alias("parts"))
    dealt = ringed.join(sizes, [*TRAJECTORY, "ball", "ring"]).withColumn("part", F.pmod(F.hash("pos"), F.col("parts")))
    names = ["ball", "ring", "part"]
    numbers = dealt.select(*TRAJECTORY, *names).distinct().withColumn(
        "block", F.row_number().over(Window.partitionBy(*TRAJECTORY).orderBy(*names)) - 1)
    blocked = dealt.join(numbers, [*TRAJECTORY, *names]).select(*TRAJECTORY, "pos", "block", "far")
    return cut_lineage(states.select(*TRAJECTORY, "pos", "vec").join(blocked, [*TRAJECTORY, "pos"]))


def _pivots(states: DataFrame) -> DataFrame:
    """`PIVOTS` steps of each trajectory, evenly far apart in time."""
    last = F.col("n_steps") - 1
    grid = F.transform(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda i: F.floor(i * last / (PIVOTS - 1)).cast("int"))
    return states.where("pos = 0").select(*TRAJECTORY, F.explode(F.array_distinct(grid)).alias("pos"))


def _tiles(placed: DataFrame, theiler: int) -> DataFrame:
    """(trajectory, ta, tb, low, high, pairs): bounds and number of the far distances between two blocks, ta <= tb."""
    ends = placed.select(*TRAJECTORY, "block", F.posexplode("far").alias("pivot", "d")).groupBy(*TRAJECTORY, "block", "pivot").agg(
        F.min("d").alias("near"), F.max("d").alias("far")).groupBy(*TRAJECTORY, "block").agg(
        F.sort_array(F.collect_list(F.struct("pivot", "near", "far"))).alias("ends"))
    blocks = placed.groupBy(*TRAJECTORY, "block").agg(F.count(F.lit(1)).alias("n")).join(ends, [*TRAJECTORY, "block"])
    blocks = cut_lineage(blocks)
    one = [blocks.select(*TRAJECTORY, F.col("block").alias(f"t{x}"), F.col("n").alias(f"n{x}"), F.col("ends").alias(f"e{x}")) for x in "ab"]
    both = one[0].join(one[1], TRAJECTORY).where("ta <= tb")
    low = F.array_max(F.zip_with("ea", "eb", lambda a, b: F.greatest(a["near"] - b["far"], b["near"] - a["far"])))
    high = F.array_min(F.zip_with("ea", "eb", lambda a, b: a["far"] + b["far"]))
    # Steps too near in time, by the tile they fall in.
    at = placed.select(*TRAJECTORY, "pos", "block")
    ahead = at.select(*TRAJECTORY, F.explode(F.expr(f"transform(sequence(1, {theiler}), k -> pos + k)")).alias("pos"), F.col("block").alias("other"))
    close = at.join(ahead, [*TRAJECTORY, "pos"]).groupBy(
        *TRAJECTORY, F.least("block", "other").alias("ta"), F.greatest("block", "other").alias("tb")).agg(F.count(F.lit(1)).alias("close"))
    pairs = F.when(F.col("ta") == F.col("tb"), F.expr("na * (na - 1) div 2")).otherwise(F.expr("na * nb"))
    tiles = both.select(*TRAJECTORY, "ta", "tb", pairs.alias("all"), F.greatest(low - SLACK * high, F.lit(0.0)).alias("low"),
                        (high * (1 + SLACK)).alias("high"))
    return cut_lineage(tiles.join(close, [*TRAJECTORY, "ta", "tb"], "left").select(
        *TRAJECTORY, "ta", "tb", "low", "high", (F.col("all") - F.coalesce("close", F.lit(0))).alias("pairs")).where("pairs > 0"))


def _read(placed: DataFrame, tiles: DataFrame, fn, schema: str) -> DataFrame:
    """`fn` on each of the tiles: the steps of both blocks, and the tile's other columns on every row."""
    entry = tiles.withColumn("block", F.explode(F.array_distinct(F.array("ta", "tb"))))
    return spread(entry.join(placed.drop("far"), [*TRAJECTORY, "block"]), [*TRAJECTORY, "ta", "tb"]).groupBy(
        *TRAJECTORY, "ta", "tb").applyInArrow(fn, schema)


def _distances(group: pa.Table, theiler: int):
    """Positions of both sides, and distances; in one block every pair is there twice."""
    left = group.column("block").to_numpy() == group.column("ta").to_numpy()
    pos_a, a = _ordered(group.filter(pa.array(left)))
    pos_b, b = (pos_a, a) if left.all() else _ordered(group.filter(pa.array(~left)))
    return pos_a, pos_b, _far_tile(pos_a, a, pos_b, b, theiler), bool(left.all())


def _values(group: pa.Table, theiler: int) -> np.ndarray:
    pos_a, pos_b, d, own = _distances(group, theiler)
    values = d[pos_a[:, None] < pos_b[None, :]] if own else d.ravel()
    return np.sort(values[np.isfinite(values)])


def _neighbours(placed: DataFrame, tiles: DataFrame, ids: str, theiler: int) -> DataFrame:
    """Two smallest distances of each step."""
    def nearest(key: tuple, group: pa.Table) -> pa.Table:
        pos_a, pos_b, d, own = _distances(group, theiler)
        two, where = _two_smallest(d), pos_a
        if not own:
            two, where = np.vstack([two, _two_smallest(d.T)]), np.concatenate([pos_a, pos_b])
        return keyed_rows(key[:-2], TRAJECTORY, {"pos": where, "r1": two[:, 0], "r2": two[:, 1]})

    def merged(found: DataFrame) -> DataFrame:
        best = F.array_sort(F.flatten(F.collect_list(F.array("r1", "r2"))))
        return found.groupBy(*TRAJECTORY, "pos").agg(best.alias("r")).select(
            *TRAJECTORY, "pos", F.col("r")[0].alias("r1"), F.col("r")[1].alias("r2"))
    schema = ids + ", pos int, r1 double, r2 double"
    never = F.lit(float("inf"))
    own = cut_lineage(_read(placed, tiles.where("ta = tb").select(*TRAJECTORY, "ta", "tb"), nearest, schema))
    reach = placed.select(*TRAJECTORY, "pos", "block").join(own, [*TRAJECTORY, "pos"], "left").groupBy(*TRAJECTORY, "block").agg(
        F.max(F.coalesce("r2", never)).alias("reach"))
    return merged(own.unionByName(_read(placed, needed(tiles, reach), nearest, schema)))


def needed(tiles: DataFrame, reach: DataFrame) -> DataFrame:
    """Tiles of two blocks that may hold a step nearer than `reach`, the farthest second neighbour in a block so far."""
    a, b = (reach.select(*TRAJECTORY, F.col("block").alias(t), F.col("reach").alias(f"{t}_reach")) for t in ("ta", "tb"))
    return tiles.where("ta < tb").join(a, [*TRAJECTORY, "ta"]).join(b, [*TRAJECTORY, "tb"]).where(
        F.col("low") <= F.greatest("ta_reach", "tb_reach")).select(*TRAJECTORY, "ta", "tb")


def _bracket(pieces: DataFrame) -> DataFrame:
    """(trajectory, total, lo, hi): both middle values lie in it. Of every piece's `n` values none is outside low..high."""
    total = F.sum("n").over(Window.partitionBy(*TRAJECTORY))
    upto = [F.sum("n").over(Window.partitionBy(*TRAJECTORY).orderBy(c).rangeBetween(Window.unboundedPreceding, 0)) for c in ("low", "high")]
    known = pieces.select(*TRAJECTORY, "low", "high", total.alias("total"), upto[0].alias("most"), upto[1].alias("least"))
    return cut_lineage(known.groupBy(*TRAJECTORY).agg(
        F.max("total").alias("total"),
        (F.min(F.when(F.col("most") >= F.expr("(total + 1) div 2"), F.col("low"))) * (1 - SLACK)).alias("lo"),
        (F.min(F.when(F.col("least") >= F.expr("(total + 2) div 2"), F.col("high"))) * (1 + SLACK)).alias("hi")))


def _median(placed: DataFrame, tiles: DataFrame, ids: str, theiler: int) -> DataFrame:
    """(trajectory, median) of all far distances: bounds, a sketch, and one pass that counts."""
    def sketch(key: tuple, group: pa.Table) -> pa.Table:
        values = _values(group, theiler)
        cuts = np.unique(len(values) * np.arange(SLICES + 1) // SLICES)
        return keyed_rows(key[:-2], TRAJECTORY, {"low": values[cuts[:-1]], "high": values[cuts[1:] - 1], "n": np.diff(cuts)})

    def kept(key: tuple, group: pa.Table) -> pa.Table:
        values = _values(group, theiler)
        lo, hi = (group.column(c)[0].as_py() for c in ("lo", "hi"))
        a, b = np.searchsorted(values, lo, "left"), np.searchsorted(values, hi, "right")
        value, n = np.unique(values[a:b], return_counts=True)
        # what lies below is a row without a value
        out = {"value": pa.array([None, *value.tolist()], pa.float64()), "n": np.r_[a, n].astype(np.int64)}
        return keyed_rows(key[:-2], TRAJECTORY, out)

    counted = tiles.withColumnRenamed("pairs", "n")
    first = _bracket(counted)
    some = counted.join(first.drop("total"), TRAJECTORY).withColumn("inside", (F.col("high") >= F.col("lo")) & (F.col("low") <= F.col("hi")))
    slices = _read(placed, some.where("inside").select(*TRAJECTORY, "ta", "tb"), sketch, ids + ", low double, high double, n long")
    second = _bracket(some.where("not inside").select(*TRAJECTORY, "low", "high", "n").unionByName(slices))
    again = counted.join(second, TRAJECTORY).withColumn("inside", (F.col("high") >= F.col("lo")) & (F.col("low") <= F.col("hi")))
    below = again.where("not inside and high < lo").select(*TRAJECTORY, F.lit(None).cast("double").alias("value"), "n")
    found = _read(placed, again.where("inside").select(*TRAJECTORY, "ta", "tb", "lo", "hi"), kept, ids + ", value double, n long")
    values = cut_lineage(found.unionByName(below).groupBy(*TRAJECTORY, "value").agg(F.sum("n").alias("n")))
    # The middle ranks among the kept values: by bins of the bracket first, then inside the one or two that hold them.
    cell = F.when(F.col("value").isNull(), -1).when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) / (
        F.col("hi") - F.col("lo")) * BINS).cast("int")).otherwise(0)
    binned = values.join(second, TRAJECTORY).withColumn("cell", cell)
    order = Window.partitionBy(*TRAJECTORY).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = binned.groupBy(*TRAJECTORY, "cell", "total").agg(F.sum("n").alias("cell_n")).withColumn(
        "before", F.coalesce(F.sum("cell_n").over(order), F.lit(0)))
    ranks = [F.expr("(total + 1) div 2"), F.expr("(total + 2) div 2")]
    holds = F.lit(False)
    for r in ranks:
        holds = holds | ((F.col("before") < r) & (r <= F.col("before") + F.col("cell_n")))
    chosen = binned.drop("total").join(cells.where(holds & (F.col("cell") >= 0)), [*TRAJECTORY, "cell"])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*TRAJECTORY, "cell").orderBy("value"))
    middle = chosen.withColumn("upto", upto)
    times = sum(((F.col("upto") >= r) & (F.col("upto") - F.col("n") < r)).cast("int") for r in ranks)
    return middle.withColumn("times", times).groupBy(*TRAJECTORY).agg(
        (F.sum(F.when(F.col("times") > 0, F.col("value") * F.col("times"))) / F.sum("times")).alias("median"))


def _long(states: DataFrame, theiler: int, rows: int) -> DataFrame:
    ids = _ids(states)
    placed = _placed(states, ids, rows)
    tiles = _tiles(placed, theiler)
    near = _neighbours(placed, tiles, ids, theiler)
    finite = F.col("r1") < F.lit(float("inf"))
    ratio = F.when((F.col("r1") > 0) & (F.col("r2") < F.lit(float("inf"))), F.try_divide("r2", "r1"))
    folded = near.withColumn("ratio", ratio).groupBy(*TRAJECTORY).agg(
        F.avg(F.when(finite, F.col("r1"))).alias("near"),
        F.try_divide(F.count_if(F.col("ratio") > 1.0).cast("double"),
                     F.sum(F.when(F.col("ratio") > 1.0, F.ln("ratio")))).alias("intrinsic_dim"))
    trajectories = states.where("pos = 0").select(*TRAJECTORY)
    return trajectories.join(folded, TRAJECTORY, "left").join(_median(placed, tiles, ids, theiler), TRAJECTORY, "left").select(
        *TRAJECTORY, F.try_divide("near", "median").alias("nearest_revisit"), "intrinsic_dim")


def pairwise_metrics(states: DataFrame, theiler: int = 5, rows: int = GROUP_ROWS) -> DataFrame:
    """`nearest_revisit` and `intrinsic_dim` per trajectory; NULL when no two steps are far enough apart."""
    if theiler < 1:
        raise ValueError("the window must exclude at least the step itself and its neighbours")
    usable = states.where(F.col("n_steps") >= 3)
    out = _short(usable.where(F.col("n_steps") <= rows), theiler)
    long = usable.where(F.col("n_steps") > rows)
    if long.select("n_steps").isEmpty():
        return out
    # these rows are read several times
    return out.unionByName(_long(cut_lineage(long), theiler, rows))
