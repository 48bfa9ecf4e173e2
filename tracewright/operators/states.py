"""From nested traces to the long `states` table, and row-local selections on it.

A trajectory is (qid, sample_idx, layer). `pos` is the dense 0-based number of a captured sample and
`n_steps` the number of samples of its trajectory, carried on every row, so that prefixes, strides and
relative positions need neither a shuffle nor a look at the neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import doubles
from ..schemas import TRAJECTORY

# Upper bound on the rows of one trajectory that meet in one task: in a window, which spills, and in a Python
# group, which is held in memory (1,024 samples of width 2,560 are 21 MB).
BLOCK_ROWS = 4096
GROUP_ROWS = 1024


def absolute_layers(captured: Column, n_layers: Column) -> Column:
    """Captured layer numbers with negative ones counted from the end."""
    return F.transform(captured, lambda l: F.when(l < 0, n_layers + l).otherwise(l))


def captured_index(captured: Column, n_layers: Column, want: int | Column) -> Column:
    """0-based slot of layer `want` among the captured layers; fails the query when it was not captured."""
    want = F.lit(want) if isinstance(want, int) else want
    absolute = F.when(want < 0, n_layers + want).otherwise(want)
    slot = F.array_position(absolute_layers(captured, n_layers), absolute)
    message = F.concat(F.lit("layer "), want.cast("string"), F.lit(" was not captured"))
    return F.when(slot > 0, (slot - 1).cast("int")).otherwise(F.raise_error(message).cast("int"))


def _sample_idx(traces: DataFrame) -> Column:
    return F.col("sample_idx") if "sample_idx" in traces.columns else F.lit(0).alias("sample_idx")


def explode_single(traces: DataFrame) -> DataFrame:
    """One stored position per question: (layer) -> vector."""
    return traces.select(
        "qid", _sample_idx(traces), F.posexplode("hidden_all_layers").alias("layer", "raw"),
    ).select("qid", "sample_idx", "layer", F.lit(0).alias("pos"), F.lit(0).alias("step_index"),
             F.lit(1).alias("n_steps"), doubles(F.col("raw")).alias("vec"))


def explode_positions(traces: DataFrame) -> DataFrame:
    """Several stored prompt positions: (position, layer) -> vector."""
    by_pos = traces.select(
        "qid", _sample_idx(traces), F.size("hidden_states_by_position").alias("n_steps"),
        F.posexplode(F.arrays_zip("available_token_positions", "hidden_states_by_position")).alias("pos", "at"))
    return by_pos.where(F.col("pos") < F.col("n_steps")).select(
        "qid", "sample_idx", "pos", "n_steps", F.col("at.available_token_positions").alias("step_index"),
        F.posexplode("at.hidden_states_by_position").alias("layer", "raw"),
    ).select(*TRAJECTORY, "pos", "step_index", "n_steps", doubles(F.col("raw")).alias("vec"))


def explode_decode(traces: DataFrame) -> DataFrame:
    """Generation steps: (step, captured layer) -> vector, with true layer numbers."""
    by_step = traces.select(
        "qid", _sample_idx(traces), "n_new_tokens",
        absolute_layers(F.col("decode_layers_captured"), F.col("num_layers_incl_embed")).alias("layers"),
        F.size("decode_hidden_states_by_step").alias("n_steps"),
        F.posexplode(F.arrays_zip("decode_step_indices", "decode_hidden_states_by_step")).alias("pos", "at"))
    return by_step.where(F.col("pos") < F.col("n_steps")).select(
        "qid", "sample_idx", "pos", "n_steps", "n_new_tokens", "layers", F.col("at.decode_step_indices").alias("step_index"),
        F.posexplode("at.decode_hidden_states_by_step").alias("slot", "raw"),
    ).select("qid", "sample_idx", F.col("layers")[F.col("slot")].alias("layer"), "pos", "step_index",
             "n_steps", "n_new_tokens", doubles(F.col("raw")).alias("vec"))


def decode_vectors(df: DataFrame, column: str, out: str = "hidden_all_layers") -> DataFrame:
    """Decode JSON-string matrices; `parse_ok` is false where the text is no matrix of numbers."""
    parsed = F.from_json(F.col(column), "array<array<float>>")
    ok = parsed.isNotNull() & (F.size(parsed) > 0) & F.forall(
        parsed, lambda v: v.isNotNull() & F.forall(v, lambda x: x.isNotNull()))
    return df.withColumns({out: F.when(ok, parsed), "parse_ok": F.coalesce(ok, F.lit(False))})  # `out` may be `column`


def available_positions(requested: Column, seq_len: Column) -> Column:
    """Requested prompt positions that exist in a sequence of this length."""
    return F.filter(requested, lambda p: p < seq_len)


def pick_position(states: DataFrame, mode: str, positions: list[int] | None = None) -> DataFrame:
    """Keep the first, the last, listed, or all stored prompt positions."""
    if mode == "all":
        return states
    if mode == "first":
        return states.where(F.col("step_index") == 0)
    if mode == "last":
        return states.where(F.col("pos") == F.col("n_steps") - 1)
    if mode == "list":
        return states.where(F.col("step_index").isin(sorted(positions or [])))
    raise ValueError(f"unknown position mode {mode!r}")


def stride_samples(steps: DataFrame, stride: int, cap: int | None = None, axis: str = "pos") -> DataFrame:
    """Every `stride`-th step of a dense 0-based axis, at most `cap` of them per trajectory.

    On a dense axis the running number of a kept step is step / stride, so no window is needed.
    """
    if stride < 1:
        raise ValueError("stride must be at least 1")
    kept = steps.where(F.col(axis) % stride == 0).withColumn(
        "sample_no", F.expr(f"cast({axis} div {int(stride)} as int)"))
    return kept.where(F.col("sample_no") < cap) if cap is not None and cap > 0 else kept


def prefix(states: DataFrame, fraction: float) -> DataFrame:
    """The first max(1, floor(n * fraction)) samples of each trajectory."""
    keep = F.greatest(F.lit(1), F.floor(F.col("n_steps") * F.lit(float(fraction))))
    return states.where(F.col("pos") < keep)


def nearest_positions(states: DataFrame, n_positions: int) -> DataFrame:
    """For each of `n_positions` evenly spaced relative positions, the nearest captured sample.

    Each row finds by itself which grid points fall on it (half-to-even, no interpolation); one row may
    serve several grid points of a short trajectory.
    """
    last = n_positions - 1
    step = 1.0 / last if last else 0.0
    nearest = lambda p: F.bround(
        F.when((p == last) & F.lit(last > 0), F.lit(1.0)).otherwise(p.cast("double") * F.lit(step))
        * (F.col("n_steps") - 1))
    hits = F.filter(F.sequence(F.lit(0), F.lit(last)), lambda p: nearest(p) == F.col("pos"))
    return states.withColumn("grid_pos", F.explode(hits))


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition for a Python group function over all shuffle partitions.

    The adaptive planner sizes partitions by bytes and would put many small but expensive groups in one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def block_of(pos: str = "pos", rows: int = BLOCK_ROWS) -> Column:
    return F.expr(f"cast({pos} div {int(rows)} as int)")


def spread_over_blocks(per_trajectory: DataFrame, n_steps: str = "n_steps", rows: int = BLOCK_ROWS) -> DataFrame:
    """Copy a per-trajectory row once per block, so a join with states has balanced keys."""
    return per_trajectory.withColumn(
        "block", F.explode(F.expr(f"sequence(0, cast(greatest({n_steps} - 1, 0) div {int(rows)} as int))")))


def with_halo(states: DataFrame, halo: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `block`, and repeat the first `halo` rows of a block as `home = false` rows of the block before.

    Windows over (trajectory, block) can then look `halo` rows ahead although no task sees more than
    `rows + halo` rows of one trajectory.
    """
    blocks = F.when(
        (F.col("pos") >= rows) & (F.col("pos") % rows < halo),
        F.array(block_of(rows=rows), block_of(rows=rows) - 1),
    ).otherwise(F.array(block_of(rows=rows)))
    return (states.withColumn("block", F.explode(blocks))
            .withColumn("home", F.col("block") == block_of(rows=rows)))
