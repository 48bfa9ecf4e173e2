"""Principal-component basis of one layer's vectors.

The covariance is never made: a block of directions Q goes to the tasks, which sum X' (X Q) over their rows (centred).
Each such pass adds a block to a Krylov space, and the Rayleigh-Ritz values and vectors of that space are the components
once their residuals vanish. What reaches the driver is a few columns of the vectors' width per pass; vectors no wider
than a block need one pass.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.arrow import matrix, vectors
from ..schemas import PCA_BASIS
from ..session import cut_lineage

EXTRA = 8  # directions beyond the wanted ones
PASSES = 200
SPACE = 12  # blocks of a space before it starts again from its best directions
TOLERANCE = 1e-11  # residual, as a share of the largest value
CHUNK = 4096  # elements of a direction in one partial sum


def _covariance_times(rows: DataFrame, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum over all rows of x (x . q), x around the mean; one row per chunk of elements leaves a task."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, q))

    def run(batches):
        mean, q = shared.value
        total = np.zeros(q.shape)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vec")) - mean
                total += x.T @ (x @ q)
        for at in range(0, len(total), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), vectors(total[at:at + CHUNK].reshape(1, -1))], ["at", "part"])
    parts = rows.mapInArrow(run, "at int, part array<double>").groupBy("at").agg(
        Summarizer.sum(array_to_vector(F.col("part"))).alias("s")).select("at", vector_to_array("s").alias("s")).orderBy("at").toArrow()
    shared.unpersist()
    return np.concatenate([s.values.to_numpy() for s in parts["s"]]).reshape(q.shape)


def _orthogonal(block: np.ndarray, space: np.ndarray | None) -> np.ndarray:
    """Orthonormal directions of `block` that `space` does not have."""
    size = np.linalg.norm(block, axis=0).max()
    for _ in range(2):
        if space is not None:
            block = block - space @ (space.T @ block)
        block, r = np.linalg.qr(block)
        block = block[:, np.abs(np.diag(r)) > 1e-12 * max(size, 1e-300)]
        size = 1.0
    return block


def leading_directions(times, width: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(values, columns) of the k largest eigenpairs of a symmetric matrix that is known by its products."""
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + EXTRA))))[0]
    space = image = None
    for _ in range(PASSES):
        new = times(block)
        space, image = (block, new) if space is None else (np.hstack([space, block]), np.hstack([image, new]))
        inner = space.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        turn, values = turn[:, ::-1], values[::-1]
        found, applied = space @ turn, image @ turn
        residual = applied[:, :k] - found[:, :k] * values[:k]
        if space.shape[1] == width or np.linalg.norm(residual, axis=0).max() <= TOLERANCE * max(values[0], 1e-300):
            break
        lead = min(found.shape[1], k + EXTRA)
        if space.shape[1] > SPACE * lead:
            space, image = found[:, :lead], applied[:, :lead]
        block = _orthogonal(applied[:, :lead] - found[:, :lead] * values[:lead], space)
        if not block.shape[1]:
            break
    return values[:k], found[:, :k]


def fit_basis(states: DataFrame, layer: int, n_components: int = 5, source: str = "prefill",
              source_traces: str = "") -> dict:
    """Mean, components and variance ratios of all vectors of a layer, right and wrong traces alike.

    Component signs are fixed so that the largest loading is positive.
    """
    rows = states.where(F.col("layer") == layer).select("vec")
    head = rows.agg(Summarizer.metrics("mean", "count", "variance").summary(array_to_vector(F.col("vec"))).alias("s")).select("s.*").first()
    n, mean = int(head["count"]), head["mean"].toArray()
    k = min(n_components, n - 1, mean.size)
    if k < 1:
        raise ValueError("at least two vectors are needed")
    if mean.size > k + EXTRA:
        rows = cut_lineage(rows)  # read in several passes
    values, columns = leading_directions(lambda q: _covariance_times(rows, mean, q) / (n - 1), mean.size, k)
    components = columns.T
    strongest = components[np.arange(k), np.abs(components).argmax(axis=1)]
    components = components * np.where(strongest < 0, -1.0, 1.0)[:, None]
    total = float(head["variance"].toArray().sum())
    ratios = np.maximum(values, 0.0) / total if total > 0 else np.zeros(k)
    return {"layer": layer, "source": source, "source_traces": source_traces, "n_fit_samples": n,
            "mean": mean.tolist(), "components": components.tolist(), "explained_variance_ratio": ratios.tolist()}


def basis_frame(spark: SparkSession, basis: dict) -> DataFrame:
    return spark.createDataFrame([tuple(basis[f] for f in PCA_BASIS.names)], PCA_BASIS)


def read_basis(spark: SparkSession, path: str, layer: int | None = None, source: str | None = None) -> dict:
    """A stored basis. Scores along a basis of another layer or axis mean nothing, hence the warning."""
    basis = spark.read.schema(PCA_BASIS).json(path).first().asDict()
    if layer is not None and basis["layer"] != layer:
        warnings.warn(f"basis is for layer {basis['layer']}, not {layer}", stacklevel=2)
    if source is not None and (basis["source"] or "prefill") != source:
        warnings.warn(f"basis is for {basis['source'] or 'prefill'} states, not {source}", stacklevel=2)
    return basis
