"""Logistic probes: one held-out probe, and cross-validated probes for all layers of a sweep at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..functions.arrow import matrix, vectors
from ..session import cut_lineage
from .ranking import auc
from .splits import group_split, stratified_folds

# Projections of a chunk of layers travel to every task; a sweep is cut into chunks that stay below this.
BASIS_BYTES = 256 << 20


# -- one held-out probe ----------------------------------------------------------------------------

def probe_predictions(rows: DataFrame, keys: list[str], label: str = "label", group: str = "qid",
                      fraction: float = 0.2, c: float = 1.0, seed: int = 42) -> DataFrame:
    """Fit on the training groups and return the test rows with `y_pred_prob`, keys attached."""
    split = cut_lineage(group_split(rows, group, fraction, seed, keys).select(
        *keys, label, "is_test", array_to_vector(F.col("features")).alias("features")))
    train = split.where(~F.col("is_test"))
    n_train = train.count()
    model = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (c * n_train),
                               elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-8).fit(train)
    scored = model.transform(split.where("is_test"))
    return scored.select(*keys, label, vector_to_array("probability")[1].alias("y_pred_prob"))


def probe_summary(predictions: DataFrame, label: str = "label") -> DataFrame:
    """One row: AUC on the test part and its class sizes. `auc` is NULL when the part has one class."""
    return auc(predictions, [], "y_pred_prob", label).select(
        "auc", (F.col("n_pos") + F.col("n_neg")).alias("n_test"), F.col("n_pos").alias("n_shared_test"))


# -- cross-validated sweep -------------------------------------------------------------------------

def _moment_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of [1, x] outer products per (layer, fold), one output row per matrix row; input sorted by (layer, fold)."""
    sums: dict[tuple[int, int], np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (layer, fold), g in sums.items():
            n = len(g)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, layer, np.int32)), pa.array(np.full(n, fold, np.int32)),
                 pa.array(np.arange(n, dtype=np.int32)), vectors(g)], ["layer", "fold", "i", "g"])
        sums.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        x = matrix(batch.column("vec"))
        x = np.hstack([np.ones((len(x), 1)), x])
        cell = np.stack([batch.column("layer").to_numpy(), batch.column("fold").to_numpy()], axis=1)
        for layer, fold in np.unique(cell, axis=0):
            part = x[(cell[:, 0] == layer) & (cell[:, 1] == fold)]
            key = (int(layer), int(fold))
            if sums and key not in sums:
                yield from flush()
            sums[key] = sums.get(key, 0.0) + part.T @ part
    yield from flush()


def _bases(k_max: int):
    """For each fold of a layer: the map x -> components of the scaled training part, as rows [b_j, P_j]."""
    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        by_fold = {f: np.stack(g.sort_values("i")["g"].to_numpy()) for f, g in group.groupby("fold")}
        total = sum(by_fold.values())
        for fold, own in by_fold.items():
            g = total - own
            n = g[0, 0]
            mean = g[0, 1:] / n
            cov = g[1:, 1:] / n - np.outer(mean, mean)
            var = np.diag(cov).copy()
            scale = np.sqrt(np.where(var > 1e-14 * np.maximum(np.diag(g)[1:] / n, 1e-300), var, 1.0))
            k = int(min(k_max, len(mean), n - 1))
            _, vecs = np.linalg.eigh(cov / np.outer(scale, scale))
            p = vecs[:, ::-1][:, :k].T / scale
            for j in range(k):
                out.append((int(key[0]), int(fold), j, np.r_[-p[j] @ mean, p[j]]))
        return pd.DataFrame(out, columns=["layer", "fold", "j", "p"])
    return solve


Z_SCHEMA = "layer int, fold int, held_out boolean, label array<int>, z array<double>"


def _project(broadcast):
    """Rows once per fold, in the component space of that fold's training part; one output row for a batch's rows of a cell.

    A cell's rows leave as one flat array: Newton's steps read them often, and would spend their time on single rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases = broadcast.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"))
            x = np.hstack([np.ones((len(x), 1)), x])
            layer, fold = batch.column("layer").to_numpy(), batch.column("fold").to_numpy()
            label = batch.column("label").to_numpy()
            for key in bases:
                for held_out in (False, True):
                    at = np.flatnonzero((layer == key[0]) & ((fold == key[1]) == held_out))
                    if len(at):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([held_out]),
                             pa.array([label[at]], pa.list_(pa.int32())), vectors((x[at] @ bases[key].T).reshape(1, -1))],
                            ["layer", "fold", "held_out", "label", "z"])
    return run


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """(cell, labels, components) of every row that `_project` made."""
    for i in range(batch.num_rows):
        y = batch.column("label")[i].values.to_numpy()
        z = batch.column("z")[i].values.to_numpy()
        yield (batch.column("layer")[i].as_py(), batch.column("fold")[i].as_py()), y, z.reshape(len(y), -1)


def _newton_parts(broadcast):
    """Per task and cell: loss, gradient and Hessian of the training rows, packed into one vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = broadcast.value
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for key, y, a in _pieces(batch):
                if key not in weights:
                    continue
                a = np.hstack([a, np.ones((len(a), 1))])
                eta = a @ weights[key]
                mu = 0.5 * (1.0 + np.tanh(0.5 * eta))
                loss = float(np.logaddexp(0.0, eta).sum() - (y * eta).sum())
                packed = np.r_[loss, a.T @ (mu - y), ((a * (mu * (1 - mu))[:, None]).T @ a).ravel()]
                sums[key] = sums.get(key, 0.0) + packed
        for key, packed in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), vectors(packed[None, :])],
                ["layer", "fold", "packed"])
    return run


def _fit_cells(train: DataFrame, width: dict[tuple[int, int], int], c: float, max_iter: int = 50,
               tol: float = 1e-8) -> dict[tuple[int, int], np.ndarray]:
    """Newton's method on all (layer, fold) cells together: one distributed sum per iteration.

    Minimises |w|^2 / 2 + c * logloss with a free intercept (last entry). Cells drop out once converged.
    """
    spark = train.sparkSession
    weights = {k: np.zeros(w + 1) for k, w in width.items()}
    best: dict[tuple[int, int], tuple[float, np.ndarray, np.ndarray]] = {}
    active = dict(weights)
    for _ in range(max_iter):
        if not active:
            break
        shared = spark.sparkContext.broadcast(active)
        parts = train.mapInArrow(_newton_parts(shared), "layer int, fold int, packed array<double>")
        summed = parts.groupBy("layer", "fold").agg(
            Summarizer.sum(array_to_vector(F.col("packed"))).alias("s")).collect()
        after = {}
        for row in summed:
            key, packed = (row["layer"], row["fold"]), row["s"].toArray()
            w = active[key]
            ridge = np.r_[np.ones(len(w) - 1), 0.0]
            value = c * packed[0] + 0.5 * (ridge * w * w).sum()
            if key in best and value > best[key][0] + 1e-12 * abs(best[key][0]):
                # overshot: half of the last step
                best_value, best_w, step = best[key]
                best[key] = (best_value, best_w, step / 2)
                after[key] = best_w + step / 2
                continue
            grad = c * packed[1:1 + len(w)] + ridge * w
            hess = c * packed[1 + len(w):].reshape(len(w), len(w)) + np.diag(ridge)
            step = -np.linalg.lstsq(hess, grad, rcond=None)[0]
            weights[key] = w
            best[key] = (value, w, step)
            if np.abs(step).max() > tol:
                after[key] = w + step
        active = after
        shared.unpersist()
    for key, w in active.items():
        weights[key] = w
    return weights


def _held_out_scores(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = broadcast.value
        for batch in batches:
            for key, y, a in _pieces(batch):
                layer, fold = (pa.array(np.full(len(y), k, np.int32)) for k in key)
                yield pa.RecordBatch.from_arrays(
                    [layer, fold, pa.array(y), pa.array(a @ weights[key][:-1] + weights[key][-1])], ["layer", "fold", "label", "score"])
    return run


def cv_sweep(states: DataFrame, labels: DataFrame, keys: list[str], label: str = "label", components: int = 50,
             folds: int = 5, seed: int = 3407, c: float = 1.0) -> DataFrame:
    """Mean held-out AUC per layer: scale, project on principal components, logistic probe, k folds.

    The folds are dealt once over the rows and shared by all layers. One pass sums the moments of all
    (layer, fold) parts, training parts being differences of those sums; a second pass projects; then every
    Newton iteration is one job for all cells. Nothing but width-sized sums reaches a single task. `keys` must
    be unique in `labels`. Labels of one class give NULL.
    """
    spark = states.sparkSession
    labels = cut_lineage(labels.select(*keys, label))  # counted, numbered and joined below
    classes = [r["count"] for r in labels.groupBy(label).count().limit(3).collect()]
    if len(classes) < 2:
        return states.select("layer").distinct().withColumn("auc", F.lit(None).cast("double")).withColumn(
            "n_folds", F.lit(0).cast("long"))
    if min(classes) < 2:
        raise ValueError("every class needs at least two rows")
    assigned = cut_lineage(stratified_folds(labels, keys, label, folds, seed).withColumnRenamed(label, "label"))
    rows = cut_lineage(states.join(assigned, keys).select(
        "layer", "fold", F.col("label").cast("int").alias("label"), "vec"))
    # a task gets rows of few cells, so about one matrix leaves it; one cell is shared by several tasks if there are few
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = rows.select("layer").distinct().count() * folds
    salt = F.pmod(F.xxhash64("vec"), F.lit(-(-parts // max(cells, 1))))
    dealt = rows.repartition(parts, "layer", "fold", salt).sortWithinPartitions("layer", "fold")
    moments = dealt.mapInArrow(_moment_parts, "layer int, fold int, i int, g array<double>").groupBy(
        "layer", "fold", "i").agg(Summarizer.sum(array_to_vector(F.col("g"))).alias("s")).select(
        "layer", "fold", "i", vector_to_array("s").alias("g"))
    solved = cut_lineage(moments.groupBy("layer").applyInPandas(
        _bases(components), "layer int, fold int, j int, p array<double>"))
    sizes = solved.groupBy("layer").agg((F.sum(F.size("p")) * 8).alias("bytes")).orderBy("layer").collect()
    out = None
    for chunk in _chunks([(r["layer"], r["bytes"]) for r in sizes]):
        part = _sweep_chunk(spark, rows.where(F.col("layer").isin(chunk)), solved.where(F.col("layer").isin(chunk)), c)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("states and labels have no keys in common")
    return out


def _chunks(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    chunk, held = [], 0
    for layer, size in sizes:
        if chunk and held + size > BASIS_BYTES:
            yield chunk
            chunk, held = [], 0
        chunk.append(layer)
        held += size
    if chunk:
        yield chunk


def _sweep_chunk(spark, rows: DataFrame, solved: DataFrame, c: float) -> DataFrame:
    fetched = solved.orderBy("layer", "fold", "j").toArrow().combine_chunks()
    at = np.stack([fetched["layer"].to_numpy(), fetched["fold"].to_numpy()], axis=1)
    bases = {}
    for layer, fold in np.unique(at, axis=0):
        own = np.flatnonzero((at[:, 0] == layer) & (at[:, 1] == fold))
        bases[int(layer), int(fold)] = np.stack([fetched["p"][int(i)].values.to_numpy() for i in own])
    shared = spark.sparkContext.broadcast(bases)
    z = rows.mapInArrow(_project(shared), Z_SCHEMA).persist()
    try:
        weights = _fit_cells(z.where(~F.col("held_out")), {k: len(v) for k, v in bases.items()}, c)
        fitted = spark.sparkContext.broadcast(weights)
        scores = z.where("held_out").mapInArrow(_held_out_scores(fitted), "layer int, fold int, label int, score double")
        per_fold = auc(scores, ["layer", "fold"], "score", "label")
        return cut_lineage(per_fold.groupBy("layer").agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_folds")))
    finally:
        z.unpersist()
        shared.unpersist()


def best_cell(results: DataFrame, cell: str = "layer", value: str = "auc") -> DataFrame:
    """The cell of the largest defined value; the first one on ties."""
    return results.where(F.col(value).isNotNull()).agg(
        F.max_by(F.struct(cell, value), F.struct(F.col(value), -F.col(cell))).alias("_b")).select(
        F.col(f"_b.{cell}").alias(f"best_{cell}"), F.col(f"_b.{value}").alias(f"best_{value}"))
