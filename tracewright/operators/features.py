"""Fixed-width features of traces: early-layer statistics and vector pools."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.arrow import matrix
from .states import prefix


def unusable_rows(traces: DataFrame) -> DataFrame:
    """One row: all traces, and those that the feature operators leave out because their matrix is missing or empty."""
    return traces.agg(F.count(F.lit(1)).alias("n"),
                      F.count_if(F.coalesce(F.size("hidden_all_layers"), F.lit(0)) <= 0).alias("n_unusable"))


def early_trace_features(traces: DataFrame, fraction: float = 0.25, pca_slots: int = 10) -> DataFrame:
    """Mean, population std and max over the first layers of each row's matrix, as one vector.

    The last `pca_slots` entries are zero: the mean of centred component scores vanishes, the slots only
    keep the feature width. Row-local, hence no shuffle; only the first layers travel to the matrix kernel.
    """
    rows = traces.where(F.size("hidden_all_layers") > 0)
    keep = F.greatest(F.lit(1), F.floor(F.size("hidden_all_layers") * F.lit(float(fraction)))).cast("int")
    first = rows.withColumn("features", F.slice(F.col("hidden_all_layers"), F.lit(1), keep).cast("array<array<double>>")).drop(
        "hidden_all_layers")
    place = first.columns.index("features")
    schema = StructType([*first.schema[:place], StructField("features", ArrayType(DoubleType())), *first.schema[place + 1:]])

    def run(batches):
        for batch in batches:
            out = []
            for layers in batch.column(place):
                x = matrix(layers.values)
                out.append(np.concatenate([x.mean(axis=0), x.std(axis=0), x.max(axis=0), np.zeros(pca_slots)]))
            ends = np.concatenate([[0], np.cumsum([len(v) for v in out])]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.zeros(0)))
            yield pa.RecordBatch.from_arrays([made if i == place else c for i, c in enumerate(batch.columns)], names=schema.names)
    return first.mapInArrow(run, schema)


def mean_pool(states: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Element-wise mean per key. Partial means are merged, so a hot key costs one vector per task."""
    return states.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(F.col(vec))).alias("_m")).select(*keys, vector_to_array("_m").alias(vec))


def early_mean_pool(states: DataFrame, keys: list[str], fraction: float = 0.25) -> DataFrame:
    return mean_pool(prefix(states, fraction), keys)


def vector_moments(states: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Element-wise mean, population std and max per key."""
    stats = Summarizer.metrics("mean", "std", "max", "count").summary(array_to_vector(F.col(vec)))
    out = states.groupBy(*keys).agg(stats.alias("_s"))
    n = F.col("_s.count").cast("double")
    return out.select(
        *keys, vector_to_array("_s.mean").alias("mean"),
        F.transform(vector_to_array("_s.std"), lambda x: x * F.sqrt((n - 1) / n)).alias("std"),
        vector_to_array("_s.max").alias("max"))
