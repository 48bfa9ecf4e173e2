"""Benchmark result blobs: <root>/[results/bench/]<dataset>/[<split>/]<model>/**/<timestamp>.json."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import RESULT_BLOB, RESULT_FILE


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    p, fs = _hadoop_path(spark, path)
    return sorted((s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(p)) if fs.exists(p) else []


def find_dataset_dir(spark: SparkSession, root: str, dataset: str) -> str:
    """The first existing layout; the error names what is there instead."""
    root = root.rstrip("/")
    bases = [f"{root}/results/bench", root]
    for base in bases:
        p, fs = _hadoop_path(spark, f"{base}/{dataset}")
        if fs.exists(p):
            return f"{base}/{dataset}"
    seen = sorted({name for base in bases for name, is_dir in _children(spark, base) if is_dir})
    raise FileNotFoundError(f"dataset {dataset!r} not found below {root}; available: {seen}")


def find_model_dirs(spark: SparkSession, dataset_dir: str, split: str | None = None, layout: str = "auto") -> list[str]:
    """Model folders of a dataset, with or without a split level. Lists folders only, never data.

    Layout "auto": folders with JSON files directly inside are models, else the level is one of splits. "models": every
    folder is a model, whose files may lie in folders of their own (one per run). In a mixed level the folders with files
    are models and the others are named in a warning.
    """
    if layout not in ("auto", "models"):
        raise ValueError(f"unknown layout {layout!r}")
    folders = [name for name, is_dir in _children(spark, dataset_dir) if is_dir]
    if layout == "models":
        return [f"{dataset_dir}/{name}" for name in folders]

    def holds_json(name: str) -> bool:
        return any(n.endswith(".json") and not d for n, d in _children(spark, f"{dataset_dir}/{name}"))

    models = [name for name in folders if holds_json(name)]
    if models:
        if others := [name for name in folders if name not in models]:
            warnings.warn(f"folders with and without JSON files below {dataset_dir}: only those with some are models, "
                          f"not {others}", stacklevel=2)
        return [f"{dataset_dir}/{m}" for m in models]
    if not folders:
        return []
    if split is None:
        if len(folders) > 1:
            raise ValueError(f"several splits, name one of {folders}")
        split = folders[0]
    elif split not in folders:
        raise ValueError(f"split {split!r} not found, available: {folders}")
    below = f"{dataset_dir}/{split}"
    return [f"{below}/{name}" for name, is_dir in _children(spark, below) if is_dir]


def latest_per_model(files: DataFrame, path: str = "path") -> DataFrame:
    """For each model the alphabetically last file, i.e. the newest timestamp."""
    return files.groupBy("model").agg(F.max(path).alias(path))


def keep_latest(records: DataFrame, path: str = "path") -> DataFrame:
    """Records of the newest file of each model."""
    return records.join(latest_per_model(records.select("model", path), path), ["model", path], "left_semi")


def read_latest_records(spark: SparkSession, model_dirs: list[str]) -> DataFrame:
    """Records of the newest blob of each model. All blobs are listed, only the chosen ones are parsed."""
    parent = model_dirs[0].rstrip("/").rsplit("/", 1)[0]
    model = F.regexp_extract(F.col("path"), re.escape(parent) + "/([^/]+)/", 1)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.json").load(model_dirs).select("path")
    # one path per model folder; the folders were listed by the driver already
    chosen = [r["path"] for r in latest_per_model(listed.withColumn("model", model)).collect()]
    blobs = spark.read.schema(RESULT_FILE).option("multiLine", "true").json(chosen)
    # the scan reports its files as URIs; a plus sign is no blank in a path
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return blobs.select(plain.alias("path"), F.explode("records").alias("r")).select(
        model.alias("model"), *[F.col(f"r.{f.name}").cast(f.dataType).alias(f.name) for f in RESULT_BLOB["records"].dataType.elementType])
