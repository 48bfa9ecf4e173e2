"""Table scans with declared schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas


def read_traces(spark: SparkSession, *paths: str, schema: StructType | None = None) -> DataFrame:
    """Trace files of one or several runs. `file_rank` tells which argument a row came from."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    parts = [reader.parquet(p).withColumn("file_rank", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def last_per_key(df: DataFrame, keys: list[str], rank: str = "file_rank") -> DataFrame:
    """Of repeated keys the row of the last file wins (of equal ranks one). Only keys and ranks are compared."""
    wins = df.groupBy(*keys).agg(F.max(rank).alias(rank))
    rest = [c for c in df.columns if c not in keys and c != rank]
    return df.join(wins, [*keys, rank], "left_semi").dropDuplicates(keys).select(*keys, *rest)


def read_states(spark: SparkSession, path: str, source: str, layers: list[int] | None = None) -> DataFrame:
    """States of one source, and of some layers; other folders are not read."""
    rows = spark.read.parquet(path).where(F.col("source") == source)
    return rows if layers is None else rows.where(F.col("layer").isin(layers))


def model_path(template: str, model: str) -> str:
    return template.format(model=model)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QUESTIONS).json(path)


def read_key_list(spark: SparkSession, path: str) -> DataFrame:
    """One question id per line; blank lines and repeats are dropped."""
    line = F.trim(F.col("value"))
    return spark.read.text(path).select(line.alias("qid")).where(F.col("qid") != "").distinct()


def done_keys(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Only the key columns of what an earlier run wrote."""
    return spark.read.parquet(path).select(*keys).distinct()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below a path; none if there is no such path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []
