"""Resumable scoring of arriving responses and running pass rates."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from ..sources.responses import parse_responses, score_responses, split_errors

KEYS = ("qid", "sample_idx")


def response_stream(spark, path: str, schema: StructType, pattern: str = "*.parquet",
                    files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def table_stream(spark, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """The rows of a parquet table that is one file, or a folder of part files."""
    p, fs = _path(spark, path)
    if fs.getFileStatus(p).isDirectory():
        return response_stream(spark, path, schema, files_per_trigger=files_per_trigger)
    return response_stream(spark, p.getParent().toString(), schema, p.getName(), files_per_trigger)


def first_arrivals(stream: DataFrame, time: str, delay: str = "1 hour", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Drop repeats of a key that arrive within `delay`; state older than that is forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def _path(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def side_car(out: str) -> str:
    return out.rstrip("/") + ".errors.jsonl"


def _written(attempts: DataFrame, questions: DataFrame, out: str, place: str, answer_type: str) -> None:
    """Results and failures of one batch, each in a folder of its own."""
    scored = score_responses(attempts, questions, answer_type).persist()
    try:
        results, errors = split_errors(scored)
        results.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{place}")
        errors.write.mode("overwrite").json(f"{side_car(out)}/{place}")
    finally:
        scored.unpersist()


def score_batch(batch: DataFrame, questions: DataFrame, out: str, run: str, batch_id: int,
                answer_type: str = "letter", keys: tuple[str, ...] = KEYS) -> None:
    """Score what is new in one stored batch, as `scored_stream` does with arriving ones; no state is kept.

    A batch that is repeated replaces its own folders, so nothing is written twice. Keys of other batches and of earlier
    runs are read from the output and skipped; failed keys stay open and are tried again. Of several answers to one key
    in a batch a usable one is taken, always the same.
    """
    spark = batch.sparkSession
    parsed = parse_responses(batch)
    rank = F.struct(F.col("error").isNotNull(), F.coalesce("raw_generation", "error"))
    others = [c for c in parsed.columns if c not in keys]
    fresh = parsed.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("_r")).select(*keys, "_r.*")
    if _exists(spark, out):
        done = spark.read.parquet(out).where((F.col("run") != run) | (F.col("batch_id") != batch_id))
        fresh = fresh.join(done.select(*keys), list(keys), "left_anti")
    _written(fresh, questions, out, f"run={run}/batch_id={batch_id}", answer_type)


class FirstUsable(StatefulProcessor):
    """The first usable answer to each key; a key with one is done, and one with failures only stays open.

    The state is one flag per key, forgotten after `retention_ms` if that is given.
    """

    def __init__(self, columns: list[str], retention_ms: int | None):
        self.columns, self.retention_ms = columns, retention_ms

    def init(self, handle) -> None:
        self.done = handle.getValueState("done", "seen boolean", self.retention_ms)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            return
        answers = pd.concat(list(rows))
        answers["_failed"] = answers["error"].notna()
        answers["_by"] = answers["raw_generation"].where(~answers["_failed"], answers["error"])
        first = answers.sort_values(["_failed", "_by"], kind="stable").iloc[:1]
        if not first["_failed"].iloc[0]:
            self.done.update((True,))
        yield first[self.columns]

    def handleInitialState(self, key, initial, timer_values) -> None:
        self.done.update((True,))

    def close(self) -> None:
        pass


@contextmanager
def _keyed_state(spark):
    """A query that starts inside keeps its state in RocksDB: on the executors' disks, with lookups by key."""
    name, want = "spark.sql.streaming.stateStore.providerClass", \
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, want)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _run_id(spark, checkpoint: str) -> str:
    """The query id in the checkpoint: the same after a restart, new with a new checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"])["id"]


def scored_stream(responses: DataFrame, questions: DataFrame, out: str, checkpoint: str, answer_type: str = "letter",
                  keys: tuple[str, ...] = KEYS, retention_ms: int | None = None) -> StreamingQuery:
    """Score everything that has arrived; a later call with the same checkpoint takes only what is new.

    Keys that have a result are known from the query's keyed state, so a batch reads its own responses and the state of
    its own keys, however much has been written before. Only a new checkpoint reads the output, once, to start from the
    keys in it. A batch that is repeated after a failure starts from the state before it and replaces its own folders.
    """
    spark = responses.sparkSession
    parsed = parse_responses(responses)
    stored = spark.read.parquet(out).select(*keys).distinct() if _exists(spark, out) else \
        spark.createDataFrame([], parsed.select(*keys).schema)
    mode = "processingTime" if retention_ms else "none"
    fresh = parsed.groupBy(*keys).transformWithStateInPandas(
        FirstUsable(parsed.columns, retention_ms), parsed.schema, "append", mode, stored.groupBy(*keys))

    def handle(batch: DataFrame, batch_id: int) -> None:
        run = _run_id(batch.sparkSession, checkpoint)
        _written(batch, questions, out, f"run={run}/batch_id={batch_id}", answer_type)
    with _keyed_state(spark):
        return (fresh.writeStream.outputMode("append").foreachBatch(handle)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def running_pass_rates(scored: DataFrame, key: str = "model") -> DataFrame:
    """Streaming counters per key."""
    return scored.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").cast("long").alias("n_correct"), F.avg("correct").alias("pass_rate"))


def _numbers(spark, path: str, prefix: str) -> list[int]:
    p, fs = _path(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and n.removeprefix(prefix).isdigit())


def _newest(rows: DataFrame, key: str) -> DataFrame:
    """The counters of each key in its last batch."""
    rest = [c for c in rows.columns if c not in (key, "batch_id")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r"), F.max("batch_id").alias("batch_id")).select(
        key, "_r.*", "batch_id")


def _stored_counts(spark, path: str) -> DataFrame:
    """The newest snapshot that a manifest names, and the batches after it."""
    root = path.rstrip("/")
    known = _numbers(spark, f"{root}/_manifest", "upto=")
    tail = [n for n in _numbers(spark, root, "batch_id=") if not known or n > known[-1]]
    parts = [spark.read.parquet(f"{root}/_snapshot/upto={known[-1]}")] if known else []
    if tail or not known:
        folders = [f"{root}/batch_id={n}" for n in tail] or [root]
        batches = spark.read.option("basePath", root).parquet(*folders)
        parts.append(batches.withColumn("batch_id", F.col("batch_id").cast("long")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact(spark, path: str, batch_id: int, key: str = "model") -> None:
    """Fold all batches up to `batch_id` into one snapshot, name it in a manifest, and drop what it replaces.

    The manifest is an empty file that appears at once, after the snapshot is whole: readers see the state before or after
    it. A snapshot without a manifest, left by a failure, is not read and is written anew. The snapshot before last and the
    batches in it go; those a reader may still have listed stay until the next time.
    """
    root = path.rstrip("/")
    known = _numbers(spark, f"{root}/_manifest", "upto=")
    if known and known[-1] >= batch_id:
        return
    _newest(_stored_counts(spark, root), key).write.mode("overwrite").parquet(f"{root}/_snapshot/upto={batch_id}")
    _commit(spark, root, batch_id)
    old = known[-1] if known else -1
    for n in _numbers(spark, root, "batch_id="):
        if n <= old:
            _drop(spark, f"{root}/batch_id={n}")
    for n in known[:-1]:
        _drop(spark, f"{root}/_manifest/upto={n}")
        _drop(spark, f"{root}/_snapshot/upto={n}")


def _commit(spark, root: str, batch_id: int) -> None:
    p, fs = _path(spark, f"{root}/_manifest/upto={batch_id}")
    fs.create(p, True).close()


def _drop(spark, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def update_counts(updates: DataFrame, path: str, checkpoint: str, key: str = "model", every: int = 50) -> StreamingQuery:
    """Write the counters each batch changed under its batch number; a repeated batch replaces its folder.

    Every `every` batches they are folded into a snapshot, so a reader meets one snapshot and a bounded tail.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
        if (batch_id + 1) % every == 0:
            compact(batch.sparkSession, path, batch_id, key)
    return (updates.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_counts(spark, path: str, key: str = "model") -> DataFrame:
    """The newest counters of each key."""
    return _newest(_stored_counts(spark, path), key).drop("batch_id")
