"""Queries that run as streams over the given tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..session import cut_lineage, fresh_path
from ..streaming import incremental as I
from . import bindings as B
from .collection import API_SQL
from .registry import query, rounded

LETTER = r"nullif(regexp_extract(raw_generation, '(^|[^\pL\pN_])([A-HJ])($|[^\pL\pN_])', 2), '')"


def _stream(spark, sf_dir, name):
    return I.table_stream(spark, f"{sf_dir}/{name}.parquet", B.table(spark, sf_dir, name).schema)


@query("stream_scored", f"""WITH {API_SQL}
SELECT qid, sample_idx, coalesce(CAST({LETTER} = substring('ABCDEFGHJ', CAST(qid % 9 + 1 AS INTEGER), 1) AS INTEGER), 0) AS correct,
       finish_reason FROM parsed WHERE error IS NULL""")
def stream_scored(spark, sf_dir):
    """Arriving chat turns, scored, deduplicated and appended; then the job is run once more and adds nothing."""
    turns = B.api_responses(spark, sf_dir, _stream(spark, sf_dir, "conversations"))
    truth = F.substring(F.lit("ABCDEFGHJ"), (F.col("qid") % 9 + 1).cast("int"), F.lit(1))
    questions = B.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid")).distinct().withColumn(
        "ground_truth", truth)
    out, state = fresh_path(spark, "scored"), fresh_path(spark, "state")
    for _ in range(2):
        I.scored_stream(turns, questions, out, state).awaitTermination()
    return spark.read.parquet(out).select("qid", "sample_idx", "correct", "finish_reason")


@query("stream_pass_rate", """
SELECT event_type AS model, count(*) AS n, CAST(sum(CAST(value > 34.59 AS INTEGER)) AS BIGINT) AS n_correct,
       round(avg(CAST(value > 34.59 AS INTEGER)), 6) AS pass_rate FROM events GROUP BY 1""")
def stream_pass_rate(spark, sf_dir):
    scored = _stream(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"), (F.col("value") > B.S_THRESHOLD).cast("int").alias("correct"))
    out, state = fresh_path(spark, "counts"), fresh_path(spark, "state")
    I.update_counts(I.running_pass_rates(scored), out, state).awaitTermination()
    return rounded(I.current_counts(spark, out))


DELAY_DAYS, ARRIVALS = 2, 5


def _arrivals_sql() -> str:
    """Batch by batch: rows behind the watermark are late; a key that is still held is a repeat; a held key goes once the
    watermark has passed its time by the delay. Late rows are told by the watermark of the batch before."""
    parts = [f"""numbered AS (
  SELECT user_id AS qid, CAST(event_id % 8 AS INTEGER) AS sample_idx, ts,
         least(row_number() OVER (PARTITION BY user_id, event_id % 8 ORDER BY ts, event_id), {ARRIVALS}) AS arrival FROM events),
marks AS (
  SELECT a.arrival, (SELECT max(ts) FROM numbered n WHERE n.arrival < a.arrival) - INTERVAL {DELAY_DAYS} DAY AS now,
         (SELECT max(ts) FROM numbered n WHERE n.arrival < a.arrival - 1) - INTERVAL {DELAY_DAYS} DAY AS before
  FROM (SELECT DISTINCT arrival FROM numbered) a),
held0 AS (SELECT 0::BIGINT AS qid, 0 AS sample_idx, NULL::TIMESTAMP AS until WHERE false)"""]
    for b in range(1, ARRIVALS + 1):
        parts.append(f"""new{b} AS (
  SELECT n.qid, n.sample_idx, n.arrival, n.ts FROM numbered n JOIN marks m USING (arrival)
  WHERE n.arrival = {b} AND (m.before IS NULL OR n.ts > m.before)
    AND NOT EXISTS (SELECT 1 FROM held{b - 1} h WHERE h.qid = n.qid AND h.sample_idx = n.sample_idx)),
held{b} AS (
  SELECT h.* FROM (SELECT * FROM held{b - 1} UNION ALL SELECT qid, sample_idx, ts + INTERVAL {DELAY_DAYS} DAY FROM new{b}) h,
         (SELECT now FROM marks WHERE arrival = {b}) m WHERE m.now IS NULL OR h.until > m.now)""")
    found = " UNION ALL ".join(f"SELECT DISTINCT qid, sample_idx, CAST(arrival AS INTEGER) AS arrival FROM new{b}" for b in range(1, ARRIVALS + 1))
    return "WITH " + ",\n".join(parts) + f"\n{found}"


@query("stream_first_arrivals", _arrivals_sql())
def stream_first_arrivals(spark, sf_dir):
    """The events of each key, one to a batch, and all from the fifth on in the last: repeats within two days are dropped,
    rows behind the watermark too, and a key that comes again later is new."""
    order = Window.partitionBy("qid", "sample_idx").orderBy("ts", "event_id")
    events = B.table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("qid"),
        (F.col("event_id") % 8).cast("int").alias("sample_idx")).withColumn(
        "arrival", F.least(F.row_number().over(order), F.lit(ARRIVALS)))
    events = cut_lineage(events)
    inbox = fresh_path(spark, "inbox")
    for b in range(1, ARRIVALS + 1):
        events.where(F.col("arrival") == b).coalesce(1).write.mode("append").parquet(inbox)
    stream = I.response_stream(spark, inbox, events.schema, files_per_trigger=1)
    out, state = fresh_path(spark, "arrivals"), fresh_path(spark, "state")
    (I.first_arrivals(stream, "ts", f"{DELAY_DAYS} days").writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out).select("qid", "sample_idx", "arrival")
