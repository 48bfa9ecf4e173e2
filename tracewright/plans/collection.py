"""Queries on scoring, curation and the bookkeeping of a collection run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import curation as C
from ..sources import blobs, responses as R
from ..sources.tables import last_per_key
from . import bindings as B
from .registry import query, rounded

# RE2 has no look-around, hence the consuming form of the same letter pattern.
LETTER_SQL = r"nullif(regexp_extract(text, '(^|[^\pL\pN_])([A-HJ])($|[^\pL\pN_])', 2), '')"
NUMBER_SQL = r"""coalesce(nullif(regexp_extract(text, '\\boxed\{(-?\d+)\}', 1), ''),
  nullif(regexp_extract(text, '(?i)(?:answer is|answer:|final answer:?)\s*\$?(-?\d+)\$?', 1), ''),
  regexp_extract_all(text, '-?\d+')[-1])"""


@query("score_letter", f"""
WITH found AS (SELECT doc_id AS qid, {LETTER_SQL} AS answer, substring('ABCDEFGHJ', CAST(doc_id % 9 + 1 AS INTEGER), 1) AS truth
               FROM documents)
SELECT qid, answer, coalesce(CAST(answer = truth AS INTEGER), 0) AS correct FROM found""")
def score_letter(spark, sf_dir):
    return B.responses(spark, sf_dir).select(
        "qid", X.extracted(F.col("raw_generation"), F.col("truth_letter")).alias("x")).select("qid", "x.answer", "x.correct")


@query("score_numeric", f"""
WITH found AS (SELECT doc_id AS qid, {NUMBER_SQL} AS answer, doc_id % 10 AS truth FROM documents)
SELECT qid, answer, coalesce(CAST(TRY_CAST(answer AS DECIMAL(38, 0)) = truth AS INTEGER), 0) AS correct FROM found""")
def score_numeric(spark, sf_dir):
    return B.responses(spark, sf_dir).select(
        "qid", X.extracted(F.col("raw_generation"), F.col("truth_number"), "numeric").alias("x")).select(
        "qid", "x.answer", "x.correct")


@query("truncation_summary", """
SELECT lang AS model, count(*) AS n, count(*) FILTER (WHERE n_chars > 4000) AS n_length,
       count(*) FILTER (WHERE n_chars >= 8000) AS n_hit_max
FROM documents GROUP BY 1""")
def truncation_summary(spark, sf_dir):
    return B.responses(spark, sf_dir).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("finish_reason") == "length").alias("n_length"),
        F.count_if(X.truncated(F.col("n_chars"), F.lit(8000))).alias("n_hit_max"))


API_SQL = """api AS (
  SELECT conv_id AS qid, CAST(turn AS INTEGER) AS sample_idx,
         CASE turn % 4 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 401 END AS status,
         CASE WHEN role IN ('assistant', 'user') THEN nullif(text, '') END AS answer,
         CASE WHEN length(text) > 500 THEN 'length' ELSE 'stop' END AS reason
  FROM conversations),
parsed AS (
  SELECT qid, sample_idx, CASE WHEN status = 200 THEN 'ok' WHEN status IN (429, 500, 502, 503, 504) THEN 'retryable'
                               ELSE 'fatal' END AS status_class,
         CASE WHEN status = 200 THEN answer END AS raw_generation,
         CASE WHEN status = 200 AND answer IS NOT NULL THEN reason END AS finish_reason,
         CASE WHEN status <> 200 THEN 'HTTP ' || status WHEN answer IS NULL THEN 'response without text' END AS error
  FROM api)"""


@query("response_text", f"""WITH {API_SQL}
SELECT qid, sample_idx, status_class, raw_generation, finish_reason, error FROM parsed""")
def response_text(spark, sf_dir):
    return R.parse_responses(B.api_responses(spark, sf_dir)).select(
        "qid", "sample_idx", "status_class", "raw_generation", "finish_reason", "error")


@query("response_status", f"WITH {API_SQL} SELECT status_class, count(*) AS n FROM parsed GROUP BY 1")
def response_status(spark, sf_dir):
    return B.api_responses(spark, sf_dir).groupBy(
        R.status_class(F.col("status")).alias("status_class")).agg(F.count(F.lit(1)).alias("n"))


@query("run_counters", f"""WITH {API_SQL}
SELECT count(*) AS processed, count(*) FILTER (WHERE error IS NULL) AS succeeded,
       count(*) FILTER (WHERE error IS NOT NULL) AS failed,
       count(*) FILTER (WHERE error IS NULL AND finish_reason = 'length') AS truncated,
       (SELECT count(*) FROM parsed d, (VALUES (4)) s(n) WHERE d.sample_idx % s.n = 1) AS skipped
FROM parsed WHERE sample_idx % 4 <> 1""")
def run_counters(spark, sf_dir):
    """Counters of a run that finds every fourth turn done already."""
    turns = R.parse_responses(B.api_responses(spark, sf_dir))
    done = turns.where("sample_idx % 4 = 1").select("qid", "sample_idx")
    return C.run_counters(turns, done)


@query("error_side_car", f"WITH {API_SQL} SELECT qid, sample_idx, error FROM parsed WHERE error IS NOT NULL")
def error_side_car(spark, sf_dir):
    return R.split_errors(R.parse_responses(B.api_responses(spark, sf_dir)).withColumn("correct", F.lit(0)))[1]


RECORDS_SQL = """records AS (
  SELECT event_type AS model, event_type || '/' || strftime(ts, '%Y%m%d') || '.json' AS path,
         CASE WHEN event_id % 17 <> 0 THEN user_id END AS qid,
         coalesce(CASE WHEN event_id % 3 = 0 THEN props END, 'q' || user_id) AS query,
         CAST(user_id * 3 AS VARCHAR) AS ground_truth, value / 100.0 AS score FROM events),
latest AS (SELECT model, max(path) AS path FROM records GROUP BY model)"""


def _records(spark, sf_dir):
    """Benchmark records as a file scan yields them: one file per model and day, some without index or prompt."""
    return B.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"),
        F.concat("event_type", F.lit("/"), F.date_format("ts", "yyyyMMdd"), F.lit(".json")).alias("path"),
        F.when(F.col("event_id") % 17 != 0, F.col("user_id")).alias("index"),
        F.when(F.col("event_id") % 3 != 0, F.lit("")).otherwise(F.col("props")).alias("prompt"),
        F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("origin_query"),
        (F.col("user_id") * 3).cast("string").alias("ground_truth"), (F.col("value") / 100.0).alias("score"))


@query("latest_blob_records", f"""WITH {RECORDS_SQL}
SELECT r.model, r.qid, r.query, r.ground_truth, CAST(r.score > 0.5 AS INTEGER) AS correct
FROM records r JOIN latest USING (model, path) WHERE r.qid IS NOT NULL AND r.query IS NOT NULL AND r.score IS NOT NULL""")
def latest_blob_records(spark, sf_dir):
    return C.pool_records(blobs.keep_latest(_records(spark, sf_dir)))


@query("pool_labels", f"""WITH {RECORDS_SQL}
SELECT model, qid, CAST(score > 0.5 AS INTEGER) AS correct FROM records WHERE qid IS NOT NULL""")
def pool_labels(spark, sf_dir):
    return C.pool_records(_records(spark, sf_dir)).select("model", "qid", "correct")


@query("pool_labels_first_keys", f"""WITH {RECORDS_SQL}
SELECT model, qid, CAST(score > 0.5 AS INTEGER) AS correct FROM records WHERE qid IN
  (SELECT DISTINCT qid FROM records WHERE qid IS NOT NULL ORDER BY qid LIMIT 40)""")
def pool_labels_first_keys(spark, sf_dir):
    """The limit is the operator here: labels of the first 40 questions."""
    records = C.pool_records(_records(spark, sf_dir))
    return C.keep_keys(records, C.first_keys(records, 40)).select("model", "qid", "correct")


@query("curated_questions", f"""WITH {RECORDS_SQL}
SELECT qid, arg_min(query, (model, query)) AS query, any_value(ground_truth) AS ground_truth
FROM records WHERE qid IS NOT NULL GROUP BY qid""")
def curated_questions(spark, sf_dir):
    return C.pool_questions(C.pool_records(_records(spark, sf_dir)))


RAW_SQL = r"""WITH raw AS (
  SELECT item_id AS id, text AS problem,
         CASE WHEN item_id % 3 = 0 THEN ' ' || item_id || ' ' WHEN item_id % 3 = 1 THEN item_id || '.5'
              ELSE '-' || item_id END AS answer FROM benchmark {limit})
SELECT 'aime_' || id AS qid, problem AS query, trim(answer) AS ground_truth FROM raw
WHERE regexp_full_match(trim(answer), '[+-]?\d+')"""


def _raw_questions(spark, sf_dir):
    sid = F.col("item_id").cast("string")
    return B.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text").alias("problem"),
        F.when(F.col("item_id") % 3 == 0, F.concat(F.lit(" "), sid, F.lit(" ")))
        .when(F.col("item_id") % 3 == 1, F.concat(sid, F.lit(".5")))
        .otherwise(F.concat(F.lit("-"), sid)).alias("answer"))


@query("integer_answer_questions", RAW_SQL.replace("{limit}", ""))
def integer_answer_questions(spark, sf_dir):
    return C.curate_raw_questions(_raw_questions(spark, sf_dir))


@query("integer_answer_questions_limited", RAW_SQL.replace("{limit}", "ORDER BY item_id LIMIT 25"))
def integer_answer_questions_limited(spark, sf_dir):
    """The limit is taken before the answer filter."""
    return C.curate_raw_questions(_raw_questions(spark, sf_dir), limit=25)


QUESTIONS_SQL = """questions AS (SELECT 'item_' || item_id AS qid, item_id FROM benchmark),
done AS (SELECT DISTINCT 'item_' || (user_id % 40) AS qid, CAST(event_id % 8 AS INTEGER) AS sample_idx FROM events
         WHERE event_type = 'view' AND user_id % 3 > 0 AND event_id % 5 < 2)"""


def _done(spark, sf_dir):
    return B.table(spark, sf_dir, "events").where("event_type = 'view' and user_id % 3 > 0 and event_id % 5 < 2").select(
        F.concat(F.lit("item_"), (F.col("user_id") % 40).cast("string")).alias("qid"),
        (F.col("event_id") % 8).cast("int").alias("sample_idx"))


@query("work_grid_pending", f"""WITH {QUESTIONS_SQL}
SELECT q.qid, CAST(i AS INTEGER) AS sample_idx FROM questions q, range(8) r(i)
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.qid = q.qid AND d.sample_idx = i)""")
def work_grid_pending(spark, sf_dir):
    return C.pending_work(B.questions(spark, sf_dir).select("qid"), 8, _done(spark, sf_dir))


SHARD_SQL = """shards AS (
  SELECT qid, CAST((row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws(':', qid, '0')), 1, 8))::BIGINT, qid) - 1) % 4
              AS INTEGER) AS shard FROM questions)"""


@query("shard_counts", f"WITH {QUESTIONS_SQL}, {SHARD_SQL} SELECT shard, count(*) AS n FROM shards GROUP BY shard")
def shard_counts(spark, sf_dir):
    return C.shard(B.questions(spark, sf_dir).select("qid"), ["qid"], 4).groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"))


@query("capped_key_selection", f"""WITH {QUESTIONS_SQL}, {SHARD_SQL},
picked AS (SELECT s.qid FROM shards s WHERE shard = 1 ORDER BY s.qid LIMIT 6)
SELECT qid FROM picked WHERE qid NOT IN (SELECT qid FROM done WHERE sample_idx = 3)""")
def capped_key_selection(spark, sf_dir):
    done = _done(spark, sf_dir).where("sample_idx = 3").select("qid")
    return C.select_work(B.questions(spark, sf_dir).select("qid"), n_shards=4, index=1, limit=6, done=done)


@query("cohort_semi", """
SELECT doc_id AS qid, lang AS model FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def cohort_semi(spark, sf_dir):
    keys = B.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("qid"))
    return C.keep_keys(B.responses(spark, sf_dir).select("qid", "model"), keys)


@query("last_file_wins", """
WITH runs AS (SELECT user_id AS qid, event_id % 3 AS file_rank, max(value) AS value FROM events GROUP BY 1, 2)
SELECT qid, round(arg_max(value, file_rank), 6) AS value FROM runs GROUP BY qid""")
def last_file_wins(spark, sf_dir):
    runs = B.table(spark, sf_dir, "events").groupBy(
        F.col("user_id").alias("qid"), (F.col("event_id") % 3).alias("file_rank")).agg(F.max("value").alias("value"))
    return rounded(last_per_key(runs, ["qid"]))


@query("unioned_runs", """
SELECT 'first' AS run, count(*) AS n, count(value) AS n_scored FROM events WHERE event_id % 2 = 0
UNION ALL SELECT 'second', count(*), 0 FROM events WHERE event_id % 2 = 1""")
def unioned_runs(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    first = e.where("event_id % 2 = 0").select("event_id", "value").withColumn("run", F.lit("first"))
    second = e.where("event_id % 2 = 1").select("event_id").withColumn("run", F.lit("second"))
    return first.unionByName(second, allowMissingColumns=True).groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_scored"))
