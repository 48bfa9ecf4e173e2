"""Queries that write given tables as the files a collection run leaves, and read those back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import curation as C, features as FE, labels as L, states as S
from ..sources import blobs, responses as R, sinks, tables
from ..session import fresh_path
from . import bindings as B
from .collection import API_SQL, _done
from .evaluate import Evaluation, evaluate
from .registry import query, rounded
from .sql_parts import SINGLE_LABELS, W_DECODE, W_SINGLE, s_rate, with_

BLOB_SQL = """blob AS (
  SELECT event_type AS model, strftime(ts, '%Y%m%d') AS run, CASE WHEN event_id % 17 <> 0 THEN 'u' || user_id END AS qid,
         CASE WHEN event_id % 3 = 0 THEN 'p' || user_id ELSE 'q' || user_id END AS query, CAST(user_id * 3 AS VARCHAR) AS ground_truth,
         CASE event_id % 4 WHEN 0 THEN value / 100 WHEN 1 THEN round(value / 100, 3) WHEN 2 THEN CAST(value > 34.59 AS INTEGER)::DOUBLE END AS score
  FROM events),
latest AS (SELECT model, max(run) AS run FROM blob GROUP BY model)"""


def _documents(spark, sf_dir):
    """Scores of every kind, one document per model and day."""
    value = F.col("value") / 100
    score = (F.when(F.col("event_id") % 4 == 0, value.cast("string"))
             .when(F.col("event_id") % 4 == 1, F.concat(F.lit('" '), F.round(value, 3).cast("string"), F.lit('"')))
             .when(F.col("event_id") % 4 == 2, F.when(F.col("value") > B.S_THRESHOLD, "true").otherwise("false"))
             .otherwise('"not scored"'))
    record = F.struct(
        F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("index"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("p"), F.col("user_id").cast("string"))).otherwise("").alias("prompt"),
        F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("origin_query"),
        (F.col("user_id") * 3).cast("string").alias("ground_truth"), F.parse_json(score).alias("score"))
    return B.table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("model"), F.date_format("ts", "yyyyMMdd").alias("run")).agg(F.collect_list(record).alias("records"))


def _blobs(spark, sf_dir):
    """<root>/results/bench/pool/model=<m>/run=<day>/*.json: one document per model and day."""
    root = fresh_path(spark, "blobs")
    _documents(spark, sf_dir).write.partitionBy("model", "run").json(f"{root}/results/bench/pool")
    found = blobs.find_dataset_dir(spark, root, "pool")
    records = blobs.read_latest_records(spark, blobs.find_model_dirs(spark, found, layout="models"))
    return records.withColumn("model", F.regexp_replace("model", "^model=", ""))


@query("files_blob_records", f"""WITH {BLOB_SQL}
SELECT model, qid, query, ground_truth, CAST(score > 0.5 AS INTEGER) AS correct
FROM blob JOIN latest USING (model, run) WHERE qid IS NOT NULL AND score IS NOT NULL""")
def files_blob_records(spark, sf_dir):
    return C.pool_records(_blobs(spark, sf_dir))


@query("files_blob_leftovers", f"""WITH {BLOB_SQL}
SELECT model, count(*) AS n, count(*) FILTER (WHERE qid IS NULL) AS no_qid, 0::BIGINT AS no_query,
       count(*) FILTER (WHERE score IS NULL) AS no_score FROM blob JOIN latest USING (model, run) GROUP BY model""")
def files_blob_leftovers(spark, sf_dir):
    return C.unusable_records(_blobs(spark, sf_dir))


@query("files_split_records", f"""WITH {BLOB_SQL}
SELECT model, qid, query, ground_truth, CAST(score > 0.5 AS INTEGER) AS correct
FROM blob WHERE qid IS NOT NULL AND score IS NOT NULL AND run = (SELECT min(run) FROM blob)""")
def files_split_records(spark, sf_dir):
    """<root>/pool/<split>/<model>/*.json, one split per day, the first one read: files lie directly in a model's folder."""
    root = fresh_path(spark, "blobs")
    _documents(spark, sf_dir).write.partitionBy("run", "model").json(f"{root}/pool")
    found = blobs.find_dataset_dir(spark, root, "pool")
    split = tables.folders(spark, found)[0]
    models = blobs.find_model_dirs(spark, found, split)
    records = blobs.read_latest_records(spark, models)
    return C.pool_records(records.withColumn("model", F.regexp_replace("model", "^model=", "")))


@query("files_questions", """
SELECT 'item_' || item_id AS qid, text AS query, CAST((item_id * 7) % 1000 AS VARCHAR) AS ground_truth FROM benchmark""")
def files_questions(spark, sf_dir):
    path = fresh_path(spark, "questions")
    sinks.write_questions(B.questions(spark, sf_dir), path)
    return tables.read_questions(spark, path)


@query("files_key_list", """
SELECT DISTINCT CAST(doc_id AS VARCHAR) AS qid, lang AS model FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def files_key_list(spark, sf_dir):
    """A list with blank lines, padding and repeats."""
    path = fresh_path(spark, "keys")
    keys = B.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("k"))
    lines = keys.select(F.explode(F.array("k", F.concat(F.lit("  "), "k", F.lit(" ")), F.lit(""))).alias("value"))
    lines.write.text(path)
    docs = B.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("qid"), F.col("lang").alias("model"))
    return C.keep_keys(docs, tables.read_key_list(spark, path)).distinct()


DONE_SQL = """questions AS (SELECT 'item_' || item_id AS qid, item_id FROM benchmark),
done AS (SELECT DISTINCT 'item_' || (user_id % 40) AS qid, CAST(event_id % 8 AS INTEGER) AS sample_idx FROM events
         WHERE event_type = 'view' AND user_id % 3 > 0 AND event_id % 5 < 2)"""


@query("files_resume", f"""WITH {DONE_SQL}
SELECT q.qid, CAST(i AS INTEGER) AS sample_idx FROM questions q, range(8) r(i)
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.qid = q.qid AND d.sample_idx = i)""")
def files_resume(spark, sf_dir):
    """What two appended runs have not done yet; only the key columns of their table are read."""
    path = fresh_path(spark, "samples")
    done = _done(spark, sf_dir).withColumn("raw_generation", F.lit("x"))
    sinks.append_table(done.where("sample_idx < 4"), path)
    sinks.append_table(done.where("sample_idx >= 4"), path)
    return C.pending_work(B.questions(spark, sf_dir).select("qid"), 8, tables.done_keys(spark, path, ["qid", "sample_idx"]))


@query("files_skip_questions", f"""WITH {DONE_SQL}
SELECT qid FROM questions WHERE qid NOT IN (SELECT qid FROM done WHERE sample_idx = 3)""")
def files_skip_questions(spark, sf_dir):
    path = fresh_path(spark, "samples")
    sinks.append_table(_done(spark, sf_dir).where("sample_idx = 3"), path)
    return C.skip_keys(B.questions(spark, sf_dir).select("qid"), tables.done_keys(spark, path, ["qid"]))


@query("files_error_side_car", f"WITH {API_SQL} SELECT qid, sample_idx, error FROM parsed WHERE error IS NOT NULL")
def files_error_side_car(spark, sf_dir):
    errors = R.split_errors(R.parse_responses(B.api_responses(spark, sf_dir)).withColumn("correct", F.lit(0)))[1]
    out = fresh_path(spark, "run")
    for odd in (0, 1):
        side_car = sinks.append_errors(errors.where(F.col("qid") % 2 == odd), out)
    return spark.read.schema("qid long, sample_idx int, error string").json(side_car)


@query("files_result_document", with_(W_SINGLE, s_rate(), SINGLE_LABELS, body="""
SELECT 'cells' AS kind, '{"label":' || label || ',"n":' || count(*) || '}' AS document FROM labelled GROUP BY label"""))
def files_result_document(spark, sf_dir):
    cells = L.outcome_cells(L.label_outcomes(B.w_single(spark, sf_dir).drop("hidden_all_layers"), L.pass_stats(B.s_samples(spark, sf_dir))))
    path = fresh_path(spark, "result")
    sinks.write_result(cells.withColumn("debug", F.lit("left out")), path, ["debug"])
    return sinks.result_document(spark.read.schema("label int, n long").json(path), "cells")


@query("missing_columns", """
SELECT 'insufficient_data' AS status, ['answer', 'problem'] AS missing, count(*) AS n FROM benchmark""")
def missing_columns(spark, sf_dir):
    """Status row of a table without the columns that a step needs."""
    rows = B.table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id")
    missing = C.require_columns(rows, {"id", "problem", "answer"})
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("insufficient_data" if missing else "ok").alias("status"), F.array(*[F.lit(m) for m in missing]).alias("missing"), "n")


@query("missing_strong_half", with_(W_SINGLE, s_rate(), body="""
SELECT DISTINCT qid FROM w_single WHERE qid NOT IN (SELECT qid FROM s_rate WHERE qid % 2 = 0)"""))
def missing_strong_half(spark, sf_dir):
    """Strict lookup against samples of every other question."""
    stats = L.pass_stats(B.s_samples(spark, sf_dir)).where("qid % 2 = 0")
    return L.missing_strong_questions(B.w_single(spark, sf_dir).drop("hidden_all_layers"), stats)


@query("files_evaluation", with_(W_SINGLE, s_rate(), SINGLE_LABELS, """stored AS (
  SELECT l.qid, l.sample_idx, l.label, e.label IN (2, 5) AS unusable
  FROM labelled l JOIN embeddings e ON e.vec_id = 5 * l.qid + l.sample_idx),
groups AS (SELECT DISTINCT qid FROM stored WHERE NOT unusable),
numbered AS (
  SELECT qid, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws(':', qid, '42')), 1, 8))::BIGINT, qid) - 1 AS rn,
         count(*) OVER () AS total FROM groups),
tested AS (SELECT s.* FROM stored s JOIN numbered n USING (qid) WHERE NOT unusable AND rn < ceil(0.2 * total))""", body="""
SELECT count(*) AS n_labelled, count(*) FILTER (WHERE unusable) AS n_unusable, (SELECT count(*) FROM tested) AS n_test,
       (SELECT CAST(sum(label) AS BIGINT) FROM tested) AS n_shared_test, 'ok' AS gate, (SELECT count(*) FROM tested) AS n_predictions,
       1::BIGINT AS n_verdicts, 'core verdict' AS documents FROM stored"""))
def files_evaluation(spark, sf_dir):
    """A whole run on matrices stored as text, some of them broken, written as tables and documents and read back."""
    broken = B.table(spark, sf_dir, "embeddings").where("label in (2, 5)").select(
        F.expr("vec_id div 5").alias("qid"), (F.col("vec_id") % 5).cast("int").alias("sample_idx"), F.lit(True).alias("broken"))
    text = F.to_json(F.col("hidden_all_layers"))
    cut = F.when(F.col("sample_idx") % 2 == 0, F.substring(text, F.lit(1), F.length(text) - 3))  # cut off, or missing
    traces = B.w_single(spark, sf_dir).join(broken, ["qid", "sample_idx"], "left").withColumn(
        "hidden_all_layers", F.when(F.col("broken"), cut).otherwise(text)).drop("broken")
    path = fresh_path(spark, "evaluation")
    evaluate(traces, B.s_samples(spark, sf_dir), interval=False).write(path)
    run = Evaluation.read(spark, path)
    named = spark.read.json([f"{path}/documents/core", f"{path}/documents/verdict"])
    more = run.predictions.agg(F.count(F.lit(1)).alias("n_predictions")).crossJoin(
        run.verdict.agg(F.count(F.lit(1)).alias("n_verdicts"))).crossJoin(
        named.agg(F.array_join(F.sort_array(F.collect_set("kind")), " ").alias("documents")))
    return run.core.select("n_labelled", "n_unusable", "n_test", "n_shared_test", "gate").crossJoin(more)


@query("unusable_feature_rows", """
SELECT count(*) AS n, count(*) FILTER (WHERE label IN (2, 5)) AS n_unusable FROM embeddings""")
def unusable_feature_rows(spark, sf_dir):
    """Rows without a matrix, or with an empty one, are left out of features; this counts them."""
    layers = F.when(F.col("label") == 2, F.array().cast("array<array<float>>")).when(F.col("label") != 5, F.array("embedding"))
    return FE.unusable_rows(B.table(spark, sf_dir, "embeddings").select(layers.alias("hidden_all_layers")))


def _stored_decode(spark, sf_dir):
    """Nested generation traces in two files; the second repeats every third trace with other step numbers."""
    steps = B.decode_steps(spark, sf_dir).groupBy("qid", "n_new_tokens").agg(
        F.sort_array(F.collect_list(F.struct("pos", "step_index", "layers"))).alias("s"))
    nested = steps.select(
        F.col("qid").cast("string").alias("qid"), "n_new_tokens", F.lit(8).alias("num_layers_incl_embed"),
        F.transform("s", lambda x: F.transform(F.array(F.lit(0), F.lit(3), F.lit(7)), lambda l: x["layers"][l])).alias("decode_hidden_states_by_step"),
        F.transform("s", lambda x: x["step_index"]).alias("decode_step_indices"),
        F.array(F.lit(0), F.lit(3), F.lit(-1)).alias("decode_layers_captured"))
    paths = [fresh_path(spark, "traces") for _ in range(2)]
    nested.write.parquet(paths[0])
    nested.where("cast(qid as int) % 3 = 0").withColumn(
        "decode_step_indices", F.transform("decode_step_indices", lambda i: i + 1)).write.parquet(paths[1])
    return tables.last_per_key(tables.read_traces(spark, *paths, schema=schemas.TRACE_DECODE), ["qid"])


@query("files_decode_states", with_(W_DECODE, """steps AS (
  SELECT e.vec_id // 20 AS qid, CAST(e.vec_id % 20 AS INTEGER) AS pos, w.n_steps, e.embedding
  FROM embeddings e JOIN w_decode w ON w.qid = e.vec_id // 20)""", body="""
SELECT CAST(qid AS VARCHAR) AS qid, l AS layer, pos, CAST(3 * pos + CAST(qid % 3 = 0 AS INTEGER) AS INTEGER) AS step_index, n_steps,
       round(embedding[8 * l + 1]::DOUBLE, 6) AS head
FROM steps, (VALUES (3), (7)) v(l)"""))
def files_decode_states(spark, sf_dir):
    """Nested traces to the states table and back, last file first, two of three layers."""
    path = fresh_path(spark, "states")
    sinks.write_states(S.explode_decode(_stored_decode(spark, sf_dir)), path, "decode")
    rows = tables.read_states(spark, path, "decode", [3, 7])
    return rounded(rows.select("qid", "layer", "pos", "step_index", "n_steps", F.col("vec")[0].alias("head")))


@query("files_prompt_states", """
SELECT CAST(vec_id // 5 AS VARCHAR) AS qid, CAST(l AS INTEGER) AS layer, CAST(vec_id % 5 AS INTEGER) AS pos,
       CAST(7 * (vec_id % 5) AS INTEGER) AS step_index, round(embedding[8 * l + 1]::DOUBLE, 6) AS head
FROM embeddings, range(8) r(l)""")
def files_prompt_states(spark, sf_dir):
    """Traces with several stored prompt positions, kept apart from generation states."""
    rows = B.w_single(spark, sf_dir).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "hidden_all_layers"))).alias("s"))
    nested = rows.select(
        F.col("qid").cast("string").alias("qid"), F.transform("s", lambda x: x["sample_idx"] * 7).alias("available_token_positions"),
        F.transform("s", lambda x: x["hidden_all_layers"]).alias("hidden_states_by_position"))
    traces, path = fresh_path(spark, "traces"), fresh_path(spark, "states")
    nested.write.parquet(traces)
    stored = tables.read_traces(spark, traces, schema=schemas.TRACE_POSITIONS)
    sinks.write_states(S.explode_positions(stored), path, "prefill")
    sinks.write_states(S.explode_decode(_stored_decode(spark, sf_dir)), path, "decode")
    found = tables.read_states(spark, path, "prefill")
    return rounded(found.select("qid", "layer", "pos", "step_index", F.col("vec")[0].alias("head")))
