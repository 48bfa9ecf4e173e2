"""Queries on pass rates and outcome labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from . import bindings as B
from .registry import query, rounded
from .sql_parts import DECODE_LABELS, SINGLE_LABELS, W_DECODE, W_SINGLE, s_rate, with_


@query("outcome_cells", with_(W_SINGLE, s_rate(), SINGLE_LABELS,
                              body="SELECT label, count(*) AS n FROM labelled GROUP BY label"))
def outcome_cells(spark, sf_dir):
    stats = L.pass_stats(B.s_samples(spark, sf_dir))
    w = B.w_single(spark, sf_dir).drop("hidden_all_layers")
    return L.outcome_cells(L.label_outcomes(w, stats))


@query("outcome_cube", with_(W_SINGLE, s_rate(), body="""
SELECT w.correct AS w_correct, CASE WHEN s.pass_rate > 0.5 THEN 0 ELSE 1 END AS s_wrong, count(*) AS n
FROM w_single w LEFT JOIN s_rate s USING (qid) GROUP BY CUBE (1, 2)"""))
def outcome_cube(spark, sf_dir):
    stats = L.pass_stats(B.s_samples(spark, sf_dir))
    return L.outcome_cube(L.outcomes(B.w_single(spark, sf_dir).drop("hidden_all_layers"), stats))


@query("labelled_traces", with_(W_SINGLE, s_rate(), body="""
SELECT w.qid, w.sample_idx, round(s.pass_rate, 6) AS s_pass_rate, CASE WHEN s.pass_rate > 0.5 THEN 0 ELSE 1 END AS label
FROM w_single w LEFT JOIN s_rate s USING (qid) WHERE w.correct = 0"""))
def labelled_traces(spark, sf_dir):
    stats = L.pass_stats(B.s_samples(spark, sf_dir))
    w = B.w_single(spark, sf_dir).drop("hidden_all_layers")
    return rounded(L.label_outcomes(w, stats).select("qid", "sample_idx", "s_pass_rate", "label"))


@query("labelled_traces_missing_as_salvageable", with_(W_DECODE, s_rate(25), body="""
SELECT w.qid, CASE WHEN s.pass_rate <= 0.5 THEN 1 ELSE 0 END AS label
FROM w_decode w LEFT JOIN s_rate s USING (qid) WHERE w.correct = 0"""))
def labelled_missing(spark, sf_dir):
    stats = L.pass_stats(B.s_samples(spark, sf_dir, 25))
    return L.label_outcomes(B.w_decode(spark, sf_dir), stats, missing_s="salvageable").select("qid", "label")


@query("missing_strong_questions", with_(W_SINGLE, s_rate(), body="""
SELECT DISTINCT qid FROM w_single WHERE correct = 0 AND qid NOT IN (SELECT qid FROM s_rate)"""))
def missing_strong(spark, sf_dir):
    stats = L.pass_stats(B.s_samples(spark, sf_dir))
    return L.missing_strong_questions(B.w_single(spark, sf_dir).where("correct = 0"), stats)


@query("pass_stats", """
SELECT user_id % 100 AS qid, round(avg(CAST(value > 34.59 AS INTEGER)), 6) AS s_pass_rate,
       CAST(sum(CAST(value > 34.59 AS INTEGER)) AS BIGINT) AS s_correct_count, count(*) AS s_total
FROM events GROUP BY 1""")
def pass_stats(spark, sf_dir):
    return rounded(L.pass_stats(B.s_samples(spark, sf_dir)))


@query("pass_rate_one_model", """
SELECT user_id % 100 AS qid, round(avg(CAST(value > 34.59 AS INTEGER)), 6) AS s_pass_rate
FROM events WHERE event_type = 'view' GROUP BY 1""")
def pass_rate_one_model(spark, sf_dir):
    chosen = L.one_model(B.s_samples(spark, sf_dir), "view")
    return rounded(L.pass_stats(chosen).select("qid", "s_pass_rate"))


@query("model_accuracy", """
SELECT event_type AS model, round(avg(CAST(value > 34.59 AS INTEGER)), 6) AS accuracy, count(*) AS n
FROM events GROUP BY 1""")
def model_accuracy(spark, sf_dir):
    return rounded(L.model_accuracy(B.s_samples(spark, sf_dir)))


@query("sample_gates", with_(W_SINGLE, s_rate(), SINGLE_LABELS, body="""
SELECT count(*) AS n, CAST(coalesce(sum(label), 0) AS BIGINT) AS n_shared,
       CAST(count(*) - coalesce(sum(label), 0) AS BIGINT) AS n_salvageable,
       CASE WHEN count(*) < 30 THEN 'too_few_rows' WHEN sum(label) = 0 OR sum(1 - label) = 0 THEN 'one_class'
            WHEN least(sum(label), sum(1 - label)) < 10 THEN 'small_cell' ELSE 'ok' END AS status
FROM labelled"""))
def sample_gates(spark, sf_dir):
    stats = L.pass_stats(B.s_samples(spark, sf_dir))
    return L.sample_gates(L.label_outcomes(B.w_single(spark, sf_dir).drop("hidden_all_layers"), stats))


@query("cohort_cells", with_(W_DECODE, s_rate(25), DECODE_LABELS, body="""
SELECT CASE WHEN qid < (SELECT (max(qid) + 1) / 2.0 FROM w_decode) THEN 'first' ELSE 'second' END AS cohort,
       label, count(*) AS n FROM labelled GROUP BY 1, 2"""))
def cohort_cells(spark, sf_dir):
    w = B.w_decode(spark, sf_dir)
    half = (F.max("qid") + 1) / 2
    cohorts = w.select("qid", F.when(
        F.col("qid") < w.agg(half.alias("half")).scalar(), "first").otherwise("second").alias("cohort"))
    labelled = L.label_outcomes(w, L.pass_stats(B.s_samples(spark, sf_dir, 25)))
    return labelled.join(cohorts, "qid").groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("n"))


@query("null_policies", with_("""w AS (
  SELECT vec_id // 5 AS qid, CASE WHEN label <> 3 THEN CAST(label >= 7 AS INTEGER) END AS correct FROM embeddings)""",
                              s_rate(), body="""
SELECT p.policy, CASE WHEN s.pass_rate > 0.5 THEN 0 ELSE 1 END AS label, count(*) AS n
FROM w CROSS JOIN (VALUES ('drop', NULL), ('wrong', 0), ('right', 1)) p(policy, stand_in) LEFT JOIN s_rate s USING (qid)
WHERE coalesce(w.correct, p.stand_in) = 0 GROUP BY 1, 2"""))
def null_policies(spark, sf_dir):
    """Outcome cells when traces without a score are dropped, counted as wrong, or counted as right."""
    stats = L.pass_stats(B.s_samples(spark, sf_dir))
    w = B.table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 5").alias("qid"), F.when(F.col("label") != 3, (F.col("label") >= 7).cast("int")).alias("correct"))
    parts = [L.outcome_cells(L.label_outcomes(w, stats, null_policy=p)).withColumn("policy", F.lit(p))
             for p in L.NULL_POLICIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
