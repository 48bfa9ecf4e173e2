"""Queries on the difficulty control, the precedence control and the verdict."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import difficulty as DI, precedence as P, verdict as V
from ..params import DEFAULTS
from . import bindings as B
from .evaluate import evaluate
from .evaluation import KEYS, SINGLE_BASE, single_norms
from .registry import query, rounded
from .sql_parts import W_DECODE, W_SINGLE, with_


def _attempts(spark, sf_dir):
    return B.w_single(spark, sf_dir).drop("hidden_all_layers")


PASS_AT_K = """pass_stats AS (
  SELECT qid, count(correct) AS total_samples, CAST(coalesce(sum(correct), 0) AS BIGINT) AS successes,
         least(coalesce(sum(correct), 0), 1)::DOUBLE AS pass_at_1, least(coalesce(sum(correct), 0), 3) / 3.0 AS pass_at_3,
         1.0 - least(coalesce(sum(correct), 0), 1)::DOUBLE AS difficulty
  FROM w_single GROUP BY qid)"""


@query("pass_at_k", with_(W_SINGLE, PASS_AT_K, body="""
SELECT qid, total_samples, successes, pass_at_1, round(pass_at_3, 6) AS pass_at_3, difficulty FROM pass_stats"""))
def pass_at_k(spark, sf_dir):
    return rounded(DI.pass_at_k(_attempts(spark, sf_dir), (1, 3)))


@query("pass_at_k_unscored", with_("""w_single AS (
  SELECT vec_id // 5 AS qid, CASE WHEN label % 3 > 0 AND (vec_id // 5) % 4 > 0 THEN CAST(label >= 7 AS INTEGER) END AS correct
  FROM embeddings)""", PASS_AT_K, body="""
SELECT qid, total_samples, successes, pass_at_1, round(pass_at_3, 6) AS pass_at_3, difficulty FROM pass_stats"""))
def pass_at_k_unscored(spark, sf_dir):
    """A third of the attempts and every fourth question have no score."""
    scored = (F.col("label") % 3 > 0) & (F.expr("vec_id div 5") % 4 > 0)
    rows = B.table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 5").alias("qid"), F.when(scored, (F.col("label") >= 7).cast("int")).alias("correct"))
    return rounded(DI.pass_at_k(rows, (1, 3)))


@query("pass_at_k_unbiased", with_(W_SINGLE, """s AS (
  SELECT qid, count(correct) AS n, CAST(sum(correct) AS BIGINT) AS c FROM w_single GROUP BY qid)""", body="""
SELECT qid, n AS total_samples, c AS successes, round(c / n, 6) AS pass_at_1,
       CASE WHEN n >= 2 THEN round(1 - greatest(n - c, 0) * greatest(n - c - 1, 0) / (n * (n - 1)), 6) END AS pass_at_2,
       round(1 - c / n, 6) AS difficulty FROM s"""))
def pass_at_k_unbiased(spark, sf_dir):
    return rounded(DI.pass_at_k(_attempts(spark, sf_dir), (2,), "unbiased"))


BINS = """known AS (
  SELECT n.*, p.pass_at_1, p.difficulty FROM norm_scores n JOIN pass_stats p USING (qid) WHERE layer = 7),
ranked_rows AS (
  SELECT *, row_number() OVER (ORDER BY difficulty, ('0x' || substr(md5(concat_ws(':', qid, sample_idx, '0')), 1, 8))::BIGINT, qid, sample_idx) - 1 AS rn,
         count(*) OVER () AS total, (SELECT least(5, count(DISTINCT difficulty)) FROM known) AS q FROM known),
binned AS (
  SELECT *, CASE WHEN q < 2 OR total < 2 THEN 0
                 ELSE CAST(greatest(0, ceil(rn * q / (total - 1)::DOUBLE) - 1) AS INTEGER) END AS difficulty_bin FROM ranked_rows),
both_scores AS (
  SELECT difficulty_bin, 'probe' AS kind, score, label FROM binned
  UNION ALL SELECT difficulty_bin, 'baseline', 1.0 - pass_at_1, label FROM binned),
kind_ranks AS (
  SELECT difficulty_bin, kind, label, rank() OVER (PARTITION BY difficulty_bin, kind ORDER BY score)
         + (count(*) OVER (PARTITION BY difficulty_bin, kind, score) - 1) / 2.0 AS mid FROM both_scores),
kind_sums AS (
  SELECT difficulty_bin, kind, sum(label) AS n1, sum(1 - label) AS n0, sum(CASE WHEN label = 1 THEN mid ELSE 0 END) AS r1
  FROM kind_ranks GROUP BY 1, 2),
kind_aucs AS (
  SELECT difficulty_bin, kind, CASE WHEN n1 > 0 AND n0 > 0 THEN (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) END AS auc FROM kind_sums),
bins AS (
  SELECT difficulty_bin, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_shared, min(difficulty) AS min_difficulty,
         max(difficulty) AS max_difficulty,
         (SELECT max(auc) FROM kind_aucs k WHERE k.difficulty_bin = b.difficulty_bin AND kind = 'probe') AS probe_auc,
         (SELECT max(auc) FROM kind_aucs k WHERE k.difficulty_bin = b.difficulty_bin AND kind = 'baseline') AS baseline_auc
  FROM binned b GROUP BY difficulty_bin)"""


def _bins(spark, sf_dir):
    rows = single_norms(spark, sf_dir).where("layer = 7").drop("layer")
    stratified = DI.stratify(rows, DI.pass_at_k(_attempts(spark, sf_dir)), KEYS)
    return DI.bin_aucs(stratified, "score")


@query("auc_per_bin", with_(*SINGLE_BASE, PASS_AT_K, BINS, body="""
SELECT difficulty_bin, n, n_shared, min_difficulty, max_difficulty, round(probe_auc, 6) AS probe_auc,
       round(baseline_auc, 6) AS baseline_auc FROM bins"""))
def auc_per_bin(spark, sf_dir):
    return rounded(_bins(spark, sf_dir))


@query("paired_t", with_(*SINGLE_BASE, PASS_AT_K, BINS, body="""
SELECT CASE WHEN n >= 2 THEN 'ok' ELSE 'insufficient_bins' END AS status, n AS usable_bins,
       CASE WHEN n >= 2 THEN round(mp, 6) END AS mean_probe_auc, CASE WHEN n >= 2 THEN round(mb, 6) END AS mean_baseline_auc,
       CASE WHEN n >= 2 THEN round(mp - mb, 6) + 0.0 END AS delta_auc,
       CASE WHEN n >= 2 THEN round(m / (sd / sqrt(n)), 6) + 0.0 END AS t_stat
FROM (SELECT count(*) AS n, avg(probe_auc) AS mp, avg(baseline_auc) AS mb, avg(probe_auc - baseline_auc) AS m,
             stddev_samp(probe_auc - baseline_auc) AS sd FROM bins WHERE probe_auc IS NOT NULL AND baseline_auc IS NOT NULL)"""))
def paired_t(spark, sf_dir):
    return rounded(DI.paired_comparison(_bins(spark, sf_dir)))


# The t distribution in closed form for up to four degrees of freedom (there are at most five bins).
T_TEST = """t_test AS (
  SELECT n, n - 1 AS df, mp - mb AS delta, m / (sd / sqrt(n)) AS t, abs(m / (sd / sqrt(n))) AS a
  FROM (SELECT count(*) AS n, avg(probe_auc) AS mp, avg(baseline_auc) AS mb, avg(probe_auc - baseline_auc) AS m,
               stddev_samp(probe_auc - baseline_auc) AS sd FROM bins WHERE probe_auc IS NOT NULL AND baseline_auc IS NOT NULL)),
t_p AS (
  SELECT *, CASE df WHEN 1 THEN 1 - 2 / pi() * atan(a) WHEN 2 THEN 1 - a / sqrt(2 + a * a)
    WHEN 3 THEN 1 - 2 / pi() * (atan(a / sqrt(3)) + a / sqrt(3) / (1 + a * a / 3))
    WHEN 4 THEN 1 - 0.75 * a / sqrt(1 + a * a / 4) * (1 - a * a / (12 * (1 + a * a / 4))) END AS p FROM t_test)"""


@query("paired_t_p_value", with_(*SINGLE_BASE, PASS_AT_K, BINS, T_TEST, body="""
SELECT CASE WHEN n >= 2 THEN 'ok' ELSE 'insufficient_bins' END AS status, n AS usable_bins,
       CASE WHEN n >= 2 THEN round(delta, 6) + 0.0 END AS delta_auc, CASE WHEN n >= 2 THEN round(t, 6) + 0.0 END AS t_stat,
       CASE WHEN n >= 2 THEN round(p, 6) END AS p_val, coalesce(n >= 2 AND p < 0.05, false) AS significant FROM t_p"""))
def paired_t_p_value(spark, sf_dir):
    tested = DI.with_t_test(DI.paired_comparison(_bins(spark, sf_dir)))
    return rounded(tested.select("status", "usable_bins", "delta_auc", "t_stat", "p_val", "significant"))


# -- precedence ------------------------------------------------------------------------------------

LOGITS = """steps AS (
  SELECT e.vec_id // 20 AS qid, CAST(e.vec_id % 20 AS INTEGER) AS step, w.n_steps, w.correct,
         list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS l, CAST((e.vec_id // 20) % 64 AS INTEGER) AS token
  FROM embeddings e JOIN w_decode w ON w.qid = e.vec_id // 20),
softmax AS (
  SELECT qid, step, n_steps, correct, list_max(l) - l[token + 1] AS gap,
         list_sum(list_transform(l, lambda x: exp(x))) AS z, list_sum(list_transform(l, lambda x: exp(x) * x)) AS zx FROM steps),
scalars AS (SELECT qid, step, n_steps, correct, gap, ln(z) - zx / z AS entropy,
                   greatest(2, n_steps // 4) AS w FROM softmax),
rolled AS (
  SELECT a.qid, a.step, avg(b.entropy) AS rolling FROM scalars a JOIN scalars b ON a.qid = b.qid
   AND b.step BETWEEN a.step + (a.w - 1) // 2 - a.w + 1 AND a.step + (a.w - 1) // 2
  GROUP BY a.qid, a.step HAVING count(*) = any_value(a.w)),
limits AS (SELECT qid, avg(rolling) + 0.5 * stddev_samp(rolling) AS lim FROM rolled GROUP BY qid),
locks AS (SELECT r.qid, min(step) AS lock_step, arg_min(rolling, step) AS divergence FROM rolled r JOIN limits USING (qid)
          WHERE rolling > lim GROUP BY r.qid),
emergence AS (SELECT qid, max(correct) AS correct, min(CASE WHEN gap < 0.4 THEN step END) AS emergence_step FROM scalars GROUP BY qid),
checks AS (
  SELECT e.qid, e.correct, e.emergence_step, k.lock_step, k.divergence,
         CASE WHEN correct <> 0 THEN 'not_applicable' WHEN lock_step IS NULL THEN 'no_lock'
              WHEN emergence_step IS NULL THEN 'no_emergence' WHEN lock_step < emergence_step THEN 'pass' ELSE 'suspicious' END AS check_result
  FROM emergence e LEFT JOIN locks k USING (qid))"""

# The stand-in logits are unit vectors, so the gap that separates steps is smaller than for real logits.
GAP = 0.4


@query("logit_emergence", with_(W_DECODE, LOGITS, body="SELECT qid, emergence_step FROM emergence"))
def logit_emergence(spark, sf_dir):
    return P.answer_emergence(P.step_scalars(B.logits(spark, sf_dir)), GAP).select("qid", "emergence_step")


@query("failure_lock", with_(W_DECODE, LOGITS, body="SELECT qid, lock_step, round(divergence, 6) AS divergence FROM locks"))
def failure_lock(spark, sf_dir):
    scalars = P.step_scalars(B.logits(spark, sf_dir))
    return rounded(P.failure_lock(P.rolling_entropy(scalars)).drop("sample_idx"))


@query("rolling_entropy", with_(W_DECODE, LOGITS, body="SELECT qid, step, round(rolling, 6) AS rolling FROM rolled"))
def rolling_entropy(spark, sf_dir):
    return rounded(P.rolling_entropy(P.step_scalars(B.logits(spark, sf_dir))).select("qid", "step", "rolling"))


@query("precedence_checks", with_(W_DECODE, LOGITS, body="""
SELECT qid, correct, emergence_step, lock_step, round(divergence, 6) AS divergence, check_result FROM checks"""))
def precedence_checks(spark, sf_dir):
    return rounded(P.check_traces(B.logits(spark, sf_dir), GAP).drop("sample_idx"))


@query("precedence_verdict", with_(W_DECODE, LOGITS, body="""
SELECT CASE WHEN n = 0 THEN 'no_valid_traces' ELSE 'ok' END AS status, n AS n_checked, round(p / n, 6) AS pass_rate,
       round(s / n, 6) AS suspicious_rate,
       CASE WHEN n = 0 THEN 'insufficient_data' WHEN s / n <= 0.1 THEN 'pass' ELSE 'suspicious' END AS verdict
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE check_result = 'pass') AS p,
             count(*) FILTER (WHERE check_result = 'suspicious') AS s FROM checks WHERE correct = 0)"""))
def precedence_verdict(spark, sf_dir):
    return rounded(P.precedence_verdict(P.check_traces(B.logits(spark, sf_dir).where("correct = 0"), GAP)))


@query("precedence_counts", with_(W_DECODE, LOGITS, body="SELECT check_result, count(*) AS n FROM checks GROUP BY 1"))
def precedence_counts(spark, sf_dir):
    return P.check_counts(P.check_traces(B.logits(spark, sf_dir), GAP))


@query("trace_sample", with_(W_SINGLE, body="""
SELECT qid, sample_idx FROM w_single WHERE correct = 0
ORDER BY ('0x' || substr(md5(concat_ws(':', qid, sample_idx, '0')), 1, 8))::BIGINT, qid, sample_idx LIMIT 100"""))
def trace_sample(spark, sf_dir):
    return P.sample_traces(_attempts(spark, sf_dir).where("correct = 0").select(*KEYS), 100)


@query("verdict")
def verdict(spark, sf_dir):
    """Probe with its bootstrap interval, both controls and the decision. All wrong traces are checked for precedence."""
    params = replace(DEFAULTS, emergence_gap=GAP)
    run = evaluate(B.w_single(spark, sf_dir), B.s_samples(spark, sf_dir), B.logits(spark, sf_dir), params)
    return rounded(run.verdict)


@query("verdict_rule", """
WITH runs AS (
  SELECT user_id AS run, avg(value) / 100 + 0.2 AS auc, count(*) FILTER (WHERE event_type = 'error') AS n_error,
         avg(event_id % 2) > 0.45 AS significant, min(value) / 20 AS delta,
         CASE WHEN max(event_id) % 2 = 0 THEN 'suspicious' ELSE 'pass' END AS leak FROM events GROUP BY 1)
SELECT run, CASE WHEN auc <= 0.5 THEN 'NO-GO' WHEN n_error % 7 = 0 THEN 'BLOCKED'
                 WHEN NOT (significant AND delta >= 0.05) THEN 'NO-GO (difficulty only)'
                 WHEN leak = 'suspicious' THEN 'CONDITIONAL' ELSE 'GO' END AS verdict FROM runs""")
def verdict_rule(spark, sf_dir):
    """The decision rule over a table of runs, here one per user."""
    runs = B.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(
        (F.avg("value") / 100 + 0.2).alias("auc"), F.count_if(F.col("event_type") == "error").alias("n_error"),
        (F.avg(F.col("event_id") % 2) > 0.45).alias("significant"), (F.min("value") / 20).alias("delta"),
        F.when(F.max("event_id") % 2 == 0, "suspicious").otherwise("pass").alias("leak"))
    none = F.lit(None).cast("string")
    blocked = F.when(F.col("n_error") % 7 == 0, "failed")
    return runs.select("run", V.verdict_of(
        F.col("auc"), none, blocked, F.col("significant"), F.col("delta"), F.col("leak")).alias("verdict"))
