"""Queries on rank statistics, probes, validation schemes and the bag-of-words control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import norm
from ..operators import bootstrap, bow, features as FE, labels as L, pairout, probes, splits, states as S
from ..operators.ranking import auc
from ..params import DEFAULTS
from . import bindings as B
from .registry import query, rounded
from .sql_parts import (AUC_VALUE, DECODE_LABELS, ELEMS, NORMS, SINGLE_LABELS, STEPS, W_DECODE, W_LAYERS, W_SINGLE, auc_sql,
                        draws_sql, newton_sql, s_rate, with_)
from .trajectories import _decode_labels, _wrong_states

KEYS = ["qid", "sample_idx"]


def _single_labels(spark, sf_dir):
    w = B.w_single(spark, sf_dir).drop("hidden_all_layers")
    return L.label_outcomes(w, L.pass_stats(B.s_samples(spark, sf_dir))).select(*KEYS, "label")


def single_norms(spark, sf_dir):
    """Norm per layer of every wrong single-position trace, with its label."""
    return S.explode_single(B.w_single(spark, sf_dir)).select(
        *KEYS, "layer", norm(F.col("vec")).alias("score")).join(_single_labels(spark, sf_dir), KEYS)


SINGLE_SCORES = """layer_norms AS (
  SELECT qid, sample_idx, layer, sqrt(sum(x * x)) AS score FROM w_layers GROUP BY 1, 2, 3),
norm_scores AS (
  SELECT n.qid, n.sample_idx, n.layer, n.score, l.label FROM layer_norms n JOIN labelled l USING (qid, sample_idx))"""

SINGLE_BASE = [W_SINGLE, W_LAYERS, s_rate(), SINGLE_LABELS, SINGLE_SCORES]


@query("auc_per_layer_norm", with_(*SINGLE_BASE, "scored AS (SELECT layer, score, label FROM norm_scores)",
                                   auc_sql("layer"), body=f"""
SELECT layer, n_pos, n_neg, round({AUC_VALUE}, 6) AS auc FROM sums"""))
def auc_per_layer_norm(spark, sf_dir):
    return rounded(auc(single_norms(spark, sf_dir), ["layer"], "score", "label"))


@query("rank_auc_length", f"""WITH scored AS (
  SELECT len(string_split(lower(text), ' ')) AS score, 1 - quality AS label
  FROM documents JOIN labels USING (doc_id)),
{auc_sql('')}
SELECT n_pos, n_neg, round({AUC_VALUE}, 6) AS auc FROM sums""")
def rank_auc_length(spark, sf_dir):
    lengths = B.token_traces(spark, sf_dir).select(F.size("tokens").alias("length"), "label")
    return rounded(auc(lengths, [], "length", "label"))


@query("sample_summary", with_(*SINGLE_BASE, body="""
SELECT layer, count(*) AS n_samples, CAST(sum(label) AS BIGINT) AS n_shared, round(avg(label), 6) AS base_rate
FROM norm_scores GROUP BY layer"""))
def sample_summary(spark, sf_dir):
    return rounded(single_norms(spark, sf_dir).groupBy("layer").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("label").cast("long").alias("n_shared"),
        F.avg("label").alias("base_rate")))


@query("best_layer_by_norm", with_(*SINGLE_BASE, "scored AS (SELECT layer, score, label FROM norm_scores)",
                                   auc_sql("layer"), f"aucs AS (SELECT layer, {AUC_VALUE} AS auc FROM sums)", body="""
SELECT layer AS best_layer, round(auc, 6) AS best_auc FROM aucs WHERE auc IS NOT NULL ORDER BY auc DESC, layer LIMIT 1"""))
def best_layer_by_norm(spark, sf_dir):
    return rounded(probes.best_cell(auc(single_norms(spark, sf_dir), ["layer"], "score", "label")))


GROUP_SPLIT = """groups AS (SELECT DISTINCT qid FROM labelled),
numbered AS (
  SELECT qid, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws(':', qid, '42')), 1, 8))::BIGINT, qid) - 1 AS rn,
         count(*) OVER () AS total FROM groups),
sides AS (SELECT qid, rn < ceil(0.2 * total) AS is_test FROM numbered)"""


@query("group_split", with_(W_SINGLE, s_rate(), SINGLE_LABELS, GROUP_SPLIT, body="""
SELECT l.qid, l.sample_idx, s.is_test FROM labelled l JOIN sides s USING (qid)"""))
def group_split(spark, sf_dir):
    return splits.group_split(_single_labels(spark, sf_dir), "qid", 0.2, 42).select(*KEYS, "is_test")


FOLDS = """classes AS (SELECT least(5, min(n)) AS k FROM (SELECT label, count(*) AS n FROM labelled GROUP BY 1)),
folds AS (
  SELECT qid, sample_idx, label, CAST((row_number() OVER (PARTITION BY label
           ORDER BY ('0x' || substr(md5(concat_ws(':', qid, sample_idx, '3407')), 1, 8))::BIGINT, qid, sample_idx) - 1)
           % (SELECT k FROM classes) AS INTEGER) AS fold FROM labelled)"""


@query("stratified_folds", with_(W_SINGLE, s_rate(), SINGLE_LABELS, FOLDS, body="SELECT * FROM folds"))
def stratified_folds(spark, sf_dir):
    return splits.stratified_folds(_single_labels(spark, sf_dir), KEYS).drop("n_folds")


@query("bootstrap_auc_ci", with_(*SINGLE_BASE, GROUP_SPLIT, """base AS (
  SELECT score, label, count(*) OVER () AS n,
         row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws(':', qid, sample_idx, '7')), 1, 8))::BIGINT, qid, sample_idx) - 1 AS row_no
  FROM norm_scores JOIN sides USING (qid) WHERE layer = 1 AND is_test)""", draws_sql(10_000, "SELECT any_value(n) FROM base", 7), """counted AS (
  SELECT rep, score, sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM draws JOIN base USING (row_no) GROUP BY 1, 2),
won AS (
  SELECT rep, pos, neg, pos * (coalesce(sum(neg) OVER (PARTITION BY rep ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         + 0.5 * neg) AS w FROM counted),
aucs AS (SELECT rep, sum(w) / (sum(pos) * sum(neg)) AS auc FROM won GROUP BY rep HAVING sum(pos) > 0 AND sum(neg) > 0)""", body="""
SELECT round(quantile_cont(auc, 0.025), 6) AS ci_low, round(quantile_cont(auc, 0.975), 6) AS ci_high, count(*) AS n_replicates
FROM aucs"""))
def bootstrap_auc_ci(spark, sf_dir):
    rows = single_norms(spark, sf_dir).where("layer = 1")
    test = splits.group_split(rows, "qid", 0.2, 42).where("is_test")
    return rounded(bootstrap.auc_interval(test, KEYS, "score", "label", 10_000, seed=7))


# -- probes ----------------------------------------------------------------------------------------

def predictions(spark, sf_dir):
    features = FE.early_trace_features(B.w_single(spark, sf_dir)).join(_single_labels(spark, sf_dir), KEYS)
    return probes.probe_predictions(features, KEYS)


@query("probe_auc")
def probe_auc(spark, sf_dir):
    return rounded(probes.probe_summary(predictions(spark, sf_dir)))


def _encoder_targets(spark, sf_dir):
    """Target correctness per question, joined to every stored sample of the encoder."""
    stats = L.pass_stats(B.s_samples(spark, sf_dir))
    target = stats.select("qid", (F.col("s_pass_rate") > 0.5).cast("int").alias("label"))
    return B.w_single(spark, sf_dir).select(*KEYS).join(target, "qid").select(*KEYS, "label")


@query("aligned_targets", with_(W_SINGLE, s_rate(), body="""
SELECT w.qid, w.sample_idx, CAST(s.pass_rate > 0.5 AS INTEGER) AS label FROM w_single w JOIN s_rate s USING (qid)"""))
def aligned_targets(spark, sf_dir):
    return _encoder_targets(spark, sf_dir)


def _sweep(states, labels):
    return probes.cv_sweep(states, labels, KEYS, folds=DEFAULTS.cv_folds, seed=DEFAULTS.cv_seed, c=DEFAULTS.cv_c)


@query("cv_layer_sweep")
def cv_layer_sweep(spark, sf_dir):
    states = S.explode_single(B.w_single(spark, sf_dir)).select(*KEYS, "layer", "vec")
    return rounded(_sweep(states, _encoder_targets(spark, sf_dir)))


def layer_features(spark, sf_dir, early: bool):
    """Mean-pooled vectors of the wrong generation traces per layer."""
    states = _wrong_states(spark, sf_dir)
    pooled = FE.early_mean_pool(states, ["qid", "layer"]) if early else FE.mean_pool(states, ["qid", "layer"])
    return pooled.withColumn("pool", F.lit("early" if early else "full"))


@query("lpo_layer_scan")
def lpo_layer_scan(spark, sf_dir):
    labels = _decode_labels(spark, sf_dir, "salvageable").select("qid", "label")
    both = layer_features(spark, sf_dir, False).unionByName(layer_features(spark, sf_dir, True))
    return rounded(pairout.pair_out_auc(both.join(labels, "qid"), ["layer", "pool"], ["qid"], c=DEFAULTS.pair_out_c))


def position_features(spark, sf_dir, n_positions: int = 20):
    picked = S.nearest_positions(_wrong_states(spark, sf_dir), n_positions)
    return picked.select("qid", "layer", "grid_pos", "vec")


@query("lpo_position_grid")
def lpo_position_grid(spark, sf_dir):
    labels = _decode_labels(spark, sf_dir, "salvageable").select("qid", "label")
    rows = position_features(spark, sf_dir).join(labels, "qid")
    return rounded(pairout.pair_out_auc(rows, ["layer", "grid_pos"], ["qid"], c=DEFAULTS.pair_out_c))


@query("cohort_confirmation")
def cohort_confirmation(spark, sf_dir):
    """Layer scan in both halves of the questions."""
    labels = _decode_labels(spark, sf_dir, "salvageable").select("qid", "label")
    half = B.w_decode(spark, sf_dir).agg(((F.max("qid") + 1) / 2).alias("h")).scalar()
    rows = layer_features(spark, sf_dir, False).join(labels, "qid").withColumn(
        "cohort", F.when(F.col("qid") < half, "first").otherwise("second"))
    scan = pairout.pair_out_auc(rows, ["cohort", "layer"], ["qid"], c=DEFAULTS.pair_out_c)
    return pairout.compare_cohorts(scan.where("cohort = 'first'"), scan.where("cohort = 'second'"), ["layer"])


# -- bag of words ----------------------------------------------------------------------------------

BOW_SQL = """tokens AS (
  SELECT doc_id AS qid, unnest(string_split(lower(text), ' ')) AS token FROM documents JOIN labels USING (doc_id)),
counts AS (SELECT qid, token, count(*) AS n FROM tokens GROUP BY 1, 2),
vocab AS (SELECT token, count(*) AS df FROM counts GROUP BY 1 HAVING count(*) >= 3)"""


def _word_counts(spark, sf_dir):
    return bow.token_counts(bow.explode_tokens(B.token_traces(spark, sf_dir)))


@query("bow_vocab", f"WITH {BOW_SQL} SELECT token, df, row_number() OVER (ORDER BY token COLLATE \"C\") - 1 AS idx FROM vocab")
def bow_vocab(spark, sf_dir):
    return bow.vocabulary(_word_counts(spark, sf_dir), DEFAULTS.min_document_frequency)


@query("bow_tfnorm", f"""WITH {BOW_SQL}, raw AS (SELECT qid, token, ln(1 + n) AS raw FROM counts JOIN vocab USING (token))
SELECT qid, token, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY qid)), 6) AS weight FROM raw""")
def bow_tfnorm(spark, sf_dir):
    counts = _word_counts(spark, sf_dir)
    return rounded(bow.log_counts(counts, bow.document_frequency(counts, DEFAULTS.min_document_frequency)))


@query("bow_vs_layer0")
def bow_vs_layer0(spark, sf_dir):
    """Bag of tokens, pooled layer 0 and token count on identical questions and pairs."""
    labels = _decode_labels(spark, sf_dir).select("qid", "label")
    tokens = B.decode_tokens(spark, sf_dir).join(labels.select("qid"), "qid", "left_semi")
    counts = bow.token_counts(tokens)
    words = bow.sparse_rows(labels, bow.log_counts(counts, bow.vocabulary(counts))).select(
        F.lit("bag_of_words").alias("features"), "qid", "label", "vec")
    layer0 = FE.mean_pool(_wrong_states(spark, sf_dir).where("layer = 0"), ["qid"]).join(labels, "qid").select(
        F.lit("layer_0").alias("features"), "qid", "label", "vec")
    fitted = None
    for rows in (words, layer0):
        part = pairout.pair_out_auc(rows, ["features"], ["qid"], c=DEFAULTS.pair_out_c)
        fitted = part if fitted is None else fitted.unionByName(part)
    lengths = counts.groupBy("qid").agg(F.sum("n").alias("length")).join(labels, "qid")
    return rounded(fitted.unionByName(auc(lengths, [], "length", "label").withColumn("features", F.lit("length"))))


# -- scalar twins of the fitted operators -----------------------------------------------------------
# With one number per row a ridge-logistic fit with a free intercept ranks rows by that number, upwards if label and
# number vary together in the training rows and downwards if not: these show split, folds, pairs and ties at every size.
# Weights, penalty, intercept and scaling show in the queries on two features below.

def _scalar(rows):
    return rows.withColumn("vec", F.array("score")).drop("score")


@query("probe_auc_norm", with_(*SINGLE_BASE, GROUP_SPLIT, """parted AS (
  SELECT n.*, is_test FROM norm_scores n JOIN sides USING (qid) WHERE layer = 7),
way AS (SELECT sign(covar_pop(score, label)) AS s FROM parted WHERE NOT is_test),
scored AS (SELECT s * score AS score, label FROM parted, way WHERE is_test)""", auc_sql(""), body=f"""
SELECT round({AUC_VALUE}, 6) AS auc, n_pos + n_neg AS n_test, n_pos AS n_shared_test FROM sums"""))
def probe_auc_norm(spark, sf_dir):
    rows = single_norms(spark, sf_dir).where("layer = 7").withColumn("features", F.array("score"))
    return rounded(probes.probe_summary(probes.probe_predictions(rows, KEYS)))


CV_NORM = """held AS (
  SELECT n.layer, f.fold, n.score, n.label FROM norm_scores n JOIN folds f USING (qid, sample_idx)),
ways AS (
  SELECT t.layer, o.fold, sign(covar_pop(t.score, t.label)) AS s
  FROM held t, (SELECT DISTINCT fold FROM held) o WHERE t.fold <> o.fold GROUP BY 1, 2),
scored AS (SELECT h.layer, h.fold, s * h.score AS score, h.label FROM held h JOIN ways USING (layer, fold))"""
CV_NORM_AUCS = f"""fold_aucs AS (SELECT layer, fold, {AUC_VALUE} AS auc FROM sums),
sweep AS (SELECT layer, avg(auc) AS auc, count(auc) AS n_folds FROM fold_aucs GROUP BY layer)"""


def _norm_sweep(spark, sf_dir):
    rows = _scalar(single_norms(spark, sf_dir).drop("label"))
    return _sweep(rows, _single_labels(spark, sf_dir))


@query("cv_norm_sweep", with_(*SINGLE_BASE, FOLDS, CV_NORM, auc_sql("layer, fold"), CV_NORM_AUCS, body="""
SELECT layer, round(auc, 6) AS auc, n_folds FROM sweep"""))
def cv_norm_sweep(spark, sf_dir):
    return rounded(_norm_sweep(spark, sf_dir))


@query("best_layer_cv_norm", with_(*SINGLE_BASE, FOLDS, CV_NORM, auc_sql("layer, fold"), CV_NORM_AUCS, body="""
SELECT layer AS best_layer, round(auc, 6) AS best_auc FROM sweep WHERE auc IS NOT NULL ORDER BY round(auc, 9) DESC, layer LIMIT 1"""))
def best_layer_cv_norm(spark, sf_dir):
    """Best layer of a fitted sweep."""
    return rounded(probes.best_cell(_norm_sweep(spark, sf_dir).withColumn("auc", F.round("auc", 9))))


@query("lpo_norm", with_(W_DECODE, s_rate(25), DECODE_LABELS, STEPS, ELEMS, NORMS, """firsts AS (
  SELECT n.layer, n.qid, n.norm AS x, l.label AS y FROM norms n JOIN labelled l USING (qid) WHERE n.pos = 0),
totals AS (SELECT layer, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y)::DOUBLE AS sy, sum(x * y) AS sxy FROM firsts GROUP BY layer),
pairs AS (
  SELECT layer, p.x - q.x AS gap,
         sign((sxy - p.x) - (sx - p.x - q.x) * (sy - 1) / (n - 2)) AS way
  FROM firsts p JOIN firsts q USING (layer) JOIN totals USING (layer) WHERE p.y = 1 AND q.y = 0)""", body="""
SELECT t.layer, CAST(sy AS BIGINT) AS n_pos, CAST(n - sy AS BIGINT) AS n_neg,
       CASE WHEN sy >= 2 AND n - sy >= 2 THEN round(avg(CASE WHEN way * gap > 0 THEN 1.0 WHEN way * gap = 0 THEN 0.5 ELSE 0.0 END), 6) END AS auc
FROM totals t LEFT JOIN pairs USING (layer) GROUP BY t.layer, sy, n"""))
def lpo_norm(spark, sf_dir):
    """Every pair of a shared-hard and a salvageable trace left out once, on the norm of the first step."""
    rows = _wrong_states(spark, sf_dir).where("pos = 0").select("qid", "layer", norm(F.col("vec")).alias("score"))
    labels = _decode_labels(spark, sf_dir).select("qid", "label")
    return rounded(pairout.pair_out_auc(_scalar(rows.join(labels, "qid")), ["layer"], ["qid"], c=DEFAULTS.pair_out_c))


# -- two features: fits that SQL can do in full ------------------------------------------------------
# A norm and one element of very different spread, so that scaling, penalty and intercept all move the result.

TWO_SINGLE = """two AS (
  SELECT n.qid, n.sample_idx, n.layer, n.label AS y, n.score AS x1, 30 * w.x AS x2
  FROM norm_scores n JOIN w_layers w USING (qid, sample_idx, layer) WHERE w.dim = 2)"""


def single_pairs(spark, sf_dir):
    """(norm, 30 times the third element) of every wrong single-position trace and layer."""
    return S.explode_single(B.w_single(spark, sf_dir)).select(
        *KEYS, "layer", F.array(norm(F.col("vec")), 30 * F.col("vec")[2]).alias("vec"))


@query("probe_two_features", with_(*SINGLE_BASE, GROUP_SPLIT, TWO_SINGLE, """parted AS (
  SELECT t.*, is_test FROM two t JOIN sides USING (qid) WHERE layer = 3),
train AS (SELECT x1, x2, y FROM parted WHERE NOT is_test)""", newton_sql("", 1.0), body="""
SELECT qid, sample_idx, y AS label, round(1 / (1 + exp(-(w1 * x1 + w2 * x2 + b))), 4) AS y_pred_prob
FROM parted CROSS JOIN fitted WHERE is_test"""))
def probe_two_features(spark, sf_dir):
    """Held-out predictions of a probe on two unscaled features: weights and intercept decide every row."""
    rows = single_pairs(spark, sf_dir).where("layer = 3").withColumnRenamed("vec", "features")
    found = probes.probe_predictions(rows.join(_single_labels(spark, sf_dir), KEYS), KEYS)
    return found.select(*KEYS, "label", F.round("y_pred_prob", 4).alias("y_pred_prob"))


CV_TWO = """held AS (SELECT t.*, f.fold FROM two t JOIN folds f USING (qid, sample_idx)),
parts AS (
  SELECT h.layer, o.fold, h.fold = o.fold AS held_out, h.x1, h.x2, h.y
  FROM held h, (SELECT DISTINCT fold FROM held) o),
scales AS (
  SELECT layer, fold, avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2
  FROM parts WHERE NOT held_out GROUP BY 1, 2),
scaled AS (
  SELECT layer, fold, held_out, y, (x1 - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END AS x1,
         (x2 - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END AS x2 FROM parts JOIN scales USING (layer, fold)),
train AS (SELECT layer, fold, x1, x2, y FROM scaled WHERE NOT held_out)"""


@query("cv_two_features", with_(*SINGLE_BASE, FOLDS, TWO_SINGLE, CV_TWO, newton_sql("layer, fold", 1.0), """scored AS (
  SELECT layer, fold, w1 * x1 + w2 * x2 AS score, y AS label FROM scaled JOIN fitted USING (layer, fold) WHERE held_out)""",
                                auc_sql("layer, fold"), CV_NORM_AUCS, body="SELECT layer, round(auc, 6) AS auc, n_folds FROM sweep"))
def cv_two_features(spark, sf_dir):
    """k-fold sweep on two features: scaled by the training folds, rotated to components, fitted, scored."""
    return rounded(_sweep(single_pairs(spark, sf_dir), _single_labels(spark, sf_dir)))


@query("lpo_two_features", with_(W_DECODE, s_rate(25), DECODE_LABELS, STEPS, ELEMS, NORMS, """two AS (
  SELECT n.layer, n.qid, n.norm AS x1, 30 * e.x AS x2, l.label AS y
  FROM norms n JOIN elems e USING (layer, qid, pos) JOIN labelled l USING (qid) WHERE n.pos = 0 AND e.dim = 2),
classes AS (SELECT layer, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg FROM two GROUP BY layer),
pairs AS (
  SELECT layer, p.qid AS pos_id, q.qid AS neg_id, p.x1 - q.x1 AS gap1, p.x2 - q.x2 AS gap2
  FROM two p JOIN two q USING (layer) JOIN classes USING (layer) WHERE p.y = 1 AND q.y = 0 AND n_pos >= 2 AND n_neg >= 2),
parts AS (SELECT p.layer, p.pos_id, p.neg_id, t.x1, t.x2, t.y FROM pairs p JOIN two t ON p.layer = t.layer AND t.qid <> p.pos_id AND t.qid <> p.neg_id),
scales AS (
  SELECT layer, pos_id, neg_id, avg(x1) AS m1, avg(x2) AS m2, CASE WHEN stddev_pop(x1) > 0 THEN stddev_pop(x1) ELSE 1 END AS s1,
         CASE WHEN stddev_pop(x2) > 0 THEN stddev_pop(x2) ELSE 1 END AS s2 FROM parts GROUP BY 1, 2, 3),
train AS (SELECT layer, pos_id, neg_id, (x1 - m1) / s1 AS x1, (x2 - m2) / s2 AS x2, y FROM parts JOIN scales USING (layer, pos_id, neg_id))""",
                                 newton_sql("layer, pos_id, neg_id", 0.01, 12), """gaps AS (
  SELECT layer, w1 * gap1 / s1 + w2 * gap2 / s2 AS gap
  FROM pairs JOIN scales USING (layer, pos_id, neg_id) JOIN fitted USING (layer, pos_id, neg_id))""", body="""
SELECT c.layer, n_pos, n_neg, round(avg(CASE WHEN abs(gap) <= 1e-12 THEN 0.5 WHEN gap > 0 THEN 1.0 WHEN gap < 0 THEN 0.0 END), 6) AS auc
FROM classes c LEFT JOIN gaps USING (layer) GROUP BY c.layer, n_pos, n_neg"""))
def lpo_two_features(spark, sf_dir):
    """Every pair left out once on two features: scaled by the rows kept, penalised, refitted."""
    rows = _wrong_states(spark, sf_dir).where("pos = 0").select(
        "qid", "layer", F.array(norm(F.col("vec")), 30 * F.col("vec")[2]).alias("vec"))
    labels = _decode_labels(spark, sf_dir).select("qid", "label")
    return rounded(pairout.pair_out_auc(rows.join(labels, "qid"), ["layer"], ["qid"], c=DEFAULTS.pair_out_c))
