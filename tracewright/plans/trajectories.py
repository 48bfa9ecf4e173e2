"""Queries on vector states: features, pools, resampled curves, selections and dynamics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import doubles, norm
from ..operators import dynamics as D, features as FE, labels as L, pca, states as S, trajectory as T
from ..params import DEFAULTS
from . import bindings as B
from .registry import query, rounded
from .sql_parts import DECODE_LABELS, ELEMS, NORMS, SINGLE_LABELS, STEPS, W_DECODE, W_LAYERS, W_SINGLE, s_rate, with_


def _decode_labels(spark, sf_dir, missing_s="shared_hard"):
    return L.label_outcomes(B.w_decode(spark, sf_dir), L.pass_stats(B.s_samples(spark, sf_dir, 25)), missing_s)


def _wrong_states(spark, sf_dir):
    return B.decode_states(spark, sf_dir, only_wrong=True)


# -- row-local features --------------------------------------------------------------------------

@query("early_trace_features", with_(W_SINGLE, W_LAYERS, """stats AS (SELECT qid, sample_idx, dim, avg(x) AS m, stddev_pop(x) AS s, max(x) AS t FROM w_layers
            WHERE layer < 2 GROUP BY 1, 2, 3)""", body="""
SELECT qid, sample_idx, list_concat(list(round(m, 6) + 0.0 ORDER BY dim), list(round(s, 6) + 0.0 ORDER BY dim),
       list(round(t, 6) + 0.0 ORDER BY dim), list_transform(range(10), lambda i: 0.0::DOUBLE)) AS features
FROM stats GROUP BY 1, 2"""))
def early_trace_features(spark, sf_dir):
    return rounded(FE.early_trace_features(B.w_single(spark, sf_dir)).select("qid", "sample_idx", "features"))


POOL_SQL = """SELECT qid, layer, list(round(m, 6) + 0.0 ORDER BY dim) AS vec FROM pooled GROUP BY 1, 2"""


@query("mean_pool", with_(W_DECODE, STEPS, ELEMS,
                          "pooled AS (SELECT qid, layer, dim, avg(x) AS m FROM elems WHERE correct = 0 GROUP BY 1, 2, 3)",
                          body=POOL_SQL))
def mean_pool(spark, sf_dir):
    return rounded(FE.mean_pool(_wrong_states(spark, sf_dir), ["qid", "layer"]))


@query("early_mean_pool", with_(W_DECODE, STEPS, ELEMS, """pooled AS (
  SELECT qid, layer, dim, avg(x) AS m FROM elems WHERE correct = 0 AND pos < greatest(1, floor(n_steps * 0.25))
  GROUP BY 1, 2, 3)""", body=POOL_SQL))
def early_mean_pool(spark, sf_dir):
    return rounded(FE.early_mean_pool(_wrong_states(spark, sf_dir), ["qid", "layer"]))


@query("vector_moments", with_(W_DECODE, STEPS, ELEMS, """pooled AS (
  SELECT qid, layer, dim, avg(x) AS m, stddev_pop(x) AS s, max(x) AS t FROM elems GROUP BY 1, 2, 3)""", body="""
SELECT qid, layer, list(round(m, 6) + 0.0 ORDER BY dim) AS mean, list(round(s, 6) + 0.0 ORDER BY dim) AS std,
       list(round(t, 6) + 0.0 ORDER BY dim) AS max FROM pooled GROUP BY 1, 2"""))
def vector_moments(spark, sf_dir):
    return rounded(FE.vector_moments(B.decode_states(spark, sf_dir), ["qid", "layer"]))


# -- resampled curves ----------------------------------------------------------------------------

RESAMPLED = """grid AS (SELECT CAST(g AS INTEGER) AS point, g / 19.0 AS t FROM range(20) r(g)),
axis AS (SELECT *, step_index / 60.0 AS x FROM norms),
ends AS (
  SELECT a.qid, a.layer, g.point, any_value(g.t) AS t,
         max(a.x) FILTER (WHERE a.x <= g.t) AS xl, arg_max(a.norm, a.x) FILTER (WHERE a.x <= g.t) AS vl,
         min(a.x) FILTER (WHERE a.x >= g.t) AS xr, arg_min(a.norm, a.x) FILTER (WHERE a.x >= g.t) AS vr
  FROM axis a, grid g GROUP BY 1, 2, 3),
curves AS (
  SELECT qid, layer, point, CASE WHEN xl IS NULL THEN vr WHEN xr IS NULL OR xl = xr THEN vl
                                 ELSE vl + (t - xl) * (vr - vl) / (xr - xl) END AS value FROM ends)"""


@query("traj_norm_resampled", with_(W_DECODE, STEPS, ELEMS, NORMS, RESAMPLED, body="""
SELECT qid, layer, point, round(value, 6) AS value FROM curves"""))
def traj_norm_resampled(spark, sf_dir):
    series = T.norm_series(B.decode_states(spark, sf_dir))
    return rounded(T.resample(series, 20, axis="step").select("qid", "layer", "point", "value"))


@query("traj_group_stats", with_(W_DECODE, s_rate(25), DECODE_LABELS, STEPS, ELEMS, NORMS, RESAMPLED, body="""
SELECT c.layer, l.label, c.point, round(avg(c.value), 6) AS mean, round(stddev_pop(c.value), 6) AS std, count(*) AS n
FROM curves c JOIN labelled l USING (qid) GROUP BY 1, 2, 3"""))
def traj_group_stats(spark, sf_dir):
    curves = T.resample(T.norm_series(_wrong_states(spark, sf_dir)), 20, axis="step")
    out = T.group_curves(curves, _decode_labels(spark, sf_dir))
    return rounded(out.select("layer", "label", "point", "mean", "std", "n"))


# -- selections ----------------------------------------------------------------------------------

@query("nearest_positions", with_(W_DECODE, STEPS, ELEMS, NORMS, body="""
SELECT n.qid, n.layer, CAST(p AS INTEGER) AS grid_pos, n.step_index, round(n.norm, 6) AS norm
FROM norms n, range(12) r(p) WHERE round_even((p / 11.0) * (n.n_steps - 1), 0) = n.pos"""))
def nearest_positions(spark, sf_dir):
    picked = S.nearest_positions(B.decode_states(spark, sf_dir), 12)
    return rounded(picked.select("qid", "layer", "grid_pos", "step_index", norm(F.col("vec")).alias("norm")))


@query("stride_sample", with_(W_DECODE, STEPS, body="""
SELECT qid, step_index, CAST(pos // 3 AS INTEGER) AS sample_no FROM steps WHERE pos % 3 = 0 AND pos // 3 < 5"""))
def stride_sample(spark, sf_dir):
    steps = B.decode_steps(spark, sf_dir).select("qid", "pos", "step_index")
    return S.stride_samples(steps, 3, 5).select("qid", "step_index", "sample_no")


@query("resolved_layer_states", with_(W_DECODE, STEPS, body="""
SELECT qid, pos, round(embedding[49]::DOUBLE, 6) AS head FROM steps"""))
def resolved_layer_states(spark, sf_dir):
    """Layer -2 looked up among the captured layers (0, 3, -2, 7) of an eight-layer model."""
    captured = F.array(*[F.lit(l) for l in (0, 3, -2, 7)])
    steps = B.decode_steps(spark, sf_dir).select("qid", "pos", F.transform(
        captured, lambda l: F.element_at("layers", F.when(l < 0, 8 + l + 1).otherwise(l + 1))).alias("stored"))
    slot = S.captured_index(captured, F.lit(8), -2)
    return rounded(steps.select("qid", "pos", doubles(F.col("stored")[slot])[0].alias("head")))


@query("available_positions", """
SELECT doc_id AS qid, list_filter([0, 10, 100, 1000, 10000], lambda p: p < n_chars) AS positions FROM documents""")
def available_positions(spark, sf_dir):
    requested = F.array(*[F.lit(p) for p in (0, 10, 100, 1000, 10000)])
    return B.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("qid"), S.available_positions(requested, F.col("n_chars")).alias("positions"))


@query("last_position", with_(W_DECODE, STEPS, body="""
SELECT qid, CAST(l AS INTEGER) AS layer, step_index, round(embedding[8 * l + 1]::DOUBLE, 6) AS head
FROM steps, range(8) r(l) WHERE pos = n_steps - 1"""))
def last_position(spark, sf_dir):
    last = S.pick_position(B.decode_states(spark, sf_dir), "last")
    return rounded(last.select("qid", "layer", "step_index", F.col("vec")[0].alias("head")))


@query("position_modes", with_(W_DECODE, STEPS, """picked AS (
  SELECT 'first' AS mode, * FROM steps WHERE step_index = 0 UNION ALL SELECT 'last', * FROM steps WHERE pos = n_steps - 1
  UNION ALL SELECT 'list', * FROM steps WHERE step_index IN (3, 12, 57, 100) UNION ALL SELECT 'all', * FROM steps)""", body="""
SELECT mode, qid, CAST(l AS INTEGER) AS layer, step_index, round(embedding[8 * l + 1]::DOUBLE, 6) AS head FROM picked, range(8) r(l)"""))
def position_modes(spark, sf_dir):
    """First, last, listed (one of them in no trace) and all stored positions."""
    states, found = B.decode_states(spark, sf_dir), None
    for mode in ("first", "last", "list", "all"):
        part = S.pick_position(states, mode, [57, 3, 100, 12]).withColumn("mode", F.lit(mode))
        found = part if found is None else found.unionByName(part)
    return rounded(found.select("mode", "qid", "layer", "step_index", F.col("vec")[0].alias("head")))


@query("parsed_vectors", """
SELECT qid, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, round(sum(CASE WHEN ok THEN x END), 4) + 0.0 AS total
FROM (SELECT vec_id // 5 AS qid, vec_id % 7 <> 0 AS ok, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY qid""")
def parsed_vectors(spark, sf_dir):
    """Matrices stored as JSON text; every seventh is cut off and must be counted as unusable."""
    text = F.to_json(F.col("hidden_all_layers"))
    raw = B.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.array(F.col("embedding")).alias("hidden_all_layers"))
    raw = raw.select(F.expr("vec_id div 5").alias("qid"), F.when(
        F.col("vec_id") % 7 == 0, F.expr("substring(to_json(hidden_all_layers), 1, 20)")).otherwise(text).alias("raw"))
    out = S.decode_vectors(raw, "raw").groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("parse_ok").alias("n_ok"),
        F.sum(F.col("hidden_all_layers")[0][0].cast("double")).alias("total"))
    return rounded(out, 4)


# -- dynamics ------------------------------------------------------------------------------------

DYN_LINEAR = """ends AS (
  SELECT qid, layer, max(n_steps) AS n, avg(norm) AS mean_norm FROM norms GROUP BY 1, 2),
pairs AS (
  SELECT e.qid, e.layer, e.pos, e.dim, e.x, e1.x - e.x AS d1, e2.x - e1.x AS d2, l.x AS xl, f.x AS xf, c.m
  FROM elems e JOIN ends n USING (qid, layer)
  LEFT JOIN elems e1 ON (e1.qid, e1.layer, e1.dim, e1.pos) = (e.qid, e.layer, e.dim, e.pos + 1)
  LEFT JOIN elems e2 ON (e2.qid, e2.layer, e2.dim, e2.pos) = (e.qid, e.layer, e.dim, e.pos + 2)
  JOIN elems l ON (l.qid, l.layer, l.dim, l.pos) = (e.qid, e.layer, e.dim, n.n - 1)
  JOIN elems f ON (f.qid, f.layer, f.dim, f.pos) = (e.qid, e.layer, e.dim, 0)
  JOIN (SELECT qid, layer, dim, avg(x) AS m FROM elems GROUP BY 1, 2, 3) c
    ON (c.qid, c.layer, c.dim) = (e.qid, e.layer, e.dim)),
walk AS (
  SELECT qid, layer, pos, sqrt(sum(d1 * d1)) AS step, sum(d1 * d2) / nullif(sqrt(sum(d1 * d1)) * sqrt(sum(d2 * d2)), 0) AS turn,
         sum(x * xl) / nullif(sqrt(sum(x * x)) * sqrt(sum(xl * xl)), 0) AS cos_last,
         sqrt(sum((x - m) * (x - m))) AS off, sqrt(sum((xl - xf) * (xl - xf))) AS net
  FROM pairs GROUP BY 1, 2, 3),
metrics AS (
  SELECT w.qid, w.layer, any_value(n.n) AS n_steps, avg(step) / any_value(n.mean_norm) AS mean_step_norm,
         sum(step) / nullif(any_value(net), 0) AS tortuosity, avg(turn) AS mean_consec_cos,
         least(any_value(n.n) - 1, coalesce(max(pos) FILTER (WHERE NOT coalesce(cos_last > 0.9, false)) + 1, 0))
           / (any_value(n.n) - 1) AS settle_frac,
         avg(off) / any_value(n.mean_norm) AS spread
  FROM walk w JOIN ends n USING (qid, layer) GROUP BY 1, 2)"""


@query("dyn_linear", with_(W_DECODE, STEPS, ELEMS, NORMS, DYN_LINEAR, body="""
SELECT qid, layer, n_steps, round(mean_step_norm, 6) AS mean_step_norm, round(tortuosity, 6) AS tortuosity,
       round(mean_consec_cos, 6) + 0.0 AS mean_consec_cos, round(settle_frac, 6) AS settle_frac, round(spread, 6) AS spread
FROM metrics"""))
def dyn_linear(spark, sf_dir):
    return rounded(D.linear_metrics(B.decode_states(spark, sf_dir), DEFAULTS.settle_cosine).drop("sample_idx"))


DYN_PAIRS = """dist AS (
  SELECT a.qid, a.layer, a.pos AS i, b.pos AS j, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d
  FROM elems a JOIN elems b ON (a.qid, a.layer, a.dim) = (b.qid, b.layer, b.dim) AND abs(a.pos - b.pos) > 5
  GROUP BY 1, 2, 3, 4),
ordered AS (SELECT *, row_number() OVER (PARTITION BY qid, layer, i ORDER BY d, j) AS k FROM dist),
near AS (SELECT qid, layer, i, max(d) FILTER (WHERE k = 1) AS r1, max(d) FILTER (WHERE k = 2) AS r2
         FROM ordered GROUP BY 1, 2, 3),
mid AS (SELECT qid, layer, median(d) AS med FROM dist WHERE i < j GROUP BY 1, 2),
pairwise AS (
  SELECT n.qid, n.layer, avg(r1) / nullif(any_value(m.med), 0) AS nearest_revisit,
         count(*) FILTER (WHERE r1 > 0 AND r2 / r1 > 1) / nullif(sum(CASE WHEN r1 > 0 AND r2 / r1 > 1 THEN ln(r2 / r1) END), 0)
           AS intrinsic_dim
  FROM near n JOIN mid m USING (qid, layer) GROUP BY 1, 2)"""


@query("dyn_pairwise", with_(W_DECODE, STEPS, ELEMS, DYN_PAIRS, body="""
SELECT qid, layer, round(nearest_revisit, 6) AS nearest_revisit, round(intrinsic_dim, 6) AS intrinsic_dim FROM pairwise"""))
def dyn_pairwise(spark, sf_dir):
    return rounded(D.pairwise_metrics(B.decode_states(spark, sf_dir), DEFAULTS.theiler_window).drop("sample_idx"))


SELFSIM = """sims AS (
  SELECT a.qid, a.layer, a.pos AS i, b.pos AS j, any_value(a.n_steps) AS n, sum(a.x * b.x) AS dot
  FROM elems a JOIN elems b ON (a.qid, a.layer, a.dim) = (b.qid, b.layer, b.dim)
   AND b.pos - a.pos >= greatest(1, floor(a.n_steps * 0.25)) GROUP BY 1, 2, 3, 4),
selfsim AS (
  SELECT s.qid, s.layer, avg(dot / (a.norm * b.norm)) AS longrange_selfsim
  FROM sims s JOIN norms a ON (a.qid, a.layer, a.pos) = (s.qid, s.layer, s.i)
  JOIN norms b ON (b.qid, b.layer, b.pos) = (s.qid, s.layer, s.j) GROUP BY 1, 2)"""

@query("dyn_selfsim", with_(W_DECODE, STEPS, ELEMS, NORMS, SELFSIM, body="""
SELECT qid, layer, round(longrange_selfsim, 6) + 0.0 AS longrange_selfsim FROM selfsim"""))
def dyn_selfsim(spark, sf_dir):
    return rounded(D.long_range_similarity(B.decode_states(spark, sf_dir), DEFAULTS.long_range_lag).drop("sample_idx"))


ALL_METRICS = """all_metrics AS (
  SELECT m.*, s.longrange_selfsim, p.nearest_revisit, p.intrinsic_dim
  FROM metrics m LEFT JOIN selfsim s USING (qid, layer) LEFT JOIN pairwise p USING (qid, layer))"""

MWU_TAIL = """long AS (
  SELECT m.layer, u.metric, u.value AS score, l.label FROM all_metrics m JOIN labelled l USING (qid),
    LATERAL (VALUES ('mean_step_norm', m.mean_step_norm), ('tortuosity', m.tortuosity),
      ('mean_consec_cos', m.mean_consec_cos), ('settle_frac', m.settle_frac), ('spread', m.spread),
      ('longrange_selfsim', m.longrange_selfsim), ('nearest_revisit', m.nearest_revisit),
      ('intrinsic_dim', m.intrinsic_dim)) u(metric, value)
  WHERE u.value IS NOT NULL),
scored AS (SELECT * FROM long),
ranked AS (
  SELECT layer, metric, score, label, rank() OVER (PARTITION BY layer, metric ORDER BY score)
         + (count(*) OVER (PARTITION BY layer, metric, score) - 1) / 2.0 AS mid FROM scored),
ties AS (SELECT layer, metric, sum(t * t * t - t) AS tie_term
         FROM (SELECT layer, metric, score, count(*)::DOUBLE AS t FROM scored GROUP BY 1, 2, 3) GROUP BY 1, 2),
sums AS (
  SELECT layer, metric, CAST(sum(label) AS BIGINT) AS n1, CAST(sum(1 - label) AS BIGINT) AS n0,
         sum(CASE WHEN label = 1 THEN mid ELSE 0 END) AS r1,
         median(score) FILTER (WHERE label = 1) AS m1, median(score) FILTER (WHERE label = 0) AS m0
  FROM ranked GROUP BY 1, 2),
tests AS (
  SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, n1::DOUBLE + n0 AS n, n1 >= 2 AND n0 >= 2 AS defined
  FROM sums JOIN ties USING (layer, metric))"""


MWU = (W_DECODE, s_rate(25), DECODE_LABELS, STEPS, ELEMS, NORMS, DYN_LINEAR, SELFSIM, DYN_PAIRS, ALL_METRICS, MWU_TAIL)
# Two-sided p: exact for up to eight values in the smaller group without ties (all its choices of ranks are listed), else
# the normal tail with continuity correction, by the series of the error function.
P_VALUES = """sizes AS (
  SELECT DISTINCT least(n1, n0) AS k, n1 + n0 AS m FROM tests WHERE defined AND least(n1, n0) <= 8 AND tie_term = 0),
RECURSIVE_PLACEHOLDER
arrangements AS (SELECT k, m, sum_ - k * (k + 1) // 2 AS u, count(*)::DOUBLE AS ways FROM chosen WHERE used = k GROUP BY 1, 2, 3),
tops AS (SELECT *, greatest(u, n1 * n0 - u) AS top,
                sqrt(n1 * n0 / 12.0 * ((n + 1) - tie_term / (n * (n - 1)))) AS sd FROM tests),
tails AS (SELECT *, (top - n1 * n0 / 2.0 - 0.5) / sd / sqrt(2.0) AS x FROM tops),
p_values AS (
  SELECT *, CASE WHEN NOT defined THEN NULL
    WHEN least(n1, n0) <= 8 AND tie_term = 0 THEN least(1.0, 2 * (SELECT sum(CASE WHEN a.u <= n1 * n0 - top THEN ways ELSE 0 END) / sum(ways)
      FROM arrangements a WHERE a.k = least(n1, n0) AND a.m = n1 + n0))
    WHEN sd = 0 THEN NULL WHEN x <= 0 THEN 1.0
    ELSE 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum([exp(i * ln(2 * x * x) + ln(x) - lgamma(2.0 * i + 2) + i * ln(2) + lgamma(i + 1.0))
                                                       FOR i IN range(100)]) END AS p_value FROM tails)"""
P_VALUES = P_VALUES.replace("RECURSIVE_PLACEHOLDER", """chosen(k, m, used, last_, sum_) AS (
  SELECT k, m, 0, 0, 0 FROM sizes
  UNION ALL SELECT c.k, c.m, used + 1, j, sum_ + j FROM chosen c, range(1, 40) r(j) WHERE used < c.k AND j > last_ AND j <= c.m),""")


def _recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query("mwu_by_metric", with_(*MWU, body="""
SELECT layer, metric, n1 AS n_shared_hard, n0 AS n_salvageable, CASE WHEN defined THEN round(u, 6) END AS mannwhitney_u,
       CASE WHEN defined THEN round((u - n1 * n0 / 2.0) / sqrt(n1 * n0 / 12.0 * ((n + 1) - tie_term / (n * (n - 1)))), 6) + 0.0 END AS z,
       CASE WHEN defined THEN round(m1, 6) + 0.0 END AS shared_hard_median,
       CASE WHEN defined THEN round(m0, 6) + 0.0 END AS salvageable_median
FROM tests"""))
def mwu_by_metric(spark, sf_dir):
    metrics = D.trajectory_metrics(_wrong_states(spark, sf_dir), params=DEFAULTS)
    tests = D.group_tests(D.metrics_long(metrics), _decode_labels(spark, sf_dir))
    return rounded(tests.drop("tie_term"))


@query("dynamics_tests", _recursive(with_(*MWU, P_VALUES, body="""
SELECT layer, metric, n1 AS n_shared_hard, n0 AS n_salvageable, CASE WHEN defined THEN round(u, 6) END AS mannwhitney_u,
       tie_term, CASE WHEN defined THEN round(m1, 6) + 0.0 END AS shared_hard_median,
       CASE WHEN defined THEN round(m0, 6) + 0.0 END AS salvageable_median, round(p_value, 6) AS p_value FROM p_values""")))
def dynamics_tests(spark, sf_dir):
    """All eight metrics per layer with p-values."""
    metrics = D.trajectory_metrics(_wrong_states(spark, sf_dir), params=DEFAULTS)
    tests = D.group_tests(D.metrics_long(metrics), _decode_labels(spark, sf_dir))
    return rounded(D.with_p_values(tests).drop("z"))


@query("dynamics_chance_summary", _recursive(with_(*MWU, P_VALUES, body="""
SELECT count(*) FILTER (WHERE p_value < 0.05) AS n_significant, count(*) AS n_tests, count(*) * 0.05::DOUBLE AS expected_by_chance
FROM p_values""")))
def dynamics_chance_summary(spark, sf_dir):
    metrics = D.trajectory_metrics(_wrong_states(spark, sf_dir), params=DEFAULTS)
    tests = D.group_tests(D.metrics_long(metrics), _decode_labels(spark, sf_dir))
    return D.chance_summary(D.with_p_values(tests))


# -- principal components ------------------------------------------------------------------------

def components_sql(k: int, squarings: int = 16) -> list[str]:
    """vectors(k, dim, v) and ratios(k, ratio) of the layer's covariance, one after the other.

    A matrix squared often enough is the projection on its leading direction, which is then taken out.
    """
    parts = ["""xs AS (SELECT qid, pos, step_index, n_steps, correct, dim, x FROM elems WHERE layer = 7),
middle AS (SELECT dim, avg(x) AS m FROM xs GROUP BY dim),
c0 AS MATERIALIZED (
  SELECT a.dim AS i, b.dim AS j, sum((a.x - ma.m) * (b.x - mb.m)) / (count(*) - 1) AS v
  FROM xs a JOIN xs b USING (qid, pos) JOIN middle ma ON ma.dim = a.dim JOIN middle mb ON mb.dim = b.dim GROUP BY 1, 2)"""]
    for t in range(k):
        parts.append(f"p{t}_0 AS MATERIALIZED (SELECT i, j, v / sum(CASE WHEN i = j THEN v END) OVER () AS v FROM c{t})")
        for m in range(squarings):
            parts.append(f"""p{t}_{m + 1} AS MATERIALIZED (
  SELECT i, j, v / sum(CASE WHEN i = j THEN v END) OVER () AS v FROM (
    SELECT a.i, b.j, sum(a.v * b.v) AS v FROM p{t}_{m} a JOIN p{t}_{m} b ON a.j = b.i GROUP BY 1, 2))""")
        last = f"p{t}_{squarings}"
        parts.append(f"""raw{t} AS (
  SELECT i AS dim, v / sqrt((SELECT max(v) FROM {last} WHERE i = j)) AS v FROM {last}
  WHERE j = (SELECT arg_max(i, v) FROM {last} WHERE i = j)),
v{t} AS MATERIALIZED (SELECT dim, v * sign((SELECT arg_max(v, abs(v)) FROM raw{t})) / sqrt((SELECT sum(v * v) FROM raw{t})) AS v FROM raw{t}),
l{t} AS MATERIALIZED (SELECT sum(c.v * a.v * b.v) AS value FROM c{t} c JOIN v{t} a ON a.dim = c.i JOIN v{t} b ON b.dim = c.j),
c{t + 1} AS MATERIALIZED (
  SELECT c.i, c.j, c.v - l.value * a.v * b.v AS v FROM c{t} c JOIN v{t} a ON a.dim = c.i JOIN v{t} b ON b.dim = c.j CROSS JOIN l{t} l)""")
    parts.append("vectors AS (" + " UNION ALL ".join(f"SELECT {t} AS k, dim, v FROM v{t}" for t in range(k)) + ")")
    parts.append("ratios AS (" + " UNION ALL ".join(
        f"SELECT {t} AS k, value / (SELECT sum(v) FROM c0 WHERE i = j) AS ratio FROM l{t}" for t in range(k)) + ")")
    return parts


@query("pca_variance", with_(W_DECODE, STEPS, ELEMS, *components_sql(3), body="""
SELECT k AS component, round(any_value(ratio), 6) AS ratio, list(round(v, 5) + 0.0 ORDER BY dim) AS loadings
FROM vectors JOIN ratios USING (k) GROUP BY k"""))
def pca_variance(spark, sf_dir):
    """Components of the last layer's states and the variance they explain, all traces taken together."""
    basis = pca.fit_basis(B.decode_states(spark, sf_dir), layer=7, n_components=3, source="decode")
    each = pca.basis_frame(spark, basis).select(F.posexplode(F.arrays_zip("components", "explained_variance_ratio")).alias("component", "b"))
    return each.select("component", F.round("b.explained_variance_ratio", 6).alias("ratio"),
                       F.transform("b.components", lambda v: F.round(v, 5) + 0.0).alias("loadings"))


@query("pca_projection", with_(W_DECODE, s_rate(25), DECODE_LABELS, STEPS, ELEMS, *components_sql(2), """norms AS (
  SELECT qid, k AS layer, pos, any_value(step_index) AS step_index, any_value(n_steps) AS n_steps, any_value(correct) AS correct,
         sum((x - m) * v) AS norm FROM xs JOIN middle USING (dim) JOIN vectors USING (dim) GROUP BY 1, 2, 3)""", RESAMPLED, body="""
SELECT 7 AS layer, 'component_' || c.layer AS series, l.label, c.point, round(avg(c.value), 5) + 0.0 AS mean,
       round(stddev_pop(c.value), 5) AS std, count(*) AS n
FROM curves c JOIN labelled l USING (qid) GROUP BY c.layer, l.label, c.point"""))
def pca_projection(spark, sf_dir):
    """Group curves of the first two components; the basis is fitted on right and wrong traces alike."""
    basis = pca.fit_basis(B.decode_states(spark, sf_dir), layer=7, n_components=2, source="decode")
    series = T.component_series(_wrong_states(spark, sf_dir).where("layer = 7"), basis, 2)
    curves = T.group_curves(T.resample(series, 20, axis="step"), _decode_labels(spark, sf_dir))
    return curves.withColumns({"mean": F.round("mean", 5) + 0.0, "std": F.round("std", 5)})
