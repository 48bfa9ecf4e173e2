"""Common table expressions shared by the reference SQL: the bindings of `bindings.py` once more."""


def with_(*parts: str, body: str) -> str:
    recursive = "RECURSIVE " if any("UNION ALL" in p and p.startswith("newton(") for p in parts) else ""
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + body


W_SINGLE = """w_single AS (
  SELECT vec_id // 5 AS qid, CAST(vec_id % 5 AS INTEGER) AS sample_idx,
         CAST(label >= 7 AS INTEGER) AS correct, embedding FROM embeddings)"""

W_LAYERS = """w_layers AS (
  SELECT qid, sample_idx, correct, CAST(l AS INTEGER) AS layer, CAST(d AS INTEGER) AS dim,
         CAST(embedding[8 * l + d + 1] AS DOUBLE) AS x
  FROM w_single, range(8) a(l), range(8) b(d))"""

W_DECODE = """w_decode AS (
  SELECT vec_id // 20 AS qid, max(CASE WHEN vec_id % 20 = 0 THEN CAST(label >= 7 AS INTEGER) END) AS correct,
         CAST(count(*) AS INTEGER) AS n_steps FROM embeddings GROUP BY 1)"""

STEPS = """steps AS (
  SELECT e.vec_id // 20 AS qid, CAST(e.vec_id % 20 AS INTEGER) AS pos, CAST(3 * (e.vec_id % 20) AS INTEGER) AS step_index,
         w.n_steps, w.correct, e.embedding
  FROM embeddings e JOIN w_decode w ON w.qid = e.vec_id // 20)"""

ELEMS = """elems AS (
  SELECT qid, pos, step_index, n_steps, correct, CAST(l AS INTEGER) AS layer, CAST(d AS INTEGER) AS dim,
         CAST(embedding[8 * l + d + 1] AS DOUBLE) AS x
  FROM steps, range(8) a(l), range(8) b(d))"""

NORMS = """norms AS (
  SELECT qid, layer, pos, any_value(step_index) AS step_index, any_value(n_steps) AS n_steps,
         any_value(correct) AS correct, sqrt(sum(x * x)) AS norm FROM elems GROUP BY 1, 2, 3)"""


def s_rate(modulus: int = 100) -> str:
    return f"""s_rate AS (
  SELECT user_id % {modulus} AS qid, avg(CAST(value > 34.59 AS INTEGER)) AS pass_rate FROM events GROUP BY 1)"""


SINGLE_LABELS = """labelled AS (
  SELECT w.*, CASE WHEN s.pass_rate > 0.5 THEN 0 ELSE 1 END AS label
  FROM w_single w LEFT JOIN s_rate s USING (qid) WHERE w.correct = 0)"""

DECODE_LABELS = """labelled AS (
  SELECT w.qid, w.n_steps, CASE WHEN s.pass_rate > 0.5 THEN 0 ELSE 1 END AS label
  FROM w_decode w LEFT JOIN s_rate s USING (qid) WHERE w.correct = 0)"""

# Won pairs by mid-ranks; expects scored(<cells>, score, label).


def auc_sql(cells: str) -> str:
    part = f"PARTITION BY {cells} " if cells else ""
    group = f"GROUP BY {cells}" if cells else ""
    lead = f"{cells}, " if cells else ""
    return f"""ranked AS (
  SELECT {lead}score, label,
         rank() OVER ({part}ORDER BY score) + (count(*) OVER ({part.rstrip()}{',' if part else 'PARTITION BY'} score) - 1) / 2.0 AS mid
  FROM scored WHERE score IS NOT NULL),
sums AS (
  SELECT {lead}CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg,
         sum(CASE WHEN label = 1 THEN mid ELSE 0 END) AS r1 FROM ranked {group})"""


AUC_VALUE = "CASE WHEN n_pos > 0 AND n_neg > 0 THEN (r1 - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END"


def newton_sql(cells: str, c: float, steps: int = 25) -> str:
    """fitted(<cells>, w1, w2, b): |w|^2 / 2 + c * logloss minimised over train(<cells>, x1, x2, y), by Newton's method.

    The 3 x 3 system of a step is solved by cofactors.
    """
    lead = f"{cells}, " if cells else ""
    on = " AND ".join(f"n.{k.strip()} = t.{k.strip()}" for k in cells.split(",")) if cells else "true"
    own = "".join(f"n.{k.strip()}, " for k in cells.split(",")) if cells else ""
    first = f"SELECT DISTINCT {lead}" if cells else "SELECT "
    source = " FROM train" if cells else ""
    return f"""newton({lead}step, w1, w2, b) AS (
  {first}0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE{source}
  UNION ALL
  SELECT {lead}step + 1,
         w1 - (g1 * (h22 * h33 - h23 * h23) + g2 * (h13 * h23 - h12 * h33) + g3 * (h12 * h23 - h13 * h22)) / det,
         w2 - (g1 * (h13 * h23 - h12 * h33) + g2 * (h11 * h33 - h13 * h13) + g3 * (h12 * h13 - h11 * h23)) / det,
         b - (g1 * (h12 * h23 - h13 * h22) + g2 * (h12 * h13 - h11 * h23) + g3 * (h11 * h22 - h12 * h12)) / det
  FROM (
    SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h13 * h23) + h13 * (h12 * h23 - h13 * h22) AS det FROM (
      SELECT {lead}step, w1, w2, b,
             {c} * sum((m - y) * x1) + w1 AS g1, {c} * sum((m - y) * x2) + w2 AS g2, {c} * sum(m - y) AS g3,
             {c} * sum(m * (1 - m) * x1 * x1) + 1 AS h11, {c} * sum(m * (1 - m) * x2 * x2) + 1 AS h22, {c} * sum(m * (1 - m)) AS h33,
             {c} * sum(m * (1 - m) * x1 * x2) AS h12, {c} * sum(m * (1 - m) * x1) AS h13, {c} * sum(m * (1 - m) * x2) AS h23
      FROM (SELECT {own}n.step, n.w1, n.w2, n.b, t.x1, t.x2, t.y, 1 / (1 + exp(-(n.w1 * t.x1 + n.w2 * t.x2 + n.b))) AS m
            FROM newton n JOIN train t ON {on} WHERE n.step < {steps}) GROUP BY {lead}step, w1, w2, b))),
fitted AS (SELECT {lead}w1, w2, b FROM newton WHERE step = {steps})"""


def mix_sql(source: str, keep: str) -> str:
    """`source` yields the columns `keep` and x, a number below 2^32; the same with x mixed."""
    for step in ("xor(x, x >> 16)", f"(x * {0x21F0AAAD}) % 4294967296", "xor(x, x >> 15)", f"(x * {0x735A2D97}) % 4294967296", "xor(x, x >> 15)"):
        source = f"SELECT {keep}, {step} AS x FROM ({source})"
    return source


def draws_sql(replicates: int, n: str, seed: int) -> str:
    """draws(rep, row_no): `n` (a query of one number) draws with replacement below it for every replicate."""
    first = mix_sql(f"SELECT rep, (rep + {seed * 1_000_003}) % 4294967296 AS x FROM range({replicates}) r(rep)", "rep")
    second = mix_sql(f"SELECT rep, x AS first, (x + rep + 1) % 4294967296 AS x FROM ({first})", "rep, first")
    low = mix_sql(f"SELECT rep, x AS second, i, (i + first) % 4294967296 AS x FROM ({second}), range(({n})) t(i)", "rep, second, i")
    low = mix_sql(f"SELECT rep, xor(x, second) AS x FROM ({low})", "rep")
    high = mix_sql(f"SELECT rep, x AS low, (x + {0x9E3779B9}) % 4294967296 AS x FROM ({low})", "rep, low")
    return f"draws AS (SELECT rep, ((x % 1073741824) * 4294967296 + low) % ({n}) AS row_no FROM ({high}))"
