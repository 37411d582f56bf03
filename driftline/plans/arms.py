"""Arms that compress or mark the peers, one model for all delays, and what estimating the peers costs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import features
from driftline.operators import scoring, walkforward
from driftline.params import SHORT

from .base import query
from .study import TRAIN_SQL, long, rounded, study_rows

DELAYS_SQL = f"(SELECT unnest({list(SHORT.delays)}) AS delta)"
WINDOW_SQL = f"s.t >= greatest(0, r.cut - {SHORT.span}) AND s.t < r.cut"
# Own value, the peers' mean where all are there, and the first two peers of each (target, t).
PEERS_SQL = TRAIN_SQL + """, pw AS (SELECT target, t, max(CASE WHEN series_id = target THEN a END) AS a, CASE WHEN count(*) FILTER (series_id <> target AND a IS NULL) = 0 THEN avg(a) FILTER (series_id <> target) END AS mean,
  list(a ORDER BY series_id) FILTER (series_id <> target) AS ps FROM adm GROUP BY 1, 2)"""


def _two(design: str) -> str:
    """The walk with regressors x1, x2 of ``sx`` (target, delta, refit_id, t, y, x1, x2; ``test`` for rows to forecast) and penalty 3."""
    return f"""{design},
g AS (SELECT target, delta, refit_id, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2, sqrt(var_pop(x1)) + 1e-9 AS s1, sqrt(var_pop(x2)) + 1e-9 AS s2, covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2
  FROM sx WHERE NOT test AND x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= {SHORT.min_train}),
q AS (SELECT *, n * v1 / (s1 * s1) + 3 AS a11, n * v2 / (s2 * s2) + 3 AS a22, n * c12 / (s1 * s2) AS a12, n * c1 / s1 AS b1, n * c2 / s2 AS b2 FROM g)
SELECT x.target, CAST(x.delta AS int) AS delta, CAST(x.t AS bigint) AS t, round(coalesce(my + (b1 * a22 - b2 * a12) / (a11 * a22 - a12 * a12) * (x1 - m1) / s1 + (b2 * a11 - b1 * a12) / (a11 * a22 - a12 * a12) * (x2 - m2) / s2, 0), 6) AS f
FROM sx x LEFT JOIN q USING (target, delta, refit_id) WHERE test"""


# Training rows and test rows of every refit; each joins the window's own columns.
ROWS_SQL = f"""rx AS (SELECT r.target, r.delta, r.refit_id, s.t, false AS test FROM ref r JOIN lab s ON s.target = r.target AND {WINDOW_SQL} UNION ALL SELECT i.target, d.delta, i.j // {SHORT.refit}, i.t, true FROM idx i CROSS JOIN {DELAYS_SQL} d)"""


def first_own(spark, sf_dir, peers: int | None = None):
    """Study rows with the own level alone, and the first ``peers`` of the peers."""
    rows = study_rows(spark, sf_dir).withColumn("own", F.slice("own", 1, 1))
    return rows.withColumn("peers", F.slice("peers", 1, peers)) if peers else rows


def forecasts_of(rows, arm: str):
    f = walkforward.walk(rows, SHORT, arms=(arm,), lam=3.0)
    return f.select("target", "delta", long("t"), F.round("f", 6).alias("f"))


@query("WITH " + _two(f"""{PEERS_SQL}, {ROWS_SQL},
sx AS (SELECT x.target, x.delta, x.refit_id, x.t, x.test, l.y, o.a AS x1, c.mean AS x2 FROM rx x JOIN lab l ON l.target = x.target AND l.t = x.t JOIN pw c ON c.target = x.target AND c.t = x.t LEFT JOIN pw o ON o.target = x.target AND o.t = x.t - x.delta)"""))
def walk_forward_mean(spark, sf_dir):
    """M6: the purged walk of the stale own level beside the mean of all peers, with a fixed penalty."""
    return forecasts_of(first_own(spark, sf_dir), "mean")


@query("WITH " + _two(f"""{PEERS_SQL}, {ROWS_SQL},
bs AS (SELECT r.target, r.delta, r.refit_id, avg(ps[1]) AS m1, sqrt(var_pop(ps[1])) + 1e-9 AS d1, avg(ps[2]) AS m2, sqrt(var_pop(ps[2])) + 1e-9 AS d2, 0.5 * atan2(2 * covar_pop(ps[1], ps[2]) / ((sqrt(var_pop(ps[1])) + 1e-9) * (sqrt(var_pop(ps[2])) + 1e-9)), var_pop(ps[1]) / pow(sqrt(var_pop(ps[1])) + 1e-9, 2) - var_pop(ps[2]) / pow(sqrt(var_pop(ps[2])) + 1e-9, 2)) AS turn FROM ref r JOIN pw s ON s.target = r.target AND {WINDOW_SQL} WHERE ps[1] IS NOT NULL AND ps[2] IS NOT NULL GROUP BY 1, 2, 3),
sx AS (SELECT x.target, x.delta, x.refit_id, x.t, x.test, l.y, o.a AS x1, cos(turn) * (ps[1] - b.m1) / b.d1 + sin(turn) * (ps[2] - b.m2) / b.d2 AS x2 FROM rx x JOIN lab l ON l.target = x.target AND l.t = x.t JOIN pw c ON c.target = x.target AND c.t = x.t LEFT JOIN bs b ON b.target = x.target AND b.delta = x.delta AND b.refit_id = x.refit_id LEFT JOIN (SELECT target, t, a FROM pw) o ON o.target = x.target AND o.t = x.t - x.delta)"""))
def walk_forward_component(spark, sf_dir):
    """M6: the same beside the first principal component of two peers, learnt anew by each refit; SQL has it as the angle that the two make."""
    return forecasts_of(first_own(spark, sf_dir, 2), "pc1")


@query()
def walk_forward_factors(spark, sf_dir):
    """M6: skill of the own block alone and beside the peers' mean, first component, first two, all but the first, all turned, and all as they are."""
    s = scoring.skill(walkforward.walk(study_rows(spark, sf_dir), SHORT, arms=("own", *walkforward.FACTORS, "cross")))
    return s.select(*scoring.KEYS, "n", *rounded("mse", "r2"))


GAP = 2


@query("WITH " + _two(f"""{PEERS_SQL}, {ROWS_SQL},
sx AS (SELECT x.target, x.delta, x.refit_id, x.t, x.test, l.y, o.a AS x1, c.mean AS x2 FROM rx x JOIN lab l ON l.target = x.target AND l.t = x.t LEFT JOIN pw c ON c.target = x.target AND c.t = x.t - {GAP} LEFT JOIN pw o ON o.target = x.target AND o.t = x.t - x.delta)"""))
def walk_forward_gapped(spark, sf_dir):
    """The own level of each delay beside peers that are late themselves; fixed penalty."""
    rows = first_own(spark, sf_dir)
    return forecasts_of(rows.withColumn("peers", features.gapped(F.col("peers"), Window.partitionBy("target").orderBy("t"), GAP)), "mean")


@query(f"""WITH {TRAIN_SQL}, ow AS (SELECT target, t, a FROM adm WHERE series_id = target),
st AS (SELECT l.target, delta, l.t, l.y, o.a AS x FROM lab l CROSS JOIN {DELAYS_SQL} JOIN ow o ON o.target = l.target AND o.t = l.t - delta),
tr AS (SELECT r.target, r.delta, refit_id, x, y, row_number() OVER (PARTITION BY r.target, r.delta, refit_id ORDER BY s.t DESC) AS back, count(*) OVER p AS n, avg(x) OVER p AS mx, sqrt(var_pop(x) OVER p) + 1e-9 AS sd FROM ref r JOIN st s ON s.target = r.target AND s.delta = r.delta AND {WINDOW_SQL} WHERE x IS NOT NULL AND y IS NOT NULL WINDOW p AS (PARTITION BY r.target, r.delta, refit_id)),
tz AS (SELECT *, (x - mx) / sd AS z FROM tr WHERE n >= {SHORT.min_train}),
hd AS (SELECT target, delta, refit_id, max(n) AS n, max(mx) AS mx, max(sd) AS sd, avg(y) AS my, n * var_pop(z) AS zz, n * covar_pop(z, y) AS zy, avg(z) AS mz, count(*) FILTER (back > {SHORT.val}) AS hn, avg(z) FILTER (back > {SHORT.val}) AS hz, avg(y) FILTER (back > {SHORT.val}) AS hy, var_pop(z) FILTER (back > {SHORT.val}) AS hv, covar_pop(z, y) FILTER (back > {SHORT.val}) AS hc FROM tz GROUP BY target, delta, refit_id, n),
lm AS (SELECT *, unnest({list(SHORT.lambdas)}) AS lam, unnest(range({len(SHORT.lambdas)})) AS li FROM hd),
sc AS (SELECT l.target, l.delta, l.refit_id, l.lam, l.li, avg(pow(l.hy + l.hn * l.hc / (l.hn * l.hv + l.lam) * (z.z - l.hz) - z.y, 2)) AS mse FROM lm l JOIN tz z ON z.target = l.target AND z.delta = l.delta AND z.refit_id = l.refit_id AND z.back <= {SHORT.val} GROUP BY 1, 2, 3, 4, 5),
pk AS (SELECT target, delta, refit_id, lam FROM sc QUALIFY row_number() OVER (PARTITION BY target, delta, refit_id ORDER BY mse, li) = 1),
co AS (SELECT h.*, CASE WHEN n <= {SHORT.val + 50} THEN {SHORT.lambdas[len(SHORT.lambdas) // 2]} ELSE lam END AS pen FROM hd h JOIN pk USING (target, delta, refit_id))
SELECT i.target, CAST(s.delta AS int) AS delta, CAST(i.t AS bigint) AS t, round(coalesce(my + zy / (zz + pen) * ((s.x - mx) / sd - mz), 0), 6) AS f FROM idx i JOIN st s ON s.target = i.target AND s.t = i.t LEFT JOIN co ON co.target = i.target AND co.delta = s.delta AND co.refit_id = i.j // {SHORT.refit}""")
def walk_forward_validated(spark, sf_dir):
    """M1, M3, O2: the purged walk of the own level with the penalty that each refit's last rows choose, the first of equal ones."""
    f = walkforward.walk(first_own(spark, sf_dir), SHORT, arms=("own",))
    return f.select("target", "delta", long("t"), F.round("f", 6).alias("f"))


TRAIN_DELAYS, UNSEEN = SHORT.delays, (4, 6)
_M = ("x", "s", "z")
_COV = {(a, b): f"c_{a}{b}" for i, a in enumerate(_M) for b in _M[i:]}
_cof = "a_ss * a_zz - a_sz * a_sz", "a_sz * a_xz - a_xs * a_zz", "a_xs * a_sz - a_ss * a_xz", "a_xx * a_zz - a_xz * a_xz", "a_xz * a_xs - a_xx * a_sz", "a_xx * a_ss - a_xs * a_xs"


def _draw_sql() -> str:
    from driftline.operators.resample import scrambled_sql

    return scrambled_sql("(refit_id * 1000003 + t)")


@query(f"""WITH {TRAIN_SQL}, ow AS (SELECT target, t, a FROM adm WHERE series_id = target),
hd AS (SELECT target, j // {SHORT.refit} AS refit_id, greatest(0, t - {max(TRAIN_DELAYS)} - {SHORT.horizon}) AS cut FROM idx WHERE j % {SHORT.refit} = 0),
dw AS (SELECT r.target, refit_id, l.t, l.y FROM hd r JOIN lab l ON l.target = r.target AND l.t >= greatest(0, r.cut - {SHORT.span}) AND l.t < r.cut),
dl AS (SELECT *, {list(TRAIN_DELAYS)}[1 + {_draw_sql()} % {len(TRAIN_DELAYS)}] AS delta FROM dw),
tr AS (SELECT d.target, refit_id, y, o.a AS x, ln(1 + delta) AS s, ln(1 + delta) * o.a AS z FROM dl d JOIN ow o ON o.target = d.target AND o.t = d.t - d.delta WHERE y IS NOT NULL AND o.a IS NOT NULL),
g AS (SELECT target, refit_id, count(*) AS n, avg(y) AS my, {', '.join(f'avg({v}) AS m_{v}, sqrt(var_pop({v})) + 1e-9 AS d_{v}, covar_pop({v}, y) AS y_{v}' for v in _M)}, {', '.join(f'covar_pop({a}, {b}) AS {c}' for (a, b), c in _COV.items())} FROM tr GROUP BY 1, 2 HAVING count(*) >= {SHORT.min_train}),
q AS (SELECT *, {', '.join(f'n * {c} / (d_{a} * d_{b}) + {3 if a == b else 0} AS a_{a}{b}' for (a, b), c in _COV.items())}, {', '.join(f'n * y_{v} / d_{v} AS b_{v}' for v in _M)} FROM g),
w AS (SELECT *, a_xx * ({_cof[0]}) + a_xs * ({_cof[1]}) + a_xz * ({_cof[2]}) AS det FROM q),
b AS (SELECT *, (({_cof[0]}) * b_x + ({_cof[1]}) * b_s + ({_cof[2]}) * b_z) / det AS w_x, (({_cof[1]}) * b_x + ({_cof[3]}) * b_s + ({_cof[4]}) * b_z) / det AS w_s, (({_cof[2]}) * b_x + ({_cof[4]}) * b_s + ({_cof[5]}) * b_z) / det AS w_z FROM w)
SELECT i.target, CAST(d.delta AS int) AS delta, CAST(i.t AS bigint) AS t, round(coalesce(my + w_x * (o.a - m_x) / d_x + w_s * (ln(1 + d.delta) - m_s) / d_s + w_z * (ln(1 + d.delta) * o.a - m_z) / d_z, 0), 6) AS f
FROM idx i CROSS JOIN (SELECT unnest({list(TRAIN_DELAYS + UNSEEN)}) AS delta) d LEFT JOIN ow o ON o.target = i.target AND o.t = i.t - d.delta LEFT JOIN b ON b.target = i.target AND b.refit_id = i.j // {SHORT.refit}""")
def walk_masked_one(spark, sf_dir):
    """One model of the own level and its staleness for all delays, those that no row was trained at among them; fixed penalty."""
    f = walkforward.masked(first_own(spark, sf_dir), SHORT, TRAIN_DELAYS, TRAIN_DELAYS + UNSEEN, lam=3.0, peers=False)
    return f.select("target", "delta", long("t"), F.round("f", 6).alias("f"))


@query()
def walk_masked(spark, sf_dir):
    """M4: skill of one model for all delays with all columns, at trained and unseen delays, beside models of one delay each."""
    rows = study_rows(spark, sf_dir)
    one = walkforward.masked(rows, SHORT, TRAIN_DELAYS, TRAIN_DELAYS + UNSEEN)
    s = scoring.skill(one.unionByName(walkforward.walk(rows, SHORT, arms=("cross",))))
    return s.select(*scoring.KEYS, "n", *rounded("mse", "r2"))


@query(f"""WITH {PEERS_SQL}, {ROWS_SQL}, pv AS (SELECT target, t, a, ps[1] AS p FROM pw),
xx AS (SELECT x.*, l.y, c.a AS now, o.a AS stale, c.p - o.p AS move, c.p AS p FROM rx x JOIN lab l ON l.target = x.target AND l.t = x.t JOIN pv c ON c.target = x.target AND c.t = x.t LEFT JOIN pv o ON o.target = x.target AND o.t = x.t - x.delta),
sc AS (SELECT target, delta, refit_id, var_pop(p) AS vp FROM xx WHERE NOT test AND p IS NOT NULL GROUP BY 1, 2, 3),
be AS (SELECT target, delta, refit_id, sum(move * (now - stale)) / (sum(move * move) + 1e-12 * pow(sqrt(max(vp)) + 1e-9, 2)) AS beta, count(*) AS k FROM xx JOIN sc USING (target, delta, refit_id) WHERE NOT test AND move IS NOT NULL AND now - stale IS NOT NULL GROUP BY 1, 2, 3),
mk AS (SELECT xx.*, stale + CASE WHEN coalesce(k, 0) > 50 THEN beta ELSE 0 END * move AS x FROM xx LEFT JOIN be USING (target, delta, refit_id)),
g AS (SELECT target, delta, refit_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS v, sqrt(var_pop(x)) + 1e-9 AS sd, covar_pop(x, y) AS c FROM mk WHERE NOT test AND x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= {SHORT.min_train})
SELECT m.target, CAST(m.delta AS int) AS delta, CAST(m.t AS bigint) AS t, round(coalesce(my + n * c / sd / (n * v / (sd * sd) + 3) * (x - mx) / sd, 0), 6) AS f FROM mk m LEFT JOIN g USING (target, delta, refit_id) WHERE test""")
def walk_marked_one(spark, sf_dir):
    """The stale level rolled forward by one peer's change since, with the exposure that each refit learns; fixed penalty."""
    return forecasts_of(first_own(spark, sf_dir, 1), "mark")


@query()
def walk_marked(spark, sf_dir):
    """Skill of levels marked by the peers' first component or by all peers, in the own level's place or beside it."""
    s = scoring.skill(walkforward.walk(study_rows(spark, sf_dir), SHORT, arms=("own", *walkforward.MARKS, "cross")))
    return s.select(*scoring.KEYS, "n", *rounded("mse", "r2"))


@query()
def estimation_cost(spark, sf_dir):
    """The peers' gain, the mean gain of 100 draws of simulated peers that can know nothing (the cost of estimating them), and what is left."""
    c = walkforward.estimation_cost(study_rows(spark, sf_dir), SHORT, 100, lam=3.0)
    return c.select("target", "delta", "draws", *rounded("net", "cost", "cost_se", "gross"))


@query()
def cost_by_peers(spark, sf_dir):
    """The gain without delay against the number of peers, and the line through the origin."""
    c = walkforward.cost_by_peers(study_rows(spark, sf_dir), SHORT, (1, 2, 3, 4))
    return c.select("target", "peers", *rounded("gain", "least", "most", "slope", "explained"))
