"""Latent states, the stability of correlations, damaged and undone series, regimes of another series, losses on other scales."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import features, frames
from driftline.operators import audit, breaks, filters, panel, scoring, walkforward
from driftline.params import SHORT
from driftline.sources import provenance

from .base import BARS_SQL, SIGNALS_SQL, bars, query, signals
from .robust import LOSS_SQL, losses
from .study import D_SQL, FC_SQL, SKILL_SQL, TRAIN_SQL, UNION_SQL, forecasts, known_panel, long, loss_differences, rounded, study_rows

FIRST, EVERY = SHORT.span, 252
_cov = lambda k: f"(sum(v * l{k}) - m * (sum(CASE WHEN k > {k} THEN v END) + sum(l{k})) + (max(n) - {k}) * m * m) / max(n)"
# Parameters of each vintage straight from its rows, and the filter as a recursion over rows.
FILTER_SQL = SIGNALS_SQL + f""", ob AS (SELECT series_id, t, a FROM sig),
vt AS (SELECT series_id, unnest(range({FIRST}, max(t) + 1, {EVERY})) AS made FROM ob GROUP BY 1),
vv AS (SELECT series_id, made, v, lag(v, 0) OVER w AS l0, lag(v, 1) OVER w AS l1, lag(v, 2) OVER w AS l2, row_number() OVER w AS k, count(*) OVER (PARTITION BY series_id, made) AS n, avg(v) OVER (PARTITION BY series_id, made) AS m FROM (SELECT vt.series_id, made, t, a AS v FROM vt JOIN ob ON ob.series_id = vt.series_id AND ob.t < made WHERE a IS NOT NULL) WINDOW w AS (PARTITION BY series_id, made ORDER BY t)),
vg AS (SELECT series_id, made, max(n) AS n, {', '.join(f'{_cov(k)} AS g{k}' for k in (0, 1, 2))} FROM vv GROUP BY series_id, made, m),
vp AS (SELECT *, CASE WHEN abs(g1) > 1e-12 THEN least(greatest(g2 / g1, 0), 0.999) ELSE 0 END AS phi FROM vg),
vl AS (SELECT *, greatest(CASE WHEN phi > 1e-9 THEN g1 / phi ELSE 0 END, 1e-12) AS lev FROM vp),
pa AS (SELECT series_id, made, n, phi, lev * (1 - phi * phi) AS q, greatest(g0 - lev, 1e-9) AS r FROM vl)"""
_STEP = "phi * phi * p + q"
STATE_SQL = FILTER_SQL + f""",
fs AS (SELECT series_id, made, phi, q, r, -1::bigint AS t, 0.0::double AS x, q / greatest(1 - phi * phi, 1e-6) AS p FROM pa
UNION ALL SELECT f.series_id, made, phi, q, r, f.t + 1, CASE WHEN a IS NULL THEN phi * x ELSE phi * x + ({_STEP}) / ({_STEP} + r) * (a - phi * x) END, CASE WHEN a IS NULL THEN {_STEP} ELSE (1 - ({_STEP}) / ({_STEP} + r)) * ({_STEP}) END FROM fs f JOIN ob ON ob.series_id = f.series_id AND ob.t = f.t + 1),
lv AS (SELECT series_id, t, made, x FROM fs WHERE t - {SHORT.horizon} >= made QUALIFY row_number() OVER (PARTITION BY series_id, t ORDER BY made DESC) = 1)"""


@query(f"WITH {FILTER_SQL} SELECT series_id, CAST(made AS int) AS made, n, round(phi, 6) AS phi, round(q, 6) AS q, round(r, 6) AS r FROM pa")
def filter_vintages(spark, sf_dir):
    """Persistence, shock and noise of each series from all its rows before a vintage, all vintages in one pass."""
    v = filters.vintages(signals(spark, sf_dir), FIRST, EVERY)
    return v.select("series_id", F.col("made").cast("int").alias("made"), long("n"), *rounded("phi", "q", "r"))


@query(f"WITH RECURSIVE {STATE_SQL} SELECT series_id, CAST(t AS bigint) AS t, CAST(made AS int) AS made, round(x, 6) AS state FROM lv")
def live_filter(spark, sf_dir):
    """Each series' own state under the newest parameters that its forecaster could have had."""
    s = filters.live_states(signals(spark, sf_dir), FIRST, EVERY, SHORT.horizon)
    return s.select("series_id", long("t"), "made", F.round("state", 6).alias("state"))


@query(f"""WITH RECURSIVE {STATE_SQL}, lab AS (SELECT series_id AS target, t, a, lead(a, {SHORT.horizon}) OVER (PARTITION BY series_id ORDER BY t) AS y FROM ob),
fi AS (SELECT l.target, l.t, l.y, v.x FROM lab l LEFT JOIN lv v ON v.series_id = l.target AND v.t = l.t),
idx AS (SELECT target, t, y, row_number() OVER (PARTITION BY target ORDER BY t) - 1 AS j FROM fi WHERE y IS NOT NULL AND t >= {SHORT.median + SHORT.span + max(SHORT.delays) + SHORT.horizon}),
ref AS (SELECT target, delta, j // {SHORT.refit} AS refit_id, greatest(0, t - delta - {SHORT.horizon}) AS cut FROM idx CROSS JOIN (SELECT unnest({list(SHORT.delays)}) AS delta) WHERE j % {SHORT.refit} = 0),
st AS (SELECT o.target, delta, o.t, o.y, s.x FROM fi o CROSS JOIN (SELECT unnest({list(SHORT.delays)}) AS delta) JOIN fi s ON s.target = o.target AND s.t = o.t - delta),
g AS (SELECT r.target, r.delta, refit_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, sqrt(var_pop(x)) + 1e-9 AS sd, var_pop(x) AS v, covar_pop(x, y) AS c FROM ref r JOIN st s ON s.target = r.target AND s.delta = r.delta AND s.t >= greatest(0, r.cut - {SHORT.span}) AND s.t < r.cut WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= {SHORT.min_train})
SELECT i.target, CAST(s.delta AS int) AS delta, CAST(i.t AS bigint) AS t, round(coalesce(my + n * c / sd / (n * v / (sd * sd) + 3) * (s.x - mx) / sd, 0), 6) AS f FROM idx i JOIN st s ON s.target = i.target AND s.t = i.t LEFT JOIN g ON g.target = i.target AND g.delta = s.delta AND g.refit_id = i.j // {SHORT.refit}""")
def walk_filtered(spark, sf_dir):
    """M7: the purged walk of the stale filtered state in the level's place; fixed penalty."""
    s = signals(spark, sf_dir)
    f = filters.live_states(s, FIRST, EVERY, SHORT.horizon)
    w = frames.ordered("series_id")
    rows = s.select("series_id", F.col("t").cast("int").alias("t"), F.lead("a", SHORT.horizon).over(w).alias("y")).join(f.select("series_id", "t", "state"), ["series_id", "t"], "left")
    rows = rows.select(F.col("series_id").alias("target"), "t", F.array("state").alias("own"), F.array().cast("array<double>").alias("peers"), "y")
    w = walkforward.walk(rows, SHORT, arms=("own",), lam=3.0)
    return w.select("target", "delta", long("t"), F.round("f", 6).alias("f"))


@query(f"""WITH {UNION_SQL}, fl AS (SELECT *, CASE WHEN min(CAST(a IS NOT NULL AS int)) OVER (PARTITION BY target, t) = 1 THEN a END AS v FROM adm),
pr AS (SELECT x.target, x.t, x.series_id AS one, y.series_id AS two, x.v AS u, y.v AS v FROM fl x JOIN fl y ON y.target = x.target AND y.t = x.t AND x.series_id < y.series_id),
co AS (SELECT target, t, one, two, CASE WHEN count(u) OVER p >= 126 AND row_number() OVER w > 252 THEN corr(u, v) OVER p END AS c FROM pr WINDOW w AS (PARTITION BY target, one, two ORDER BY t), p AS (PARTITION BY target, one, two ORDER BY t ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
lg AS (SELECT *, lag(c, 63) OVER (PARTITION BY target, one, two ORDER BY t) AS b FROM co)
SELECT target, CAST(t AS bigint) AS t, count(*) AS pairs, round(corr(c, b), 5) AS stability FROM lg WHERE c IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2""")
def structure_stability(spark, sf_dir):
    """How far the pattern of all pairs' correlations in the last 252 rows is that of a quarter before."""
    p = known_panel(spark, sf_dir).select("target", "t", "series_id", "a")
    return scoring.structure_stability(p, ["target"]).select("target", long("t"), "pairs", F.round("stability", 5).alias("stability"))


@query(f"""WITH {SKILL_SQL}, cp AS (SELECT o.series_id AS target, avg(corr) AS coupling FROM (SELECT x.series_id, y.series_id AS peer, corr(x.a, y.a) AS corr FROM sig x JOIN sig y ON y.date = x.date AND y.series_id <> x.series_id GROUP BY 1, 2) o GROUP BY 1),
pt AS (SELECT concat(rt.target, '/', delta) AS id, coupling AS x, s_cross - s_own AS y FROM rt JOIN cp ON cp.target = rt.target WHERE delta > 0),
o AS (SELECT p.id, corr(q.x, q.y) AS without, regr_slope(q.y, q.x) AS slope, regr_intercept(q.y, q.x) AS i FROM pt p JOIN pt q ON q.id <> p.id GROUP BY 1), s AS (SELECT avg(x) AS m, regr_sxx(y, x) AS sxx, count(*) AS n FROM pt)
SELECT id, round(without, 5) AS without, round(slope, 5) AS slope, round(-i / slope, 5) AS crossing, round(1 / s.n + (x - m) ** 2 / sxx, 6) AS leverage FROM o JOIN pt USING (id) CROSS JOIN s""")
def leave_one_out(spark, sf_dir):
    """Whether the relation of coupling and gain, one point for each target and delay, hangs on a single point."""
    s = signals(spark, sf_dir)
    a, b = s.select(F.col("series_id").alias("target"), "date", F.col("a").alias("u")), s.select(F.col("series_id").alias("peer"), "date", F.col("a").alias("v"))
    c = a.join(b, "date").where("target <> peer").groupBy("target", "peer").agg(F.corr("u", "v").alias("c")).groupBy("target").agg(F.avg("c").alias("x"))
    r = scoring.substitution_rate(scoring.skill(forecasts(spark, sf_dir))).where("delta > 0")
    p = r.join(c, "target").select(F.concat_ws("/", "target", F.col("delta").cast("string")).alias("id"), "x", (F.col("s_cross") - F.col("s_own")).alias("y"))
    return scoring.leave_one_out(p, "x", "y").select("id", *[F.round(k, 5).alias(k) for k in ("without", "slope", "crossing")], F.round("leverage", 6).alias("leverage"))


@query(f"""WITH {BARS_SQL}, o AS (SELECT date, open, high, low, close FROM raw WHERE series_id = 'ASIA'),
x AS (SELECT r.*, row_number() OVER w - 1 AS ix, count(*) OVER (PARTITION BY r.series_id) AS n, {', '.join(f'coalesce(last_value(o.{c} IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), first_value(o.{c} IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS o_{c}' for c in ('open', 'high', 'low', 'close'))} FROM raw r LEFT JOIN o ON o.date = r.date WINDOW w AS (PARTITION BY r.series_id ORDER BY r.date)),
s AS (SELECT *, max(CASE WHEN ix = n // 2 - 1 THEN close / o_close END) OVER (PARTITION BY series_id) AS scale FROM x)
SELECT series_id, CAST(date AS varchar) AS date, {', '.join(f'round(ln(CASE WHEN ix >= n // 2 THEN o_{c} * scale ELSE {c} END), 6) AS {c}' for c in ('open', 'high', 'low', 'close'))} FROM s""")
def spliced(spark, sf_dir):
    """From the middle on, every series is another vendor's, scaled to the close before; in logs."""
    b = bars(spark, sf_dir)
    s = breaks.spliced(b, b.where("series_id = 'ASIA'"), F.floor(F.col("n") / 2))
    return s.select("series_id", F.col("date").cast("string").alias("date"), *[F.round(F.log(c), 6).alias(c) for c in ("open", "high", "low", "close")])


MONTH_SQL = BARS_SQL + """, mc AS (SELECT series_id, date_trunc('month', date) AS month, arg_max(close, date) AS close FROM raw GROUP BY 1, 2), mr AS (SELECT series_id, month, ln(close / lag(close) OVER (PARTITION BY series_id ORDER BY month)) AS r FROM mc)"""


def monthly(spark, sf_dir):
    """(series_id, month, r): returns of month ends."""
    m = bars(spark, sf_dir).groupBy("series_id", F.trunc("date", "MM").alias("month")).agg(F.max_by("close", "date").alias("close"))
    return m.select("series_id", "month", F.log(F.col("close") / F.lag("close").over(Window.partitionBy("series_id").orderBy("month"))).alias("r"))


@query(f"""WITH {MONTH_SQL}, av AS (SELECT series_id, month, avg(r) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r FROM mr WHERE r IS NOT NULL), ks AS (SELECT *, row_number() OVER w AS k, lag(r) OVER w AS before FROM av WINDOW w AS (PARTITION BY series_id ORDER BY month)),
rh AS (SELECT series_id, CASE WHEN count(*) FILTER (k <= 60) < 24 THEN 0 ELSE least(greatest(coalesce(corr(before, r) FILTER (k <= 60), 0), 0), 0.95) END AS rho FROM ks GROUP BY 1)
SELECT series_id, strftime(month, '%Y-%m-%d') AS month, round(r, 6) AS r, round(rho, 6) AS rho, round((r - rho * before) / (1 - rho), 6) AS sharp FROM ks JOIN rh USING (series_id)""")
def desmoothed(spark, sf_dir):
    """Three-month means of returns, as an appraiser would quote them, with the smoothing undone."""
    m = monthly(spark, sf_dir).where("r IS NOT NULL")
    smooth = m.withColumn("r", F.avg("r").over(Window.partitionBy("series_id").orderBy("month").rowsBetween(-2, 0)))
    d = breaks.desmoothed(smooth, 60)
    return d.select("series_id", F.date_format("month", "yyyy-MM-dd").alias("month"), *rounded("r", "rho", "sharp"))


@query(f"""WITH {TRAIN_SQL}, pm AS (SELECT target, t, max(date) AS date, avg(a) FILTER (series_id <> target) AS x FROM adm GROUP BY 1, 2), hd AS (SELECT target, t AS refit FROM idx WHERE j % {SHORT.refit} = 0),
mm AS (SELECT h.target, refit, month(date) AS month, avg(x) AS mean FROM hd h JOIN pm p ON p.target = h.target AND p.t < h.refit WHERE x IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 3),
rw AS (SELECT p.target, p.t, month(date) AS month, CASE WHEN i.j IS NULL THEN f.refit ELSE max(h.refit) OVER (PARTITION BY p.target ORDER BY p.t) END AS refit FROM pm p LEFT JOIN idx i ON i.target = p.target AND i.t = p.t LEFT JOIN hd h ON h.target = p.target AND h.refit = p.t JOIN (SELECT target, min(refit) AS refit FROM hd GROUP BY 1) f ON f.target = p.target)
SELECT r.target, CAST(r.t AS bigint) AS t, round(mean, 6) AS placebo FROM rw r LEFT JOIN mm ON mm.target = r.target AND mm.refit = r.refit AND mm.month = r.month""")
def seasonal_placebo(spark, sf_dir):
    """Peers that carry the shared seasons and nothing else, their months' means renewed at each refit."""
    r = study_rows(spark, sf_dir).select("target", "t", features.finite_mean(F.col("peers")).alias("x"), walkforward.position(SHORT).alias("j"))
    d = known_panel(spark, sf_dir).groupBy("target", "t").agg(F.month(F.max("date")).alias("month"))
    return breaks.seasonal_placebo(r.join(d, ["target", "t"]), SHORT.refit).select("target", long("t"), F.round("placebo", 6).alias("placebo"))


SHARES = {"top33": 2 / 3, "top20": 0.8, "top10": 0.9}
CRISIS = ("1996-06-01", "1997-06-30")
SECOND_SQL = LOSS_SQL + f""", cal AS (SELECT series_id AS target, date, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS t FROM sig),
oc AS (SELECT cal.target, cal.t, cal.date, last_value(s.a IGNORE NULLS) OVER (PARTITION BY cal.target ORDER BY cal.t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS o FROM cal LEFT JOIN sig s ON s.series_id = 'ASIA' AND s.date = cal.date),
ov AS (SELECT *, lag(o) OVER (PARTITION BY target ORDER BY t) AS v FROM oc),
oq AS (SELECT target, t, date, v, {', '.join(f'CASE WHEN count(v) OVER p >= 60 THEN quantile_cont(v, {q!r}) OVER p END AS {k}' for k, q in SHARES.items())} FROM ov WINDOW p AS (PARTITION BY target ORDER BY t ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
jn AS (SELECT l.target, l.t, own - "cross" AS num, own - fresh AS den, v, date, top33, top20, top10, quantile_cont(v, 1 / 3.0::double) OVER (PARTITION BY l.target) AS w1, quantile_cont(v, 2 / 3.0::double) OVER (PARTITION BY l.target) AS w2 FROM ls l JOIN oq q ON q.target = l.target AND q.t = l.t WHERE delta = 2),
ms AS (SELECT target, num, den, unnest(['bottom67', 'top33', 'top20', 'top10', 'calm', 'middle', 'stressed', 'crisis', 'outside']) AS regime,
  unnest([v <= top33, v > top33, v > top20, v > top10, v <= w1, v > w1 AND v <= w2, v > w2, date BETWEEN DATE '{CRISIS[0]}' AND DATE '{CRISIS[1]}', date NOT BETWEEN DATE '{CRISIS[0]}' AND DATE '{CRISIS[1]}']) AS inside FROM jn)"""


@query(f"WITH {SECOND_SQL} SELECT target, regime, count(*) AS n, round(CASE WHEN abs(sum(den)) > 1e-9 THEN sum(num) / sum(den) END, 4) AS rate FROM ms WHERE inside GROUP BY 1, 2")
def second_series_regimes(spark, sf_dir):
    """the rate at delay 2 by rungs of another series as of the row before, by its whole-window terciles (which look ahead, for comparison), and in and out of a crisis."""
    s = signals(spark, sf_dir)
    v = panel.rungs(panel.second_series(s, "ASIA", s.select(F.col("series_id").alias("target"), "date")), SHARES)
    q = losses(spark, sf_dir).where("delta = 2").select("target", "t", (F.col("own") - F.col("cross")).alias("num"), (F.col("own") - F.col("fresh")).alias("den"))
    j = q.join(v, ["target", "t"])
    whole = lambda p: F.percentile("v", F.lit(p)).over(Window.partitionBy("target"))
    j = j.withColumn("w1", whole(1 / 3)).withColumn("w2", whole(2 / 3))
    x, crisis = F.col("v"), F.col("date").between(*CRISIS)
    masks = {"bottom67": F.col("base"), **{k: F.col(k) for k in SHARES}, "calm": x <= F.col("w1"), "middle": (x > F.col("w1")) & (x <= F.col("w2")), "stressed": x > F.col("w2"), "crisis": crisis, "outside": ~crisis}
    m = j.select("target", "num", "den", F.explode(F.array(*[F.struct(F.lit(k).alias("regime"), c.alias("inside")) for k, c in masks.items()])).alias("m")).where("m.inside")
    rate = F.when(F.abs(F.sum("den")) > 1e-9, F.sum("num") / F.sum("den"))
    return m.groupBy("target", "m.regime").agg(F.count("*").alias("n"), F.round(rate, 4).alias("rate"))


_LOSS = {"qlike": "ev / {x} - ln(ev / {x}) - 1", "mse": "pow(ev - {x}, 2)", "natural": "pow(ev * mh - {x} * m0, 2)", "unweighted": "pow((ev - {x}) * mh, 2)"}


@query(f"""WITH {FC_SQL}, sm AS (SELECT *, coalesce(avg(exp(y - f)) OVER (PARTITION BY target, arm, delta ORDER BY t ROWS BETWEEN {SHORT.span + 1} PRECEDING AND 2 PRECEDING), 1) AS smear FROM fc),
bv AS (SELECT series_id AS target, t, coalesce(avg(exp(y)) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {SHORT.span + 1} PRECEDING AND 2 PRECEDING), 1) AS bench_var, exp(lm) AS m0, exp(lead(lm) OVER (PARTITION BY series_id ORDER BY t)) AS mh FROM study),
jn AS (SELECT s.*, exp(y) AS ev, exp(f) * smear AS h, bench_var AS b, m0, mh FROM sm s JOIN bv USING (target, t) WHERE y IS NOT NULL AND f IS NOT NULL AND bench_var IS NOT NULL AND m0 IS NOT NULL AND mh IS NOT NULL)
SELECT target, arm, delta, count(*) AS n, {', '.join(f"round(1 - sum({e.format(x='h')}) / sum({e.format(x='b')}), 6) AS {k}_skill" for k, e in _LOSS.items())} FROM jn GROUP BY 1, 2, 3""")
def scale_losses(spark, sf_dir):
    """A1, M5: skill of smeared variances by four losses, against the resolved labels' mean variance."""
    s = signals(spark, sf_dir)
    w = frames.ordered("series_id")
    m = s.select(F.col("series_id").alias("target"), "t", "lm", F.lead("a").over(w).alias("y"), F.exp("lm").alias("m0"), F.exp(F.lead("lm").over(w)).alias("mh"))
    w = frames.ordered("target")
    m = m.withColumn("bench_var", F.coalesce(F.avg(F.exp("y")).over(w.rowsBetween(-(SHORT.span + 1), -2)), F.lit(1.0))).drop("y", "lm")
    f = scoring.smear(forecasts(spark, sf_dir), SHORT.span, SHORT.horizon).join(m, ["target", "t"])
    return scoring.scale_losses(f).select(*scoring.KEYS, "n", *rounded(*[f"{k}_skill" for k in _LOSS]))


@query(f"""WITH {SIGNALS_SQL}, ms AS (SELECT series_id, t, CASE WHEN count(c) OVER f >= 22 THEN avg(c) OVER f END AS slow, yz FROM (SELECT series_id, t, yz, r * r AS c FROM sig) WINDOW f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)),
md AS (SELECT *, CASE WHEN count(slow) OVER m >= {SHORT.min_periods} THEN quantile_cont(slow, 0.5) OVER m END AS ms, CASE WHEN count(yz) OVER m >= {SHORT.min_periods} THEN quantile_cont(yz, 0.5) OVER m END AS my FROM ms WINDOW m AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {SHORT.median - 1} PRECEDING AND CURRENT ROW))
SELECT series_id, CAST(t AS bigint) AS t, round(ln(slow / ms), 6) AS slow, round(ln(my), 6) AS level FROM md""")
def slow_measures(spark, sf_dir):
    """A variance over 22 rows against its median, and the level that the study's own median takes out."""
    w = frames.ordered("series_id")
    s = signals(spark, sf_dir).withColumn("c22", frames.mean(F.col("r") * F.col("r"), w, 22))
    m = features.measures(F.col("yz"), F.col("c22"), w, SHORT.median, SHORT.min_periods)
    return s.select("series_id", long("t"), *[F.round(c, 6).alias(k) for k, c in m.items()])


@query(f"""WITH {BARS_SQL}, j AS (SELECT series_id, date, ln(close / lag(close) OVER (PARTITION BY series_id ORDER BY date)) AS jump FROM raw), s AS (SELECT *, stddev_samp(jump) OVER (PARTITION BY series_id) AS sd FROM j)
SELECT series_id, CAST(date AS varchar) AS date, round(jump, 6) AS jump FROM s WHERE abs(jump) > 3 * sd""")
def discontinuities(spark, sf_dir):
    """Returns beyond three standard deviations of their series."""
    return audit.discontinuity(bars(spark, sf_dir)).select("series_id", F.col("date").cast("string").alias("date"), F.round("jump", 6).alias("jump"))


@query(f"""WITH {BARS_SQL}, o AS (SELECT r.series_id, r.close AS x, CASE WHEN row_number() OVER (PARTITION BY r.series_id ORDER BY r.date) % 50 = 0 THEN r.close * 1.01 ELSE r.close * 1.001 END AS y, r.date FROM raw r)
SELECT series_id, count(*) AS shared, count(*) FILTER (abs(x - y) > 0.005 * abs(x)) AS apart FROM o GROUP BY 1""")
def reconciled(spark, sf_dir):
    """Closes against a second source that is off by a tenth of a percent everywhere and by one percent on each fiftieth row."""
    b = bars(spark, sf_dir)
    other = b.withColumn("close", F.col("close") * F.when((F.col("t") + 1) % 50 == 0, 1.01).otherwise(1.001))
    return panel.reconcile(b, other)


@query(f"""WITH {D_SQL}, fo AS (SELECT target, delta, t, d FROM df WHERE delta > 0), fl AS (SELECT target, delta, t, d FROM fo QUALIFY count(*) OVER (PARTITION BY target, t) = 3),
ce AS (SELECT 'whole' AS family, concat('whole:', target, '/', delta) AS cell_id, concat(target, '-', delta) AS label, count(*) AS n, min(t) AS start, max(t) AS stop FROM fl GROUP BY target, delta UNION ALL SELECT 'own', concat('own:', target, '/', delta), concat(target, '-own', delta), count(*), min(t), max(t) FROM fo GROUP BY target, delta),
lb AS (SELECT n, start, stop, string_agg(DISTINCT label, '+' ORDER BY label) AS calendar_group FROM ce GROUP BY 1, 2, 3)
SELECT cell_id, family, calendar_group, CAST(n AS bigint) AS n FROM ce JOIN lb USING (n, start, stop)""")
def harvested(spark, sf_dir):
    """Cells recorded under several labels, those of one calendar merged."""
    d = loss_differences(spark, sf_dir).where("delta > 0")
    full = d.withColumn("k", F.count("*").over(Window.partitionBy("target", "t"))).where("k = 3").drop("k")
    label = lambda tag: F.concat(F.col("target"), F.lit(tag), F.col("delta").cast("string"))
    cells = [x.groupBy("target", "delta").agg(F.collect_list("d").alias("series"), F.min("t").alias("start"), F.max("t").alias("stop")).select(F.lit(f).alias("family"), F.concat(F.lit(f"{f}:"), label("/")).alias("cell_id"), label(tag).alias("calendar_group"), "series", "start", "stop") for f, x, tag in (("whole", full, "-"), ("own", d, "-own"))]
    return provenance.harvest(cells[0].unionByName(cells[1]), ("whole", "own")).select("cell_id", "family", "calendar_group", long("n"))


@query()
def walk_factor_filter(spark, sf_dir):
    """Skill of the ragged-edge factor in the own block's place, with parameters of the first rows and with ever newer ones, beside the stale block alone and with all peers."""
    rows = study_rows(spark, sf_dir)
    base = walkforward.stale_rows(rows, SHORT)
    parts = [walkforward.walk(rows, SHORT)]
    for name, every in (("frozen", None), ("live", EVERY)):
        s = filters.factor_states(rows, SHORT.delays, FIRST, every, SHORT.horizon)
        known = base.join(s.select("target", "delta", F.col("t").alias("t"), "state"), ["target", "delta", "t"], "left").withColumn("stale", F.array("state")).drop("state")
        parts.append(walkforward.walk(known, SHORT, arms=("own",)).withColumn("arm", F.lit(name)))
    s = scoring.skill(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return s.select(*scoring.KEYS, "n", *rounded("mse", "r2"))


@query(f"""WITH {UNION_SQL}, ok AS (SELECT target, date FROM adm GROUP BY 1, 2 HAVING min(CAST(a IS NOT NULL AS int)) = 1), al AS (SELECT date FROM ok WHERE target = 'ASIA' INTERSECT SELECT date FROM ok WHERE target = 'EUROPE' INTERSECT SELECT date FROM ok WHERE target = 'AMERICA')
SELECT adm.target, count(*) AS n, CAST(min(date) AS varchar) AS first, CAST(max(date) AS varchar) AS last, round(avg(a), 6) AS mean FROM adm SEMI JOIN al USING (date) WHERE target IN ('ASIA', 'EUROPE', 'AMERICA') AND series_id = target GROUP BY 1""")
def common_dates(spark, sf_dir):
    """Three targets on the days that all three can use, so that their scores compare like with like."""
    p = known_panel(spark, sf_dir)
    full = p.withColumn("whole", F.min(F.col("a").isNotNull().cast("int")).over(Window.partitionBy("target", "date"))).where("whole = 1 AND series_id = target")
    names = ("ASIA", "EUROPE", "AMERICA")
    each = panel.shared_dates([full.where(F.col("target") == n).select("target", "date", "a") for n in names], ["date"])
    g = each[0].unionByName(each[1]).unionByName(each[2]).groupBy("target")
    return g.agg(F.count("*").alias("n"), F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last"), F.round(F.avg("a"), 6).alias("mean"))


@query(f"""WITH {D_SQL}, c AS (SELECT concat(target, '/', delta) AS cell_id, list(d ORDER BY t) AS s FROM df GROUP BY target, delta), e AS (SELECT * FROM c UNION ALL SELECT concat('again ', cell_id), s FROM c WHERE cell_id LIKE '%/2')
SELECT min(cell_id) AS cell_id, count(*) AS copies FROM e GROUP BY s""")
def distinct_cells(spark, sf_dir):
    """Cells whose series was recorded before under another name."""
    d = loss_differences(spark, sf_dir)
    c = d.groupBy("target", "delta").agg(F.array_sort(F.collect_list(F.struct("t", "d"))).alias("s")).select(F.concat_ws("/", "target", F.col("delta").cast("string")).alias("cell_id"), F.col("s.d").alias("series"))
    again = c.where(F.col("cell_id").endswith("/2")).withColumn("cell_id", F.concat(F.lit("again "), "cell_id"))
    return scoring.distinct_series(c.unionByName(again)).select("cell_id", "copies")
