"""Breaks, paths of the rate over time, resampled ratios and bands, regimes, cost of estimation and outages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import frames
from driftline.operators import breaks, inference, panel, resample, scoring, walkforward
from driftline.params import SHORT

from .base import BARS_SQL, SIGNALS_SQL, bars, query, signals
from .study import D_SQL, FC_SQL, TRAIN_SQL, forecasts, long, loss_differences, rounded, study_rows

DRAWS, BLOCK = 1500, SHORT.block_for(max(SHORT.delays))

BREAK_SQL = SIGNALS_SQL + """, bx AS (SELECT series_id, t, ln(nullif(pk, 0)) AS v, ln(yz) AS a, r, ln(nullif(pk, 0)) - lag(ln(nullif(pk, 0))) OVER (PARTITION BY series_id ORDER BY t) AS dv, ln(yz / nullif(cc_var, 0)) AS q FROM sig),
bp AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS ix, count(*) OVER (PARTITION BY series_id) AS n FROM bx WHERE v IS NOT NULL AND a IS NOT NULL AND r IS NOT NULL AND dv IS NOT NULL AND q IS NOT NULL),
bw AS (SELECT series_id, ix >= n // 2 AS after, v, a, r, dv, q, row_number() OVER (PARTITION BY series_id ORDER BY ix) - 1 AS pos FROM bp WHERE n // 2 >= 271 AND n // 2 + 271 <= n AND ix >= n // 2 - 271 AND ix < n // 2 + 271 AND NOT (ix >= n // 2 - 21 AND ix < n // 2 + 21))"""


def break_windows(spark, sf_dir):
    w = frames.ordered("series_id")
    v = F.log("pk")
    s = signals(spark, sf_dir).select("series_id", "t", v.alias("v"), F.log("yz").alias("a"), "r", (v - F.lag(v).over(w)).alias("dv"), F.log(F.col("yz") / F.nullif(F.col("cc_var"), F.lit(0.0))).alias("q")).dropna()
    return breaks.event_window(s, ["series_id"], F.floor(F.col("n") / 2))


@query(f"WITH {BREAK_SQL} SELECT series_id, after, count(*) AS n, CAST(min(pos) AS bigint) AS first_pos, round(avg(a), 6) AS mean FROM bw GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """250 rows on each side of the middle row, less 21 next to it."""
    return break_windows(spark, sf_dir).groupBy("series_id", "after").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"), F.round(F.avg("a"), 6).alias("mean"))


@query(f"""WITH {BREAK_SQL}, sd AS (SELECT series_id, after, count(*) AS m, regr_slope(a, v) AS b, regr_intercept(a, v) AS i, avg(v) AS mv, regr_sxx(a, v) AS sxx, avg(q) AS mq, corr(r, dv) AS c FROM bw GROUP BY 1, 2),
x AS (SELECT series_id, pos, (CASE WHEN after THEN 1 ELSE -1 END) * (a - i - b * v) * (1.0 / m - mv * (v - mv) / sxx) AS i0, (CASE WHEN after THEN 1 ELSE -1 END) * (a - i - b * v) * (v - mv) / sxx AS i1, q - mq AS z FROM bw JOIN sd USING (series_id, after)),
k AS (SELECT unnest(range(-9, 10)) AS k), lr AS (SELECT x.series_id, sum((1 - abs(k) / 10.0) * x.i0 * y.i0) AS v00, sum((1 - abs(k) / 10.0) * x.i0 * y.i1) AS v01, sum((1 - abs(k) / 10.0) * x.i1 * y.i1) AS v11, sum((1 - abs(k) / 10.0) * x.z * y.z) AS zz FROM x CROSS JOIN k JOIN x y ON y.series_id = x.series_id AND y.pos = x.pos + k.k GROUP BY 1),
j AS (SELECT lr.*, one.m + two.m AS n, two.i - one.i AS b0, two.b - one.b AS b1, abs(two.c - one.c) AS alignment, two.mq - one.mq AS shift, one.m AS n0, two.m AS n1 FROM lr JOIN sd one ON one.series_id = lr.series_id AND NOT one.after JOIN sd two ON two.series_id = lr.series_id AND two.after)
SELECT series_id, n, round((b0 * b0 * v11 - 2 * b0 * b1 * v01 + b1 * b1 * v00) / (v00 * v11 - v01 * v01), 4) AS level, round(alignment, 6) AS alignment, round(abs(shift / sqrt(greatest(zz / n, 1e-18) * (1.0 / n0 + 1.0 / n1))), 4) AS range FROM j""")
def break_statistics(spark, sf_dir):
    """A10: break in level, alignment and range at the middle row of each series."""
    return breaks.break_statistics(break_windows(spark, sf_dir), ["series_id"]).select("series_id", "n", F.round("level", 4).alias("level"), F.round("alignment", 6).alias("alignment"), F.round("range", 4).alias("range"))


LOSS_SQL = FC_SQL + """, l0 AS (SELECT target, delta, t, max(CASE WHEN arm = 'own' THEN (y - f) ** 2 END) AS own, max(CASE WHEN arm = 'cross' THEN (y - f) ** 2 END) AS "cross", max((y - bench) ** 2) AS bench FROM ok GROUP BY 1, 2, 3),
ls AS (SELECT l.*, z.own AS fresh FROM l0 l JOIN l0 z ON z.target = l.target AND z.t = l.t AND z.delta = 0 WHERE l.own IS NOT NULL AND l."cross" IS NOT NULL AND z.own IS NOT NULL)"""
ROLL_SQL = LOSS_SQL + """, nm AS (SELECT *, row_number() OVER (PARTITION BY target, delta ORDER BY t) - 1 AS ix, count(*) OVER (PARTITION BY target, delta) AS n FROM ls WHERE delta > 0),
sw AS (SELECT target, delta, ix AS start FROM nm WHERE ix % 75 = 0 AND ix + 300 <= n),
rw AS (SELECT s.target, s.delta, s.start, max(m.t) AS last, (sum(m.own) - sum(m.fresh)) / sum(m.bench) AS lost, (sum(m.own) - sum(m."cross")) / sum(m.bench) AS gain FROM sw s JOIN nm m ON m.target = s.target AND m.delta = s.delta AND m.ix BETWEEN s.start AND s.start + 299 GROUP BY 1, 2, 3),
rr AS (SELECT target, delta, start, last, CASE WHEN lost > 1e-9 THEN gain / lost END AS rate FROM rw)"""


def losses(spark, sf_dir):
    return scoring.squared_losses(forecasts(spark, sf_dir))


def rolled(spark, sf_dir):
    """Windows of 300 rows, 75 apart: the derived series are short."""
    return scoring.rolling_rate(losses(spark, sf_dir), 300, 75)


@query(f"WITH {ROLL_SQL} SELECT target, delta, CAST(start AS bigint) AS start, CAST(last AS bigint) AS last, round(rate, 4) AS rate FROM rr")
def rolling_rate(spark, sf_dir):
    """The substitution rate in rolling windows."""
    return rolled(spark, sf_dir).select("target", "delta", long("start"), long("last"), F.round("rate", 4).alias("rate"))


@query(f"""WITH {ROLL_SQL}, yr AS (SELECT r.*, year(date) + dayofyear(date) / 365.25 AS yr FROM rr r JOIN study s ON s.series_id = r.target AND s.t = r.last WHERE rate IS NOT NULL)
SELECT target, delta, count(*) AS windows, round(min(rate), 4) AS least, round(max(rate), 4) AS most, round(max(rate) - min(rate), 4) AS range, round(CASE WHEN count(*) > 2 THEN regr_slope(rate, yr) * 10 END, 4) AS trend FROM yr GROUP BY 1, 2""")
def rate_trend(spark, sf_dir):
    """Its span and its trend a decade."""
    d = signals(spark, sf_dir).select(F.col("series_id").alias("target"), F.col("t").alias("last"), (F.year("date") + F.dayofyear("date") / 365.25).alias("year"))
    g = scoring.rate_trend(rolled(spark, sf_dir).join(d, ["target", "last"]))
    return g.select("target", "delta", "windows", *[F.round(c, 4).alias(c) for c in ("least", "most", "range", "trend")])


@query(f"""WITH {LOSS_SQL}, q AS (SELECT target, delta, t, own - "cross" AS num, own - fresh AS den FROM ls WHERE delta > 0), {resample.block_sums_sql('q', ['target', 'delta'], ['num', 'den'], DRAWS, BLOCK)},
p AS (SELECT target, delta, sum(num) / sum(den) AS ratio FROM q GROUP BY 1, 2)
SELECT target, delta, max(n) AS n, round(max(ratio), 4) AS ratio, count(*) AS draws, round(quantile_cont(num / den, 0.025), 4) AS lo, round(quantile_cont(num / den, 0.975), 4) AS hi FROM bs JOIN p USING (target, delta) WHERE abs(den) > 1e-9 GROUP BY 1, 2""")
def ratio_bootstrap(spark, sf_dir):
    """Interval of the whole substitution rate, numerator and denominator on the same resampled rows."""
    q = losses(spark, sf_dir).where("delta > 0").select("target", "delta", "t", (F.col("own") - F.col("cross")).alias("num"), (F.col("own") - F.col("fresh")).alias("den"))
    return resample.ratio(q, ["target", "delta"], "num", "den", DRAWS, BLOCK).select("target", "delta", "n", "draws", *[F.round(c, 4).alias(c) for c in ("ratio", "lo", "hi")])


SUP_SQL = D_SQL.replace("range(0, 9)", f"range(0, {BLOCK + 1})").replace("k / 9.0", f"k / {BLOCK + 1}.0")


@query(f"""WITH {SUP_SQL}, {resample.block_sums_sql('df', ['target', 'delta'], ['d'], DRAWS, BLOCK)},
tp AS (SELECT target, draw, max(abs(bs.d / bs.n - mean) / greatest(se, 1e-12)) AS top FROM bs JOIN hc USING (target, delta) GROUP BY 1, 2), cr AS (SELECT target, quantile_cont(top, 0.95) AS critical FROM tp GROUP BY 1)
SELECT target, delta, n, round(mean, 6) AS mean, round(se, 6) AS se, round(critical, 4) AS critical, round(mean - critical * se, 6) AS lo, round(mean + critical * se, 6) AS hi FROM hc JOIN cr USING (target)""")
def sup_t_band(spark, sf_dir):
    """A band for the gains at all delays at once; one block length for the kernel and the draws."""
    b = inference.sup_t(loss_differences(spark, sf_dir), ["target"], "delta", "d", DRAWS, BLOCK)
    return b.select("target", "delta", "n", F.round("critical", 4).alias("critical"), *rounded("mean", "se", "lo", "hi"))


SEEDS, SEED_DRAWS = 20, 200


@query(f"""WITH {D_SQL}, {resample.block_sums_sql('df', ['target', 'delta'], ['d'], SEED_DRAWS * (SEEDS + 1), BLOCK)},
sd AS (SELECT target, delta, draw // {SEED_DRAWS} AS seed, quantile_cont(d / n, 0.025) > 0 OR quantile_cont(d / n, 0.975) < 0 AS clear FROM bs GROUP BY 1, 2, 3),
ct AS (SELECT target, delta, count(*) FILTER (clear AND seed > 0) AS clears, bool_or(clear AND seed = 0) AS first FROM sd GROUP BY 1, 2)
SELECT target, delta, clears, CASE WHEN first AND clears = {SEEDS} THEN '*' WHEN first OR clears = {SEEDS} THEN '?' ELSE '' END AS star FROM ct""")
def seed_stability(spark, sf_dir):
    """Whether a star survives 20 other draw sequences."""
    return resample.stability(loss_differences(spark, sf_dir), ["target", "delta"], "d", SEED_DRAWS, BLOCK, SEEDS)


RUNGS = (("top33", 0.67, 1), ("top20", 0.8, 2), ("top10", 0.9, 3))
RUNG_SQL = LOSS_SQL + f""", th AS (SELECT series_id AS target, t, lag(a) OVER (PARTITION BY series_id ORDER BY t) AS before, {', '.join(f'CASE WHEN count(a) OVER p >= 60 THEN quantile_cont(a, {q}) OVER p END AS {n}' for n, q, _ in RUNGS)} FROM sig WINDOW p AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
rg AS (SELECT target, l.t, own - "cross" AS num, own - fresh AS den, CAST(coalesce(before <= top33, false) AS int) AS base, {', '.join(f'CAST(coalesce(before > {n}, false) AS int) AS {n}' for n, _, _ in RUNGS)} FROM ls l JOIN th USING (target, t) WHERE delta = 2)"""


def rung_rows(spark, sf_dir):
    """Gain and loss at delay 2, and masks of the quiet two thirds and of ever more unquiet rows, by trailing quantiles of the row before."""
    w = frames.ordered("series_id")
    past = w.rowsBetween(-252, -1)
    before = F.lag("a").over(w)
    hold = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    qs = {n: frames.quantile(F.col("a"), q, past, 60) for n, q, _ in RUNGS}
    m = signals(spark, sf_dir).select(F.col("series_id").alias("target"), "t", hold(before <= qs["top33"]).alias("base"), *[hold(before > q).alias(n) for n, q in qs.items()])
    q = losses(spark, sf_dir).where("delta = 2").select("target", "t", (F.col("own") - F.col("cross")).alias("num"), (F.col("own") - F.col("fresh")).alias("den"))
    return q.join(m, ["target", "t"])


@query(f"""WITH {RUNG_SQL}, c AS (SELECT target, t, num * top10 AS na, den * top10 AS da, num * base AS nb, den * base AS db FROM rg), m AS (SELECT target, count(*) AS n, avg(na) AS na, avg(da) AS da, avg(nb) AS nb, avg(db) AS db FROM c GROUP BY 1),
x AS (SELECT c.target, row_number() OVER (PARTITION BY c.target ORDER BY t) AS pos, (c.na - m.na) / m.da - m.na / m.da ** 2 * (c.da - m.da) - (c.nb - m.nb) / m.db + m.nb / m.db ** 2 * (c.db - m.db) AS x FROM c JOIN m USING (target)),
v AS (SELECT a.target, sum((1 - abs(k) / 13.0) * a.x * b.x) AS s FROM x a CROSS JOIN (SELECT unnest(range(-12, 13)) AS k) JOIN x b ON b.target = a.target AND b.pos = a.pos + k GROUP BY 1)
SELECT target, n, round(na / da, 4) AS one, round(nb / db, 4) AS two, round(na / da - nb / db, 4) AS contrast, round(sqrt(greatest(s / n, 0) / n), 4) AS se FROM m JOIN v USING (target)""")
def regime_contrast(spark, sf_dir):
    """The rate in unquiet rows less that in quiet ones, as one parameter of the full sample."""
    r = rung_rows(spark, sf_dir)
    r = r.select("target", "t", *[(F.col(c) * F.col(k)).alias(f"{c}_{k}") for c in ("num", "den") for k in ("top10", "base")])
    c = inference.contrast(r, ["target"], ("num_top10", "den_top10"), ("num_base", "den_base"), 12)
    return c.select("target", "n", *[F.round(x, 4).alias(x) for x in ("one", "two", "contrast", "se")])


LADDER_SQL = RUNG_SQL + f""", lg AS ({' UNION ALL '.join(f'SELECT target, {i} AS rung, t, num * {n} AS num, den * {n} AS den, {n} AS k FROM rg' for i, n in enumerate(['base', *[r[0] for r in RUNGS]]))}),
{resample.block_sums_sql('lg', ['target', 'rung'], ['num', 'den', 'k'], DRAWS, BLOCK)},
al AS (SELECT target, rung, draw, num, den, k FROM bs UNION ALL SELECT target, rung, -1, sum(num), sum(den), sum(k) FROM lg GROUP BY 1, 2), ax AS (SELECT target, rung, draw, CASE WHEN k >= 20 AND den > 0 THEN num / den END AS x FROM al),
cx AS (SELECT a.target, a.rung, a.draw, a.x - b.x AS c FROM ax a JOIN ax b ON b.target = a.target AND b.draw = a.draw AND b.rung = 0 WHERE a.rung > 0),
ob AS (SELECT target, rung, max(CASE WHEN draw < 0 THEN c END) AS o, stddev_samp(CASE WHEN draw >= 0 THEN c END) AS sd FROM cx GROUP BY 1, 2),
dr AS (SELECT target, draw, max(CASE WHEN rung = {len(RUNGS)} THEN c - CASE WHEN draw < 0 THEN 0 ELSE o END END) AS contrast, corr(rung, c - CASE WHEN draw < 0 THEN 0 ELSE o END) AS pearson, regr_slope(c - CASE WHEN draw < 0 THEN 0 ELSE o END, rung) AS slope, max((c - CASE WHEN draw < 0 THEN 0 ELSE o END) / sd) AS tmax, max(CASE WHEN rung = {len(RUNGS)} THEN sd END) AS sd FROM cx JOIN ob USING (target, rung) GROUP BY 1, 2 HAVING count(c) = {len(RUNGS)})
SELECT z.target, count(*) - 1 AS draws, round(max(z.sd), 4) AS sd, {', '.join(f'round(max(z.{c}), 4) AS {c}, round((1 + count(*) FILTER (d.draw >= 0 AND d.{c} >= z.{c})) / count(*), 6) AS p_{c}' for c in ('contrast', 'pearson', 'slope', 'tmax'))} FROM dr d JOIN dr z ON z.target = d.target AND z.draw < 0 GROUP BY 1"""


@query(f"WITH {LADDER_SQL}")
def ladder_trend(spark, sf_dir):
    """Whether the rate climbs with the rungs, under one joint block bootstrap."""
    g = resample.ladder(rung_rows(spark, sf_dir), ["target"], ["base", *[r[0] for r in RUNGS]], [r[2] for r in RUNGS], DRAWS, BLOCK)
    return g.select("target", "draws", *[F.round(c, 4).alias(c) for c in ("sd", "contrast", "pearson", "slope", "tmax")], *rounded("p_contrast", "p_pearson", "p_slope", "p_tmax"))


@query(f"""WITH {BARS_SQL}, e AS (SELECT series_id, date_trunc('month', date) AS month, arg_max(close, date) AS close FROM bars WHERE month(date) IN (3, 6, 9, 12) GROUP BY 1, 2)
SELECT series_id, strftime(month, '%Y-%m-%d') AS month, round(ln(close / lag(close) OVER (PARTITION BY series_id ORDER BY month)), 6) AS r FROM e""")
def phase_subset(spark, sf_dir):
    """F8: one phase of the quarterly grid, so that windows don't share a month."""
    e = panel.phase(bars(spark, sf_dir), (3, 6, 9, 12)).groupBy("series_id", F.trunc("date", "MM").alias("month")).agg(F.max_by("close", "date").alias("close"))
    r = F.log(F.col("close") / F.lag("close").over(Window.partitionBy("series_id").orderBy("month")))
    return e.select("series_id", F.date_format("month", "yyyy-MM-dd").alias("month"), F.round(r, 6).alias("r"))


@query(f"""WITH {SIGNALS_SQL} SELECT series_id, CAST(date AS varchar) AS date, round(r, 6) AS r, CAST(row_number() OVER (PARTITION BY series_id ORDER BY abs(r) DESC, date) AS bigint) AS place FROM sig WHERE r IS NOT NULL QUALIFY place <= 8""")
def top_movers(spark, sf_dir):
    """O3: the eight days of each series that moved most."""
    t = scoring.top(signals(spark, sf_dir).where("r IS NOT NULL"), ["series_id"], [F.abs("r").desc(), F.col("date")], 8)
    return t.select("series_id", F.col("date").cast("string").alias("date"), F.round("r", 6).alias("r"), long("place"))


@query(f"""WITH {SIGNALS_SQL}, pk AS (SELECT series_id, arg_max(t, row(a, -t)) AS top FROM sig WHERE a IS NOT NULL GROUP BY 1) SELECT s.series_id, CAST(s.t - top AS bigint) AS away, round(a, 6) AS a FROM sig s JOIN pk USING (series_id) WHERE abs(s.t - top) <= 20""")
def peak_rows(spark, sf_dir):
    """20 rows on each side of a series' peak."""
    w = Window.partitionBy("series_id")
    s = signals(spark, sf_dir).withColumn("top", F.max_by(F.when(F.col("a").isNotNull(), F.col("t")), F.struct("a", -F.col("t"))).over(w)).withColumn("away", F.col("t") - F.col("top"))
    return s.where(F.abs("away") <= 20).select("series_id", long("away"), F.round("a", 6).alias("a"))


@query(f"""WITH {SIGNALS_SQL}, x AS (SELECT series_id, date, close, lag(close) OVER (PARTITION BY series_id ORDER BY date) AS moved, open, high, low, row_number() OVER (PARTITION BY series_id ORDER BY date) - 1 AS ix, count(*) OVER (PARTITION BY series_id) AS n FROM raw)
SELECT series_id, CAST(date AS varchar) AS date, CASE WHEN ix >= n // 2 THEN coalesce(moved, close) ELSE close END AS shifted,
round(CASE WHEN ix >= n // 2 THEN greatest(1.25 * ln(high / open), ln(close / open)) ELSE ln(high / open) END, 6) AS up, round(CASE WHEN ix >= n // 2 THEN least(1.25 * ln(low / open), ln(close / open)) ELSE ln(low / open) END, 6) AS down FROM x""")
def corrupted(spark, sf_dir):
    """From the middle on, closes a day late and ranges (up and down from the open, in logs) stretched by a quarter."""
    half = F.floor(F.col("n") / 2)
    b = breaks.stretched(breaks.shifted(bars(spark, sf_dir), half), half, 1.25)
    return b.select("series_id", F.col("date").cast("string").alias("date"), "shifted", *[F.round(F.log(F.col(c) / F.col("open")), 6).alias(n) for c, n in (("high", "up"), ("low", "down"))])


@query(f"""WITH {TRAIN_SQL}, ow AS (SELECT target, t, a, y, coalesce(avg(y) OVER (PARTITION BY target ORDER BY t ROWS BETWEEN {SHORT.horizon + SHORT.span} PRECEDING AND {SHORT.horizon + 1} PRECEDING), 0) AS bench FROM (SELECT target, t, a, lead(a, {SHORT.horizon}) OVER (PARTITION BY target ORDER BY t) AS y FROM adm WHERE series_id = target)),
st AS (SELECT o.target, delta, o.t, o.y, o.bench, x.a AS x FROM ow o CROSS JOIN (SELECT unnest({list(SHORT.delays)}) AS delta) JOIN ow x ON x.target = o.target AND x.t = o.t - delta),
rf AS (SELECT target, delta, refit_id, m.kind, greatest(0, head - CASE WHEN m.kind = 'feature' THEN 0 ELSE delta END - {SHORT.horizon}) AS cut FROM ref CROSS JOIN (SELECT unnest(['feature', 'outage']) AS kind) m),
g AS (SELECT r.target, r.delta, r.refit_id, r.kind, count(*) AS n, avg(x) AS mx, avg(y) AS my, sqrt(var_pop(x)) + 1e-9 AS sd, var_pop(x) AS v, covar_pop(x, y) AS c FROM rf r JOIN st s ON s.target = r.target AND s.delta = r.delta AND s.t >= greatest(0, r.cut - {SHORT.span}) AND s.t < r.cut AND s.x IS NOT NULL AND s.y IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) >= {SHORT.min_train}),
f AS (SELECT s.target, s.delta, m.kind, s.y, s.bench, coalesce(my + n * c / sd / (n * v / (sd * sd) + 3) * (s.x - mx) / sd, 0) AS f FROM idx i JOIN st s ON s.target = i.target AND s.t = i.t CROSS JOIN (SELECT unnest(['feature', 'outage']) AS kind) m LEFT JOIN g ON g.target = i.target AND g.delta = s.delta AND g.refit_id = i.j // {SHORT.refit} AND g.kind = m.kind),
sk AS (SELECT target, delta, kind, 1 - sum((y - f) ** 2) / sum((y - bench) ** 2) AS r2 FROM f GROUP BY 1, 2, 3),
sp AS (SELECT target, delta, max(CASE WHEN kind = 'feature' THEN r2 END) AS sf, max(CASE WHEN kind = 'outage' THEN r2 END) AS so FROM sk GROUP BY 1, 2), z AS (SELECT *, max(CASE WHEN delta = 0 THEN so END) OVER (PARTITION BY target) AS s0 FROM sp)
SELECT target, CAST(delta AS int) AS delta, round(s0 - so, 6) AS total, round(s0 - sf, 6) AS feature, round(sf - so, 6) AS vintage, round(CASE WHEN abs(s0 - so) > 1e-12 THEN (sf - so) / (s0 - so) END, 5) AS vintage_share FROM z WHERE delta > 0""")
def outage_split(spark, sf_dir):
    """What a delay costs by an old level and by old coefficients, from two own-arm walks with a fixed penalty."""
    rows = study_rows(spark, sf_dir).withColumn("own", F.slice("own", 1, 1))
    skills = [scoring.skill(walkforward.walk(rows, SHORT, arms=("own",), lam=3.0, feature_only=x)).select("target", "delta", F.col("r2").alias(n)) for x, n in ((True, "s_feature"), (False, "s_outage"))]
    return scoring.outage_split(skills[0].join(skills[1], ["target", "delta"])).select("target", "delta", *rounded("total", "feature", "vintage"), F.round("vintage_share", 5).alias("vintage_share"))
