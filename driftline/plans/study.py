"""Panels, forecasts, scores and inference over the derived markets."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.functions import features, frames, normal
from driftline.operators import inference, models, panel, resample, scoring, walkforward
from driftline.params import SHORT
from driftline.sources import bars as sources
from driftline.sources import provenance

from .base import BARS_SQL, SIGNALS_SQL, STUDY_SQL, bars, query, r6, signals, study

CLOSE_SQL = "conv AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in sources.CLOSE_UTC.items()) + ") v(series_id, close_utc))"
long = lambda c: F.col(c).cast("long").alias(c)
rounded = lambda *cs: [F.round(c, 6).alias(c) for c in cs]

UNION_SQL = SIGNALS_SQL + f""", {CLOSE_SQL},
grid AS (SELECT g.series_id AS target, s.series_id, d.date, a FROM (SELECT DISTINCT series_id FROM sig) g CROSS JOIN (SELECT DISTINCT series_id FROM sig) s CROSS JOIN (SELECT DISTINCT date FROM sig) d LEFT JOIN sig ON sig.series_id = s.series_id AND sig.date = d.date),
filled AS (SELECT target, series_id, date, CASE WHEN series_id = target THEN a ELSE last_value(a IGNORE NULLS) OVER (PARTITION BY target, series_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END AS a FROM grid),
own AS (SELECT series_id AS target, date FROM sig WHERE a IS NOT NULL),
pan AS (SELECT f.*, row_number() OVER (PARTITION BY target, series_id ORDER BY date) - 1 AS t FROM filled f JOIN own USING (target, date)),
adm AS (SELECT p.target, p.series_id, p.date, p.t, CASE WHEN p.series_id = p.target OR pc.close_utc < oc.close_utc THEN a ELSE lag(a) OVER (PARTITION BY p.target, p.series_id ORDER BY t) END AS a
  FROM pan p JOIN conv pc ON pc.series_id = p.series_id JOIN conv oc ON oc.series_id = p.target)"""


def known_panel(spark, sf_dir):
    return panel.admissible(panel.fill_union(signals(spark, sf_dir)), sources.conventions(spark))


@query(f"WITH {SIGNALS_SQL} SELECT CAST(date AS varchar) AS date, {', '.join(f'''round(max(CASE WHEN series_id = '{n}' THEN a END), 6) AS \"{n}\"''' for n in sources.CLOSE_UTC)} FROM sig GROUP BY date")
def panel_outer(spark, sf_dir):
    """Outer alignment on date."""
    p = panel.outer_panel(signals(spark, sf_dir), list(sources.CLOSE_UTC))
    return p.select(F.col("date").cast("string").alias("date"), *[F.round(F.col(f"`{n}`"), 6).alias(n) for n in sources.CLOSE_UTC])


@query(f"""WITH {SIGNALS_SQL}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM sig WHERE series_id = 'AMERICA'),
j AS (SELECT cal.t, cal.date, i.series_id, a FROM cal CROSS JOIN (SELECT DISTINCT series_id FROM sig) i LEFT JOIN sig ON sig.series_id = i.series_id AND sig.date = cal.date)
SELECT CAST(t AS bigint) AS t, series_id, round(last_value(a IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 6) AS a FROM j""")
def ffill_reindex(spark, sf_dir):
    """Carried on the target's calendar only."""
    s = signals(spark, sf_dir)
    cal = s.where("series_id = 'AMERICA'").select(F.col("series_id").alias("target"), "date")
    return panel.fill_reindex(s, cal).select(long("t"), "series_id", F.round("a", 6).alias("a"))


@query(f"WITH {UNION_SQL} SELECT target, series_id, CAST(t AS bigint) AS t, round(a, 6) AS a FROM pan")
def ffill_union(spark, sf_dir):
    """Carried on the union calendar, then the target's rows."""
    return panel.fill_union(signals(spark, sf_dir)).select("target", "series_id", long("t"), F.round("a", 6).alias("a"))


@query(f"WITH {UNION_SQL} SELECT target, series_id, CAST(t AS bigint) AS t, round(a, 6) AS a FROM adm")
def admissible(spark, sf_dir):
    """As known at the target's close; equal closes count from the next row."""
    return known_panel(spark, sf_dir).select("target", "series_id", long("t"), F.round("a", 6).alias("a"))


@query(f"""WITH {UNION_SQL} SELECT target, CAST(t AS bigint) AS t, round(avg(a), 6) AS peer_mean, count(a) AS peers FROM adm WHERE series_id <> target GROUP BY 1, 2""")
def peer_mean(spark, sf_dir):
    """Mean of the peers that are there."""
    w = panel.wide(known_panel(spark, sf_dir)).withColumn("p", F.map_values("peers"))
    return w.select("target", long("t"), F.round(features.finite_mean(F.col("p")), 6).alias("peer_mean"), F.size(F.filter("p", lambda x: x.isNotNull())).cast("long").alias("peers"))


ZONES = {"ASIA": ("15:00:00", "Asia/Tokyo"), "EUROPE": ("16:30:00", "Europe/London"), "AMERICA": ("16:00:00", "America/New_York")}
ZONES_SQL = ", ".join(f"('{k}', TIME '{a}', '{z}')" for k, (a, z) in ZONES.items())


@query(f"""WITH {BARS_SQL}, z AS (SELECT * FROM (VALUES {ZONES_SQL}) v(series_id, local_close, zone)), c AS (SELECT b.series_id, b.date, (b.date + z.local_close) AT TIME ZONE z.zone AS at FROM bars b JOIN z USING (series_id)),
j AS (SELECT o.series_id AS target, p.series_id AS peer, epoch(p.at) < epoch(o.at) AS earlier FROM c o JOIN c p ON o.date = p.date AND o.series_id <> p.series_id)
SELECT target, peer, count(*) AS n, CAST(sum(CAST(earlier AS int)) AS bigint) AS earlier FROM j GROUP BY 1, 2""")
def clock_audit(spark, sf_dir):
    """Which closes come first on the true clock, summer time and all."""
    z = F.broadcast(spark.createDataFrame([(k, a, b) for k, (a, b) in ZONES.items()], "series_id string, local_close string, zone string"))
    c = bars(spark, sf_dir).join(z, "series_id").select("series_id", "date", panel.close_instant(F.col("date"), F.col("local_close"), F.col("zone")).alias("at"))
    o, p = c.select(F.col("series_id").alias("target"), "date", F.col("at").alias("own")), c.select(F.col("series_id").alias("peer"), "date", "at")
    return o.join(p, "date").where("target <> peer").groupBy("target", "peer").agg(F.count("*").alias("n"), F.sum((F.col("at") < F.col("own")).cast("long")).alias("earlier"))


def study_rows(spark, sf_dir):
    """Rows for the walk-forward engine: own block and peers as arrays, label and benchmark."""
    p = panel.wide(known_panel(spark, sf_dir))
    w = Window.partitionBy("target").orderBy("t")
    block = features.har(F.col("own"), w)
    p = p.select("target", "t", F.array(*block.values()).alias("own"), F.map_values("peers").alias("peers"), F.lead("own", SHORT.horizon).over(w).alias("y"))
    past = w.rowsBetween(-(SHORT.horizon + SHORT.span), -(SHORT.horizon + 1))
    return p.withColumn("bench", F.coalesce(F.avg("y").over(past), F.lit(0.0)))


TRAIN_SQL = UNION_SQL + f""", lab AS (SELECT target, t, lead(a, {SHORT.horizon}) OVER (PARTITION BY target ORDER BY t) AS y FROM adm WHERE series_id = target),
idx AS (SELECT target, t, row_number() OVER (PARTITION BY target ORDER BY t) - 1 AS j FROM lab WHERE y IS NOT NULL AND t >= {SHORT.median + SHORT.span + max(SHORT.delays) + SHORT.horizon}),
ref AS (SELECT target, delta, t AS head, j // {SHORT.refit} AS refit_id, greatest(0, t - delta - {SHORT.horizon}) AS cut FROM idx CROSS JOIN (SELECT unnest({list(SHORT.delays)}) AS delta) WHERE j % {SHORT.refit} = 0),
win AS (SELECT r.target, r.delta, r.refit_id, r.head, max(l.t) + {SHORT.horizon} AS resolved, count(*) AS n FROM ref r JOIN lab l ON l.target = r.target AND l.t >= greatest(0, r.cut - {SHORT.span}) AND l.t < r.cut AND l.y IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {TRAIN_SQL} SELECT target, CAST(delta AS int) AS delta, count(*) AS refits, CAST(sum(CASE WHEN resolved > head - delta THEN 1 ELSE 0 END) AS bigint) AS late FROM win GROUP BY 1, 2")
def train_windows(spark, sf_dir):
    """Training windows by a blocked equi-join; no label resolves too late."""
    return walkforward.leaks(study_rows(spark, sf_dir), SHORT)


@query()
def walk_forward(spark, sf_dir):
    """M1, M3, M4: purged walk-forward ridge of own and cross arms at every delay."""
    f = walkforward.walk(study_rows(spark, sf_dir), SHORT)
    return f.select("target", "arm", "delta", "t", "j", *rounded("y", "f", "bench"))


@query()
def walk_forward_rate(spark, sf_dir):
    """A1, A5: skill and substitution rate of the walk-forward."""
    s = scoring.skill(walkforward.walk(study_rows(spark, sf_dir), SHORT))
    return scoring.substitution_rate(s).select("target", "delta", *rounded("s_own", "s_cross", "rate"))


@query()
def walk_forward_sign(spark, sf_dir):
    """M2: logistic walk-forward of the sign, its accuracy and area under the curve."""
    rows = study_rows(spark, sf_dir).withColumn("y", F.when(F.col("y").isNotNull(), (F.col("y") > 0).cast("double")))
    f = walkforward.walk(rows, SHORT, "logistic")
    return scoring.classified(f).select(*scoring.KEYS, "n", *rounded("accuracy", "balanced", "brier", "log_score", "auc"))


@query(f"""WITH {TRAIN_SQL}, ow AS (SELECT target, t, a, lead(a, {SHORT.horizon}) OVER (PARTITION BY target ORDER BY t) AS y FROM adm WHERE series_id = target),
st AS (SELECT o.target, delta, o.t, o.y, x.a AS x FROM ow o CROSS JOIN (SELECT unnest({list(SHORT.delays)}) AS delta) JOIN ow x ON x.target = o.target AND x.t = o.t - delta),
g AS (SELECT r.target, r.delta, refit_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, sqrt(var_pop(x)) + 1e-9 AS sd, var_pop(x) AS v, covar_pop(x, y) AS c FROM ref r JOIN st s ON s.target = r.target AND s.delta = r.delta AND s.t >= greatest(0, r.cut - {SHORT.span}) AND s.t < r.cut AND s.x IS NOT NULL AND s.y IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= {SHORT.min_train})
SELECT i.target, CAST(s.delta AS int) AS delta, CAST(i.j AS bigint) AS j, CAST(i.t AS bigint) AS t, round(coalesce(my + n * c / sd / (n * v / (sd * sd) + 3) * (s.x - mx) / sd, 0), 6) AS f
FROM idx i JOIN st s ON s.target = i.target AND s.t = i.t LEFT JOIN g ON g.target = i.target AND g.delta = s.delta AND g.refit_id = i.j // {SHORT.refit}""")
def walk_forward_one(spark, sf_dir):
    """M1, M4: the purged walk with one regressor and a fixed penalty, which SQL can state whole."""
    rows = study_rows(spark, sf_dir).withColumn("own", F.slice("own", 1, 1))
    f = walkforward.walk(rows, SHORT, arms=("own",), lam=3.0)
    return f.select("target", "delta", long("j"), long("t"), F.round("f", 6).alias("f"))


# Forecasts that need no fit: the stale level, and one-regressor ridge. Both engines can state them.
FC_SQL = STUDY_SQL + """,
d AS (SELECT unnest([0, 1, 2, 3]) AS delta),
fc AS (SELECT s.series_id AS target, 'own' AS arm, CAST(delta AS int) AS delta, s.t, s.y, s.bench, u.a AS f FROM study s CROSS JOIN d LEFT JOIN study u ON u.series_id = s.series_id AND u.t = s.t - delta
  UNION ALL SELECT s.series_id, 'cross', CAST(delta AS int), s.t, s.y, s.bench, (u.a + coalesce(m.m, u.a)) / 2 FROM study s CROSS JOIN d LEFT JOIN study u ON u.series_id = s.series_id AND u.t = s.t - delta
  LEFT JOIN (SELECT a.series_id, a.t, avg(b.a) AS m FROM study a JOIN study b ON b.date = a.date AND b.series_id <> a.series_id GROUP BY 1, 2) m ON m.series_id = s.series_id AND m.t = s.t),
ok AS (SELECT * FROM fc WHERE y IS NOT NULL AND f IS NOT NULL AND bench IS NOT NULL)"""


def forecasts(spark, sf_dir):
    """Persistence of the stale own level (own), and its mean with the peers' current one (cross)."""
    w = frames.ordered("series_id")
    s = study(spark, sf_dir)
    # The peers' mean from the day's sum and count: no pairs of series.
    day = Window.partitionBy("date")
    others = (F.sum("a").over(day) - F.coalesce("a", F.lit(0.0))) / F.nullif(F.count("a").over(day) - F.col("a").isNotNull().cast("int"), F.lit(0))
    s = s.withColumn("m", F.when((F.count("a").over(day) - F.col("a").isNotNull().cast("int")) > 0, others)).withColumn("ds", features.delayed(F.col("a"), SHORT.delays, w)).withColumn("d", F.explode("ds"))
    stale = F.col("d.stale")
    arms = F.array(F.struct(F.lit("own").alias("arm"), stale.alias("f")), F.struct(F.lit("cross").alias("arm"), ((stale + F.coalesce("m", stale)) / 2).alias("f")))
    return s.select(F.col("series_id").alias("target"), "d.delta", "t", "y", "bench", F.explode(arms).alias("x")).select("target", "x.arm", "delta", "t", "y", "x.f", "bench")


@query(f"""WITH {FC_SQL} SELECT target, arm, delta, count(*) AS n, round(avg(CAST((f > 0) = (y > 0) AS int)), 6) AS accuracy FROM ok GROUP BY 1, 2, 3""")
def persist_accuracy(spark, sf_dir):
    """A2: how often a stale sign is right; the flagship."""
    f = forecasts(spark, sf_dir).where("y IS NOT NULL AND f IS NOT NULL AND bench IS NOT NULL")
    return f.groupBy("target", "arm", "delta").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("f") > 0) == (F.col("y") > 0)).cast("int")), 6).alias("accuracy"))


@query(f"""WITH {FC_SQL} SELECT target, arm, delta, count(*) AS n, round(avg((y - f) ** 2), 6) AS mse, round(avg(exp(y - f) - (y - f) - 1), 4) AS qlike, round(1 - sum((y - f) ** 2) / sum((y - bench) ** 2), 6) AS r2, round(1 - sum(exp(y - f) - (y - f) - 1) / sum(exp(y - bench) - (y - bench) - 1), 6) AS qlike_skill FROM ok GROUP BY 1, 2, 3""")
def skill(spark, sf_dir):
    """A1: losses and skill against the resolved-label benchmark."""
    return scoring.skill(forecasts(spark, sf_dir)).select(*scoring.KEYS, "n", F.round("qlike", 4).alias("qlike"), *rounded("mse", "r2", "qlike_skill"))


@query(f"WITH {STUDY_SQL} SELECT series_id, CAST(t AS bigint) AS t, round(bench, 6) AS bench, round(exp(bench), 6) AS bench_level FROM study")
def bench_mean(spark, sf_dir):
    """Mean of labels that had resolved; the same for every delay."""
    return study(spark, sf_dir).select("series_id", long("t"), *r6(bench=F.col("bench"), bench_level=F.exp("bench")))


@query(f"""WITH {STUDY_SQL} SELECT series_id, CAST(t AS bigint) AS t, round(avg(CASE WHEN y IS NOT NULL THEN CAST(y > 0 AS int) END) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING), 6) AS base_rate FROM study""")
def base_rate(spark, sf_dir):
    """Expanding share of rises among resolved labels, three rows late."""
    w = frames.ordered("series_id").rowsBetween(Window.unboundedPreceding, -5)
    return study(spark, sf_dir).select("series_id", long("t"), F.round(F.avg(F.when(F.col("y").isNotNull(), (F.col("y") > 0).cast("int"))).over(w), 6).alias("base_rate"))


PROB_SQL = FC_SQL + ", pr AS (SELECT target, arm, delta, t, CAST(y > 0 AS int) AS y, 1 / (1 + exp(-f)) AS f FROM ok)"


def probabilities(spark, sf_dir):
    f = forecasts(spark, sf_dir).where("y IS NOT NULL AND f IS NOT NULL AND bench IS NOT NULL")
    return f.withColumn("y", (F.col("y") > 0).cast("int")).withColumn("f", 1 / (1 + F.exp(-F.col("f"))))


@query(f"""WITH {PROB_SQL} SELECT target, arm, delta, round(avg((y - f) ** 2), 6) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(least(greatest(f, 1e-6), 1 - 1e-6)) ELSE ln(1 - least(greatest(f, 1e-6), 1 - 1e-6)) END), 6) AS log_score,
round((avg(CASE WHEN y = 1 THEN CAST(f > 0.5 AS int) END) + avg(CASE WHEN y = 0 THEN CAST(f <= 0.5 AS int) END)) / 2, 6) AS balanced FROM pr GROUP BY 1, 2, 3""")
def brier_log(spark, sf_dir):
    """A2, A4: Brier, log score, balanced accuracy."""
    return scoring.binary(probabilities(spark, sf_dir)).select(*scoring.KEYS, *rounded("brier", "log_score", "balanced"))


@query(f"""WITH {PROB_SQL}, rk AS (SELECT *, rank() OVER (PARTITION BY target, arm, delta ORDER BY f) + (count(*) OVER (PARTITION BY target, arm, delta, f) - 1) / 2.0 AS r FROM pr)
SELECT target, arm, delta, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS auc FROM rk GROUP BY 1, 2, 3""")
def auc(spark, sf_dir):
    """Area under the curve with shared ranks."""
    return scoring.auc(probabilities(spark, sf_dir)).select(*scoring.KEYS, F.round("auc", 6).alias("auc"))


SKILL_SQL = FC_SQL + """, sk AS (SELECT target, arm, delta, 1 - sum((y - f) ** 2) / sum((y - bench) ** 2) AS r2 FROM ok GROUP BY 1, 2, 3),
pv AS (SELECT target, delta, max(CASE WHEN arm = 'own' THEN r2 END) AS s_own, max(CASE WHEN arm = 'cross' THEN r2 END) AS s_cross FROM sk GROUP BY 1, 2),
ls AS (SELECT *, max(CASE WHEN delta = 0 THEN s_own END) OVER (PARTITION BY target) - s_own AS lost FROM pv),
rt AS (SELECT *, CASE WHEN delta > 0 AND lost > 1e-9 THEN (s_cross - s_own) / lost END AS rate FROM ls)"""


@query(f"WITH {SKILL_SQL} SELECT target, delta, round(s_own, 6) AS s_own, round(s_cross, 6) AS s_cross, round(rate, 6) AS rate FROM rt")
def substitution_rate(spark, sf_dir):
    """A5: share of the skill lost to delay that peers give back; undefined at delay 0."""
    return scoring.substitution_rate(scoring.skill(forecasts(spark, sf_dir))).select("target", "delta", *rounded("s_own", "s_cross", "rate"))


@query(f"WITH {SKILL_SQL} SELECT delta, count(*) AS n, round(avg(rate), 6) AS mean_of_ratios, round(sum(s_cross - s_own) / sum(lost), 6) AS ratio_of_means FROM rt WHERE rate IS NOT NULL GROUP BY 1")
def rate_summary(spark, sf_dir):
    """A5: mean of ratios and ratio of means."""
    r = scoring.substitution_rate(scoring.skill(forecasts(spark, sf_dir)))
    return scoring.rate_summary(r).select("delta", "n", *rounded("mean_of_ratios", "ratio_of_means"))


@query(f"""WITH {SKILL_SQL}, c AS (SELECT target, delta, min(s_own) OVER (PARTITION BY target ORDER BY delta) AS m FROM pv), b AS (SELECT target, delta AS d0, m, lead(m) OVER w AS m1, lead(delta) OVER w AS d1 FROM c WINDOW w AS (PARTITION BY target ORDER BY delta))
SELECT p.target, p.delta, round(CASE WHEN p.s_cross >= max(b.m) THEN 0.0 ELSE min(CASE WHEN p.s_cross <= b.m AND p.s_cross >= b.m1 AND b.m > b.m1 THEN b.d0 + (b.m - p.s_cross) / (b.m - b.m1) * (b.d1 - b.d0) END) END, 6) AS age FROM pv p JOIN b USING (target) GROUP BY p.target, p.delta, p.s_cross""")
def effective_age(spark, sf_dir):
    """The age at which the own curve has the cross arm's skill."""
    r = scoring.substitution_rate(scoring.skill(forecasts(spark, sf_dir)))
    curve, wanted = r.select("target", "delta", F.col("s_own").alias("s")), r.select("target", "delta", F.col("s_cross").alias("s"))
    return scoring.effective_age(curve, wanted).select("target", "delta", F.round("age", 6).alias("age"))


@query(f"""WITH {FC_SQL}, x AS (SELECT target, delta, exp(f - y) AS ratio FROM ok WHERE arm = 'own') SELECT target, delta, count(*) AS n, round(quantile_cont(ratio, 0.5), 6) AS median, round(avg(CAST(ratio > 2 AS int)), 6) AS above_double, round(avg(CAST(ratio < 0.5 AS int)), 6) AS below_half, round(quantile_cont(ratio, 0.05), 6) AS p05, round(quantile_cont(ratio, 0.95), 4) AS p95 FROM x GROUP BY 1, 2""")
def tail_report(spark, sf_dir):
    """How far forecasts are off."""
    f = forecasts(spark, sf_dir).where("arm = 'own' AND y IS NOT NULL AND f IS NOT NULL AND bench IS NOT NULL").withColumn("ratio", F.exp(F.col("f") - F.col("y")))
    return scoring.tail_report(f, ["target", "delta"]).select("target", "delta", "n", *rounded("median", "above_double", "below_half", "p05"), F.round("p95", 4).alias("p95"))


MI_SQL = STUDY_SQL + """, v AS (SELECT series_id, t, a, y FROM study WHERE a IS NOT NULL AND y IS NOT NULL), z AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM v),
b AS (SELECT series_id, t, n, ((row_number() OVER (PARTITION BY series_id ORDER BY a) - 1) * 16) // n AS bx, ((row_number() OVER (PARTITION BY series_id ORDER BY y) - 1) * 16) // n AS yb FROM z),
q AS (SELECT series_id, -1 AS draw, n, bx, yb FROM b UNION ALL SELECT series_id, draw, n, bx, ((row_number() OVER (PARTITION BY series_id, draw ORDER BY md5(concat(draw, ':', t)), t) - 1) * 16) // n FROM b CROSS JOIN (SELECT unnest(range(200)) AS draw)),
c AS (SELECT series_id, draw, n, bx, yb, count(*) AS k FROM q GROUP BY ALL), e AS (SELECT *, sum(k) OVER (PARTITION BY series_id, draw, bx) AS kx, sum(k) OVER (PARTITION BY series_id, draw, yb) AS ky FROM c),
m AS (SELECT series_id, draw, max(n) AS n, sum(k / n * ln(k * n / (kx * ky))) AS mi FROM e GROUP BY 1, 2),
mn AS (SELECT series_id, max(n) AS n, max(CASE WHEN draw < 0 THEN mi END) AS mi, avg(CASE WHEN draw >= 0 THEN mi END) AS null_mean, stddev_samp(CASE WHEN draw >= 0 THEN mi END) AS null_sd FROM m GROUP BY 1)"""


@query(f"""WITH {MI_SQL} SELECT series_id, n, round(mi, 6) AS mi, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(greatest(mi - null_mean, 0), 6) AS debiased FROM mn""")
def mutual_info(spark, sf_dir):
    """Mutual information in 16 bins of equal count, less its mean over 200 permutations."""
    return scoring.mutual_information_null(study(spark, sf_dir), ["series_id"], "a", "y").select("series_id", "n", *rounded("mi", "null_mean", "null_sd", "debiased"))


@query(f"""WITH {MI_SQL}, u AS (SELECT DISTINCT series_id, y FROM v), g AS (SELECT series_id, least(coalesce(y - lag(y) OVER w, 1e300), coalesce(lead(y) OVER w - y, 1e300)) AS gap FROM u WINDOW w AS (PARTITION BY series_id ORDER BY y)),
h AS (SELECT series_id, avg(ln(2 * gap)) + ln(count(*) - 1) + 0.57721566490153286 AS h FROM g GROUP BY 1), s AS (SELECT series_id, var_samp(y) AS var FROM v GROUP BY 1)
SELECT series_id, round(1 - exp(2 * h) / (2 * pi() * exp(1)) / var * exp(-2 * greatest(mi - null_mean, 0)), 6) AS ceiling FROM mn JOIN h USING (series_id) JOIN s USING (series_id)""")
def information_ceiling(spark, sf_dir):
    """The R2 that the debiased information and the target's entropy allow."""
    s = study(spark, sf_dir).where("a IS NOT NULL AND y IS NOT NULL")
    j = scoring.mutual_information_null(s, ["series_id"], "a", "y").join(scoring.nearest_entropy(s, ["series_id"], "y").drop("n"), "series_id").join(s.groupBy("series_id").agg(F.var_samp("y").alias("var")), "series_id")
    return j.select("series_id", F.round(scoring.r2_ceiling(F.col("entropy"), F.col("var"), F.col("debiased")), 6).alias("ceiling"))


@query(f"""WITH {SIGNALS_SQL}, v AS (SELECT DISTINCT series_id, a FROM sig WHERE a IS NOT NULL), g AS (SELECT series_id, least(coalesce(a - lag(a) OVER w, 1e300), coalesce(lead(a) OVER w - a, 1e300)) AS gap FROM v WINDOW w AS (PARTITION BY series_id ORDER BY a))
SELECT series_id, count(*) AS n, round(avg(ln(2 * gap)) + ln(count(*) - 1) + 0.57721566490153286, 6) AS entropy FROM g GROUP BY 1""")
def nearest_entropy(spark, sf_dir):
    """Differential entropy by nearest neighbours."""
    return scoring.nearest_entropy(signals(spark, sf_dir), ["series_id"], "a").select("series_id", "n", F.round("entropy", 6).alias("entropy"))


@query(f"""WITH {SIGNALS_SQL}, p AS (SELECT x.series_id AS one, y.series_id AS two, x.a AS u, y.a AS v FROM sig x JOIN sig y ON x.date = y.date AND x.series_id < y.series_id WHERE x.a IS NOT NULL AND y.a IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY one, two ORDER BY u) + (count(*) OVER (PARTITION BY one, two, u) - 1) / 2.0 AS ru, rank() OVER (PARTITION BY one, two ORDER BY v) + (count(*) OVER (PARTITION BY one, two, v) - 1) / 2.0 AS rv FROM p)
SELECT one, two, count(*) AS n, round(corr(u, v), 6) AS pearson, round(corr(ru, rv), 6) AS spearman, round(0.5 * ln((1 + corr(u, v)) / (1 - corr(u, v))), 6) AS fisher FROM r GROUP BY 1, 2""")
def coupling(spark, sf_dir):
    """Correlations between markets."""
    s = signals(spark, sf_dir)
    a, b = s.select(F.col("series_id").alias("one"), "date", F.col("a").alias("u")), s.select(F.col("series_id").alias("two"), "date", F.col("a").alias("v"))
    return scoring.correlations(a.join(b, "date").where("one < two"), ["one", "two"], "u", "v").select("one", "two", "n", *rounded("pearson", "spearman", "fisher"))


@query(f"""WITH {SIGNALS_SQL}, k AS (SELECT unnest(range(-3, 4)) AS lag) SELECT x.series_id AS lead_series, y.series_id AS lag_series, CAST(k.lag AS int) AS lag, round(corr(x.a, y.a), 6) AS corr FROM sig x CROSS JOIN k JOIN sig y ON y.t = x.t + k.lag AND y.series_id <> x.series_id GROUP BY 1, 2, 3""")
def lead_lag_corr(spark, sf_dir):
    """Correlations at leads and lags, each row sent to its seven partners' keys."""
    s = signals(spark, sf_dir).select("series_id", F.col("t").cast("long").alias("t"), "a")
    x = s.withColumn("lag", F.explode(F.sequence(F.lit(-3), F.lit(3)))).select(F.col("series_id").alias("lead_series"), (F.col("t") + F.col("lag")).alias("t"), "lag", F.col("a").alias("u"))
    y = s.select(F.col("series_id").alias("lag_series"), "t", F.col("a").alias("v"))
    return x.join(y, "t").where("lead_series <> lag_series").groupBy("lead_series", "lag_series", "lag").agg(F.round(F.corr("u", "v"), 6).alias("corr"))


@query(f"""WITH {SIGNALS_SQL}, th AS (SELECT series_id, date, t, a, CASE WHEN count(a) OVER p >= 60 THEN quantile_cont(a, 0.33) OVER p END AS lo, CASE WHEN count(a) OVER p >= 60 THEN quantile_cont(a, 0.67) OVER p END AS hi, lag(a) OVER w AS before FROM sig
WINDOW p AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING), w AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, CASE WHEN lo IS NULL OR before IS NULL THEN 'none' WHEN before <= lo THEN 'low' WHEN before > hi THEN 'high' ELSE 'mid' END AS regime, count(*) AS n, round(avg(a), 6) AS mean FROM th GROUP BY 1, 2""")
def regimes(spark, sf_dir):
    """Terciles by trailing quantiles of the row before."""
    w = frames.ordered("series_id")
    past = w.rowsBetween(-252, -1)
    s = signals(spark, sf_dir)
    s = s.withColumn("lo", frames.quantile(F.col("a"), 0.33, past, 60)).withColumn("hi", frames.quantile(F.col("a"), 0.67, past, 60)).withColumn("before", F.lag("a").over(w))
    regime = F.when(F.col("lo").isNull() | F.col("before").isNull(), "none").when(F.col("before") <= F.col("lo"), "low").when(F.col("before") > F.col("hi"), "high").otherwise("mid")
    return s.groupBy("series_id", regime.alias("regime")).agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean"))


EPISODES = (("one", "1996-01-01", "1997-06-30"), ("two", "1997-01-01", "1998-12-31"))


@query(f"""WITH {SIGNALS_SQL}, e AS (SELECT * FROM (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in EPISODES)}) v(name, lo, hi)) SELECT name, series_id, count(*) AS n, round(avg(a), 6) AS mean, CAST(arg_max(date, a) AS varchar) AS peak FROM sig JOIN e ON date BETWEEN lo AND hi GROUP BY 1, 2""")
def episodes(spark, sf_dir):
    """Calendar episodes, which overlap, and their peaks."""
    e = spark.createDataFrame(EPISODES, "name string, lo string, hi string").select("name", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    return panel.in_episodes(signals(spark, sf_dir), e).groupBy("name", "series_id").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean"), F.max_by("date", "a").cast("string").alias("peak"))


@query(f"""WITH {STUDY_SQL}, g AS (SELECT series_id, count(*) AS n, covar_pop(a, y) AS c, var_pop(a) AS v, avg(a) AS mx, avg(y) AS my FROM study WHERE a IS NOT NULL AND y IS NOT NULL GROUP BY 1),
s AS (SELECT *, n * c / (sqrt(v) + 1e-9) / (n * v / (sqrt(v) + 1e-9) ** 2 + 3) / (sqrt(v) + 1e-9) AS slope FROM g) SELECT series_id, n, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept FROM s""")
def ridge_one(spark, sf_dir):
    """M1: ridge from sufficient statistics."""
    return models.ridge_one(study(spark, sf_dir), ["series_id"], "a", "y", 3.0).select("series_id", "n", *rounded("slope", "intercept"))


@query(f"""WITH {SIGNALS_SQL}, v AS (SELECT series_id, a, lag(a) OVER (PARTITION BY series_id ORDER BY t) AS b FROM sig) SELECT series_id, count(*) AS n, round(sum(a * b) / sum(b * b), 6) AS phi FROM v WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def ar_one(spark, sf_dir):
    """M8: persistence through the origin."""
    return models.persistence(signals(spark, sf_dir), ["series_id"], "a").select("series_id", "n", F.round("phi", 6).alias("phi"))


@query(f"WITH {SKILL_SQL} SELECT target, count(*) AS n, round(regr_slope(ln(s_own), delta), 6) AS slope, round(exp(regr_slope(ln(s_own), delta) / 2), 6) AS phi FROM pv WHERE s_own > 0 GROUP BY 1 HAVING count(*) > 1")
def geometric_decay(spark, sf_dir):
    """Decay of the own curve."""
    r = scoring.substitution_rate(scoring.skill(forecasts(spark, sf_dir))).select("target", "delta", F.col("s_own").alias("s"))
    return models.geometric_decay(r, ["target"]).select("target", "n", *rounded("slope", "phi"))


@query("""WITH RECURSIVE g AS (SELECT phi::double AS phi, eta::double AS eta, s::double AS noise, k, d AS delta FROM (VALUES (0.9), (0.98)) a(phi), (VALUES (0.1), (0.4)) b(eta), (VALUES (0.3), (1.0)) e(s), (VALUES (1), (5)) f(k), (VALUES (0), (5), (21)) c(d)),
r AS (SELECT *, 0 AS step, 1.0::double AS p FROM g UNION ALL SELECT phi, eta, noise, k, delta, step + 1, (phi * phi * p + eta * eta) * noise * noise / (phi * phi * p + eta * eta + noise * noise) FROM r WHERE step < 400),
v AS (SELECT *, (SELECT sum(pow(phi, j)) / k FROM range(1, k + 1) x(j)) AS w, (SELECT sum(pow(phi, abs(i - j))) / (k * k) FROM range(0, k) x(i), range(0, k) y(j)) AS c FROM r WHERE step = 400)
SELECT phi, eta, noise, CAST(k AS int) AS k, CAST(delta AS int) AS delta, round(pow(phi, 2 * delta) * w * w * (eta * eta / (1 - phi * phi) - p) / (eta * eta / (1 - phi * phi) * c + noise * noise / k), 6) AS ceiling FROM v""")
def delay_ceiling(spark, sf_dir):
    """What any filter can reach for the mean of the next k observations; the SQL iterates the filter and sums the covariances."""
    g = spark.createDataFrame([(p, e, s, k, d) for p in (0.9, 0.98) for e in (0.1, 0.4) for s in (0.3, 1.0) for k in (1, 5) for d in (0, 5, 21)], "phi double, eta double, noise double, k int, delta int")
    return g.select("*", F.round(models.delay_ceiling(*[F.col(c) for c in ("phi", "eta", "noise", "k", "delta")]), 6).alias("ceiling"))


@query("SELECT rho::double AS rho, round(0.5 + asin(rho) / pi(), 6) AS accuracy, round(0.5 + asin(rho) / pi(), 4) AS by_quadrature FROM (VALUES (0.1), (0.5), (0.9)) v(rho)")
def threshold_accuracy(spark, sf_dir):
    """Sign accuracy of a bivariate normal in closed form and by quadrature."""
    g = spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "rho double")
    return g.select("rho", F.round(scoring.gaussian_accuracy(F.col("rho")), 6).alias("accuracy"), F.round(models.threshold_accuracy(F.col("rho")), 4).alias("by_quadrature"))


D_SQL = FC_SQL + """, df AS (SELECT target, delta, t, (y - max(CASE WHEN arm = 'own' THEN f END)) ** 2 - (y - max(CASE WHEN arm = 'cross' THEN f END)) ** 2 AS d, pow(max(CASE WHEN arm = 'own' THEN f END) - max(CASE WHEN arm = 'cross' THEN f END), 2) AS adj FROM ok GROUP BY target, delta, t, y),
dm AS (SELECT target, delta, t, d - avg(d) OVER (PARTITION BY target, delta) AS e, d, row_number() OVER (PARTITION BY target, delta ORDER BY t) AS pos, count(*) OVER (PARTITION BY target, delta) AS n FROM df),
gm AS (SELECT a.target, a.delta, k.k, sum(a.e * b.e) / max(a.n) AS gamma FROM dm a CROSS JOIN (SELECT unnest(range(0, 9)) AS k) k JOIN dm b ON b.target = a.target AND b.delta = a.delta AND b.pos = a.pos + k.k GROUP BY 1, 2, 3),
lr AS (SELECT target, delta, sum(CASE WHEN k = 0 THEN gamma ELSE 2 * (1 - k / 9.0) * gamma END) AS lrv FROM gm GROUP BY 1, 2),
hc AS (SELECT target, delta, count(*) AS n, avg(d) AS mean, sqrt(greatest(max(lrv), 1e-18) / count(*)) AS se FROM df JOIN lr USING (target, delta) GROUP BY 1, 2)"""


def loss_differences(spark, sf_dir):
    return inference.differentials(forecasts(spark, sf_dir).where("bench IS NOT NULL"))


@query(f"WITH {D_SQL} SELECT target, delta, n, round(mean, 6) AS mean, round(se, 6) AS se, round(mean / se, 6) AS z FROM hc")
def hac_test(spark, sf_dir):
    """Equal predictive ability with a long-run variance."""
    return inference.hac(loss_differences(spark, sf_dir), ["target", "delta"], "d", 8).select("target", "delta", "n", *rounded("mean", "se", "z"))


@query(f"WITH {D_SQL}, c AS (SELECT target, delta, count(*) AS n, avg(d + adj) AS mean, stddev_samp(d + adj) / sqrt(count(*)) AS se FROM df GROUP BY 1, 2) SELECT target, delta, n, round(mean, 6) AS mean, round(se, 6) AS se, round(mean / nullif(se, 0), 6) AS z FROM c")
def nested_test(spark, sf_dir):
    """I4: the nested-model adjustment, and independent errors."""
    d = inference.differentials(forecasts(spark, sf_dir).where("bench IS NOT NULL"), nested=True)
    return inference.naive(d, ["target", "delta"], "d").select("target", "delta", "n", *rounded("mean", "se", "z"))


@query(f"""WITH {D_SQL}, w AS (SELECT a.target, a.t, a.d AS num, b.d AS den FROM df a JOIN df b ON a.target = b.target AND a.t = b.t AND a.delta = 2 AND b.delta = 1),
e AS (SELECT target, num, den, num - avg(num) OVER q AS x, den - avg(den) OVER q AS y, row_number() OVER (PARTITION BY target ORDER BY t) AS pos, count(*) OVER q AS n FROM w WINDOW q AS (PARTITION BY target)),
g AS (SELECT a.target, k, sum(a.x * b.x) / max(a.n) AS xx, sum(a.y * b.y) / max(a.n) AS yy, sum(a.x * b.y) / max(a.n) AS xy, sum(a.y * b.x) / max(a.n) AS yx FROM e a CROSS JOIN (SELECT unnest(range(0, 9)) AS k) JOIN e b ON b.target = a.target AND b.pos = a.pos + k GROUP BY 1, 2),
v AS (SELECT target, sum(CASE WHEN k = 0 THEN xx ELSE 2 * (1 - k / 9.0) * xx END) AS vn, sum(CASE WHEN k = 0 THEN yy ELSE 2 * (1 - k / 9.0) * yy END) AS vd, sum(CASE WHEN k = 0 THEN xy ELSE (1 - k / 9.0) * (xy + yx) END) AS cv FROM g GROUP BY 1),
m AS (SELECT target, count(*) AS n, avg(num) AS mn, avg(den) AS md FROM e GROUP BY 1),
q AS (SELECT target, n, mn, md, greatest(vn, 1e-18) / n AS vn, greatest(vd, 1e-18) / n AS vd, cv / n AS cv FROM v JOIN m USING (target)),
ab AS (SELECT *, md * md - {inference.Z95 ** 2!r} * vd AS A, -2 * (mn * md - {inference.Z95 ** 2!r} * cv) AS B, mn * mn - {inference.Z95 ** 2!r} * vn AS C FROM q),
f AS (SELECT *, CASE WHEN A = 0 OR (B * B - 4 * A * C < 0 AND A <= 0) THEN 'unbounded' WHEN B * B - 4 * A * C < 0 THEN 'empty' WHEN A > 0 THEN 'interval' ELSE 'exclusion' END AS kind FROM ab)
SELECT target, n, round(mn / md, 4) AS ratio, kind, round(CASE WHEN kind IN ('interval', 'exclusion') THEN least((-B - sqrt(greatest(B * B - 4 * A * C, 0))) / (2 * A), (-B + sqrt(greatest(B * B - 4 * A * C, 0))) / (2 * A)) END, 4) AS lo,
round(CASE WHEN kind IN ('interval', 'exclusion') THEN greatest((-B - sqrt(greatest(B * B - 4 * A * C, 0))) / (2 * A), (-B + sqrt(greatest(B * B - 4 * A * C, 0))) / (2 * A)) END, 4) AS hi FROM f""")
def fieller_set(spark, sf_dir):
    """The confidence set of a ratio of means, with its kind."""
    d = loss_differences(spark, sf_dir)
    p = d.groupBy("target", "t").agg(F.max(F.when(F.col("delta") == 2, F.col("d"))).alias("num"), F.max(F.when(F.col("delta") == 1, F.col("d"))).alias("den")).where("num IS NOT NULL AND den IS NOT NULL")
    s = inference.ratio(p, ["target"], "num", "den", 8)
    return s.select("target", "n", F.round("ratio", 4).alias("ratio"), "set.kind", F.round("set.lo", 4).alias("lo"), F.round("set.hi", 4).alias("hi"))


@query(f"""WITH {D_SQL}, one AS (SELECT target, t, d FROM df WHERE delta = 1), {resample.block_sums_sql('one', ['target'], ['d'], 1500, 40)}, m AS (SELECT target, avg(d) AS mean FROM one GROUP BY 1)
SELECT target, max(n) AS n, round(max(mean), 6) AS mean, round(quantile_cont(d / n, 0.025), 6) AS lo, round(quantile_cont(d / n, 0.975), 6) AS hi FROM bs JOIN m USING (target) GROUP BY 1""")
def block_bootstrap(spark, sf_dir):
    """Moving blocks by prefix sums, from draws that both engines repeat; d pairs the two arms."""
    d = loss_differences(spark, sf_dir).where("delta = 1").drop("delta")
    return resample.mean(d, ["target"], "d", 1500, 40).select("target", "n", *rounded("mean", "lo", "hi"))


@query(f"""WITH {D_SQL}, v AS (SELECT target, avg(d) OVER (PARTITION BY target) AS m, count(*) OVER (PARTITION BY target) AS n, row_number() OVER (PARTITION BY target ORDER BY t) AS k, avg(d) OVER (PARTITION BY target ORDER BY t) AS rec FROM df WHERE delta = 1)
SELECT target, max(n) AS n, round(max(n) * max(m) ** 2 / (sum((k * (rec - m)) ** 2) / (max(n) * max(n))), 4) AS statistic FROM v GROUP BY 1""")
def self_normalised(spark, sf_dir):
    """Recursive means instead of a bandwidth."""
    d = loss_differences(spark, sf_dir).where("delta = 1")
    return inference.self_normalised(d, ["target"], "d").select("target", "n", F.round("statistic", 4).alias("statistic"))


@query(f"""WITH {D_SQL}, p AS (SELECT target, delta, round(mean / se, 4) AS z FROM hc), q AS (SELECT *, {normal.two_sided_sql('z')} AS pv FROM p), j AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY pv, delta) AS j, count(*) OVER (PARTITION BY target) AS m FROM q)
SELECT target, delta, round(pv, 6) AS p, round(least(1, min(pv * m / j) OVER (PARTITION BY target ORDER BY j DESC)), 6) AS bh, round(least(1, max(pv * (m - j + 1)) OVER (PARTITION BY target ORDER BY j)), 6) AS holm FROM j""")
def multiplicity(spark, sf_dir):
    """P of each delay's test, and adjusted in its family; z is taken to four decimals."""
    z = inference.hac(loss_differences(spark, sf_dir), ["target", "delta"], "d", 8)
    t = z.select("target", "delta", normal.two_sided(F.round("z", 4)).alias("p"))
    return inference.multiplicity(t, ["target"]).select("target", "delta", *rounded("p", "bh", "holm"))


@query(f"""WITH {D_SQL}, x AS (SELECT target, delta, CAST(count(*) FILTER (d <> 0) AS int) AS n, CAST(count(*) FILTER (d > 0) AS int) AS plus FROM df GROUP BY 1, 2)
SELECT target, delta, n, plus, round(least(1, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(0, least(plus, n - plus) + 1) r(i))), 6) AS p FROM x WHERE n > 0""")
def sign_test(spark, sf_dir):
    """Exact sign test."""
    d = loss_differences(spark, sf_dir)
    return inference.sign_test(d, ["target", "delta"], "d").select("target", "delta", "n", "plus", F.round("p", 6).alias("p"))


@query(f"""WITH {SIGNALS_SQL}, e AS (SELECT series_id, r - avg(r) OVER q AS x, row_number() OVER (PARTITION BY series_id ORDER BY t) AS pos, count(*) OVER q AS n FROM sig WINDOW q AS (PARTITION BY series_id)),
g AS (SELECT a.series_id, k, max(a.n) AS n, sum(a.x * b.x) / max(a.n) AS c FROM e a CROSS JOIN (SELECT unnest(range(0, 6)) AS k) JOIN e b ON b.series_id = a.series_id AND b.pos = a.pos + k GROUP BY 1, 2)
SELECT g.series_id, max(g.n) AS n, round(max(g.n) * (max(g.n) + 2) * sum((g.c / z.c) ** 2 / (g.n - g.k)), 4) AS q FROM g JOIN g z ON z.series_id = g.series_id AND z.k = 0 WHERE g.k > 0 GROUP BY 1""")
def ljung_box(spark, sf_dir):
    """Portmanteau test."""
    return inference.ljung_box(signals(spark, sf_dir), ["series_id"], "r", 5).select("series_id", "n", F.round("q", 4).alias("q"))


@query(f"""WITH {SIGNALS_SQL}, s AS (SELECT series_id, t, a, count(*) OVER (PARTITION BY series_id) AS n FROM sig), m AS (SELECT series_id, (t - 300 + n) % n AS t, a FROM s) SELECT s.series_id, count(*) AS n, round(corr(s.a, m.a), 6) AS placebo FROM s JOIN m ON m.series_id = s.series_id AND m.t = s.t WHERE s.a IS NOT NULL AND m.a IS NOT NULL GROUP BY 1""")
def shift_placebo(spark, sf_dir):
    """A circular shift leaves no relation."""
    s = signals(spark, sf_dir).select("series_id", "t", "a")
    m = inference.circular_shift(s, ["series_id"], "a", 300).where("a IS NOT NULL AND moved IS NOT NULL")
    return m.groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.corr("a", "moved"), 6).alias("placebo"))


@query(f"""WITH {SIGNALS_SQL}, l AS (SELECT series_id, year(date) AS yr, sha256(string_agg(concat(CAST(date AS varchar), chr(9), printf('%.4f', r)), chr(10) ORDER BY concat(CAST(date AS varchar), chr(9), printf('%.4f', r)))) AS h, count(*) AS k FROM sig GROUP BY 1, 2)
SELECT series_id, CAST(sum(k) AS bigint) AS rows, sha256(string_agg(h, chr(10) ORDER BY yr)) AS sha256 FROM l GROUP BY 1""")
def series_digest(spark, sf_dir):
    """Content digests by year and whole."""
    return provenance.series_digest(signals(spark, sf_dir), "r").select("series_id", "rows", "sha256")


@query(f"""WITH {SIGNALS_SQL}, x AS (SELECT series_id, date, close, year(date) AS yr, max(year(date)) OVER (PARTITION BY series_id) AS last FROM sig),
a AS (SELECT series_id, yr, sha256(string_agg(concat(CAST(date AS varchar), chr(9), printf('%.4f', close)), chr(10) ORDER BY date)) AS h FROM x WHERE series_id <> 'EUROPE' OR yr < last GROUP BY 1, 2),
b AS (SELECT series_id, yr, sha256(string_agg(concat(CAST(date AS varchar), chr(9), printf('%.4f', close + CASE WHEN series_id = 'ASIA' AND yr = 1996 THEN 1 ELSE 0 END)), chr(10) ORDER BY date)) AS h FROM x WHERE series_id <> 'AMERICA' GROUP BY 1, 2),
s AS (SELECT a.series_id, count(b.h) AS there, count(*) FILTER (b.h IS DISTINCT FROM a.h) AS off, count(*) AS k FROM a LEFT JOIN b ON b.series_id = a.series_id AND b.yr = a.yr GROUP BY 1)
SELECT series_id, CASE WHEN there = 0 THEN 'MISSING' WHEN off > 0 THEN 'DIFFERENT' WHEN k < (SELECT count(*) FROM b WHERE b.series_id = s.series_id) THEN 'SAME DATA' ELSE 'IDENTICAL' END AS state FROM s""")
def manifest_states(spark, sf_dir):
    """One series is missing, one changed in a year, one longer than recorded."""
    s = signals(spark, sf_dir).select("series_id", "date", "close")
    last = F.max(F.year("date")).over(Window.partitionBy("series_id"))
    old = provenance.series_digest(s.withColumn("last", last).where("series_id <> 'EUROPE' OR year(date) < last"), "close")
    now = s.where("series_id <> 'AMERICA'").withColumn("close", F.when((F.col("series_id") == "ASIA") & (F.year("date") == 1996), F.col("close") + 1).otherwise(F.col("close")))
    return provenance.verify(old, provenance.series_digest(now, "close")).select("series_id", "state")


@query()
def factor_filter(spark, sf_dir):
    """M7: one-factor filter with a ragged edge, one group per target."""
    import numpy as np
    import pandas as pd

    p = panel.fill_union(signals(spark, sf_dir)).select("target", "t", "series_id", "a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf.pivot(index="t", columns="series_id", values="a").sort_index()
        own = list(w.columns).index(pdf["target"].iloc[0])
        obs = w.to_numpy(float)
        par = models.factor_parameters(obs[: max(len(obs) // 2, 60)])
        return pd.DataFrame({"target": pdf["target"].iloc[0], "t": w.index, "now": np.round(models.kalman(obs, par), 6), "late": np.round(models.kalman(obs, par, 5, own), 6)})

    return p.groupBy("target").applyInPandas(run, "target string, t int, now double, late double")


@query()
def fixed_b(spark, sf_dir):
    """Simulated critical values."""
    return inference.fixed_b(spark, [(250, 12), (500, 25)], 12_000).select("n", "band", F.round("critical", 4).alias("critical"))


@query()
def coverage_study(spark, sf_dir):
    """Coverage of a HAC interval under dependence."""
    return inference.coverage(spark, 200, 200, 0.5, 12).select("reps", F.round("covered", 4).alias("covered"))
