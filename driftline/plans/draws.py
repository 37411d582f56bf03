"""Stationary resamples, the check of the best of many, joint nulls and areas under the curve: every draw is a key."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftline.operators import inference, models, resample

from .base import STUDY_SQL, query, study
from .robust import BLOCK, DRAWS
from .study import D_SQL, PROB_SQL, loss_differences, probabilities, rounded


def hac_sql(source: str, by: list[str], x: str, band: int) -> str:
    """Common table expressions that end in ``hs`` (by, n, mean, se): a mean with its long-run error."""
    k, same = ", ".join(by), " AND ".join(f"b.{c} = a.{c}" for c in by)
    return f"""hm AS (SELECT {k}, {x} - avg({x}) OVER p AS e, row_number() OVER (PARTITION BY {k} ORDER BY t) AS pos, count(*) OVER p AS n FROM {source} WINDOW p AS (PARTITION BY {k})),
hg AS (SELECT {', '.join('a.' + c for c in by)}, i, sum(a.e * b.e) / max(a.n) AS gamma FROM hm a CROSS JOIN (SELECT unnest(range(0, {band + 1})) AS i) JOIN hm b ON {same} AND b.pos = a.pos + i GROUP BY ALL),
hl AS (SELECT {k}, sum(CASE WHEN i = 0 THEN gamma ELSE 2 * (1 - i / {band + 1}.0) * gamma END) AS lrv FROM hg GROUP BY {k}),
hs AS (SELECT {k}, count(*) AS n, avg({x}) AS mean, sqrt(greatest(max(lrv), 1e-18) / count(*)) AS se FROM {source} JOIN hl USING ({k}) GROUP BY {k})"""


def _stationary_sql(kind: str) -> str:
    return f"""SELECT * FROM (WITH {resample.block_sums_sql('one', ['target'], ['d'], DRAWS, BLOCK, kind=kind)} SELECT target, '{kind}' AS kind, max(n) AS n, round(max(mean), 6) AS mean, round(quantile_cont(d / n, 0.025), 6) AS lo, round(quantile_cont(d / n, 0.975), 6) AS hi FROM bs JOIN mn USING (target) GROUP BY 1)"""


@query(f"WITH {D_SQL}, one AS (SELECT target, t, d FROM df WHERE delta = 1), mn AS (SELECT target, avg(d) AS mean FROM one GROUP BY 1) {_stationary_sql('restart')} UNION ALL {_stationary_sql('geometric')}")
def stationary_bootstrap(spark, sf_dir):
    """Blocks that run round the end, by restarts at each row and by geometric lengths; the two have one law."""
    d = loss_differences(spark, sf_dir).where("delta = 1").drop("delta")
    parts = [resample.mean(d, ["target"], "d", DRAWS, BLOCK, kind=k).withColumn("kind", F.lit(k)) for k in ("restart", "geometric")]
    return parts[0].unionByName(parts[1]).select("target", "kind", "n", *rounded("mean", "lo", "hi"))


@query(f"""WITH {D_SQL}, rc AS (SELECT target, delta, t, d FROM df WHERE delta > 0 QUALIFY count(*) OVER (PARTITION BY target, t) = 3), {hac_sql('rc', ['target', 'delta'], 'd', BLOCK)},
fx AS (SELECT *, mean >= -se * sqrt(2 * ln(ln(greatest(n, 3)))) AS keep FROM hs), tp AS (SELECT target, n, count(*) AS models, count(*) FILTER (keep) AS kept, max(sqrt(n) * mean) AS statistic FROM fx GROUP BY 1, 2),
{resample.block_sums_sql('rc', ['target', 'delta'], ['d'], 2000, BLOCK, 7, 'restart')},
bo AS (SELECT b.target, draw, max(sqrt(f.n) * (d / f.n - mean)) AS every, max(sqrt(f.n) * (d / f.n - CASE WHEN keep THEN mean ELSE 0 END)) AS partly FROM bs b JOIN fx f ON f.target = b.target AND f.delta = b.delta GROUP BY 1, 2)
SELECT target, CAST(max(models) AS int) AS models, max(n) AS n, CAST(max(kept) AS int) AS kept, round(max(statistic), 6) AS statistic, round(avg(CAST(every >= statistic AS int)), 6) AS p_reality, round(avg(CAST(partly >= statistic AS int)), 6) AS p_spa FROM bo JOIN tp USING (target) GROUP BY 1""")
def reality_check(spark, sf_dir):
    """The best delay's gain against none, over 2,000 stationary draws."""
    d = loss_differences(spark, sf_dir).where("delta > 0").withColumn("k", F.count("*").over(Window.partitionBy("target", "t"))).where("k = 3")
    q = inference.reality_check(d.select("target", F.col("delta").alias("model"), "t", "d"), ["target"], 2000, BLOCK)
    return q.select("target", "models", "n", "kept", *rounded("statistic", "p_reality", "p_spa"))


BAND, LONG, NULLS = 12, 60, 2000
_LAGS = range(1, BAND + 1)


def _null_sql(name: str, seed: int) -> str:
    """|t| of each cell and draw, from prefix sums: a long-run variance is the mean square of moving sums, which lie inside a block or astride two."""
    return f"""{name} AS (WITH ids AS (SELECT n, long, nb, unnest(range({NULLS} * nb)) AS id FROM jl),
st AS (SELECT n, long, nb, id // nb AS draw, id % nb AS b, {resample.scrambled_sql('id', seed)} % (n - long + 1) AS start FROM ids),
bl AS (SELECT *, start + CASE WHEN b = nb - 1 THEN n - (nb - 1) * long ELSE long END AS stop, lead(start) OVER (PARTITION BY n, draw ORDER BY b) AS next FROM st),
ag AS (SELECT a.target, a.delta, bl.n, draw, sum(z.p - a.p) AS s, sum(z.s2 - a.s2a + a.hh + z.tt) + 2 * sum(coalesce(list_dot_product(z.tv, x.hr), 0)) AS q, max(CASE WHEN b = 0 THEN a.hd END) + max(CASE WHEN b = nb - 1 THEN z.td END) AS dd
  FROM bl JOIN jp a ON a.n = bl.n AND a.pos = bl.start JOIN jp z ON z.target = a.target AND z.delta = a.delta AND z.pos = bl.stop LEFT JOIN jp x ON x.target = a.target AND x.delta = a.delta AND x.pos = bl.next GROUP BY 1, 2, 3, 4)
SELECT target, delta, draw, abs(s / n) / sqrt(greatest((q - 2 * s / n * ({(BAND + 1) ** 2} * s - dd) + s / n * s / n * ((n - {BAND}) * {(BAND + 1) ** 2} + {2 * sum(k * k for k in _LAGS)})) / ({BAND + 1} * n), 1e-18) / n) AS t FROM ag)"""


NULL_SQL = f"""{D_SQL}, jc AS (SELECT target, delta, t, d FROM df QUALIFY count(*) OVER (PARTITION BY target, t) = 4), {hac_sql('jc', ['target', 'delta'], 'd', BAND)},
jz AS (SELECT target, delta, n, pos, sum(e) OVER (PARTITION BY target, delta ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p FROM hm UNION ALL SELECT DISTINCT target, delta, n, 0, 0.0 FROM hm),
j1 AS (SELECT *, [{', '.join(f'coalesce(lead(p, {k}) OVER w - p, 0)' for k in _LAGS)}] AS hv, [{', '.join(f'coalesce(p - lag(p, {k}) OVER w, 0)' for k in _LAGS)}] AS tv, p - lag(p, {BAND + 1}) OVER w AS m FROM jz WINDOW w AS (PARTITION BY target, delta ORDER BY pos)),
j2 AS (SELECT *, sum(coalesce(m * m, 0)) OVER (PARTITION BY target, delta ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s2 FROM j1),
jp AS (SELECT target, delta, n, pos, p, s2, lead(s2, {BAND}) OVER (PARTITION BY target, delta ORDER BY pos) AS s2a, list_reverse(hv) AS hr, tv, {' + '.join(f'hv[{k}] * hv[{k}]' for k in _LAGS)} AS hh, {' + '.join(f'tv[{k}] * tv[{k}]' for k in _LAGS)} AS tt, {' + '.join(f'{BAND + 1 - k} * hv[{k}]' for k in _LAGS)} AS hd, {' + '.join(f'{BAND + 1 - k} * tv[{k}]' for k in _LAGS)} AS td FROM j2),
jl AS (SELECT n, long, CAST(ceil(n / long) AS bigint) AS nb FROM (SELECT n, min(x) AS long FROM (SELECT n, unnest(range(least({LONG}, greatest(2, n // 4)), n)) AS x FROM (SELECT DISTINCT n FROM hm)) WHERE n % x = 0 OR n % x > {BAND} GROUP BY 1)),
{_null_sql('jt', 5)}, {_null_sql('jo', 5 + 7777)},
lm AS (SELECT target, delta, h.n, abs(mean / se) AS seen, {inference.Z95!r} AS a, {inference.Z95!r} + 2.9694 * ({BAND + 1} / h.n) + 0.4160 * pow({BAND + 1} / h.n, 2) - 0.5324 * pow({BAND + 1} / h.n, 3) AS b, c FROM hs h JOIN (SELECT target, delta, quantile_cont(t, 0.95) AS c FROM jo GROUP BY 1, 2) USING (target, delta)),
ru AS (SELECT target, delta, seen, unnest(['A', 'B', 'C']) AS rule, unnest([a, b, c]) AS lim FROM lm),
ht AS (SELECT rule, draw, count(*) AS cells, count(*) FILTER (t > lim) AS hits FROM jt JOIN ru USING (target, delta) GROUP BY 1, 2), sn AS (SELECT rule, count(*) FILTER (seen > lim) AS seen FROM ru GROUP BY 1)"""


@query(f"""WITH {NULL_SQL} SELECT rule, max(cells) AS cells, max(seen) AS hits, round(avg(hits), 6) AS null_mean, round((1 + count(*) FILTER (hits >= seen)) / {NULLS + 1}, 6) AS p, round(CASE WHEN count(*) FILTER (hits >= seen) = 0 THEN 1 - pow(0.05, 1.0 / {NULLS}) END, 6) AS bound FROM ht JOIN sn USING (rule) GROUP BY 1""")
def joint_null(spark, sf_dir):
    """How many targets and delays would be significant by luck, by three rules of what is significant."""
    d = loss_differences(spark, sf_dir).withColumn("k", F.count("*").over(Window.partitionBy("target", "t"))).where("k = 4")
    c = d.groupBy("target", "delta").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "d"))), lambda x: x["d"]).alias("series"))
    cells = c.select(F.concat_ws("/", "target", "delta").alias("cell_id"), "series", F.lit(BAND).alias("bandwidth"), inference.fixed_band(F.size("series"), F.lit(BAND)).alias("critical_value"))
    return inference.joint_null(cells, NULLS, LONG).select("rule", "cells", "hits", *rounded("null_mean", "p", "bound"))


AREAS = 500


@query(f"""WITH {PROB_SQL}, pa AS (SELECT target, t, y, max(CASE WHEN arm = 'own' THEN f END) AS own, max(CASE WHEN arm = 'cross' THEN f END) AS "cross" FROM pr WHERE delta = 1 GROUP BY 1, 2, 3),
pn AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY t) - 1 AS pos, count(*) OVER (PARTITION BY target) AS n FROM pa WHERE own IS NOT NULL AND "cross" IS NOT NULL),
ln AS (SELECT DISTINCT n, CAST(ceil(n / {BLOCK}.0) AS bigint) AS nb FROM pn WHERE n > {2 * BLOCK}), ids AS (SELECT n, nb, unnest(range({AREAS} * nb)) AS id FROM ln),
st AS (SELECT n, nb, id // nb AS draw, id % nb AS b, {resample.scrambled_sql('id')} % (n - {BLOCK} + 1) AS start FROM ids),
en AS (SELECT n, draw, unnest(range(start, start + CASE WHEN b = nb - 1 THEN n - (nb - 1) * {BLOCK} ELSE {BLOCK} END)) AS pos FROM st),
wt AS (SELECT n, draw, pos, count(*) AS w FROM en GROUP BY 1, 2, 3 UNION ALL SELECT n, -1, unnest(range(n)), 1 FROM ln),
lg AS (SELECT target, n, draw, y, w, unnest(['own', 'cross']) AS arm, unnest([own, "cross"]) AS f FROM wt JOIN pn USING (n, pos)),
gp AS (SELECT target, n, draw, arm, f, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS w1, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS w0 FROM lg GROUP BY ALL),
rk AS (SELECT *, sum(w0) OVER (PARTITION BY target, draw, arm ORDER BY f) AS upto FROM gp),
au AS (SELECT target, n, draw, arm, sum(w1 * (upto - w0 / 2)) / (sum(w1) * sum(w0)) AS auc FROM rk GROUP BY ALL),
df2 AS (SELECT target, n, draw, max(CASE WHEN arm = 'own' THEN auc END) AS own, max(CASE WHEN arm = 'cross' THEN auc END) AS "cross" FROM au GROUP BY ALL)
SELECT target, n, count(*) FILTER (draw >= 0) AS draws, round(max(CASE WHEN draw < 0 THEN own END), 6) AS own, round(max(CASE WHEN draw < 0 THEN "cross" END), 6) AS "cross", round(max(CASE WHEN draw < 0 THEN "cross" - own END), 6) AS difference,
round(quantile_cont(CASE WHEN draw >= 0 THEN "cross" - own END, 0.025), 6) AS lo, round(quantile_cont(CASE WHEN draw >= 0 THEN "cross" - own END, 0.975), 6) AS hi FROM df2 GROUP BY 1, 2""")
def auc_bootstrap(spark, sf_dir):
    """What the peers add to the area under the curve at delay 1, with its interval over 500 draws of weighted ranks."""
    f = probabilities(spark, sf_dir).where("delta = 1")
    arm = lambda a: F.max(F.when(F.col("arm") == a, F.col("f"))).alias(a)
    a = resample.area_difference(f.groupBy("target", "t", "y").agg(arm("own"), arm("cross")), ["target"], AREAS, BLOCK)
    return a.select("target", "n", "draws", *rounded("own", "cross", "difference", "lo", "hi"))


@query(f"""WITH {STUDY_SQL}, sx AS (SELECT series_id, t, a AS x, y FROM study WHERE a IS NOT NULL AND y IS NOT NULL), sm AS (SELECT series_id, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS i, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM sx GROUP BY 1),
se AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY t) AS pos, (y - i - b * x) * (x - mx) / sxx AS i1, (y - i - b * x) * (1.0 / n - mx * (x - mx) / sxx) AS i0 FROM sx JOIN sm USING (series_id)),
sv AS (SELECT a.series_id, sum((1 - abs(k) / 10.0) * a.i0 * b.i0) AS v0, sum((1 - abs(k) / 10.0) * a.i1 * b.i1) AS v1 FROM se a CROSS JOIN (SELECT unnest(range(-9, 10)) AS k) JOIN se b ON b.series_id = a.series_id AND b.pos = a.pos + k GROUP BY 1)
SELECT series_id, n, round(b, 6) AS slope, round(sqrt(greatest(v1, 0)), 6) AS slope_se, round(i, 6) AS intercept, round(sqrt(greatest(v0, 0)), 6) AS intercept_se FROM sm JOIN sv USING (series_id)""")
def ols_hac(spark, sf_dir):
    """M9: least squares of the next value on this one, with long-run errors."""
    g = models.ols_hac(study(spark, sf_dir), ["series_id"], "a", "y", 9)
    return g.select("series_id", "n", *rounded("slope", "slope_se", "intercept", "intercept_se"))


# How much of the long-run variance a short band keeps, for the tests that use one.
@query(f"""WITH {D_SQL}, nb AS (SELECT target, delta, t, d FROM df WHERE delta > 0), {hac_sql('nb', ['target', 'delta'], 'd', 8)}, wd AS (SELECT target, delta, sum(CASE WHEN i = 0 THEN gamma ELSE 2 * (1 - i / {BLOCK + 1}.0) * gamma END) AS lrv FROM (SELECT a.target, a.delta, i, sum(a.e * b.e) / max(a.n) AS gamma FROM hm a CROSS JOIN (SELECT unnest(range(0, {BLOCK + 1})) AS i) JOIN hm b ON b.target = a.target AND b.delta = a.delta AND b.pos = a.pos + i GROUP BY ALL) GROUP BY 1, 2)
SELECT target, delta, round(greatest(hl.lrv, 0) / wd.lrv, 6) AS share FROM hl JOIN wd USING (target, delta)""")
def retention(spark, sf_dir):
    """The share of the long-run variance that a band of 8 keeps against one of the block's length."""
    return inference.retention(loss_differences(spark, sf_dir).where("delta > 0"), ["target", "delta"], "d", 8, BLOCK).select("target", "delta", F.round("share", 6).alias("share"))
