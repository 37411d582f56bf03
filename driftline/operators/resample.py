"""Moving-block resampling by prefix sums.

Starts come from integer arithmetic that any SQL engine repeats. A block's sum is a difference of two
prefix sums, so a draw costs its blocks and not its rows. Starts depend on a group's length only:
groups of one length are resampled together, which keeps what they share.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

M31 = 2147483648


def scrambled(x: Column, seed: int = 12345) -> Column:
    """A number in 0 .. 2^31 - 1 for each whole number: three linear congruences with shifts folded in between."""
    u = (x.cast("long") * F.lit(1103515245).cast("long") + seed) % M31
    u = u.bitwiseXOR(F.shiftright(u, 15))
    u = (u * F.lit(1664525).cast("long") + 1013904223) % M31
    u = u.bitwiseXOR(F.shiftright(u, 13))
    u = (u * F.lit(22695477).cast("long") + 1) % M31
    return u.bitwiseXOR(F.shiftright(u, 16))


def scrambled_sql(x: str, seed: int = 12345) -> str:
    """The same as SQL."""
    u = f"(({x} * 1103515245 + {seed}) % {M31})"
    u = f"xor({u}, {u} >> 15)"
    u = f"(({u} * 1664525 + 1013904223) % {M31})"
    u = f"xor({u}, {u} >> 13)"
    u = f"(({u} * 22695477 + 1) % {M31})"
    return f"xor({u}, {u} >> 16)"


def starts(lengths: DataFrame, draws: int, block: int, seed: int = 12345) -> DataFrame:
    """(n, draw, b, start, stop) of the blocks of each length n: starts in 0 .. n - block, both ends included; the last block is cut to fill n."""
    nb = F.ceil(F.col("n") / block).cast("long")
    d = lengths.select("n", nb.alias("nb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw")).repartition("n", "draw")
    b = d.select("n", "nb", "draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("b"))
    start = scrambled(F.col("draw") * F.col("nb") + F.col("b"), seed) % (F.col("n") - block + 1)
    size = F.when(F.col("b") == F.col("nb") - 1, F.col("n") - F.col("b") * block).otherwise(block)
    return b.select("n", "draw", "b", start.alias("start"), size.alias("size")).select("n", "draw", "b", "start", (F.col("start") + F.col("size")).alias("stop"))


def circular_starts(lengths: DataFrame, draws: int, block: int, kind: str, seed: int = 12345) -> DataFrame:
    """(n, draw, start, stop) of the blocks of a stationary resample of each length n, which run round the end: ``stop`` may exceed n.

    ``restart``: at each row a new block begins with chance 1 / block. ``geometric``: blocks of geometric length and mean
    ``block``, one after another; so many are drawn that fewer than one draw in 1e12 is not filled, and the last one fills it.
    """
    d = lengths.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw")).repartition("n", "draw")
    w = Window.partitionBy("n", "draw").orderBy("at")
    if kind == "restart":
        i = d.select("n", "draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("at"))
        i = i.withColumn("u", scrambled(F.col("draw") * F.col("n") + F.col("at"), seed))
        new = i.where((F.col("at") == 0) | (F.col("u") < M31 // block)).withColumn("start", scrambled(F.col("u"), seed + 1) % F.col("n"))
        size = F.coalesce(F.lead("at").over(w), F.col("n")) - F.col("at")
        return new.select("n", "draw", "start", (F.col("start") + size).alias("stop"))
    if kind != "geometric" or block < 2:
        raise ValueError(f"no blocks of kind {kind} and mean length {block}")
    many = F.ceil(F.col("n") / block + 8 * F.sqrt(F.col("n") / block) + 20).cast("long")
    i = d.select("n", "draw", many.alias("many"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("at"))
    i = i.withColumn("u", scrambled(F.col("draw") * F.col("many") + F.col("at"), seed))
    long = 1 + F.floor(F.log((F.col("u") + 0.5) / M31) / math.log(1 - 1 / block))
    i = i.select("n", "draw", "at", (F.col("at") == F.col("many") - 1).alias("last"), long.alias("long"), (scrambled(F.col("u"), seed + 1) % F.col("n")).alias("start"))
    i = i.withColumn("done", F.coalesce(F.sum("long").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).where("done < n")
    size = F.when(F.col("last"), F.col("n") - F.col("done")).otherwise(F.least(F.col("long"), F.col("n") - F.col("done")))
    return i.select("n", "draw", "start", (F.col("start") + size).alias("stop"))


def block_sums(series: DataFrame, by: list[str], cols: list[str], draws: int, block: int, seed: int = 12345, kind: str = "moving") -> DataFrame:
    """(by, n, draw, cols): sums of the columns of (by, t, cols) over each draw's blocks; nulls count as 0, groups of up to two blocks are left out.

    ``kind``: ``moving`` blocks of fixed length, or those of ``circular_starts``.
    """
    w = Window.partitionBy(*by)
    run = w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    pre = series.select(*by, F.row_number().over(w.orderBy("t")).cast("long").alias("pos"), F.count("*").over(w).alias("n"), *[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).over(run).alias(c) for c in cols]).where(F.col("n") > 2 * block)
    pre = pre.unionByName(pre.where("pos = 1").select(*by, F.lit(0).cast("long").alias("pos"), "n", *[F.lit(0.0).alias(c) for c in cols]))
    lengths = pre.where("pos = 0").select("n").distinct()
    blocks = starts(lengths, draws, block, seed) if kind == "moving" else circular_starts(lengths, draws, block, kind, seed)
    end = lambda pos, weight: F.struct(pos.alias("pos"), weight.alias("w"))
    round_ = (F.col("stop") > F.col("n")).cast("int")  # what runs past the end goes on at the first row; the sum before it is 0
    ends = blocks.select("n", "draw", F.explode(F.array(end(F.col("start"), F.lit(-1)), end(F.least("stop", "n"), F.lit(1)), end(F.greatest(F.col("stop") - F.col("n"), F.lit(0)), round_))).alias("e"))
    # Ends that meet cancel, so fewer rows are joined.
    ends = ends.groupBy("n", "draw", F.col("e.pos").alias("pos")).agg(F.sum("e.w").alias("w")).where("w <> 0")
    return pre.join(ends, ["n", "pos"]).groupBy(*by, "n", "draw").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in cols])


def _circular_sql(draws: int, block: int, kind: str, seed: int) -> str:
    if kind == "restart":
        return f"""ids AS (SELECT n, draw, unnest(range(n)) AS ix FROM ln CROSS JOIN (SELECT unnest(range({draws})) AS draw)),
us AS (SELECT n, draw, ix, {scrambled_sql('(draw * n + ix)', seed)} AS u FROM ids),
rs AS (SELECT n, draw, ix, {scrambled_sql('u', seed + 1)} % n AS start FROM us WHERE ix = 0 OR u < {M31 // block}),
en AS (SELECT n, draw, start, start + coalesce(lead(ix) OVER (PARTITION BY n, draw ORDER BY ix), n) - ix AS stop FROM rs)"""
    return f"""kn AS (SELECT n, CAST(ceil(n / {block} + 8 * sqrt(n / {block}) + 20) AS bigint) AS many FROM ln), ids AS (SELECT n, many, draw, unnest(range(many)) AS ix FROM kn CROSS JOIN (SELECT unnest(range({draws})) AS draw)),
us AS (SELECT n, draw, ix, ix = many - 1 AS last, {scrambled_sql('(draw * many + ix)', seed)} AS u FROM ids),
rs AS (SELECT n, draw, ix, last, 1 + CAST(floor(ln((u + 0.5::double) / {M31}) / {math.log(1 - 1 / block)!r}::double) AS bigint) AS long, {scrambled_sql('u', seed + 1)} % n AS start FROM us),
dn AS (SELECT *, coalesce(sum(long) OVER (PARTITION BY n, draw ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM rs),
en AS (SELECT n, draw, start, start + CASE WHEN last THEN n - done ELSE least(long, n - done) END AS stop FROM dn WHERE done < n)"""


def block_sums_sql(source: str, by: list[str], cols: list[str], draws: int, block: int, seed: int = 12345, kind: str = "moving") -> str:
    """Common table expressions that end in ``bs``, the same sums by joins."""
    k, same = ", ".join(by), " AND ".join(f"h.{c} = l.{c}" for c in by)
    head = f"""pre AS (SELECT {k}, row_number() OVER w AS pos, count(*) OVER (PARTITION BY {k}) AS n, {', '.join(f'sum(coalesce({c}, 0)) OVER (PARTITION BY {k} ORDER BY t ROWS UNBOUNDED PRECEDING) AS {c}' for c in cols)} FROM {source} WINDOW w AS (PARTITION BY {k} ORDER BY t)),
p0 AS (SELECT {k}, pos, n, {', '.join(cols)} FROM pre UNION ALL SELECT {k}, 0, n, {', '.join('0.0' for _ in cols)} FROM pre WHERE pos = 1)"""
    if kind == "moving":
        return f"""{head},
ln AS (SELECT DISTINCT n, CAST(ceil(n / {block}.0) AS bigint) AS nb FROM pre WHERE n > {2 * block}), ids AS (SELECT n, nb, unnest(range({draws} * nb)) AS id FROM ln),
st AS (SELECT n, nb, id // nb AS draw, id % nb AS b, {scrambled_sql('id', seed)} % (n - {block} + 1) AS start FROM ids),
en AS (SELECT *, start + CASE WHEN b = nb - 1 THEN n - (nb - 1) * {block} ELSE {block} END AS stop FROM st),
bs AS (SELECT {', '.join('l.' + c for c in by)}, e.n, e.draw, {', '.join(f'sum(h.{c} - l.{c}) AS {c}' for c in cols)} FROM en e JOIN p0 l ON l.n = e.n AND l.pos = e.start JOIN p0 h ON {same} AND h.pos = e.stop GROUP BY ALL)"""
    turn = " AND ".join(f"r.{c} = l.{c}" for c in by)
    return f"""{head},
ln AS (SELECT DISTINCT n FROM pre WHERE n > {2 * block}), {_circular_sql(draws, block, kind, seed)},
bs AS (SELECT {', '.join('l.' + c for c in by)}, e.n, e.draw, {', '.join(f'sum(h.{c} - l.{c} + r.{c}) AS {c}' for c in cols)} FROM en e JOIN p0 l ON l.n = e.n AND l.pos = e.start JOIN p0 h ON {same} AND h.pos = least(e.stop, e.n) JOIN p0 r ON {turn} AND r.pos = greatest(e.stop - e.n, 0) GROUP BY ALL)"""


def scrambled_array(x: np.ndarray, seed: int = 12345) -> np.ndarray:
    """``scrambled`` of an array."""
    u = (np.asarray(x, np.int64) * 1103515245 + seed) % M31
    u ^= u >> 15
    u = (u * 1664525 + 1013904223) % M31
    u ^= u >> 13
    u = (u * 22695477 + 1) % M31
    return u ^ (u >> 16)


def rows_drawn(n: int, draws: np.ndarray, block: int, seed: int = 12345) -> np.ndarray:
    """Rows of each moving-block draw, n in each: what ``starts`` gives for the same numbers."""
    nb = -(-n // block)
    first = scrambled_array(draws[:, None] * nb + np.arange(nb), seed) % (n - block + 1)
    return (first[:, :, None] + np.arange(block)).reshape(len(draws), -1)[:, :n]


def by_draw(cells: DataFrame, keep: list[str], draws: int, statistic: Callable[[pd.Series, np.ndarray], dict[str, np.ndarray]], schema: str, chunk: int = 250) -> DataFrame:
    """(keep, draw, statistics) of cells whose columns are whole series as arrays: one task takes one cell and ``chunk`` draws at a time.

    ``statistic`` gets a cell's row and draw numbers and gives a value of each for every draw.
    """
    parts = cells.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // chunk))))
    parts = parts.repartition(*keep, "__part")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.select(*keep).schema.fields)

    def run(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                at = np.arange(row["__part"] * chunk, min(draws, (row["__part"] + 1) * chunk), dtype=np.int64)
                yield pd.DataFrame({k: [row[k]] * len(at) for k in keep} | {"draw": at} | statistic(row, at))

    return parts.mapInPandas(run, f"{kinds}, draw bigint, {schema}")


def weighted_area(y: np.ndarray, f: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Area under the curve of scores f for labels y under each row of weights: pairs count as often as both ends are drawn, ties half. NaN where a kind is missing."""
    order = np.argsort(f, kind="stable")
    y, f, w = y[order], f[order], weight[:, order].astype(float)
    low = np.cumsum(w * (y == 0), 1)
    head = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
    tail = np.append(head[1:], len(f)) - 1
    of = np.repeat(np.arange(len(head)), tail - head + 1)
    below = np.concatenate([np.zeros((len(w), 1)), low[:, tail[:-1]]], 1)[:, of]
    upto = low[:, tail][:, of]
    ones, zeros = (w * (y == 1)).sum(1), low[:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((ones > 0) & (zeros > 0), (w * (y == 1) * (below + upto)).sum(1) / 2 / (ones * zeros), np.nan)


def area_difference(pairs: DataFrame, by: list[str], draws: int = 500, block: int = 40, seed: int = 12345) -> DataFrame:
    """(by, n, own, cross, difference, draws, lo, hi): areas under the curve of two scores of (by, t, y in 0, 1; own; cross), and the interval of their difference on shared moving blocks.

    A draw gives rows weights, and ranks are weighted: nothing is copied or sorted again. Draws in which a kind of
    label is missing are left out, as are groups of up to two blocks. A task holds one group's history.
    """
    at = F.array_sort(F.collect_list(F.struct("t", "y", "own", "cross")))
    cells = pairs.where("y IS NOT NULL AND own IS NOT NULL AND cross IS NOT NULL").groupBy(*by).agg(at.alias("r")).where(F.size("r") > 2 * block)
    cells = cells.select(*by, *[F.col(f"r.{c}").cast("array<double>").alias(f"__{c}") for c in ("y", "own", "cross")])

    def statistic(row, draw):
        y, n = np.asarray(row["__y"]), len(row["__y"])
        rows = rows_drawn(n, np.maximum(draw - 1, 0), block, seed)
        weight = np.zeros((len(draw), n))
        np.add.at(weight, (np.arange(len(draw))[:, None], rows), 1)
        weight[draw == 0] = 1  # draw 0 is the data
        return {"n": [n] * len(draw)} | {c: weighted_area(y, np.asarray(row[f"__{c}"]), weight) for c in ("own", "cross")}

    s = by_draw(cells, by, draws + 1, statistic, "n bigint, own double, cross double")
    d = F.col("cross") - F.col("own")
    real = (F.col("draw") > 0) & ~F.isnan(d)
    seen = lambda c: F.max(F.when(F.col("draw") == 0, c))
    return s.groupBy(*by, "n").agg(seen(F.col("own")).alias("own"), seen(F.col("cross")).alias("cross"), seen(d).alias("difference"), F.count(F.when(real, 1)).alias("draws"), *[F.percentile(F.when(real, d), F.lit(q)).alias(c) for c, q in (("lo", 0.025), ("hi", 0.975))])


def _interval(x: Column) -> list[Column]:
    return [F.percentile(x, F.lit(0.025)).alias("lo"), F.percentile(x, F.lit(0.975)).alias("hi")]


def mean(series: DataFrame, by: list[str], x: str, draws: int, block: int, seed: int = 12345, kind: str = "moving") -> DataFrame:
    """(by, n, mean, lo, hi): percentile interval of a mean."""
    s = block_sums(series, by, [x], draws, block, seed, kind)
    return s.groupBy(*by, "n").agg(*_interval(F.col(x) / F.col("n"))).join(series.groupBy(*by).agg(F.avg(x).alias("mean")), by).select(*by, "n", "mean", "lo", "hi")


def ratio(series: DataFrame, by: list[str], num: str, den: str, draws: int, block: int, seed: int = 12345, least: float = 1e-9) -> DataFrame:
    """(by, n, ratio, draws, lo, hi): interval of a ratio of sums, both resampled on the same rows; draws with a denominator of up to ``least`` in size are left out."""
    s = block_sums(series, by, [num, den], draws, block, seed).where(F.abs(den) > least)
    point = series.groupBy(*by).agg((F.sum(num) / F.nullif(F.sum(den), F.lit(0.0))).alias("ratio"))
    return s.groupBy(*by, "n").agg(F.count("*").alias("draws"), *_interval(F.col(num) / F.col(den))).join(point, by).select(*by, "n", "ratio", "draws", "lo", "hi")


def stability(series: DataFrame, by: list[str], x: str, draws: int, block: int, seeds: int) -> DataFrame:
    """(by, clears, star): in how many of ``seeds`` further draw sequences the interval of a mean excludes 0; '*' when the first does and all do, '?' when they disagree, blank when none does."""
    s = block_sums(series, by, [x], draws * (seeds + 1), block).withColumn("seed", F.floor(F.col("draw") / draws))
    one = s.groupBy(*by, "seed").agg(*_interval(F.col(x) / F.col("n"))).withColumn("clear", (F.col("lo") > 0) | (F.col("hi") < 0))
    g = one.groupBy(*by).agg(F.sum((F.col("clear") & (F.col("seed") > 0)).cast("long")).alias("clears"), F.max(F.when(F.col("seed") == 0, F.col("clear"))).alias("first"))
    star = F.when(F.col("first"), F.when(F.col("clears") == seeds, "*").otherwise("?")).otherwise(F.when(F.col("clears") == seeds, "?").otherwise(""))
    return g.select(*by, "clears", star.alias("star"))


def ladder(rows: DataFrame, by: list[str], masks: list[str], ranks: list[int], draws: int, block: int, least: int = 20) -> DataFrame:
    """Whether a ratio of sums of (by, t, num, den, mask columns) climbs with the rungs of a ladder; the first mask is the base, whose ratio is taken off each rung's.

    (by, draws, contrast, sd, p_contrast of the last rung; pearson, slope and tmax over the rungs with p).
    A p counts draws, centred at what was seen, that reach it. A draw needs ``least`` rows and a positive denominator on every rung.
    """
    rung = F.posexplode(F.array(*[F.col(m).cast("double") for m in masks])).alias("rung", "k")
    long = rows.select(*by, "t", "num", "den", rung).select(*by, "rung", "t", "k", (F.col("num") * F.col("k")).alias("num"), (F.col("den") * F.col("k")).alias("den"))
    seen = long.groupBy(*by, "rung").agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("k").alias("k")).withColumn("draw", F.lit(-1).cast("long"))
    s = block_sums(long, [*by, "rung"], ["num", "den", "k"], draws, block).drop("n").unionByName(seen)
    w = Window.partitionBy(*by, "draw")
    x = F.when((F.col("k") >= least) & (F.col("den") > 0), F.col("num") / F.col("den"))
    s = s.withColumn("x", x).withColumn("base", F.max(F.when(F.col("rung") == 0, F.col("x"))).over(w)).where("rung > 0").withColumn("c", F.col("x") - F.col("base"))
    r = Window.partitionBy(*by, "rung")
    s = s.withColumn("o", F.max(F.when(F.col("draw") < 0, F.col("c"))).over(r)).withColumn("sd", F.stddev_samp(F.when(F.col("draw") >= 0, F.col("c"))).over(r)).withColumn("whole", F.count("c").over(w)).where(F.col("whole") == len(ranks))
    rank = F.element_at(F.array(*[F.lit(float(v)) for v in ranks]), F.col("rung"))
    s = s.withColumn("v", F.when(F.col("draw") < 0, F.col("c")).otherwise(F.col("c") - F.col("o"))).withColumn("rank", rank)
    last = F.col("rung") == len(ranks)
    d = s.groupBy(*by, "draw").agg(F.max(F.when(last, F.col("v"))).alias("contrast"), F.max(F.when(last, F.col("sd"))).alias("sd"), F.corr("rank", "v").alias("pearson"), F.regr_slope("v", "rank").alias("slope"), F.max(F.col("v") / F.nullif(F.col("sd"), F.lit(0.0))).alias("tmax"))
    stats = ["contrast", "pearson", "slope", "tmax"]
    for c in stats:
        d = d.withColumn(f"o_{c}", F.max(F.when(F.col("draw") < 0, F.col(c))).over(Window.partitionBy(*by)))
    p = lambda c: ((1 + F.sum(((F.col("draw") >= 0) & (F.col(c) >= F.col(f"o_{c}"))).cast("long"))) / F.count("*")).alias(f"p_{c}")
    return d.groupBy(*by).agg((F.count("*") - 1).alias("draws"), F.max(F.when(F.col("draw") < 0, F.col("sd"))).alias("sd"), *[F.max(f"o_{c}").alias(c) for c in stats], *[p(c) for c in stats])
