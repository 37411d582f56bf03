"""Purged walk-forward forecasts.

Rows are (target, t, own, peers, y). A row goes once to the group of its target and each delay; a
grouped Arrow function fits all refits of that group, ridge from running sums, and returns
coefficients; forecasts are then a join of test rows with coefficients and a dot product in
Catalyst. Refits come every ``refit``-th position of the test index. A label at u resolves at
u + h, so training ends at t - delta - h. Each arm trains on the rows that are complete for itself.

Arms that compress the peers (their mean, principal components, a level marked by them) are linear in
the columns with weights that each refit learns, so they too are fitted from running sums, and
their coefficients are handed out for the columns: scoring is the same for all arms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.params import Params

from . import models, resample
from .panel import training_rows

#: own: the target's stale block; peers: the others' current values; cross: both.
ARMS = ("own", "cross")
#: The own block beside the peers' mean, their first component, first two, all but the first, all of them turned.
FACTORS = ("mean", "pc1", "pc2", "rest", "turned")
#: The own level rolled forward by the first component's change since it was seen, in its place (mark) or beside it (mark_own), or by all peers' changes (mark_all).
MARKS = ("mark", "mark_own", "mark_all")
COEFS = "target string, arm string, delta int, refit_id int, n int, lambda double, mu array<double>, sd array<double>, beta array<double>, smear double"


def position(p: Params) -> F.Column:
    """A row's place j in the test index, null off it: rows that every delay may forecast, after the median has its rows. It depends on the largest delay, so all arms and delays share it."""
    some = (F.col("t") >= p.median + p.span + max(p.delays) + p.horizon) & F.col("y").isNotNull()
    return F.when(some, F.count(F.when(some, 1)).over(Window.partitionBy("target").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)) - 1)


def test_index(rows: DataFrame, p: Params) -> DataFrame:
    """(target, t, j) of the test index."""
    return rows.select("target", "t", position(p).alias("j")).where("j IS NOT NULL")


def refits(index: DataFrame, p: Params, extra_purge: int = 0) -> DataFrame:
    """(target, delta, refit_id, cut, lo) of each refit: training rows are lo <= u < cut."""
    heads = index.where(F.col("j") % p.refit == 0).select("target", "t", (F.col("j") / p.refit).cast("int").alias("refit_id"))
    d = heads.withColumn("delta", F.explode(F.array(*[F.lit(x) for x in p.delays])))
    cut = F.greatest(F.lit(0), F.col("t") - F.col("delta") - p.horizon - extra_purge)
    return d.select("target", "delta", "refit_id", cut.alias("cut"), F.greatest(F.lit(0), cut - p.span).alias("lo"))


def stale_rows(rows: DataFrame, p: Params, delays: tuple[int, ...] | None = None, past: bool = False) -> DataFrame:
    """(target, t, delta, stale, peers, y, j, bench): own blocks of every delay beside the row's peers, from one window; with ``past`` also the peers of then, as ``before``."""
    w = Window.partitionBy("target").orderBy("t")
    ago = lambda c, d: F.lag(c, d).over(w) if d else F.col(c)
    more = ["before"] if past else []
    s = F.array(*[F.struct(F.lit(d).alias("delta"), ago("own", d).alias("stale"), *[ago("peers", d).alias(c) for c in more]) for d in delays or p.delays])
    bench = F.col("bench") if "bench" in rows.columns else F.lit(0.0).alias("bench")
    return rows.select("target", "t", "peers", "y", bench, s.alias("all"), position(p).alias("j")).withColumn("s", F.explode("all")).select("target", "t", "s.delta", "s.stale", "peers", "y", "j", "bench", *[f"s.{c}" for c in more])


def framed(rows: DataFrame, p: Params, past: bool = False) -> DataFrame:
    """``stale_rows`` of rows, or rows as they are if they have a delay each: then ``stale`` is what is known at that delay."""
    return rows if "delta" in rows.columns else stale_rows(rows, p, past=past)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to more partitions than a shuffle has: groups that cost much time and few bytes would else be merged into a few tasks."""
    return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def complete(xs) -> F.Column:
    return xs.isNotNull() & F.forall(xs, lambda x: x.isNotNull() & ~F.isnan(x))


def _stacked(col: pd.Series) -> np.ndarray:
    """Arrays as rows; a missing array, and a null in one, is NaN."""
    width = max((len(v) for v in col if v is not None), default=0)
    return np.array([np.full(width, np.nan) if v is None else v for v in col], float).reshape(len(col), width)


def _turns(arm: str, own: int, P: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(windows x (own + peers) columns x regressors) of an arm that compresses the peers, from the windows' rows of ``P``."""
    k = P.shape[1]
    part = np.full((len(first), k, 1), 1 / k) if arm == "mean" else models.bases(P, first, last)
    part = part[:, :, {"mean": slice(0, 1), "pc1": slice(0, 1), "pc2": slice(0, 2), "rest": slice(1, None), "turned": slice(None)}[arm]]
    out = np.zeros((len(first), own + k, own + part.shape[2]))
    out[:, np.arange(own), np.arange(own)] = 1
    out[:, own:, own:] = part
    return out


def _marked(arm: str, own: int, k: int, beta: np.ndarray) -> np.ndarray:
    """(windows x (own + peers + peers of then) columns x regressors): the first own column moved by ``beta`` times the peers' changes."""
    more = int(arm == "mark_own")
    out = np.zeros((len(beta), own + 2 * k, own + more))
    out[:, np.arange(own), np.arange(own) + more] = 1
    out[:, 0, 0] = 1
    out[:, own : own + k, 0], out[:, own + k :, 0] = beta, -beta
    return out


def _fits(arm: str, own: np.ndarray, peers: np.ndarray, before: np.ndarray | None, y: np.ndarray, t: np.ndarray, j: np.ndarray, delta: int, p: Params, kind: str, lam: float | None, back: int):
    """(design, training rows' numbers, refit, first, last, (mu, sd, beta, lambda)) of all refits of an arm, whose training rows end ``back`` before their head."""
    parts = {"own": [own], "peers": [peers]}.get(arm, [own, peers] + ([before] if arm in MARKS else []))
    X = np.hstack(parts)
    head = np.flatnonzero(j % p.refit == 0)
    cut = np.maximum(0, t[head] - back)
    use = np.flatnonzero(np.isfinite(X).all(1) & np.isfinite(y))
    window = lambda rows: (np.searchsorted(t[rows], np.maximum(0, cut - p.span)), np.searchsorted(t[rows], cut))
    first, last = window(use)
    enough = last - first >= max(p.min_train, 1)
    first, last, at = first[enough], last[enough], (j[head[enough]] // p.refit).astype(int)
    lambdas = p.lambdas if lam is None else (lam,)
    if kind == "ridge" and len(at):
        turn = None
        if arm in FACTORS or arm in MARKS:
            whole = np.flatnonzero(np.isfinite(peers).all(1))
            lo, hi = (v[enough] for v in window(whole))
            if arm in FACTORS:
                turn = _turns(arm, own.shape[1], peers[whole], lo, hi)
            else:
                now = np.concatenate([own[delta:, 0], np.full(delta, np.nan)])  # the stale level of delta rows on is this row's
                dP, da = peers - before, now - own[:, 0]
                some = np.flatnonzero(np.isfinite(dP).all(1) & np.isfinite(da))
                a, b = (v[enough] for v in window(some))
                one = None if arm == "mark_all" else models.bases(peers[whole], lo, hi)[:, :, 0]
                turn = _marked(arm, own.shape[1], peers.shape[1], models.exposures(da[some], dP[some], a, b, one))
        fits = zip(*models.ridge_windows(X[use], y[use], first, last, lambdas, p.val, turn))
    else:
        fits = _logistic_fits(X[use], y[use], first, last, p, lam)
    return X, use, at, first, last, fits


def fit(rows: DataFrame, p: Params, kind: str = "ridge", arms: tuple[str, ...] = ARMS, extra_purge: int = 0, lam: float | None = None, feature_only: bool = False) -> DataFrame:
    """Coefficients of every (target, arm, delta, refit) with at least ``min_train`` rows that are complete for the arm.

    A group is one target's history at one delay. With ``feature_only`` the labels are known without delay, and only the features are old.
    """
    names = [c.split()[0] for c in COEFS.split(", ")]
    past = bool(set(arms) & set(MARKS))
    if kind != "ridge" and set(arms) & {*FACTORS, *MARKS}:
        raise ValueError("arms that compress the peers are fitted by ridge only")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        t, y, j, delta = pdf["t"].to_numpy(), pdf["y"].to_numpy(float), pdf["j"].to_numpy(float), int(pdf["delta"].iloc[0])
        own, peers = _stacked(pdf["stale"]), _stacked(pdf["peers"])
        before = _stacked(pdf["before"]) if past else None
        out = []
        for arm in arms:
            X, use, at, first, last, fits = _fits(arm, own, peers, before, y, t, j, delta, p, kind, lam, (0 if feature_only else delta) + p.horizon + extra_purge)
            for refit, a, b, (mu, sd, beta, pick) in zip(at, first, last, fits):
                smear = float(np.exp(y[use[a:b]] - models.linear(beta, (X[use[a:b]] - mu) / sd)).mean()) if kind == "ridge" else 1.0
                out.append((pdf["target"].iloc[0], arm, delta, int(refit), int(b - a), float(pick), mu, sd, beta, smear))
        return pd.DataFrame(out, columns=names)

    # All columns go along, though no fit needs the benchmark: scoring then reuses the same shuffle.
    return spread(framed(rows, p, past), "target", "delta").groupBy("target", "delta").applyInPandas(run, COEFS)


def _logistic_fits(X: np.ndarray, y: np.ndarray, first: np.ndarray, last: np.ndarray, p: Params, lam: float | None):
    """(mu, sd, beta, lambda) of each window; each begins where the window before ended, a few rows back."""
    beta = None
    for a, b in zip(first, last):
        mu, sd = X[a:b].mean(0), X[a:b].std(0) + 1e-9
        beta, pick = models.by_validation((X[a:b] - mu) / sd, y[a:b], p.lambdas if lam is None else (lam,), p.val, "logistic", beta)
        yield mu, sd, beta, pick


def predicted(x, mu="mu", sd="sd", beta="beta") -> F.Column:
    """The linear forecast of a row of columns; null where a coefficient is missing."""
    z = F.zip_with(F.zip_with(x, mu, lambda a, b: a - b), sd, lambda a, b: a / b)
    return F.aggregate(F.zip_with(z, F.slice(beta, 2, 10_000), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) + F.get(beta, F.lit(0))


def score(rows: DataFrame, coefs: DataFrame, p: Params, kind: str = "ridge", arms: tuple[str, ...] = ARMS) -> DataFrame:
    """(target, arm, delta, t, j, y, f, smear, bench): each test row by its refit's coefficients; 0 (or one half) where there are none or a value is missing."""
    past = bool(set(arms) & set(MARKS))
    x = framed(rows, p, past).where("j IS NOT NULL").withColumn("refit_id", F.floor(F.col("j") / p.refit).cast("int")).withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    design = F.when(F.col("arm") == "own", F.col("stale")).when(F.col("arm") == "peers", F.col("peers"))
    if past:
        design = design.when(F.col("arm").isin(*MARKS), F.concat("stale", "peers", "before"))
    x = x.withColumn("x", design.otherwise(F.concat("stale", "peers")))
    # Few rows: coefficients are refits times arms; adaptive execution picks the join.
    m = x.join(coefs, ["target", "arm", "delta", "refit_id"], "left")
    dot = predicted("x")
    if kind != "ridge":
        dot = F.when(dot.isNotNull(), 1 / (1 + F.exp(-F.least(F.greatest(dot, F.lit(-30.0)), F.lit(30.0)))))  # least and greatest skip nulls
    f = F.coalesce(F.when(complete(F.col("x")), dot), F.lit(0.0 if kind == "ridge" else 0.5))
    return m.select("target", "arm", "delta", "t", "j", "y", f.alias("f"), F.coalesce("smear", F.lit(1.0)).alias("smear"), "bench")


def walk(rows: DataFrame, p: Params, kind: str = "ridge", arms: tuple[str, ...] = ARMS, **kw) -> DataFrame:
    """Forecasts of (target, t, own array, peers array, y[, bench]) for all arms and delays."""
    return score(rows, fit(rows, p, kind, arms, **kw), p, kind, arms)


def masked_columns(stale: np.ndarray, peers: np.ndarray | None, delay: np.ndarray) -> np.ndarray:
    """Own block of ``delay`` rows ago, peers, and how stale the block is: log(1 + delay) alone and times the own level."""
    s = np.log1p(delay.astype(float))[:, None]
    return np.hstack([stale, *([] if peers is None else [peers]), s, s * stale[:, :1]])


def masked(rows: DataFrame, p: Params, train: tuple[int, ...], test: tuple[int, ...], seed: int = 12345, lam: float | None = None, peers: bool = True, own_cut: bool = False) -> DataFrame:
    """Forecasts, as ``walk`` gives them, of one model for all delays: each refit trains on rows that are held back by a delay of ``train`` drawn for that row, and is scored at every delay of ``test``.

    All rows end at the longest delay's cut, so no row borrows what a late forecaster lacks. ``own_cut`` lets every row
    end at its own delay's instead: too hopeful for a shared model, it prices the other. The draw of a row is an integer
    of refit and row that SQL repeats. Validation takes the last rows in order of delay, then time. A group is one target's history.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        t, y, j = pdf["t"].to_numpy(), pdf["y"].to_numpy(float), pdf["j"].to_numpy(float)
        own, others = _stacked(pdf["own"]), _stacked(pdf["peers"]) if peers else None
        grid, out = np.array(train), []
        for h in np.flatnonzero(j % p.refit == 0):
            refit = int(j[h] // p.refit)
            cut = max(0, t[h] - (grid.min() if own_cut else grid.max()) - p.horizon)
            u = np.arange(np.searchsorted(t, max(0, cut - p.span)), np.searchsorted(t, cut))
            d = grid[resample.scrambled_array(refit * 1_000_003 + t[u], seed) % len(grid)]
            keep = (u >= d) & ((t[u] + d <= t[h] - p.horizon) if own_cut else True)
            u, d = u[keep], d[keep]
            at = np.lexsort((u, d))
            u, d = u[at], d[at]
            X = masked_columns(own[u - d], None if others is None else others[u], d)
            ok = np.isfinite(X).all(1) & np.isfinite(y[u])
            if ok.sum() < max(p.min_train, 1):
                continue
            X, label = X[ok], y[u][ok]
            mu, sd = X.mean(0), X.std(0) + 1e-9
            beta, pick = models.by_validation((X - mu) / sd, label, p.lambdas if lam is None else (lam,), p.val)
            smear = float(np.exp(label - models.linear(beta, (X - mu) / sd)).mean())
            out.append((pdf["target"].iloc[0], "masked", -1, refit, int(ok.sum()), float(pick), mu, sd, beta, smear))
        return pd.DataFrame(out, columns=[c.split()[0] for c in COEFS.split(", ")])

    coefs = rows.select("target", "t", "own", "peers", "y", position(p).alias("j")).groupBy("target").applyInPandas(run, COEFS).drop("arm", "delta")
    s = F.log1p(F.col("delta").cast("double"))
    x = stale_rows(rows, p, test).where("j IS NOT NULL").withColumn("refit_id", F.floor(F.col("j") / p.refit).cast("int"))
    x = x.withColumn("x", F.concat("stale", *(["peers"] if peers else []), F.array(s, s * F.get("stale", F.lit(0)))))
    m = x.join(coefs, ["target", "refit_id"], "left")
    f = F.coalesce(F.when(complete(F.col("x")), predicted("x")), F.lit(0.0))
    return m.select("target", F.lit("masked").alias("arm"), "delta", "t", "j", "y", f.alias("f"), F.coalesce("smear", F.lit(1.0)).alias("smear"), "bench")


def leaks(rows: DataFrame, p: Params, extra_purge: int = 0) -> DataFrame:
    """(target, delta, refits, late): training labels that resolve after what is known at the refit; late must be 0."""
    sched = refits(test_index(rows, p), p, extra_purge)
    heads = test_index(rows, p).where(F.col("j") % p.refit == 0).select("target", F.col("t").alias("head"), (F.col("j") / p.refit).cast("int").alias("refit_id"))
    used = training_rows(rows.where("y IS NOT NULL").select("target", "t"), sched).groupBy("target", "delta", "refit_id").agg((F.max("t") + p.horizon).alias("resolved"))
    j = used.join(heads, ["target", "refit_id"])
    return j.groupBy("target", "delta").agg(F.count("*").alias("refits"), F.sum((F.col("resolved") > F.col("head") - F.col("delta")).cast("long")).alias("late"))


def _losses(X: np.ndarray, own: int, y: np.ndarray, t: np.ndarray, j: np.ndarray, delta: int, p: Params, lam: float | None) -> float:
    """Sum of squared errors over the test index of one arm whose columns are ``X``, the first ``own`` of them the own block."""
    _, _, at, _, _, fits = _fits("cross", X[:, :own], X[:, own:], None, y, t, j, delta, p, "ridge", lam, delta + p.horizon)
    test = np.flatnonzero(np.isfinite(j))
    f = np.zeros(len(test))
    refit = (j[test] // p.refit).astype(int)
    for k, (mu, sd, beta, _) in zip(at, fits):
        use = np.flatnonzero(refit == k)
        f[use] = models.linear(beta, (X[test[use]] - mu) / sd)
    f[~np.isfinite(X[test]).all(1)] = 0.0
    return float(((y[test] - f) ** 2).sum())


def _late(x: np.ndarray, delta: int) -> np.ndarray:
    return np.concatenate([np.full((min(delta, len(x)), x.shape[1]), np.nan), x[: len(x) - delta]]) if delta else x


def surrogate_peers(P: np.ndarray, draws: list[np.random.Generator]) -> np.ndarray:
    """(draws x rows x peers): first-order autoregressions with the peers' persistence, means and joint shocks, and no relation to anything else; holes where a row of ``P`` has one.

    Persistence and shocks come from the rows without holes, one after another. All draws take a step together.
    """
    k = P.shape[1]
    whole = np.isfinite(P).all(1)
    V = P[whole]
    mu = V.mean(0)
    v0, v1 = V[:-1] - mu, V[1:] - mu
    phi = (v0 * v1).sum(0) / np.maximum((v0 * v0).sum(0), 1e-12)
    root = np.linalg.cholesky(np.cov(v1 - phi * v0, rowvar=False).reshape(k, k) + 1e-12 * np.eye(k))
    e = np.stack([rng.normal(size=P.shape) @ root.T for rng in draws])
    out = np.empty_like(e)
    out[:, 0] = e[:, 0] / np.sqrt(np.maximum(1 - phi * phi, 1e-6))
    for i in range(1, len(P)):
        out[:, i] = phi * out[:, i - 1] + e[:, i]
    out += mu
    out[:, ~whole] = np.nan
    return out


def estimation_cost(rows: DataFrame, p: Params, draws: int = 100, seed: int = 12345, lam: float | None = None, chunk: int = 10) -> DataFrame:
    """(target, delta, draws, net, cost, cost_se, gross): skill that the peers add, what peers without information add (their estimation's cost, as a rule below 0), and the difference.

    A draw puts ``surrogate_peers`` in the peers' place. A task takes one target's history and ``chunk`` draws, which it makes
    itself, for all delays; the own arm does not know the peers and is fitted once.
    """
    parts = rows.select("target", "t", "own", "peers", "y", "bench", position(p).alias("j")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // chunk)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        target, part = pdf["target"].iloc[0], int(pdf["part"].iloc[0])
        t, y, j, bench = (pdf[c].to_numpy(float) for c in ("t", "y", "j", "bench"))
        own, peers = _stacked(pdf["own"]), _stacked(pdf["peers"])
        test = np.isfinite(j)
        base = float(((y[test] - bench[test]) ** 2).sum())
        numbers = range(1 + (part - 1) * chunk, 1 + min(draws, part * chunk)) if part else (-1, 0)
        if part and len(numbers):
            made = zip(numbers, surrogate_peers(peers, [np.random.default_rng([seed, *str(target).encode(), n]) for n in numbers]))
        else:
            made = ((-1, np.zeros((len(t), 0))), (0, peers)) if not part else ()
        out = []
        for n, P in made:
            for d in p.delays:
                X = np.hstack([_late(own, d), P])
                out.append((target, d, n, _losses(X, own.shape[1], y, t, j, d, p, lam) / base if base > 0 else np.nan))
        return pd.DataFrame(out, columns=["target", "delta", "draw", "loss"])

    s = spread(parts, "target", "part").groupBy("target", "part").applyInPandas(run, "target string, delta int, draw int, loss double")
    own = F.max(F.when(F.col("draw") == -1, F.col("loss"))).over(Window.partitionBy("target", "delta"))
    s = s.withColumn("gain", own - F.col("loss"))
    fakes = F.when(F.col("draw") > 0, F.col("gain"))
    g = s.groupBy("target", "delta").agg(F.count(fakes).alias("draws"), F.max(F.when(F.col("draw") == 0, F.col("gain"))).alias("net"), F.avg(fakes).alias("cost"), (F.stddev_samp(fakes) / F.sqrt(F.count(fakes))).alias("cost_se"))
    return g.withColumn("gross", F.col("net") - F.col("cost"))


def subset(k: int, n: int, rep: int, seed: int = 12345) -> np.ndarray:
    """``k`` of ``n`` columns, those with the smallest scrambled numbers, in their order."""
    return np.sort(np.argsort(resample.scrambled_array((rep * 1009 + k) * 1009 + np.arange(n), seed), kind="stable")[:k])


def cost_by_peers(rows: DataFrame, p: Params, counts: tuple[int, ...], reps: int = 3, delta: int = 0, seed: int = 12345, lam: float | None = None) -> DataFrame:
    """(target, peers, gain, least, most, slope, explained): mean gain in skill over the own arm of ``reps`` random subsets of so many peers, and the line through the origin that fits the gains.

    A count that reaches all peers has one subset. A cost of estimating is such a line; peers that mislead need not give one.
    """
    parts = rows.select("target", "t", "own", "peers", "y", "bench", position(p).alias("j")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in (0, *counts)])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        target, k = pdf["target"].iloc[0], int(pdf["k"].iloc[0])
        t, y, j, bench = (pdf[c].to_numpy(float) for c in ("t", "y", "j", "bench"))
        own, peers = _stacked(pdf["own"]), _stacked(pdf["peers"])
        test = np.isfinite(j)
        base, n = float(((y[test] - bench[test]) ** 2).sum()), peers.shape[1]
        sets = [subset(min(k, n), n, r, seed) for r in range(1 if k == 0 or k >= n else reps)]
        loss = [_losses(np.hstack([_late(own, delta), peers[:, c]]), own.shape[1], y, t, j, delta, p, lam) / base if base > 0 else np.nan for c in sets]
        return pd.DataFrame({"target": target, "k": k, "peers": [len(c) for c in sets], "loss": loss})

    s = spread(parts, "target", "k").groupBy("target", "k").applyInPandas(run, "target string, k int, peers int, loss double")
    own = F.max(F.when(F.col("k") == 0, F.col("loss"))).over(Window.partitionBy("target"))
    g = s.withColumn("gain", own - F.col("loss")).where("k > 0").groupBy("target", "k", "peers").agg(F.avg("gain").alias("gain"), F.min("gain").alias("least"), F.max("gain").alias("most"))
    w = Window.partitionBy("target")
    slope = F.sum(F.col("peers") * F.col("gain")).over(w) / F.sum(F.col("peers") * F.col("peers")).over(w)
    g = g.withColumn("slope", slope)
    off = F.sum((F.col("gain") - F.col("slope") * F.col("peers")) ** 2).over(w)
    return g.select("target", "peers", "gain", "least", "most", "slope", (1 - off / F.nullif(F.sum(F.col("gain") ** 2).over(w), F.lit(0.0))).alias("explained"))
