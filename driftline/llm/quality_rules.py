"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Base measures of every text come in one pass without a shuffle. A text goes if any rule (a measure
that is high in junk) is above its cutoff. What is bounded is this verdict, not each rule: in each
stratum (a band of text length) it shall reject at most ``risk`` of the clean documents.

* Clean labelled documents, equal texts once, are dealt by a hash of the text: ``TUNING`` of them
  propose cutoffs, the others are the holdout that tests them.
* The proposals are steps from loose to tight, the same for all rules: from 1 down to the greatest
  value of the tuning documents (``SLACK``), then down its upper quantiles (``TAILS``), on a grid of 1 / GRID.
* A step holds if the exact binomial bound says so: P(Bin(n, risk) <= k) <= delta / bands, k of
  the n holdout documents rejected by any rule. Steps are tested in their order up to the first that
  fails, which needs no correction for their number (they don't depend on the holdout); strata are
  corrected for by Bonferroni. The last step that holds is taken; without one all rules are off.
* Strata are bands, or neighbouring bands taken together where one alone has too small a holdout for
  even k = 0 to hold: of all ways to take them together, the one with most strata of which each has enough.
  It looks at numbers of documents only, never at what the rules say, and there are at most as many strata as bands. So
  each stratum's bound holds for exactly the documents that its cutoffs are used on. If all bands together
  have too few, all rules are off.

Near-equal texts still count as trials of their own. 3-word windows are told apart by 64-bit hashes less
as many bits as a text's window numbers need: in a text of 20,000 words the chance of a false repeat is 4 in 10 million.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Upper ends of the bands of n_words; the last is open.
BANDS = (200, 600)
RISK, DELTA = 0.03, 0.05
RULES = ("symbol_share", "upper_share", "repeat_share", "dup_line_share", "bang_share")
SLACK = (0.75, 0.5, 0.25, 0.1, 0.0)
TAILS = (0.001, 0.0025, 0.005, 0.01, 0.02)
GRID = 1000
# One in so many clean documents is for tuning.
TUNING = 3


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and shares) per row, h the text's MD5; null text counts as empty.

    Other columns of ``docs`` are ignored. Repeated doc_ids are measured row by row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spaces = "\t\x0b\x0c\r"
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    lacking = lambda chars: F.length(bare) - F.length(F.translate(bare, chars, ""))
    d = docs.select(
        "doc_id",
        F.md5(text).alias("h"),
        F.filter(F.split(F.translate(text, spaces + "\n", " " * 5), " "), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "").alias("lines"),
        F.length(bare).cast("long").alias("word_chars"),
        lacking(SYMBOLS).cast("long").alias("n_symbols"),
        lacking(UPPER).alias("n_upper"),
        lacking("!").alias("n_bang"),
    )
    kept = ["doc_id", "h", "word_chars", "n_symbols", "n_upper", "n_bang"]
    # Windows as longs, the hash above and the number below: sorted as primitives, equal hashes lie side by side.
    d = d.select(
        *kept, "w", F.size("w").alias("n"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size("w"), F.lit(2))))).cast("long").alias("room"),
    )
    at = F.when(F.col("n") >= 3, F.sequence(F.lit(0), F.col("n") - 3)).otherwise(F.array().cast("array<int>"))
    key = F.transform(at, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).bitwiseAND(-F.col("room")).bitwiseOR(i.cast("long")))
    d = d.select(*kept, "n_lines", "n_dup_lines", F.col("n").cast("long").alias("n_words"), "room", F.sort_array(key).alias("s"))
    same = lambda x, j: F.coalesce(F.get("s", j).bitwiseAND(-F.col("room")) == x.bitwiseAND(-F.col("room")), F.lit(False))
    twice = F.transform(F.filter("s", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x.bitwiseAND(F.col("room") - 1).cast("int"))
    d = d.select(*kept, "n_words", "n_lines", "n_dup_lines", F.sort_array(twice).alias("f"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("f", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    d = d.select(*kept, "n_words", "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))
    share = lambda x, of: (F.col(x) / F.greatest(F.col(of), F.lit(1))).alias
    return d.select(
        "doc_id", "h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars")("symbol_share"), share("n_upper", "word_chars")("upper_share"), share("n_bang", "word_chars")("bang_share"),
        share("n_repeat_words", "n_words")("repeat_share"), share("n_dup_lines", "n_lines")("dup_line_share"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def band() -> F.Column:
    out = F.lit(len(BANDS))
    for k in reversed(range(len(BANDS))):
        out = F.when(F.col("n_words") < BANDS[k], k).otherwise(out)
    return out


def ln_factorial(x: F.Column) -> F.Column:
    """ln x! by Stirling's series at x + 9, taken down by the product between."""
    z = x + 9.0
    inv = 1 / z
    series = (z + 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + inv / 12 - inv * inv * inv / 360 + F.pow(inv, 5) / 1260 - F.pow(inv, 7) / 1680
    down = F.lit(0.0)
    for k in range(1, 10):
        down = down + F.log(x + float(k))
    return series - down


def binomial_tail(k: F.Column, n: F.Column, p: float) -> F.Column:
    """P(Bin(n, p) <= k): terms from k downwards, each from the one above, until they no longer count.

    Below the mean the terms fall by a ratio under 1 each, so sqrt(n) terms of a deviation's width
    are exact to about 1e-12. At or above the mean the value is at least about a half.
    """
    k, n = k.cast("double"), n.cast("double")
    log_top = ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    reach = F.least(k, F.ceil(40 * F.sqrt(n * p) + 200)).cast("int")
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a, i):
        j = k - i
        term = a["term"] * (j + 1) * (1 - p) / ((n - j) * p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(reach >= 1, F.sequence(F.lit(1), reach)).otherwise(F.array().cast("array<int>")), first, step, lambda a: a["sum"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_top) * total)


def tuning() -> F.Column:
    return F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % TUNING == 0


def proposals(clean: DataFrame) -> DataFrame:
    """(stratum, rule, step, cutoff) from tuning documents (stratum, rules): counts on the grid, then their running sums."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.ceil(F.col(r) * GRID).cast("long").alias("bin")) for r in RULES]))
    bins = clean.select("stratum", pairs.alias("x")).groupBy("stratum", "x.rule", "x.bin").agg(F.count("*").alias("c"))
    w = Window.partitionBy("stratum", "rule")
    run = bins.withColumn("below", F.sum("c").over(w.orderBy("bin"))).withColumn("all", F.sum("c").over(w))
    top = F.max("bin")
    steps = [(top + (GRID - top) * x) / GRID for x in SLACK] + [F.min(F.when(F.col("below") >= (1 - x) * F.col("all"), F.col("bin"))) / GRID for x in TAILS]
    return run.groupBy("stratum", "rule").agg(F.array(*steps).alias("steps")).select("stratum", "rule", F.posexplode("steps").alias("step", "cutoff"))


def least_holdout(risk: float, delta: float) -> int:
    """Documents that a stratum's holdout needs for a step without a rejection to hold."""
    return math.ceil(math.log(delta / (len(BANDS) + 1)) / math.log1p(-risk))


def joinings() -> list[list[int]]:
    """All ways to take neighbouring bands together, each as the stratum of every band (named by its first), those with most strata first."""
    k = len(BANDS) + 1
    cuts = [c for r in reversed(range(k)) for c in itertools.combinations(range(1, k), r)]
    return [[max([0, *(x for x in c if x <= i)]) for i in range(k)] for c in cuts]


def strata(clean: DataFrame, risk: float, delta: float) -> DataFrame:
    """One row: ``strata``, the stratum of every band, nulls if the labels are too few for any."""
    k, least = len(BANDS) + 1, least_holdout(risk, delta)
    sizes = [F.count(F.when(~tuning() & (band() == i), 1)) for i in range(k)]
    way = F.when(F.lit(False), F.array(*[F.lit(None).cast("int")] * k))
    for w in joinings():
        enough = F.lit(True)
        for part in set(w):
            enough = enough & (sum((F.get("s", F.lit(i)) for i in range(k) if w[i] == part), F.lit(0)) >= least)
        way = way.when(enough, F.array(*[F.lit(x) for x in w]))
    way = way.otherwise(F.array(*[F.lit(None).cast("int")] * k))
    return clean.groupBy().agg(F.array(*sizes).alias("s")).select(way.alias("strata"))


def tested(clean: DataFrame, risk: float, delta: float) -> DataFrame:
    """(stratum, n, step, k, holds, cutoffs) of every step, cutoffs a map by rule; ``clean``: (h, n_words, stratum, rules), equal texts once."""
    steps = proposals(clean.where(tuning())).groupBy("stratum", "step").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    steps = stored(steps)  # strata times steps: a few rows
    over = F.lit(False)
    for r in RULES:
        over = over | (F.col(r) > F.col("cutoffs")[r])
    k = clean.where(~tuning()).join(F.broadcast(steps), "stratum").groupBy("stratum", "step").agg(F.count("*").alias("n"), F.sum(over.cast("long")).alias("k"))
    return k.join(steps, ["stratum", "step"]).withColumn("holds", binomial_tail(F.col("k"), F.col("n"), risk) <= delta / (len(BANDS) + 1))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(band, stratum, step, cutoffs) of every band whose stratum was tested. Labels: (doc_id, quality); a document counts as clean if all its labels are 1.

    A stratum whose first step fails has step -1 and no cutoffs; without enough labels there are no rows. Measures that
    are not stored yet are computed once and stored.
    """
    clean = labels.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1").select("doc_id")
    # Stored ahead of any filter: the optimiser would else write the measures' expressions into the filter again and again.
    held = stored(measured.select("doc_id", "h", "n_words", "base_failed", *RULES).join(clean, "doc_id"))
    held = stored(held.where(~F.col("base_failed")).select("h", "n_words", *RULES).distinct())
    way = stored(strata(held, risk, delta))  # one row
    t = tested(held.crossJoin(F.broadcast(way)).withColumn("stratum", F.get("strata", band())).where("stratum IS NOT NULL").drop("strata"), risk, delta)
    fail = F.min(F.when(~F.col("holds"), F.col("step"))).over(Window.partitionBy("stratum"))
    t = t.withColumn("fail", F.coalesce(fail, F.lit(len(SLACK) + len(TAILS))))
    last = F.when(F.col("step") < F.col("fail"), F.col("step"))
    on = t.groupBy("stratum").agg(F.coalesce(F.max(last), F.lit(-1)).alias("step"), F.max_by("cutoffs", last).alias("cutoffs"))
    return way.select(F.posexplode("strata").alias("band", "stratum")).join(on, "stratum").select("band", "stratum", "step", "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per row of ``docs``: base measures, base_failed and kept.

    Empty or null text: no words, base_failed. No labels, or too few for the bound: every rule is
    off and the base decides. Empty table: no rows.
    """
    m = stored(measures(docs))
    on = cutoffs(m, labels, risk, delta)
    # One row of a cutoff for each band and rule, whatever the input.
    limits = on.agg(F.map_from_entries(F.collect_list(F.struct("band", F.coalesce("cutoffs", F.create_map().cast("map<string,double>"))))).alias("cut"))
    j = m.crossJoin(F.broadcast(limits)).withColumn("mine", F.try_element_at("cut", band()))
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(F.col(r) > F.try_element_at("mine", F.lit(r)), F.lit(False))
    return j.withColumn("kept", ~F.col("base_failed") & ~over).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
