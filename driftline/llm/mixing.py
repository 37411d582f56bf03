"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. ``documents_sizes`` counts words once and keeps (doc_id, source, size).
2. ``source_targets`` ranks sources by code point, weighs them 1, 2, 3, ... in turn and fills
   their targets up to ``max_repeat`` times their size, excess reshared by weight.
3. ``apportion`` gives sources whole blocks by the highest quotients target / (2 seats + 1):
   the house goes to all quotients above a divisor, found by narrowing it with one aggregate of
   many trial divisors per round; of equal last quotients the later sources give way, so the house is
   met exactly. Within a source, shards get integer quotas the same way.
4. A shard's documents lie end to end in seeded order. Its words are cut into floor(words / 64) blocks that
   are equal to a word: 64 words in a large shard, up to 127 in one that has no more. A
   quota of q over n blocks takes each block q // n times and q % n seeded ones once more.

Nothing is gathered but single rows of sums. A shard holds a bounded share of the corpus, and a
source has a bounded number of shards, so a hot source is many tasks.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

BLOCK_WORDS = 64
SHARD_WORDS = 1 << 17
MAX_SHARDS = 4096


def word_count(text) -> F.Column:
    """Runs of ``[^\\x20\\x09-\\x0D]``; 0 for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: float = 3.0) -> tuple[DataFrame, float]:
    """(mix_source, source_size, rank, weight, target) per source of (source, size), and the total.

    A null source is a source of its own and ranks last.
    """
    src = sizes.groupBy(F.col("source").alias("mix_source")).agg(F.sum("size").alias("source_size"), F.sum(F.col("size") + 1).alias("load"))
    src = stored(src)
    # Ranks without one task for all: range-sorted parts, then each part's first rank.
    key = [F.col("mix_source").isNull(), F.col("mix_source")]
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = stored(src.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()))
    parts = ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("rows"))
    before, base = 0, []
    for r in sorted(parts.collect()):
        base.append((r["part"], before))
        before += r["rows"]
    spark = sizes.sparkSession
    starts = spark.createDataFrame(base, "part long, base long")
    ordered = ordered.join(F.broadcast(starts), F.shiftright("at", 33) == F.col("part"))
    rank = F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    src = stored(ordered.select("mix_source", "source_size", "load", rank.alias("rank"), w.alias("weight")))
    # The level at which targets min(level * weight, max_repeat * size) add up to the share of all words.
    total = (src.agg(F.sum("source_size")).head()[0] or 0) * share
    cap = F.col("source_size") * float(max_repeat)
    level, full = 0.0, 0.0
    while True:
        held = cap <= level * F.col("weight")
        r = src.agg(F.sum(F.when(held, cap).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight")))).head()
        held_words, free = float(r[0] or 0), float(r[1] or 0)
        if free <= 0:
            break
        new = (total - held_words) / free
        if new <= level or held_words == full and level > 0:
            level = max(level, new)
            break
        level, full = new, held_words
    return src.withColumn("target", F.least(cap, F.col("weight") * level)), total


def divisor(votes: DataFrame, house: int, trials: int = 64, rounds: int = 12) -> float:
    """A divisor d for which rounding ``target / d`` half up (at most ``cap``) gives at least ``house`` seats, and more by ties alone."""
    total = float(votes.agg(F.sum("target")).head()[0] or 0)
    if house <= 0 or total <= 0:
        return float("inf")
    n = votes.count()
    lo, hi = total / (house + n + 1.0) / 2, total / max(house - n, 1) * 2 + 1
    for _ in range(rounds):
        ds = np.linspace(lo, hi, trials)
        seats = [F.sum(F.least(F.floor(F.col("target") / float(d) + 0.5), F.col("cap"))) for d in ds]
        got = np.array([x or 0 for x in votes.agg(*seats).head()])
        ok = np.flatnonzero(got >= house)
        if not len(ok):
            return lo
        k = ok[-1]
        lo = float(ds[k])
        if got[k] == house or k + 1 == trials:
            break
        hi = float(ds[k + 1])
    return lo


def apportion(votes: DataFrame, house: int) -> DataFrame:
    """(rank, seats): exactly ``house`` Sainte-Lague seats (or all that caps allow) for (rank, target, cap); ties to the lower rank."""
    d = divisor(votes, house)
    given = stored(votes.select("rank", "target", F.least(F.floor(F.col("target") / d + 0.5), F.col("cap")).cast("long").alias("seats")))
    over = int((given.agg(F.sum("seats")).head()[0] or 0) - max(house, 0))
    if over <= 0:
        return given.select("rank", "seats")
    # The lowest last quotients go back: as many as sources tie at the divisor, one of each.
    last = given.where("seats > 0").select("rank", (F.col("target") / (2 * F.col("seats") - 1)).alias("q"))
    back = last.orderBy(F.round(F.log("q"), 12), F.desc("rank")).limit(over).select("rank", F.lit(1).alias("back"))
    return given.join(back, "rank", "left").select("rank", (F.col("seats") - F.coalesce("back", F.lit(0))).alias("seats"))


def highest_quotients(votes: np.ndarray, cap: np.ndarray, house: int) -> np.ndarray:
    """Sainte-Lague seats: ``house`` of the quotients votes / (2 k - 1), k up to cap, highest first; ties to the first."""
    votes, cap = np.asarray(votes, float), np.asarray(cap, np.int64)
    house = min(int(house), int(cap.sum()))
    total = votes.sum()
    if house <= 0 or total <= 0:
        return np.zeros(len(votes), np.int64)
    lo, hi = total / (house + len(votes) + 1) / 4, total / max(house - len(votes), 1) * 4 + 1
    give = lambda d: np.minimum(np.floor(votes / d + 0.5).astype(np.int64), cap)
    while give(lo).sum() < house:
        lo /= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if give(mid).sum() >= house else (lo, mid)
    seats = give(lo)
    while (over := int(seats.sum()) - house) > 0:  # equal last quotients: the later give way
        last = np.where(seats > 0, votes / (2 * seats - 1), np.inf)
        back = np.flatnonzero(last <= last.min() * (1 + 1e-12))[::-1][:over]
        seats[back] -= 1
    return seats


def _shard_quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("shard", ignore_index=True)
    pdf["quota"] = highest_quotients(pdf["words"].to_numpy(), pdf["cap"].to_numpy(), int(pdf["seats"].iloc[0]))
    return pdf[["rank", "shard", "words", "blocks", "quota"]]


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, max_repeat: int = 3, shard_words: int = SHARD_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, and the columns ``carry``) for every row of ``docs`` (doc_id, text, source).

    Null or blank text: size and taken 0. Null source: a source that ranks last. A repeated
    doc_id: each row is a document of its own; rows alike in id and text lie in one shard, side by side. Empty table: no rows. Other columns are ignored.
    Same input and seed, same result, whatever the partitions.
    """
    # Rows without an id, and rows that share one, are told apart by their texts.
    sizes = stored(docs.select("doc_id", *carry, "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("__text")))
    src, total = source_targets(sizes, weights, share, max_repeat)
    load = float(src.agg(F.sum("load")).head()[0] or 0)
    per_shard = max(float(shard_words), load / MAX_SHARDS)
    src = stored(src.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("load") / per_shard)).cast("int")))
    placed = sizes.join(src.select("mix_source", "rank", "shards"), F.col("source").eqNullSafe(F.col("mix_source")))
    placed = stored(placed.select("doc_id", *carry, "size", "__text", "rank", F.pmod(F.xxhash64("doc_id", "__text", F.lit(seed)), F.col("shards")).cast("int").alias("shard")))
    shards = placed.groupBy("rank", "shard").agg(F.sum("size").alias("words"))
    blocks = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.floor(F.col("words") / block_words))).otherwise(0).cast("long")
    shards = stored(shards.withColumn("blocks", blocks).withColumn("cap", blocks * max_repeat))
    # Blocks are near equal, not exactly: a source's target in blocks counts by its own block size.
    votes = stored(src.join(shards.groupBy("rank").agg(F.sum("blocks").alias("source_blocks")), "rank").select("rank", "target", "source_size", (F.col("source_blocks") * max_repeat).alias("cap"), (F.col("target") * F.col("source_blocks") / F.greatest(F.col("source_size"), F.lit(1))).alias("want")))
    in_blocks = votes.withColumn("target", F.col("want"))
    house = int(round(float(in_blocks.agg(F.sum("target")).head()[0] or 0)))
    seats = apportion(in_blocks.select("rank", "target", "cap"), house)
    quotas = shards.join(seats, "rank").groupBy("rank").applyInPandas(_shard_quotas, "rank long, shard int, words long, blocks long, quota long")
    quotas = stored(quotas)
    w = Window.partitionBy("rank", "shard").orderBy(F.xxhash64("doc_id", "__text", F.lit(seed + 1)), "doc_id", "size", "__text", *carry).rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("stop", F.sum("size").over(w)).join(quotas, ["rank", "shard"]).join(src.select("rank", "source_size", "target"), "rank")
    return laid.select("doc_id", "size", "source_size", "target", taken(seed).alias("taken"), *carry)


def taken(seed: int) -> F.Column:
    """Words of [stop - size, stop) that fall into chosen blocks, times their repeats.

    Block b of n is [W b // n, W (b + 1) // n). Those taken once more are the images of
    0 .. quota % n - 1 under b -> (a b + c) mod n with a prime to n, so exactly quota % n of n.
    """
    size, stop, W, n, q = (F.col(c) for c in ("size", "stop", "words", "blocks", "quota"))
    start = stop - size
    # 2^61 - 1 is prime and larger than any n, so it is prime to every n; its residue is the step.
    a = F.lit((1 << 61) - 1) % n
    c = F.pmod(F.xxhash64(F.col("rank"), F.col("shard"), F.lit(seed + 2)), n)
    more = q % n
    first = F.greatest(F.lit(0), F.floor(start * n / W) - 1).cast("long")
    last = F.least(n - 1, F.floor(stop * n / W) + 1).cast("long")
    wide = lambda x: x.cast("decimal(38,0)")
    edge = lambda b: F.floor(wide(W) * wide(b) / wide(n)).cast("long")
    got = lambda b: F.greatest(F.lit(0).cast("long"), F.least(stop, edge(b + 1)) - F.greatest(start, edge(b)))
    # b is the image of (b - c) / a; being chosen needs only a bijection, so the forward image serves.
    extra = lambda b: F.when(((wide(a) * wide(b) + wide(c)) % wide(n)).cast("long") < more, got(b)).otherwise(0).cast("long")
    once = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, b: acc + extra(b))
    return F.when((size > 0) & (n > 0), F.floor(q / n).cast("long") * size + F.when(more > 0, once).otherwise(0)).otherwise(0).cast("long")
