"""Target-distribution importance resampling by hashed n-grams.

One pass writes every text as a packed stream of uint16 buckets, one per run of 1 to 3 words; the
offsets of a batch's streams are its documents' offsets. The streams are then sorted block by block
and run-length encoded for counts, a bucket's gain follows from the counts of corpus and target, and
a second pass over the streams gathers gains and sums them between offsets. CRCs of runs come from
those of their words: appending a word of L bytes moves a CRC by a linear map that L fixes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import stored

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42

U = np.uint32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=U)
    for _ in range(8):
        t = (t >> U(1)) ^ ((t & U(1)) * U(0xEDB88320))
    return t


_CRC = _crc_table()
# _MOVE[k] moves a CRC over 2 ** k zero bytes: four tables, one for each of its bytes.
_MOVE: list[np.ndarray] = []


def _power(k: int) -> np.ndarray:
    while len(_MOVE) <= k:
        at = (np.arange(256, dtype=U)[None, :] << (U(8) * np.arange(4, dtype=U))[:, None]).astype(U)
        _MOVE.append(_moved(_MOVE[-1], _moved(_MOVE[-1], at)) if _MOVE else _CRC[at & U(255)] ^ (at >> U(8)))
    return _MOVE[k]


def _moved(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & U(255)] ^ tables[1][(c >> U(8)) & U(255)] ^ tables[2][(c >> U(16)) & U(255)] ^ tables[3][c >> U(24)]


def _over(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC moved over its own number of bytes, one binary digit of that number after another."""
    c = c.copy()
    for k in range(int(n.max(initial=0)).bit_length()):
        at = np.flatnonzero((n >> k) & 1)
        c[at] = _moved(_power(k), c[at])
    return c


def crcs(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes."""
    c = np.full(len(s), 0xFFFFFFFF, U)
    at, k = np.arange(len(s)), 0
    while len(at):
        c[at] = _CRC[(c[at] ^ buf[s[at] + k]) & U(255)] ^ (c[at] >> U(8))
        k += 1
        at = at[e[at] - s[at] > k]
    return ~c


def _space(c: np.ndarray) -> np.ndarray:
    """CRC after one more space."""
    c = ~c
    return ~(_CRC[(c ^ U(32)) & U(255)] ^ (c >> U(8)))


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, grouped by text; each text's number of features, and of words."""
    low = tk.lower(buf)
    s, e, doc = tk.runs(_WORD[low], offs)
    n = len(offs) - 1
    words = np.bincount(doc, minlength=n)
    one = crcs(low, s, e)
    found, of = [one], [doc]
    run = one
    for k in (1, 2):
        if len(s) <= k:
            break
        run = _over(_space(run[:-1]), e[k:] - s[k:]) ^ one[k:]
        inside = doc[k:] == doc[:-k]
        found.append(run[inside])
        of.append(doc[k:][inside])
    doc = np.concatenate(of)
    order = np.argsort(doc, kind="stable")
    return (np.concatenate(found)[order] % U(BUCKETS)).astype(np.uint16), np.bincount(doc, minlength=n), words


def streams(texts: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with n_words and the packed stream of each row's whole text, written to the shared folder."""
    src = texts.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column("__text")):
                ids, n, words = features(buf, offs)
                at = np.concatenate([[0], np.cumsum(n)]) * 2
                packed = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:-1]), pa.array(words, pa.int64()), packed], [*keep, "n_words", "stream"])

    return stored(src.mapInArrow(run, (schema + ", " if keep else "") + "n_words bigint, stream binary"))


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a batch's streams, and where each stream begins and the last ends."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    ids = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint16) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint16)
    return ids, (at - at[0]) // 2


def counts(packed: DataFrame) -> dict[int, int]:
    """Features of each bucket: blocks of streams are sorted and run-length encoded, runs added up. At most ``BUCKETS`` rows meet."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            ids = np.sort(_packed(b.column("stream"))[0], kind="stable")
            if len(ids):
                head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                total[ids[head]] += np.diff(np.append(head, len(ids)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    rows = packed.select("stream").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    return {r["bucket"]: r["n"] for r in rows}


def gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored."""
    S, T = sum(corpus.values()), sum(target.values())
    ratio = lambda k: (target.get(k, 0) + 1.0) * (S + BUCKETS) / ((corpus.get(k, 0) + 1.0) * (T + BUCKETS))
    return np.array([math.floor(1000 * math.log(ratio(k))) for k in range(BUCKETS)], np.int64)


def weighed(packed: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` with n_features and weight, the sum of gains over a stream."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keep).schema.fields)

    def run(batches):
        for b in batches:
            ids, at = _packed(b.column("stream"))
            n = np.diff(at)
            weight = np.zeros(len(n), np.int64)
            some = n > 0  # reduceat gives an empty stretch its first element
            if some.any():
                weight[some] = np.add.reduceat(gain[ids], at[:-1][some])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(weight)], [*keep, "n_features", "weight"])

    return packed.select(*keep, "stream").mapInArrow(run, f"{schema}, n_features bigint, weight bigint")


def noise(doc_id: str) -> Column:
    """Gumbel noise of a document in thousandths, floored, from a hash of its id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` in one global order with ``place`` 0, 1, ...: range partitions are sorted and counted where they lie, so no task holds more than its range.

    The order must tell all rows apart. Offsets of partitions, one row each, are all that the driver sees.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(k, k + b.num_rows))], [*b.schema.names, "__part", "__at"])
            k += b.num_rows

    laid = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, f"{schema}, __part int, __at bigint"))
    offsets, total = [], 0
    for r in sorted(laid.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        offsets.append((r["__part"], total))
        total += r["n"]
    first = df.sparkSession.createDataFrame(offsets, "__part int, __first bigint")
    return laid.join(F.broadcast(first), "__part").select(*df.columns, (F.col("__first") + F.col("__at")).alias("place"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``: those drawn to look like ``target`` have a rank.

    Null and empty texts have no features and weight 0. A null doc_id has the noise of an empty one and
    comes first among equal scores; repeated rows are drawn each for itself. Of ``least`` words or more
    ``percent`` in a hundred rows are drawn, rounded down. An empty table gives no rows; an empty target
    has every bucket at 0. Other columns of either table are not read.
    """
    packed = streams(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__row")), ["doc_id", "__row"])
    gain = gains(counts(packed), counts(streams(target, [])))
    score = (F.col("weight") + noise("doc_id")).alias("score")
    scored = stored(weighed(packed, gain, ["doc_id", "__row", "n_words"]).select("doc_id", "__row", (F.col("n_words") < least).alias("__short"), "n_features", "weight", score))
    drawn = scored.where("NOT __short").count() * percent // 100
    placed = numbered(scored, F.col("__short"), F.col("score").desc(), F.col("doc_id"), F.col("__row"))
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
