"""Language ID by hierarchical discrimination.

A text is a histogram of hashed letter trigrams. Linear support vector machines, one for each pair
of families, vote for the family; within it, one-versus-one machines for each pair of languages
vote for the language. Ties in votes go to the larger sum of margins. Languages are those of the
training rows; families come from a table, and a language outside it is a family of its own.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .store import stored

DIMS = 2048
# Training rows per language; a documented bound on the training sample. Every language is learnt, however many there are.
PER_LANG = 800

# ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "malayic": "id jv ms su tl",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def histograms(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of unit length per text: square roots of counts of hashed trigrams of letters and gaps."""
    n = len(offs) - 1
    b = _LETTER[buf]
    if len(b) > 1:  # capitals of Latin-1
        cap = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        b[1:][cap] += 32
    out = np.zeros((n, DIMS), np.float32)
    if len(b) >= 3:
        gap = b == 32
        x = b.astype(np.uint32)
        h = ((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(0x9E3779B1)
        doc = np.repeat(np.arange(n), np.diff(offs))
        ok = (doc[:-2] == doc[2:]) & ~(gap[1:-1] & (gap[:-2] | gap[2:]))
        key = doc[:-2] * DIMS + (h >> np.uint32(21))
        out = np.bincount(key[ok], minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    n = len(offs) - 1
    found = np.zeros(n, bool)
    found[np.searchsorted(offs, np.flatnonzero(_ASCII_LETTER[buf]), "right") - 1] = True
    for i in np.flatnonzero(~found & (np.diff(offs) > 0)):
        found[i] = any(map(str.isalpha, buf[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def svm(X: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 12, seed: int = 5) -> np.ndarray:
    """Linear SVM (hinge loss) by dual coordinate descent; y in -1, 1. The last weight is the bias."""
    X = np.hstack([X, np.ones((len(X), 1), np.float32)]).astype(np.float64)
    sq, a, w = (X * X).sum(1), np.zeros(len(X)), np.zeros(X.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(X)):
            new = min(max(a[i] + (1 - y[i] * (X[i] @ w)) / sq[i], 0.0), cost)
            if new != a[i]:
                w += (new - a[i]) * y[i] * X[i]
                a[i] = new
    return w.astype(np.float32)


def vote(model: dict, X: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class number and confidence (0 to 1) of each row."""
    k = len(model["classes"])
    if k == 1:
        return np.zeros(len(X), np.int64), np.ones(len(X))
    margin = X @ model["w"][:, :-1].T + model["w"][:, -1]
    votes, total, worst = np.zeros((len(X), k)), np.zeros((len(X), k)), np.full((len(X), k), np.inf)
    for j, (p, q) in enumerate(itertools.combinations(range(k), 2)):
        for c, m in ((p, margin[:, j]), (q, -margin[:, j])):
            votes[:, c] += m > 0
            total[:, c] += m
            worst[:, c] = np.minimum(worst[:, c], m)
    best = np.argmax(np.where(votes == votes.max(1, keepdims=True), total, -np.inf), 1)
    return best, 1 / (1 + np.exp(-3 * worst[np.arange(len(X)), best]))


def family_of(lang: str) -> str:
    """The family of a language tag; a tag outside the table is a family of its own."""
    return FAMILY.get(lang.lower()[:2], lang) if len(lang) <= 3 or lang[2] in "-_" else lang


def train(docs: DataFrame, per_lang: int = PER_LANG) -> dict | None:
    """The model from (doc_id, text, lang) rows; None if there is nothing to learn from.

    The sample holds about ``per_lang`` texts of each language, chosen by a hash of doc_id. Each machine is fitted in
    a task of its own, from the texts of its two classes; the driver sees weights alone.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n")))
    # One short row for each language, so it may be broadcast.
    share = F.broadcast(counts.select("lang", F.least(F.lit(1.0), per_lang / F.col("n")).alias("share")))
    langs = sorted(r["lang"] for r in counts.select("lang").collect())
    if not langs:
        return None
    at = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(share, "lang").where(at < F.col("share")).select("lang", "text")

    def encode(batches):
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column("text")):
                x = histograms(buf, offs).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column("lang").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    # Texts become histograms where they lie; the limit only guards against a doc_id that repeats without end.
    seen = stored(sample.mapInArrow(encode, "lang string, x binary").limit(2 * per_lang * len(langs)))
    families: dict[str, list[str]] = {}
    for r in sorted(seen.select("lang").distinct().collect()):
        families.setdefault(family_of(r["lang"]), []).append(r["lang"])
    top = sorted(families)
    if not top:
        return None
    # What each language is in each machine: the first class of its pair, or the second.
    roles = [(lang, f"{i}:{j}", y) for i, j in itertools.combinations(range(len(top)), 2) for k, y in ((i, 1.0), (j, -1.0)) for lang in families[top[k]]]
    for k, f in enumerate(top):
        roles += [(families[f][c], f"{k}/{i}:{j}", y) for i, j in itertools.combinations(range(len(families[f])), 2) for c, y in ((i, 1.0), (j, -1.0))]
    weights: dict[str, np.ndarray] = {}
    if roles:

        def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["lang", "x"], ignore_index=True)  # rows arrive in any order
            X = np.stack([np.frombuffer(x, np.float16) for x in pdf["x"]]).astype(np.float32)
            return pd.DataFrame([(pdf["machine"].iloc[0], svm(X, pdf["y"].to_numpy()).tobytes())], columns=["machine", "w"])

        j = seen.join(F.broadcast(spark.createDataFrame(roles, "lang string, machine string, y double")), "lang")
        weights = {r["machine"]: np.frombuffer(r["w"], np.float32) for r in j.groupBy("machine").applyInPandas(fitted, "machine string, w binary").collect()}
    pick = lambda head, n: np.array([weights[f"{head}{i}:{j}"] for i, j in itertools.combinations(range(n), 2)], np.float32)
    return {"top": {"classes": top, "w": pick("", len(top))}, "within": [{"classes": families[f], "w": pick(f"{k}/", len(families[f]))} for k, f in enumerate(top)]}


def label(buf: np.ndarray, offs: np.ndarray, model: dict | None) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text of a slice; ``und`` and 0 without a letter or a model."""
    n = len(offs) - 1
    lang, score = np.full(n, "und", object), np.zeros(n)
    at = np.flatnonzero(has_letter(buf, offs)) if model else []
    if len(at):
        X = histograms(buf, offs)[at]
        fam, p = vote(model["top"], X)
        for f, inner in enumerate(model["within"]):
            m = np.flatnonzero(fam == f)
            if len(m):
                c, q = vote(inner, X[m])
                lang[at[m]] = np.array(inner["classes"], object)[c]
                score[at[m]] = p[m] * q
    return lang, score


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text.

    ``und`` with score 0: null text, a text without a letter, or no model. Empty table: no rows.
    """

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column("text")):
                lang, score = label(buf, offs, model)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def known(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` without rows of language ``und``, and with the language predicted in ``lang``, if there is such a column; other columns as they are.

    Without a model all rows with a letter stay as they are.
    """
    place = docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches):
        for b in batches:
            keep, said = np.zeros(b.num_rows, bool), np.full(b.num_rows, None, object)
            for lo, hi, buf, offs in tk.slices(b.column("text")):
                if model:
                    said[lo:hi] = label(buf, offs, model)[0]
                keep[lo:hi] = said[lo:hi] != "und" if model else has_letter(buf, offs)
            cols = list(b.columns)
            if model and place is not None:
                cols[place] = pa.array(said, pa.string()).cast(cols[place].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def fold(col: str, k: int) -> F.Column:
    """crc32 of a key as text, modulo k; null for a null key."""
    return F.crc32(F.col(col).cast("string")) % k


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learnt from rows whose fold of four is not 2, predicted for all.

    A null doc_id is in no fold: neither learnt from nor held out.
    """
    model = train(docs.where(fold("doc_id", 4) != 2), per_lang)
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
