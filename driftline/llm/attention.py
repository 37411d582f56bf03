"""Quality classifier: attention-based multiple-instance learning over passages.

A text is a bag of passages of ``PASSAGE`` words. Each passage is encoded (h), a gate
tanh(V h) * sigmoid(U h) gives its attention, and the attention-weighted sum of encodings is scored
by a logistic unit. Only labels of documents are used. Encoder, gate and unit are learnt together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

PASSAGE = 64
BAG = 32
# Bounds of the training sample: labelled documents, and passages of one document.
TRAIN_DOCS, TRAIN_PASSAGES = 5000, 64
THRESHOLD = 0.3
HIDDEN, GATE = 16, 8


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars.encode())] = True
    return t


_CLASSES = [_table("#*$%&|<>"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("!?"), _table("0123456789"), _table(".,;:"), _table("\n"), np.arange(256) >= 128, _table("abcdefghijklmnopqrstuvwxyz")]
DIMS = len(_CLASSES) + 5 + BAG


def encode(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and the text number of each. A text without words has one passage of zeros."""
    n = len(offs) - 1
    s, e, doc = tk.words(buf, offs)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    parts = np.maximum(-(-count // PASSAGE), 1)
    base = np.concatenate([[0], np.cumsum(parts)[:-1]])
    total = int(parts.sum())
    owner = np.repeat(np.arange(n), parts)
    X = np.zeros((total, DIMS), np.float32)
    if not len(s):
        return X, owner
    at = base[doc] + (np.arange(len(s)) - first[doc]) // PASSAGE
    k = np.bincount(at, minlength=total).astype(np.float64)
    some = np.flatnonzero(k)
    head = np.searchsorted(at, some)
    tail = np.append(head[1:], len(s)) - 1
    size = np.maximum(e[tail] - s[head], 1)
    for j, t in enumerate(_CLASSES):
        c = np.concatenate([[0], np.cumsum(t[buf], dtype=np.int64)])
        X[some, j] = (c[e[tail]] - c[s[head]]) / size
    length = (e - s).astype(np.float64)
    kk = np.maximum(k, 1)
    mean = np.bincount(at, length, total) / kk
    X[:, 8] = mean / 8
    X[:, 9] = np.sqrt(np.maximum(np.bincount(at, length * length, total) / kk - mean * mean, 0)) / 8
    h = tk.hashes(tk.lower(buf), s, e)
    key = np.sort((at.astype(np.uint64) << np.uint64(36)) | (h >> np.uint64(28)))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    X[:, 10] = np.bincount((key[fresh] >> np.uint64(36)).astype(np.int64), minlength=total) / kk
    X[:, 11] = k / PASSAGE
    X[:, 12] = np.log1p(count)[owner] / 8
    bag = np.bincount(at * BAG + (h >> np.uint64(59)).astype(np.int64), minlength=total * BAG).reshape(total, BAG)
    X[:, 13:] = np.sqrt(bag / kk[:, None])
    return X, owner


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict, X: np.ndarray, owner: np.ndarray, n: int) -> dict:
    """All values of the network; ``owner`` ascends and misses no text."""
    h = np.tanh((X - p["mu"]) / p["sd"] @ p["W"] + p["b"])
    v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    a = (v * u) @ p["w"]
    cut = np.searchsorted(owner, np.arange(n))
    top = np.maximum.reduceat(a, cut)
    ex = np.exp(a - top[owner])
    alpha = ex / np.add.reduceat(ex, cut)[owner]
    z = np.add.reduceat(h * alpha[:, None], cut)
    return {"h": h, "v": v, "u": u, "alpha": alpha, "z": z, "p": _sigmoid(z @ p["c"] + p["d"])}


def gradient(p: dict, fixed: dict, x: np.ndarray, o: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean log loss of texts with labels ``y`` and passages ``x`` of owners ``o``, in each weight of ``p``."""
    n = len(y)
    f = forward(p | fixed, x, o, n)
    g = (f["p"] - y) / n
    dz = g[:, None] * p["c"]
    dalpha = (f["h"] * dz[o]).sum(1)
    cut = np.searchsorted(o, np.arange(n))
    da = f["alpha"] * (dalpha - np.add.reduceat(f["alpha"] * dalpha, cut)[o])
    dvu = da[:, None] * p["w"]
    dv, du = dvu * f["u"] * (1 - f["v"] ** 2), dvu * f["v"] * f["u"] * (1 - f["u"])
    dh = f["alpha"][:, None] * dz[o] + dv @ p["V"].T + du @ p["U"].T
    dpre = dh * (1 - f["h"] ** 2)
    return {"W": ((x - fixed["mu"]) / fixed["sd"]).T @ dpre, "b": dpre.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ da, "c": f["z"].T @ g, "d": np.array([g.sum()])}


def fit(X: np.ndarray, owner: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 256, seed: int = 3) -> dict:
    """Weights by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    p = {"W": rng.normal(0, 0.3, (DIMS, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    fixed = {"mu": X.mean(0), "sd": X.std(0) + 0.05}
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    start = np.searchsorted(owner, np.arange(len(y) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            own = np.sort(order[lo : lo + batch])
            rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in own])
            o = np.repeat(np.arange(len(own)), start[own + 1] - start[own])
            x = X[rows]
            grad = gradient(p, fixed, x, o, y[own])
            t += 1
            for k in p:
                gk = grad[k] + 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * gk
                m2[k] = 0.999 * m2[k] + 0.001 * gk * gk
                p[k] = p[k] - 0.01 * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return {k: np.asarray(v, np.float32) for k, v in (p | fixed).items()}


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> dict | None:
    """The model from at most about ``train_docs`` labelled documents, chosen by a hash of doc_id; None without labels of both kinds.

    Of a document with several labels the least counts. A training document gives at most
    ``TRAIN_PASSAGES`` passages, evenly spaced.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = known.count()
    if not total:
        return None
    at = F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(1 << 30)) / float(1 << 30)
    # Bounded by train_docs, so it may be broadcast.
    sample = known.where(at < min(1.0, train_docs / total)).limit(2 * train_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality"))

    def features(batches):
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column("text")):
                X, owner = encode(buf, offs)
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                xs = []
                for i in range(hi - lo):
                    x = X[cut[i] : cut[i + 1]]
                    if len(x) > TRAIN_PASSAGES:
                        x = x[np.linspace(0, len(x) - 1, TRAIN_PASSAGES).astype(int)]
                    xs.append(x.astype(np.float16).tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("quality").slice(lo, hi - lo), pa.array(xs, pa.binary())], ["doc_id", "quality", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(features, f"doc_id {kind}, quality int, x binary").toPandas().sort_values(["doc_id", "x"], ignore_index=True)
    y = (got["quality"].to_numpy() == 1).astype(np.float64)
    if len(set(y)) < 2:
        return None
    xs = [np.frombuffer(x, np.float16).reshape(-1, DIMS).astype(np.float32) for x in got["x"]]
    return fit(np.concatenate(xs), np.repeat(np.arange(len(xs)), [len(x) for x in xs]), y)


def score(docs: DataFrame, model: dict | None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: doc_id) with score in 0 to 1 of every row's whole text.

    A null, empty or blank text is a bag of one empty passage. Without a model every score is 0.5.
    Empty table: no rows.
    """
    keep = keep or ["doc_id"]
    src = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", score double"

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column("__text")):
                if model:
                    X, owner = encode(buf, offs)
                    p = np.round(forward(model, X, owner, hi - lo)["p"].astype(np.float64), 6)  # what lies beyond depends on a text's neighbours in the batch
                else:
                    p = np.full(hi - lo, 0.5)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:-1]), pa.array(p)], [*keep, "score"])

    return src.mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: learnt from labels whose fold of five is not 0.

    A null doc_id is in no fold: neither learnt from nor held out.
    """
    fold = lambda: F.crc32(F.col("doc_id").cast("string")) % 5
    model = train(docs, labels.where(fold() != 0), train_docs)
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
