"""Secret scans: fixed patterns, and a linear-chain conditional random field for what they miss.

The field tags tokens as secret begin, inside or outside by shape, neighbouring words and file
features, decoded by Viterbi (see ``crf``). It is trained here: on a bounded sample of texts, in
which the fixed patterns' finds are secrets, with made-up secrets and look-alikes set into them.
"""

from __future__ import annotations

import hashlib
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from . import textkit as tk

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
INNER = "+/_.-"

TRAIN_DOCS, WINDOWS = 300, 2500


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value) of each base match, by start, then kind. Positions are code points."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out)


def features(t: crf.Tokens) -> list[np.ndarray]:
    """Shape, neighbouring shapes, hashed words around, and the file's kind crossed with the token's length."""
    shape = t.shape()
    word = np.where((t.n < 16) & (t.digits == 0), (t.h >> np.uint64(52)).astype(np.int64), 0)
    n = max(len(t.offs) - 1, 1)
    size = np.maximum(np.diff(t.offs), 1) if len(t.offs) > 1 else np.ones(1)
    marks = np.bincount(t.doc[(t.kind == 2)], minlength=n)[:n] / size * 100
    digits = np.bincount(t.doc, t.digits, n)[:n] / size * 100
    file = np.searchsorted([0.5, 2, 6], marks, "right") * 3 + np.searchsorted([0.5, 5], digits, "right")
    band = np.searchsorted([8, 12, 20], t.n, "right") * 2 + (t.digits > 0)
    return [shape, t.shifted(shape, -1, 1023), t.shifted(shape, 1, 1023), word, t.shifted(word, -1, 1), t.shifted(word, -2, 1), t.shifted(word, 1, 1), file[t.doc] * 8 + band if len(t.doc) else t.doc]


SIZES = [1024, 1024, 1024, crf.BUCKETS, crf.BUCKETS, crf.BUCKETS, crf.BUCKETS, 96]


def _value(rng: np.random.Generator) -> str:
    pick = lambda chars, lo, hi: "".join(rng.choice(list(chars), rng.integers(lo, hi + 1)))
    an, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    return [
        lambda: pick("0123456789abcdef", 16, 48), lambda: pick(an, 14, 44), lambda: pick(b64, 24, 60), lambda: "ghp_" + pick(an, 36, 36), lambda: "sk-" + pick(an, 32, 48),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16), lambda: "AIza" + pick(an + "_-", 35, 35),
        lambda: f"xoxb-{pick(string.digits, 11, 12)}-{pick(an, 24, 24)}", lambda: ".".join(("eyJ" + pick(an + "_-", 17, 40), "eyJ" + pick(an + "_-", 30, 80), pick(an + "_-", 43, 43))),
    ][rng.integers(9)]()


def _planted(rng: np.random.Generator) -> tuple[str, str, str]:
    """(before, secret, after)."""
    word = rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "pwd", "auth", "access_key", "private_key", "client_secret", "credential", "Authorization: Bearer", "bearer", "key", "SECRET_KEY", "DB_PASSWORD", ""])
    if not word:
        return "", _value(rng), ""
    sep = rng.choice(["=", ": ", " = ", ":", " is ", " "])
    quote = rng.choice(["", "", '"', "'"])
    return f"{word}{sep}{quote}", _value(rng), quote


def _decoy(rng: np.random.Generator) -> str:
    d = lambda k: "".join(rng.choice(list(string.digits), k))
    w = lambda k: "".join(rng.choice(list(string.ascii_lowercase), k))
    return [
        lambda: f"https://{w(6)}.example.com/{w(5)}/{d(4)}?page={d(1)}", lambda: f"{w(6)}.{d(2)}@mail{d(1)}.example.com", lambda: f"{d(2)}.{d(3)}.{d(2)}.{d(3)}", lambda: d(16),
        lambda: f"+1 ({d(3)}) 555-{d(4)}", lambda: f"20{d(2)}-0{rng.integers(1, 9)}-1{d(1)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: w(22), lambda: f"{w(9)}-{w(8)}-{w(7)}", lambda: f"{w(8)}_{w(9)}_{w(4)}.{w(2)}", lambda: f"{w(1)}{d(5)}", lambda: w(14).upper(), lambda: f"{d(3)},{d(3)}.{d(2)}", lambda: f"token {w(9)}", lambda: f"secret: {w(5)}",
    ][rng.integers(15)]()


def samples(texts: list[str], count: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """(window of a text, its secrets in code points): one third plain, one third with secrets, one third with look-alikes."""
    rng, out = np.random.default_rng(seed), []
    bags = [w for w in (t.split(" ") for t in texts) if w]
    for k in range(count if bags else 0):
        bag = bags[rng.integers(len(bags))]
        at = int(rng.integers(len(bag)))
        words = bag[at : at + int(rng.integers(8, 30))]
        cut = int(rng.integers(len(words) + 1))
        left, right = " ".join(words[:cut]), " ".join(words[cut:])
        before, secret, after = ("", "", "") if k % 3 == 0 else _planted(rng) if k % 3 == 1 else (_decoy(rng), "", "")
        head = left + (" " if left else "") + before
        text = head + secret + after + (" " if right else "") + right
        marks = [(v, e) for _, _, e, v in base_spans(text)]
        if secret and not any(s < len(head) + len(secret) and e > len(head) for s, e in marks):
            marks.append((len(head), len(head) + len(secret)))
        out.append((text, marks))
    return out


def slice_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def labelled(windows: list[tuple[str, list[tuple[int, int]]]], inner: str, feats) -> list[tuple[list[np.ndarray], np.ndarray]]:
    """Sequences for training: features and labels of each window."""
    if not windows:
        return []
    buf, offs = slice_of([w for w, _ in windows])
    t = crf.Tokens(buf, offs, inner)
    fs = feats(t)
    y = np.zeros(len(t.s), np.int64)
    cut = np.searchsorted(t.doc, np.arange(len(windows) + 1))
    for i, (text, marks) in enumerate(windows):
        pos = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]) + offs[i]
        for s, e in marks:
            inside = np.flatnonzero((t.s[cut[i] : cut[i + 1]] < pos[e]) & (t.e[cut[i] : cut[i + 1]] > pos[s])) + cut[i]
            y[inside] = 2
            y[inside[:1]] = 1
    return [([f[a:b] for f in fs], y[a:b]) for a, b in zip(cut[:-1], cut[1:]) if b > a]


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, windows: int = WINDOWS) -> tuple[list[np.ndarray], np.ndarray]:
    """The field's weights, from at most ``train_docs`` texts chosen by a hash of doc_id. Without texts, made-up words stand in."""
    texts = sample_texts(docs, train_docs)
    return crf.fit(labelled(samples(texts, windows), INNER, features), SIZES)


def sample_texts(docs: DataFrame, count: int) -> list[str]:
    """A stretch of at most 3,000 code points, at a hashed place, of at most ``count`` texts: the same ones whatever the partitions."""
    key = F.xxhash64("doc_id", F.lit(47))
    # The hash thins the rows first, so tasks send few however many they are.
    share = min(1.0, 4 * count / max(docs.count(), 1))
    rows = docs.where((F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30))) & F.col("text").isNotNull() & (F.length("text") > 0))
    place = F.pmod(key, F.greatest(F.lit(1), F.length("text") - 3000)).cast("int") + 1
    picked = rows.select(key.alias("k"), F.substring(F.col("text"), place, F.lit(3000)).alias("text")).orderBy("k", "text").limit(count).collect()
    return [r["text"] for r in picked] or ["lorem ipsum dolor sit amet consectetur adipiscing elit"]


def suspects(buf: np.ndarray, t: crf.Tokens) -> set[int]:
    """Texts of a slice in which a base pattern can match."""
    low, out = tk.lower(buf).tobytes(), set(t.doc[t.n >= 32].tolist())
    for body, words in ((low, WORDS), (buf.tobytes(), (b"AKIA",))):
        for w in words:
            at = body.find(w)
            while at >= 0:
                i = int(np.searchsorted(t.offs, at, "right")) - 1
                out.add(i)
                at = body.find(w, int(t.offs[i + 1]))
    return out


def extra_spans(t: crf.Tokens, y: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """(start, end) in code points of each labelled stretch, by text."""
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(*crf.spans(y, t.doc)):
        i = int(t.doc[a])
        lo = int(t.offs[i])
        chars = lambda at: int(((t.buf[lo:at] & 0xC0) != 0x80).sum())  # noqa: E731, B023
        s = chars(int(t.s[a]))
        out.setdefault(i, []).append((s, s + len(t.buf[t.s[a] : t.e[b]].tobytes().decode("utf-8", "replace"))))
    return out


def find(buf: np.ndarray, offs: np.ndarray, model) -> dict[int, list[tuple[int, int, int, int]]]:
    """All spans by text number, as ``base_spans`` gives them; the field's own are of kind 3 and overlap no base span."""
    t = crf.Tokens(buf, offs, INNER)
    base = {i: base_spans(buf[offs[i] : offs[i + 1]].tobytes().decode()) for i in suspects(buf, t)}
    W, T = model
    y = crf.decode(crf.emissions(features(t), W), T, t.doc) if len(t.s) else np.zeros(0, np.int64)
    out = {i: list(b) for i, b in base.items() if b}
    for i, more in extra_spans(t, y).items():
        taken = base.get(i, [])
        out.setdefault(i, []).extend((s, 3, e, s) for s, e in more if not any(s < x[2] and e > x[0] for x in taken))
    return {i: sorted(v) for i, v in out.items() if v}


def joined(found, kinds) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e, *_ in found)


def scan(docs: DataFrame, model=None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row's whole text.

    Null or empty text: no spans. Empty table: no rows. A repeated doc_id: a row each.
    Other columns are ignored.
    """
    model = model or train(docs)
    kinds = (*KINDS, "crf")

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column("text")):
                found = find(buf, offs, model)
                n = [[0] * (hi - lo) for _ in KINDS]
                digest, text = [hashlib.sha256(b"").hexdigest()] * (hi - lo), [""] * (hi - lo)
                for i, v in found.items():
                    own = [x for x in v if x[1] < 3]
                    for x in own:
                        n[x[1]][i] += 1
                    digest[i], text[i] = hashlib.sha256(joined(own, kinds).encode()).hexdigest(), joined(v, kinds)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in n), pa.array(digest, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, model=None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret's value replaced in ``text``; ``n_chars``, if there, follows. Other columns stay; null texts stay null."""
    model = model or train(docs)
    names = docs.columns

    def run(batches):
        for b in batches:
            at = names.index("text")
            for lo, hi, buf, offs in tk.slices(b.column("text")):
                cols = [c.slice(lo, hi - lo) for c in b.columns]
                found = find(buf, offs, model)
                if found:
                    texts = cols[at].to_pylist()
                    size = cols[names.index("n_chars")].to_pylist() if "n_chars" in names else None
                    for i, v in found.items():
                        parts, done, old = [], 0, texts[i]
                        for s, e in sorted((x[3], x[2]) for x in v):
                            if e > done:
                                parts += [old[done : max(s, done)], mark if s >= done else ""]
                                done = e
                        texts[i] = "".join(parts) + old[done:]
                        if size:
                            size[i] = len(texts[i])
                    cols[at] = pa.array(texts, cols[at].type)
                    if size:
                        cols[names.index("n_chars")] = pa.array(size, cols[names.index("n_chars")].type)
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
