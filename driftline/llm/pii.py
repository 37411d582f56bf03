"""Personal data: fixed patterns, and a skip-chain conditional random field for what they miss.

Tokens are nodes with labels outside, begin, inside, joined in a chain. Tokens of a document that
are the same once case and punctuation are dropped (555-123-4567, 5551234567) share a hub, however
far apart and however many: each has an edge to it whose potential favours one label for both, so all
mentions count for each and none is weaker for being the tenth. Hubs are made of tokens with
digits and of capitalised words. Beliefs come from loopy message passing with damping.
Tokens that the chain leaves open, or that share a hub with an open one, take part; where outside leads
whatever labels the neighbours may have, a token is observed as outside. Edges grow with tokens, not with pairs.
"""

from __future__ import annotations

import hashlib
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import crf
from . import textkit as tk
from .secrets import extra_spans, joined, labelled, sample_texts, slice_of

# The base patterns, in the order in which kinds are listed.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
INNER = "._%+-"

TRAIN_DOCS, WINDOWS = 300, 2500
ROUNDS, DAMPING = 12, 0.5
STRENGTHS, BIASES = (0.5, 1.0, 2.0, 4.0, 6.0), (0.0, 1.0, 2.0)
# Characters of a token that may share a hub, at least: with a digit, and capitalised.
LEAST = (4, 3)
SIZES = [1024, 1024, 1024, crf.BUCKETS, crf.BUCKETS, crf.BUCKETS, crf.BUCKETS, crf.BUCKETS]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of each base match, by kind, then start. Positions are code points."""
    out = [(0, *m.span()) for m in EMAIL.finditer(text)] if "@" in text else []
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return out


def features(t: crf.Tokens) -> list[np.ndarray]:
    shape = t.shape()
    word = np.where((t.n < 16) & (t.digits == 0), (t.h >> np.uint64(52)).astype(np.int64), 0)
    return [shape, t.shifted(shape, -1, 1023), t.shifted(shape, 1, 1023), t.pattern(), word, t.shifted(word, -1, 1), t.shifted(word, -2, 1), t.shifted(word, 1, 1)]


def _name(rng: np.random.Generator) -> str:
    part = lambda: "".join(rng.choice("b br c d f g h j k l m n p r s st t tr v w".split()) + rng.choice("a e i o u ai ea ou".split()) for _ in range(rng.integers(1, 4))) + rng.choice(["", "n", "r", "s", "l", "th"])
    return part().capitalize()


def _made_up(rng: np.random.Generator) -> tuple[str, str, str]:
    """(before, personal datum, after) of kinds that the fixed patterns don't know."""
    d = lambda k: "".join(rng.choice(list(string.digits), k))
    up = lambda k: "".join(rng.choice(list(string.ascii_uppercase), k))
    sep = rng.choice([": ", " ", " is ", " no. ", " = "])
    day, month, year = f"{rng.integers(1, 29):02d}", int(rng.integers(1, 13)), f"{rng.integers(1930, 2010)}"
    word = "January February March April May June July August September October November December".split()[month - 1]
    return [
        lambda: (f"{rng.choice(['SSN', 'ssn', 'social security number', 'tax number'])}{sep}", f"{d(3)}-{d(2)}-{d(4)}", ""),
        lambda: (f"{rng.choice(['IBAN', 'iban', 'account', 'bank account'])}{sep}", f"{rng.choice(['DE', 'FR', 'ES', 'GB', 'NL'])}{d(20)}" if rng.random() < 0.5 else f"{up(2)}{d(2)} {d(4)} {d(4)} {d(4)}", ""),
        lambda: (f"{rng.choice(['phone', 'tel', 'call', 'mobile', 'fax', 'phone number'])}{sep}", rng.choice([f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(6)}", f"0{d(9)}"]), ""),
        lambda: (f"{rng.choice(['passport', 'Passport', 'licence', 'ID', 'id', 'member', 'patient', 'badge'])}{sep}", rng.choice([f"{up(1)}{d(8)}", f"{up(2)}{d(6)}", f"{up(2)}-{d(4)}-{d(3)}", f"{up(1)}{d(4)}-{d(5)}", f"{d(4)}-{up(2)}-{d(4)}"]), ""),
        lambda: (f"{rng.choice(['born', 'born on', 'DOB', 'dob', 'date of birth', 'birthday'])}{rng.choice([': ', ' ', ' is '])}", rng.choice([f"{year}-{month:02d}-{day}", f"{day}/{month:02d}/{year}", f"{day}.{month:02d}.{year}", f"{day} {word} {year}", f"{word} {day}"]), ""),
        lambda: (f"{rng.choice(['address', 'lives at', 'living at', 'ship to', 'home address'])}{rng.choice([': ', ' '])}", f"{rng.integers(1, 400)} {_name(rng)} {rng.choice(['Street', 'Road', 'Avenue', 'Lane', 'St', 'Ave', 'Drive', 'Square'])}", ""),
        lambda: (f"{rng.choice(['Mr.', 'Mrs.', 'Ms.', 'Dr.', 'Mr', 'Mrs', 'Dr', 'Dear', 'name:', 'my name is', 'patient:', 'customer:', 'contact:', 'signed by'])} ", f"{_name(rng)} {_name(rng)}" if rng.random() < 0.7 else _name(rng), rng.choice(["", ","])),
    ][rng.integers(7)]()


def _decoy(rng: np.random.Generator) -> str:
    d = lambda k: "".join(rng.choice(list(string.digits), k))
    w = lambda k: "".join(rng.choice(list(string.ascii_lowercase), k))
    return [
        lambda: d(int(rng.integers(1, 9))), lambda: d(int(rng.integers(9, 20))), lambda: f"{rng.choice(['card', 'number', 'order'])} {d(16)}", lambda: f"20{d(2)}-0{rng.integers(1, 9)}-1{d(1)}", lambda: f"{d(1)}.{d(2)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: w(7).capitalize(), lambda: f"{w(5)}-{w(4)}", lambda: w(8).upper() + "!!",
        lambda: f"{w(6)}***", lambda: f"password={d(3)}{w(9)}{d(4)}", lambda: "".join(rng.choice(list("0123456789abcdef"), 32)), lambda: "AKIA" + "".join(rng.choice(list(string.ascii_uppercase + string.digits), 16)), lambda: f"https://{w(6)}.example.com/{d(4)}", lambda: f"{d(4)}-{d(4)}",
        lambda: f". {_name(rng)}", lambda: f"the {_name(rng)} {w(5)}", lambda: f"on 1{d(1)} {rng.choice(['May', 'June', 'March'])} 20{d(2)}", lambda: f"chapter {d(2)} {_name(rng)}", lambda: f"{d(2)} km of {w(6)}", lambda: f"in {_name(rng)} {w(4)}", lambda: f"{_name(rng)} {_name(rng)}",
    ][rng.integers(22)]()


def _again(datum: str, rng: np.random.Generator) -> str:
    """The datum as it comes back: as it is, in other case, or with other punctuation."""
    if " " in datum or not any(c.isdigit() for c in datum):
        return datum
    return [lambda: datum, lambda: datum.lower(), lambda: datum.replace("-", ""), lambda: datum.replace("-", ".")][rng.integers(4)]()


def samples(texts: list[str], count: int, seed: int = 13, made=_made_up) -> list[tuple[str, list[tuple[int, int]]]]:
    """(window of a text, its personal data in code points). Half of those with a datum have it again, up to six times, without what stands before."""
    rng, out = np.random.default_rng(seed), []
    bags = [t.split(" ") for t in texts]
    for k in range(count if bags else 0):
        bag = bags[rng.integers(len(bags))]
        at = int(rng.integers(len(bag)))
        words = bag[at : at + int(rng.integers(10, 30))]
        before, datum, after = ("", "", "") if k % 3 == 0 else made(rng) if k % 3 == 1 else (_decoy(rng), "", "")
        places = sorted(rng.integers(0, len(words) + 1, 1 + (int(rng.integers(1, 7)) if datum and rng.random() < 0.5 else 0)).tolist())
        text, marks, last = "", [], 0
        for j, cut in enumerate(places):
            value = _again(datum, rng) if j and datum else datum
            text += " ".join(words[last:cut]) + " " + (before if j == 0 else "")
            if value:
                marks.append((len(text), len(text) + len(value)))
            text += value + (after if j == 0 else "") + " "
            last = cut
        text += " ".join(words[last:])
        marks += [(s, e) for _, s, e in base_spans(text) if not any(s < y and e > x for x, y in marks)]
        out.append((text, marks))
    return out


def forms(t: crf.Tokens) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each token's letters and digits (of its text, in lower case), and whether it may share a hub."""
    buf = t.buf
    bare = ((buf >= 48) & (buf <= 57)) | ((buf >= 65) & (buf <= 90)) | ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    at = np.concatenate([[0], np.cumsum(bare)])
    s, e = at[t.s], at[t.e]
    key = tk.hashes(tk.lower(buf[bare]), s, e) ^ tk.fmix(t.doc.astype(np.uint64) + np.uint64(1))
    lead = buf[t.s]
    capital = (t.digits == 0) & (lead >= 65) & (lead <= 90) & (t.upper == 1) & (e - s > LEAST[1] - 1)
    return key, ((t.digits > 0) & (e - s >= LEAST[0])) | capital


def graph(t: crf.Tokens, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (tokens), chain edges between nodes, and edges of (node, hub), as positions among the nodes; hubs are numbered on from these."""
    key, worth = forms(t)
    again = worth & np.isin(key, key[opened & worth])
    node = np.flatnonzero(opened | again)
    step = np.flatnonzero((np.diff(node) == 1) & (np.diff(t.doc[node]) == 0))
    some = np.flatnonzero(worth[node])
    _, hub, count = np.unique(key[node[some]], return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    many = count[hub] > 1
    return node, np.stack([step, step + 1]), np.stack([some[many], len(node) + number[hub[many]]])


def infer(t: crf.Tokens, E: np.ndarray, T: np.ndarray, skip: tuple[float, float], rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels of all tokens; the nodes, and their beliefs. ``skip``: strength of an edge to a hub, and a hub's own lean to personal data."""
    y = np.zeros(len(E), np.int64)
    node, chain, spoke = graph(t, crf.open_tokens(E, T, t.doc)) if len(E) else (y, np.zeros((2, 0), int), np.zeros((2, 0), int))
    if not len(node):
        return y, node, np.zeros((0, crf.LABELS))
    hubs = int(spoke[1].max()) + 1 - len(node) if spoke.size else 0
    local = np.zeros((len(node) + hubs, crf.LABELS))
    local[: len(node)] = E[node]
    local[len(node) :, 1:] = skip[1]
    prev, nxt = node - 1, np.minimum(node + 1, len(E) - 1)
    is_node = np.zeros(len(E), bool)
    is_node[node] = True
    left = (prev >= 0) & (t.doc[np.maximum(prev, 0)] == t.doc[node]) & ~is_node[np.maximum(prev, 0)]
    right = (node + 1 < len(E)) & (t.doc[nxt] == t.doc[node]) & ~is_node[nxt]
    local[: len(node)][left] += T[0]
    local[: len(node)][right] += T[:, 0]
    agree = skip[0] * (np.eye(crf.LABELS) + 0.5 * np.array([[0, 0, 0], [0, 0, 1], [0, 1, 0]]))
    src = np.concatenate([chain[0], chain[1], spoke[0], spoke[1]])
    dst = np.concatenate([chain[1], chain[0], spoke[1], spoke[0]])
    a, s = chain.shape[1], spoke.shape[1]
    back = np.concatenate([np.arange(a, 2 * a), np.arange(a), np.arange(2 * a + s, 2 * a + 2 * s), np.arange(2 * a, 2 * a + s)])
    local, msg = np.ascontiguousarray(local.T), np.zeros((crf.LABELS, len(src)))  # labels first: sums over them are sums of rows
    gathered = lambda: local + np.stack([np.bincount(dst, m, local.shape[1]) for m in msg])
    kinds = [(slice(0, a), T), (slice(a, 2 * a), T.T), (slice(2 * a, None), agree)]
    for _ in range(rounds if len(src) else 0):
        v, new = gathered()[:, src] - msg[:, back], np.empty_like(msg)
        for part, pot in kinds:
            for k in range(crf.LABELS):
                x = v[:, part] + pot[:, k, None]
                top = np.maximum(np.maximum(x[0], x[1]), x[2])
                new[k, part] = top + np.log(np.exp(x[0] - top) + np.exp(x[1] - top) + np.exp(x[2] - top))
        msg = DAMPING * msg + (1 - DAMPING) * (new - np.maximum(np.maximum(new[0], new[1]), new[2]))
    total = gathered()[:, : len(node)].T
    belief = np.exp(total - total.max(1, keepdims=True))
    belief /= belief.sum(1, keepdims=True)
    y[node] = belief.argmax(1)
    return y, node, belief


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, windows: int = WINDOWS):
    """(weights, transitions, (strength, bias)): the chain by its likelihood, then the hubs' two numbers by the beliefs in the right labels of other windows."""
    texts = sample_texts(docs, train_docs)
    W, T = crf.fit(labelled(samples(texts, windows), INNER, features), SIZES)
    held = samples(texts, windows // 4, seed=29)
    seqs = labelled(held, INNER, features)
    buf, offs = slice_of([w for w, _ in held])
    t = crf.Tokens(buf, offs, INNER)
    truth = np.concatenate([y for _, y in seqs])
    E = crf.emissions(features(t), W)

    def loss(skip: tuple[float, float]) -> float:
        _, node, belief = infer(t, E, T, skip)
        return float(-np.log(np.maximum(belief[np.arange(len(node)), truth[node]], 1e-9)).sum()) if len(node) else 0.0

    return W, T, min(((s, b) for s in STRENGTHS for b in BIASES), key=loss)


def find(buf: np.ndarray, offs: np.ndarray, model) -> dict[int, list[tuple[int, int, int]]]:
    """All spans by text number as (kind, start, end), by kind, then start; the field's own are of kind 4 and overlap no base span."""
    t = crf.Tokens(buf, offs, INNER)
    digits = np.unique(t.doc[t.digits > 0])
    at = np.searchsorted(offs, np.flatnonzero(buf == 64), "right") - 1
    base = {int(i): base_spans(buf[offs[i] : offs[i + 1]].tobytes().decode()) for i in np.union1d(digits, at)}
    W, T, skip = model
    y, _, _ = infer(t, crf.emissions(features(t), W), T, skip) if len(t.s) else (np.zeros(0, np.int64), None, None)
    out = {i: list(b) for i, b in base.items() if b}
    for i, more in extra_spans(t, y).items():
        taken = base.get(i, [])
        out.setdefault(i, []).extend((4, s, e) for s, e in more if not any(s < x[2] and e > x[1] for x in taken))
    return {i: sorted(v) for i, v in out.items() if v}


def scan(docs: DataFrame, model=None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row's whole text.

    Null or empty text: no spans. Empty table: no rows. A repeated doc_id: a row each.
    Other columns are ignored.
    """
    model = model or train(docs)
    kinds = (*KINDS, "crf")
    counts = [f"n_{k}" for k in KINDS]

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column("text")):
                n = [[0] * (hi - lo) for _ in KINDS]
                digest, text = [hashlib.sha256(b"").hexdigest()] * (hi - lo), [""] * (hi - lo)
                for i, v in find(buf, offs, model).items():
                    own = [(s, k, e) for k, s, e in v if k < 4]
                    for x in own:
                        n[x[1]][i] += 1
                    digest[i] = hashlib.sha256(joined(own, kinds).encode()).hexdigest()
                    text[i] = joined([(s, k, e) for k, s, e in v], kinds)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in n), pa.array(digest, pa.string()), pa.array(text, pa.string())], ["doc_id", *counts, "base_sha256", "spans"])

    schema = ", ".join(f"{c} long" for c in counts)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}, base_sha256 string, spans string")
