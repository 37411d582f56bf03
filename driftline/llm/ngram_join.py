"""N-gram Jaccard self-join by prefix trees: near-duplicate components of documents.

A document is the set of its distinct word shingles. Documents link at Jaccard similarity
0.75 or more. Sets are counted and classed by 60-bit hashes of shingles, and overlaps within a
tree by 44 bits of them; all is exact but for collisions of these.

1. ``sketch`` reads every text: each document's set size and class (equal sets are one class, so
   copies cost one row each). ``frequent`` counts in how many classes each shingle is, and
   keeps those in more than ``ALL_PAIRS``, at most ``HOT`` of them.
2. The global order of shingles is rare before frequent (bands of those counts), then by hash.
   It is the high bits of a shingle's key, so keys sort in that order. A passage that many
   documents share comes last, so it makes no candidates unless a document is little else.
3. ``postings`` sends the first n - ceil(0.75 n) + 1 keys of each class, packed, to buckets by key.
   Two sets that link share one of them. ``candidates`` pairs the members of a key's group under
   bounds by size and position; groups beyond ``ALL_PAIRS`` only pair with two pivots.
4. ``Tree`` stores ordered sets in a trie. ``verify`` walks the trie of a pivot's partners with the pivot.
   Overlaps so far are shared along paths, and a subtree is left as a whole, its members unseen, when
   the overlap so far and the remaining lengths can't reach the bound for any size in it.
5. What is then left are large groups that span several components. ``crossing`` stores each of their
   members once, in the trie of one shard, and sends each member outside its group's main component
   once to each shard in question; the walk finds its partners. No pairs are made: a task returns only
   links that join components, so fewer rows than it has members, and no link between components is lost.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .store import stored

WORDS = 5
ALL_PAIRS = 8
BUCKET_ROWS = 1 << 20
# Frequent shingles that order the rest, at most: 9 bytes each for every task. More, and only the most frequent count.
HOT = 2_000_000
# A key's group beyond this many rows is dealt to several buckets; their components meet in ``crossing``.
SPLIT = 250_000
# Rows of (a, group, b, doc_id) that may be broadcast to the texts; more come in so many scans of the texts at most, beyond that by a shuffle of the texts.
BROADCAST_ROWS, SCANS = 1_000_000, 16
# Partners of a pivot in one task, about.
GROUP = 64
# Keys of the sets in one tree, and of the sets that walk it in one task, about.
SHARD_KEYS = 1 << 18
# Keys between two looks at the bound on a path, and keys that one step of a walk compares.
RUN, STEP = 128, 1 << 20
# Bytes of a key that two sets are compared by: 44 bits of hash, ample within a pair.
KEY_BYTES = 6
POSTING = np.dtype([("t", "<u8"), ("c", "<i8"), ("n", "<u4"), ("p", "<u4")])
U = np.uint64


def sets(buf: np.ndarray, offs: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text in ascending order, end to end, and their cuts.

    With fewer than k words, the whole sequence is the one shingle; without words, none.
    """
    n = len(offs) - 1
    s, e, doc = tk.words(buf, offs)
    h = tk.hashes(tk.lower(buf), s, e)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    win = tk.combine(h, k)
    head = np.flatnonzero(doc[: len(win)] == doc[k - 1 :]) if len(win) else np.zeros(0, np.int64)
    win, of = win[head], doc[head]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        own = np.array([tk.combine(h[first[i] : first[i + 1]], int(count[i]))[0] for i in short], U)
        of = np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        win, of = np.concatenate([win, own])[order], of[order]
    cut = np.searchsorted(of, np.arange(n + 1))
    for i in range(n):
        win[cut[i] : cut[i + 1]].sort()
    fresh = np.ones(len(win), bool)
    fresh[1:] = (win[1:] != win[:-1]) | (of[1:] != of[:-1])
    return win[fresh], np.searchsorted(of[fresh], np.arange(n + 1))


def classes(vals: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever its order; 0 for an empty set."""
    run = np.concatenate([np.zeros(1, U), np.cumsum(tk.fmix(vals + tk.K1), dtype=U)])
    n = np.diff(cut).astype(U)
    return np.where(n > 0, tk.fmix((run[cut[1:]] - run[cut[:-1]]) ^ (n * tk.K2)), U(0)).view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, n) of every row."""

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column("text")):
                vals, cut = sets(buf, offs)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(classes(vals, cut)), pa.array(np.diff(cut).astype(np.int64))], ["doc_id", "cls", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, cls long, n long")


def _fresh(cls: np.ndarray, n: np.ndarray, done: set) -> np.ndarray:
    """Non-empty sets whose class this task has not met."""
    ok = n > 0
    for i, c in enumerate(cls.tolist()):
        ok[i] &= c not in done
        done.add(c)
    return ok


def _dealt(v: np.ndarray, to: np.ndarray, size: int) -> pa.RecordBatch:
    """(bucket, blob): the items of v, ``size`` bytes each, packed by bucket."""
    order = np.argsort(to, kind="stable")
    ids, at = np.unique(to[order], return_index=True)
    raw = v[order].view(np.uint8).reshape(len(v), -1)[:, :size]
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array([raw[x:y].tobytes() for x, y in zip(at, [*at[1:], len(v)])], pa.binary())], ["bucket", "blob"])


def _counted(v: np.ndarray, buckets: int) -> pa.RecordBatch:
    """(bucket, ones, many): 5-byte values that are in ``v`` once, and values with 4-byte counts that repeat in it."""
    v, df = np.unique(v, return_counts=True)
    wide = np.zeros((len(v), 9), np.uint8)
    wide[:, :5] = v.view(np.uint8).reshape(-1, 8)[:, :5]
    wide[:, 5:] = df.astype("<u4").view(np.uint8).reshape(-1, 4)
    to = (v % U(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    ids, at = np.unique(to[order], return_index=True)
    ones, many = [], []
    for x, y in zip(at, [*at[1:], len(v)]):
        i = order[x:y]
        ones.append(wide[i[df[i] == 1], :5].tobytes())
        many.append(wide[i[df[i] > 1]].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ones, pa.binary()), pa.array(many, pa.binary())], ["bucket", "ones", "many"])


def frequent(docs: DataFrame, buckets: int) -> DataFrame:
    """(v, df): 40-bit prefixes of the shingle hashes that are in more than ``ALL_PAIRS`` classes (a class counts once a task).

    Tasks count before they send, so a shingle of all texts is a row of each task's lots, not of each text.
    """

    def deal(batches):
        done, held, size = set(), [], 0
        for b in batches:
            for _, _, buf, offs in tk.slices(b.column("text")):
                vals, cut = sets(buf, offs)
                n = np.diff(cut)
                ok = np.repeat(_fresh(classes(vals, cut), n, done), n)
                held.append(vals[ok] >> U(24))
                size += len(held[-1])
                if size > 1_000_000:
                    yield _counted(np.concatenate(held), buckets)
                    held, size = [], 0
        if size:
            yield _counted(np.concatenate(held), buckets)

    def count(table: pa.Table) -> pa.Table:
        ones = np.frombuffer(b"".join(table.column("ones").to_pylist()), np.uint8).reshape(-1, 5)
        many = np.frombuffer(b"".join(table.column("many").to_pylist()), np.uint8).reshape(-1, 9)
        wide = np.zeros((len(ones) + len(many), 8), np.uint8)
        wide[:, :5] = np.concatenate([ones, many[:, :5]])
        v, times = wide.view("<u8").ravel(), np.concatenate([np.ones(len(ones), np.int64), np.ascontiguousarray(many[:, 5:]).view("<u4").ravel().astype(np.int64)])
        order = np.argsort(v, kind="stable")
        v, times = v[order], times[order]
        head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        df = np.add.reduceat(times, head) if len(v) else times
        some = df > ALL_PAIRS
        return pa.table({"v": v[head[some]].astype(np.int64), "df": df[some]})

    return docs.select("text").mapInArrow(deal, "bucket long, ones binary, many binary").groupBy("bucket").applyInArrow(count, "v long, df long")


def _packed(batches):
    """The columns of a batch, eight bytes a value, as one row: a row for each value takes the driver about a kilobyte."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in b.columns], b.schema.names)


class Order:
    """Bands of the frequent shingles: 0 for all others, then one more for each fourfold count."""

    def __init__(self, found: DataFrame):
        least = ALL_PAIRS + 1
        if found.count() > HOT:
            kept, least = 0, 1 << 62
            for r in found.groupBy(F.floor(F.log2("df")).alias("e")).count().orderBy(F.desc("e")).collect():
                kept += r["count"]
                if kept > HOT:
                    break
                least = 1 << int(r["e"])
        rows = found.where(F.col("df") >= least).select("v", "df").mapInArrow(_packed, "v binary, df binary").collect()
        v, df = (np.frombuffer(b"".join(r[c] for r in rows), np.int64) for c in ("v", "df"))
        order = np.argsort(v)
        self.v, df = v[order].astype(U), df[order].astype(float)
        self.band = np.clip(1 + np.floor(np.log(np.maximum(df, ALL_PAIRS) / ALL_PAIRS) / np.log(4)), 1, 15).astype(np.uint8)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.v & U((1 << 22) - 1)).astype(np.int64)] = True

    def of(self, vals: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vals), np.uint8)
        if len(self.v):
            v = vals >> U(24)
            at = np.flatnonzero(self.maybe[(v & U((1 << 22) - 1)).astype(np.int64)])
            where = np.minimum(np.searchsorted(self.v, v[at]), len(self.v) - 1)
            same = self.v[where] == v[at]
            out[at[same]] = self.band[where[same]]
        return out


def keys(vals: np.ndarray, cut: np.ndarray, order: Order) -> np.ndarray:
    """Keys in the global order within each set."""
    b = order.of(vals)
    out = (b.astype(U) << U(60)) | (vals >> U(4))
    if b.any():
        high = np.concatenate([[0], np.cumsum(b > 0)])
        for i in np.flatnonzero(high[cut[1:]] > high[cut[:-1]]):
            out[cut[i] : cut[i + 1]].sort()
    return out


def parts_of(t: np.ndarray) -> np.ndarray:
    """Into how many buckets a key's group is dealt, by its band."""
    return np.maximum(1, (4.0 ** (t >> U(60)).astype(np.float64) * ALL_PAIRS / SPLIT).astype(np.int64))


def postings(docs: DataFrame, order, buckets: int) -> DataFrame:
    """(bucket, blob): packed prefix postings. Copies within a task post once."""

    def run(batches):
        done, held, size = set(), [], 0

        def flush():
            a = np.concatenate(held)
            salt = a["c"].view(U) % parts_of(a["t"]).astype(U)
            return _dealt(a, (tk.fmix(a["t"] + salt * tk.K1) % U(buckets)).astype(np.int64), POSTING.itemsize)

        for b in batches:
            for _, _, buf, offs in tk.slices(b.column("text")):
                vals, cut = sets(buf, offs)
                cls, key, n = classes(vals, cut), keys(vals, cut, order.value), np.diff(cut)
                take = np.where(_fresh(cls, n, done), n - -(-3 * n // 4) + 1, 0)
                m = int(take.sum())
                a = np.empty(m, POSTING)
                pos = np.arange(m) - np.repeat(np.cumsum(take) - take, take)
                a["t"], a["c"], a["n"], a["p"] = key[np.repeat(cut[:-1], take) + pos], np.repeat(cls, take), np.repeat(n, take), pos
                held.append(a)
                size += m
                if size > 500_000:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(run, "bucket long, blob binary")


def may_link(x: np.ndarray, y: np.ndarray, index: bool = True) -> np.ndarray:
    """Whether two postings of one key may belong to sets that link; x is the smaller set."""
    nx, ny, px, py = (v.astype(np.int64) for v in (x["n"], y["n"], x["p"], y["p"]))
    ok = (4 * nx >= 3 * ny) & (np.minimum(px, py) + 1 + np.minimum(nx - px - 1, ny - py - 1) >= -(-3 * (nx + ny) // 7))
    return ok & (px < nx - -(-6 * nx // 7) + 1) if index else ok


def _unpack(table: pa.Table) -> np.ndarray:
    """Postings by key, size and class, each once."""
    a = np.frombuffer(b"".join(table.column("blob").to_pylist()), POSTING)
    a = a[np.lexsort((a["c"], a["n"], a["t"]))]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a["t"][1:] != a["t"][:-1]) | (a["c"][1:] != a["c"][:-1])
    return a[fresh]


def _pairs(a: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    got = np.empty(len(i), [("a", "<i8"), ("b", "<i8")])
    got["a"], got["b"] = np.minimum(a["c"][i], a["c"][j]), np.maximum(a["c"][i], a["c"][j])
    return got


FOUND = "kind int, t long, a long, b long, n int, p int"


def candidates(posted: DataFrame) -> DataFrame:
    """Rows of kind 0: a candidate pair (a, b) of classes; of kind 2: one with a large group's pivot; of kind 1: a posting (t, a, n, p) of such a group."""

    def run(table: pa.Table) -> pa.Table:
        a = _unpack(table)
        head = np.flatnonzero(np.concatenate([[True], a["t"][1:] != a["t"][:-1]]))
        size = np.diff(np.append(head, len(a)))
        start, k = np.repeat(head, size), np.repeat(size, size)
        at = np.arange(len(a))
        got = []
        for d in range(1, ALL_PAIRS):
            i = at[(k <= ALL_PAIRS) & (at + d < start + k)]
            i = i[may_link(a[i], a[i + d])]
            got.append(_pairs(a, i, i + d))
        small, got = np.unique(np.concatenate(got)), []
        large = k > ALL_PAIRS
        for pivot in (start, start + k // 2):
            i = at[large & (at != pivot)]
            x, y = np.minimum(i, pivot[i]), np.maximum(i, pivot[i])
            ok = may_link(a[x], a[y], False)
            got.append(_pairs(a, x[ok], y[ok]))
        star = np.unique(np.concatenate(got))
        pairs = np.concatenate([small, star])
        left = a[large | (parts_of(a["t"]) > 1)]
        m, r = len(pairs), len(left)
        zero = np.zeros(m, np.int32)
        return pa.table({
            "kind": np.concatenate([zero[: len(small)], zero[len(small) :] + 2, np.ones(r, np.int32)]), "t": np.concatenate([np.zeros(m, np.int64), left["t"].view(np.int64) if r else np.zeros(0, np.int64)]), "a": np.concatenate([pairs["a"], left["c"]]),
            "b": np.concatenate([pairs["b"], np.zeros(r, np.int64)]), "n": np.concatenate([zero, left["n"].astype(np.int32)]), "p": np.concatenate([zero, left["p"].astype(np.int32)]),
        })

    return posted.groupBy("bucket").applyInArrow(run, FOUND)


class Tree:
    """A trie of ordered sets with runs of keys as nodes; a node knows the least and greatest size below it, and the component if all below is of one.

    A leaf is one set; ``mark`` is a set's component (or any label that is not to be joined with itself).
    """

    def __init__(self, found: list[np.ndarray], mark: np.ndarray):
        order = sorted(range(len(found)), key=lambda i: found[i].byteswap().tobytes())
        self.of, found = np.array(order, np.int64), [found[i] for i in order]
        self.size, self.mark = np.array([len(x) for x in found], np.int64), np.asarray(mark)[self.of]
        first = np.concatenate([[0], np.cumsum(self.size)])
        flat = np.concatenate(found) if found else np.zeros(0, U)
        self.vocab, self.ids = np.unique(flat, return_inverse=True)
        common = np.zeros(len(found) + 1, np.int64)
        for i in range(1, len(found)):
            m = min(self.size[i - 1], self.size[i])
            differ = found[i - 1][:m] != found[i][:m]
            common[i] = int(differ.argmax()) if differ.any() else m
        # A node: sets lo .. hi agree on their first ``depth`` keys, of which its own run starts at ``top``.
        rows, ahead = [], [(0, len(found), 0)] if found else []
        kids = []
        at = 0
        while at < len(ahead):
            lo, hi, top = ahead[at]
            at += 1
            full = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(self.size[lo])
            depth = min(full, top + RUN)
            rows.append((lo, hi, top, depth))
            if depth < full:
                parts = [(lo, hi, depth)]
            elif hi - lo > 1:
                edge = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == full)).tolist(), hi]
                parts = [(x, y, depth) for x, y in zip(edge, edge[1:])]
            else:
                parts = []
            kids.append((len(ahead), len(parts)))
            ahead += parts
        lo, hi, top, self.depth = np.array(rows, np.int64).reshape(-1, 4).T
        self.kid, self.kids = np.array(kids, np.int64).reshape(-1, 2).T
        self.start, self.run = first[lo] + top, self.depth - top
        self.leaf = np.where(self.kids == 0, lo, -1)
        cut = np.stack([lo, hi], 1).ravel()
        pick = lambda f, v: f.reduceat(np.append(v, v[-1:]), cut)[::2] if len(v) else v
        self.least, self.most = pick(np.minimum, self.size), pick(np.maximum, self.size)
        low, high = pick(np.minimum, self.mark), pick(np.maximum, self.mark)
        self.whole, self.one = low == high, low

    def walk(self, probes: list[np.ndarray], mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, set): all links of probes with sets of other marks."""
        got, lot, width = [], max(1, (1 << 25) // max(1, len(self.vocab))), len(self.vocab)
        for at in range(0, len(probes) if width else 0, lot):
            got += self._walk(probes[at : at + lot], np.asarray(mark[at : at + lot]), at)
        pr, st = np.concatenate(got, 1) if got else np.zeros((2, 0), np.int64)
        return pr, self.of[st]

    def _walk(self, probes, mark, base):
        width = len(self.vocab)
        nx = np.array([len(x) for x in probes], np.int64)
        of, flat = np.repeat(np.arange(len(probes)), nx), np.concatenate(probes)
        where = np.searchsorted(self.vocab, flat)
        here = self.vocab[np.minimum(where, width - 1)] == flat
        has = np.zeros((len(probes), width), bool)
        has[of[here], where[here]] = True
        # Places of a probe's keys among those of the tree: odd for a key of the tree, even for one between two.
        place, begin = of * (2 * width + 2) + 2 * where + here, np.cumsum(nx) - nx
        # Pairs of probe and node to look at, or (``inner``) whose node's children are next; either is cut up until it fits a step.
        todo = [(np.arange(len(probes)), np.zeros(len(probes), np.int64), np.zeros(len(probes), np.int64), False)]
        while todo:
            pr, nd, ov, inner = todo.pop()
            n = (self.kids if inner else self.run)[nd]
            if n.sum() > STEP and len(nd) > 1:
                half = len(nd) // 2
                todo += [(pr[half:], nd[half:], ov[half:], inner), (pr[:half], nd[:half], ov[:half], inner)]
                continue
            if inner:
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                todo.append((np.repeat(pr, n), np.repeat(self.kid[nd], n) + step, np.repeat(ov, n), False))
                continue
            stop = np.cumsum(n)
            key = self.ids[np.repeat(self.start[nd] - stop + n, n) + np.arange(stop[-1])]
            same = np.concatenate([[0], np.cumsum(has[np.repeat(pr, n), key])])
            ov = ov + same[stop] - same[stop - n]
            deep = self.depth[nd]
            last = self.ids[np.maximum(self.start[nd] + n - 1, 0)]
            seen = np.where(deep > 0, np.searchsorted(place, pr * (2 * width + 2) + 2 * last + 1, "right") - begin[pr], 0)
            seen = np.where((n == 0) & (deep > 0), 0, seen)  # an empty run has no last key of its own
            # Sizes y below the node with 7 (ov + min(nx - seen, y - deep)) >= 3 (nx + y).
            low = np.maximum(self.least[nd], -(-(3 * nx[pr] - 7 * (ov - deep)) // 4))
            high = np.minimum(self.most[nd], (7 * (ov + nx[pr] - seen) - 3 * nx[pr]) // 3)
            ok = (low <= high) & ~(self.whole[nd] & (self.one[nd] == mark[pr]))
            pr, nd, ov = pr[ok], nd[ok], ov[ok]
            end = self.kids[nd] == 0
            if end.any():
                yield np.stack([pr[end] + base, self.leaf[nd[end]]])
            pr, nd, ov = pr[~end], nd[~end], ov[~end]
            if len(nd):
                todo.append((pr, nd, ov, True))


def joining(u: np.ndarray, v: np.ndarray, cu: np.ndarray, cv: np.ndarray) -> list[int]:
    """Positions of links (u, v) that join two components (cu, cv) not joined by those before."""
    up: dict[int, int] = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    keep = []
    for i, (x, y) in enumerate(zip(cu.tolist(), cv.tolist())):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(i)
    return keep


def crossing(left: DataFrame, size: int | None = None) -> DataFrame | None:
    """(t, part, q, role, comp, cls): who is to meet in which tree, so that all members of a key's group of (t, a, n, comp) that lie in several components meet; None if there is none.

    Role 0 is stored in the tree, role 1 walks it. A member is stored under the largest of its
    groups, in shards of about ``SHARD_KEYS`` keys. It walks all shards that hold a member of a group in
    which it is outside the component with most members. Of two members in different components
    one is outside, so they meet. Walkers of a shard are dealt to tasks by their keys, too.
    ``size``: the number of rows, if it is known.
    """
    per = left.groupBy("t", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("keys"))
    groups = stored(per.groupBy("t").agg(F.max(F.struct("m", "comp"))["comp"].alias("main"), F.sum("m").alias("size"), F.sum("keys").alias("keys"), F.count("*").alias("r")).where("r > 1").drop("r"), rows=size)
    if not groups.limit(1).count():
        return None
    rows = stored(left.join(groups, "t").select("t", "a", "n", "comp", "main", "size", "keys"), rows=size)
    home = F.max(F.struct("size", "t", "keys")).alias("h")
    stays = rows.groupBy("a").agg(home, F.min("comp").alias("comp"), F.min("n").alias("n"))
    stays = stored(stays.select("a", "comp", "n", F.col("h.t").alias("home"), F.pmod(F.xxhash64("a"), F.ceil(F.col("h.keys") / SHARD_KEYS)).cast("int").alias("part")), rows=size)
    # The shards of each group, an array of a few; then those of each walker, and each once.
    shards = stored(rows.select("t", "a").join(stays.select("a", "home", "part"), "a").groupBy("t").agg(F.array_sort(F.collect_set(F.struct("home", "part"))).alias("shards")), rows=size)
    goes = rows.where("comp <> main").select("t", "a", "n", "comp").join(shards, "t").groupBy("a", "n", "comp").agg(F.array_distinct(F.flatten(F.collect_set("shards"))).alias("shards"))
    goes = stored(goes.select("a", "n", "comp", F.explode("shards").alias("s")).select("a", "n", "comp", "s.home", "s.part"))
    lots = goes.groupBy("home", "part").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / SHARD_KEYS)).cast("int").alias("lots"))
    lots = stored(lots, rows=size)
    tree = stays.join(lots, ["home", "part"]).select("home", "part", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("q"), F.lit(0).alias("role"), "comp", "a")
    walk = goes.join(lots, ["home", "part"]).select("home", "part", F.pmod(F.xxhash64("a"), F.col("lots")).cast("int").alias("q"), F.lit(1).alias("role"), "comp", "a")
    return tree.unionByName(walk).select(F.col("home").alias("t"), "part", "q", "role", "comp", F.col("a").alias("cls"))


def nameless(docs: DataFrame, reps: DataFrame) -> DataFrame | None:
    """(cls, text): a text of each class all of whose rows have a null doc_id; None if there is no such class."""
    alone = reps.where("doc_id IS NULL").select("cls")
    if not alone.limit(1).count():
        return None

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in tk.slices(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(classes(*sets(buf, offs))), b.column("text").slice(lo, hi - lo)], ["cls", "text"])

    found = docs.where("doc_id IS NULL").select("text").mapInArrow(run, "cls long, text string")
    return stored(found.join(alone, "cls", "left_semi").groupBy("cls").agg(F.min("text").alias("text")))


def fetched(docs: DataFrame, to: DataFrame, reps: DataFrame, order, unnamed: DataFrame | None = None, many: int | None = None) -> DataFrame:
    """Rows of ``to`` (cls and other columns), each with its class's ordered set as ``keys``.

    ``reps``: (cls, doc_id) of each class; ``unnamed``: what ``nameless`` finds. Texts are read
    again. Few rows are broadcast to the texts, so no text is shuffled. With more, the texts are, once:
    each meets its rows as one list and gives one set, which goes straight to their groups.
    ``many``: about how many rows there are, if that is known.
    """
    many = to.count() if many is None else many
    few = many <= BROADCAST_ROWS
    to = stored(to.join(reps, "cls"), rows=many)
    own = [c for c in to.columns if c not in ("cls", "doc_id")]
    side = to if few else to.groupBy("cls", "doc_id").agg(F.collect_list(F.struct(*own)).alias("at"))
    rest = ["cls", *own] if few else ["cls", "at"]
    rows = docs.select("doc_id", "text").join(F.broadcast(side) if few else side, "doc_id").select(*rest, "text")
    if unnamed is not None:  # no doc_id leads to these
        rows = rows.unionByName(side.where("doc_id IS NULL").select(*rest).join(unnamed, "cls").select(*rows.columns))

    def ordered(batches):
        for batch in batches:
            for lo, hi, buf, offs in tk.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                vals, cut = sets(buf, offs)
                key = keys(vals, cut, order.value).byteswap().view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                # A repeated doc_id has other texts, too: the class tells.
                ok = pa.array(classes(vals, cut) == part.column("cls").to_numpy())
                blobs = pa.array([key[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c).filter(ok) for c in rest), blobs.filter(ok)], [*rest, "keys"])

    made = rows.mapInArrow(ordered, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest) + ", keys binary")
    return made if few else made.select("cls", F.explode("at").alias("x"), "keys").select("cls", "x.*", "keys")


def verify(docs: DataFrame, pairs: DataFrame, reps: DataFrame, order, unnamed: DataFrame | None = None) -> DataFrame:
    """(u, v) of the pairs (a, b) that link: a pivot a walks the tree of its partners, dealt to groups of about ``GROUP``."""
    per = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")), rows=pairs.count())
    partner = pairs.join(per, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"), F.lit(0).alias("role"), F.col("b").alias("cls"))
    pivot = per.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(1).alias("role"), F.col("a").alias("cls"))
    return linked(docs, partner.unionByName(pivot), ["a", "g"], reps, order, unnamed)


def meet(docs: DataFrame, to: DataFrame, reps: DataFrame, order, unnamed: DataFrame | None = None) -> DataFrame:
    """(u, v): links found in the trees of ``crossing``, as many as join components."""
    return linked(docs, to, ["t", "part", "q"], reps, order, unnamed)


def linked(docs: DataFrame, to: DataFrame, by: list[str], reps: DataFrame, order, unnamed: DataFrame | None = None) -> DataFrame:
    """(u, v): what ``_links`` finds in each group (``by``) of ``to``.

    Where there are more rows than are broadcast, whole groups are dealt to blocks of about so many, a scan of the texts each.
    A block's sets leave the disk before those of the next are made, and no text is shuffled.
    """
    many = to.count()
    scans = -(-many // BROADCAST_ROWS) if BROADCAST_ROWS < many <= SCANS * BROADCAST_ROWS else 1
    to = stored(to, rows=many) if scans > 1 else to
    found = []
    for k in range(scans):
        block = to.where(F.pmod(F.xxhash64(*by), F.lit(scans)) == k) if scans > 1 else to
        sent = fetched(docs, block, reps, order, unnamed, -(-many // scans))
        found.append(stored(sent.groupBy(*by).applyInArrow(_links, "u long, v long"), gathered=True))
    return reduce(DataFrame.unionByName, found)


def _links(table: pa.Table) -> pa.Table:
    """Sets of role 1 walk the tree of those of role 0; of their links those that join components (of the same class, or ``comp``) in this task.

    A set may come twice where a repeated row has a text again: once is enough.
    """
    role, cls = table.column("role").to_numpy(), table.column("cls").to_numpy()
    comp = table.column("comp").to_numpy() if "comp" in table.column_names else cls
    blobs = table.column("keys").to_pylist()
    stay, go = (_once(np.flatnonzero(role == r), cls) for r in (0, 1))
    tree = Tree([_read(blobs[i]) for i in stay], comp[stay])
    pr, st = tree.walk([_read(blobs[i]) for i in go], comp[go])
    u, v = go[pr], stay[st]
    keep = joining(cls[u], cls[v], comp[u], comp[v])
    return pa.table({"u": pa.array(cls[u][keep], pa.int64()), "v": pa.array(cls[v][keep], pa.int64())})


def _once(at: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return at[np.sort(np.unique(cls[at], return_index=True)[1])]


def _read(blob: bytes) -> np.ndarray:
    """Keys from their leading bytes; they keep the order."""
    wide = np.zeros((len(blob) // KEY_BYTES, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, KEY_BYTES)
    return wide.view(">u8").ravel().astype(U)


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Null, empty or blank text: no shingles, linked with nothing, its own component. Equal sets are
    linked. A repeated doc_id: a row each, and their texts' components are told apart by text;
    a null doc_id gets the least doc_id of its component, null if there is none.
    Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(sketch(docs), gathered=True)
    total, many = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    buckets = max(parts, -(-total // 4 // BUCKET_ROWS), 1)
    order = spark.sparkContext.broadcast(Order(stored(frequent(docs, max(parts, -(-total // (4 * BUCKET_ROWS)), 1)), gathered=True)))
    found = stored(candidates(postings(docs, order, buckets)), gathered=True)
    size = {r["hot"]: r["count"] for r in found.groupBy((F.col("kind") == 1).alias("hot")).count().collect()}
    reps = stored(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), rows=many)
    unnamed = nameless(docs, reps)
    pairs = stored(found.where("kind <> 1").groupBy("a", "b").agg(F.max("kind").alias("kind")), rows=size.get(False, 0))
    # First a partner for each class and all pivots; then what is not yet in one component; then the large groups.
    first = pairs.where("kind = 0").groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(pairs.where("kind = 2").select("a", "b"))
    done = stored(first.distinct(), rows=size.get(False, 0))
    links = verify(docs, done, reps, order, unnamed)
    comps = stored(components(links), rows=many)
    more = stored(_apart(pairs.select("a", "b").join(done, ["a", "b"], "left_anti"), comps), rows=size.get(False, 0))
    if more.limit(1).count():
        links = links.unionByName(verify(docs, more, reps, order, unnamed))
        comps = stored(components(links), rows=many)
    hot = found.where("kind = 1").select("t", "a", "n")
    left = hot.join(comps, F.col("a") == F.col("node"), "left").select("t", "a", "n", F.coalesce("component", "a").alias("comp"))
    to = crossing(stored(left, rows=size.get(True, 0)), size.get(True, 0))
    if to is not None:
        links = links.unionByName(meet(docs, to, reps, order, unnamed))
        comps = stored(components(links), rows=many)
    part = stored(reps.join(comps, F.col("cls") == F.col("node"), "left").select("cls", "doc_id", F.coalesce("component", "cls").alias("comp")), rows=many)
    least = stored(part.groupBy("comp").agg(F.min("doc_id").alias("component_id")), rows=many)
    named = stored(part.join(least, "comp").select("cls", "component_id"), rows=many)
    out = rows.join(named, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose classes are not in one component."""
    c = lambda x: comps.select(F.col("node").alias(x), F.col("component").alias(f"{x}_comp"))
    both = pairs.join(c("a"), "a", "left").join(c("b"), "b", "left")
    return both.where(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")).select("a", "b")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that with its least doc_id; all columns as they are.

    Rows with a null doc_id stay. Of rows alike in doc_id and text one stays; an id whose texts
    lie in several components stays as far as it is the least of one.
    """
    found = stored(join(docs), gathered=True)
    kept = found.where("doc_id = component_id").select("doc_id")
    gone = stored(found.where("doc_id IS NOT NULL").select("doc_id").distinct().join(kept.distinct(), "doc_id", "left_anti"), gathered=True)
    few = gone.count() <= BROADCAST_ROWS
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    again = stored(kept.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not again.limit(1).count():
        return left
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, "doc_id", "left_anti").unionByName(once).select(*docs.columns)
