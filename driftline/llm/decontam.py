"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, quantities, units after numbers, and names (capitalised words
within a sentence) give way to typed placeholders; other words stand in lower case. Windows of
``WINDOW`` template tokens of the corpus are hash-joined with those of the benchmark. Within an
occurrence of an item, each original value of a slot must map to one value: windows that disagree
with the mapping don't count. A document is contaminated by an item if under one mapping, that of
any occurrence or the most frequent one of the document, consistent windows cover at least
``COVERAGE`` of the item's, so a re-parameterised question is caught as well as a copy, also where
a document asks it several times. Items with fewer than ``FEW`` windows that count are also matched whole:
by the values of all their tokens, and by their whole template with one value for each original
value, if it has ``LITERALS`` literal words, or ``WINDOW`` tokens and one literal word (a lesser
template fits too much; its item is found by its values).

The build side of the hash join is a block of benchmark items of bounded size, sent to every task;
a larger benchmark takes more blocks, one scan each. A document meets a whole item in one task, so
nothing is shuffled, and hot windows or documents meet nobody else.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from . import textkit as tk
from .store import stored

WINDOW, COVERAGE = 5, 0.5
# Literal words that a window needs to count.
LITERALS = 3
# Items with fewer windows that count are matched whole, too.
FEW = 3
# Windows of a block at most (an item with more is a block of its own).
BLOCK_WINDOWS = 1_000_000
U = np.uint64
INVERSE = U(pow(int(tk.K1), -1, 1 << 64))

# Units of measure.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ton tons "
    "ml cl l litre litres liter liters gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "mph kmh hz khz mhz ghz w kw mw kwh j kj cal kcal v a pa kpa k c f degree degrees percent dollar dollars euro euros cent cents usd eur gbp"
)

LITERAL, NUM, QTY, UNIT, NAME = range(5)
_PLACE = np.array([0, 11, 12, 13, 14], U) * tk.K2

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_STOP = np.zeros(256, np.int64)
_STOP[list(b".!?:;\n\"")] = 1


def unit_hashes() -> np.ndarray:
    raw = [u.encode() for u in sorted(set(UNITS.split()))]
    offs = np.cumsum([0, *map(len, raw)])
    return np.sort(tk.hashes(np.frombuffer(b"".join(raw), np.uint8), offs[:-1], offs[1:]))


def templates(buf: np.ndarray, offs: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of a slice: its hash in the template, its type, the hash of its own value, its text's number."""
    s, e, doc = tk.runs(_TOKEN[buf], offs)
    value = tk.hashes(tk.lower(buf), s, e)
    kind = np.zeros(len(s), np.int64)
    if not len(s):
        return value, kind, value, doc
    lead, tail = buf[s], buf[e - 1]
    digit = (lead >= 48) & (lead <= 57)
    kind[digit] = np.where((tail[digit] >= 48) & (tail[digit] <= 57), NUM, QTY)
    second = buf[np.minimum(s + 1, len(buf) - 1)]
    latin = (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    after = buf[np.minimum(s + 1 + latin, len(buf) - 1)]
    cap = np.flatnonzero((((lead >= 65) & (lead <= 90)) | latin) & (e - s > 1 + latin) & (((after >= 97) & (after <= 122)) | (after >= 128)))
    cap = cap[cap > 0]
    cap = cap[doc[cap] == doc[cap - 1]]
    stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
    kind[cap[stops[s[cap]] == stops[e[cap - 1]]]] = NAME
    nxt = np.flatnonzero(kind[:-1] == NUM) + 1
    nxt = nxt[(doc[nxt] == doc[nxt - 1]) & (kind[nxt] == LITERAL)]
    kind[nxt[np.isin(value[nxt], units)]] = UNIT
    return np.where(kind == LITERAL, value, _PLACE[kind]), kind, value, doc


def windows(h: np.ndarray, kind: np.ndarray, doc: np.ndarray, k: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that count, and the token at which each begins."""
    w = tk.combine(h, k)
    if not len(w):
        return w, np.zeros(0, np.int64)
    lit = np.concatenate([[0], np.cumsum(kind == LITERAL)])
    at = np.flatnonzero((doc[: len(w)] == doc[k - 1 :]) & (lit[k:] - lit[:-k] >= min(LITERALS, k)))
    return w[at], at


def powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, x, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of token hashes: weighted sums up to each, and what brings a run's sum to weights that begin with 1."""
    return np.concatenate([np.zeros(1, U), np.add.accumulate(x * powers(tk.K1, len(x))[:-1])]), powers(INVERSE, len(x))


def spans(p: tuple[np.ndarray, np.ndarray], at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each run of n tokens from ``at`` on; its cost does not grow with n."""
    return tk.fmix((p[0][at + n] - p[0][at]) * p[1][at] + n.astype(U) * tk.K2)


class Whole:
    """Items as whole token sequences, by values or by templates: the hash of their first tokens leads to lengths, that of all tokens to items.

    Whether a template's first token is a name or a unit depends on what stands before it, so templates are told from the second token on.
    """

    def __init__(self, x: np.ndarray, begin: np.ndarray, length: np.ndarray, item: np.ndarray, skip: int):
        self.skip, n, p = skip, length - skip, sums(x)
        head = np.minimum(n, WINDOW)
        self.heads = np.unique(head)
        first = np.unique(np.stack([spans(p, begin + skip, head), n.astype(U)]), axis=1)
        self.first, self.n = first[0], first[1].astype(np.int64)
        full = spans(p, begin + skip, n)
        order = np.argsort(full, kind="stable")
        self.full, self.begin, self.item = full[order], begin[order], item[order]

    def hits(self, x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens at which an item's sequence begins, and the item's place in ``begin`` and ``item``."""
        p, where, which = sums(x), [], []
        for h in self.heads.tolist():
            at = np.arange(self.skip, len(x) - h + 1)
            key = spans(p, at, np.full(len(at), h))
            lo, hi = np.searchsorted(self.first, key, "left"), np.searchsorted(self.first, key, "right")
            at, n = np.repeat(at, hi - lo), self.n[_ranges(lo, hi)]
            ok = at + n <= len(x)
            at, n = at[ok], n[ok]
            ok = doc[at - self.skip] == doc[at + n - 1]
            at, n = at[ok], n[ok]
            key = spans(p, at, n)
            lo, hi = np.searchsorted(self.full, key, "left"), np.searchsorted(self.full, key, "right")
            where.append(np.repeat(at, hi - lo) - self.skip)
            which.append(_ranges(lo, hi))
        return np.concatenate(where), np.concatenate(which)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo to hi - 1 of each pair, one after another."""
    n = hi - lo
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _votes(slots) -> dict[int, Counter]:
    votes: dict[int, Counter] = defaultdict(Counter)
    for x, y in (xy for s in slots for xy in s):
        votes[x][y] += 1
    return votes


def _best(votes: dict[int, Counter]) -> dict[int, int]:
    return {x: min(c, key=lambda y: (-c[y], y != x, y)) for x, c in votes.items()}  # noqa: B023


class Block:
    """Some benchmark items as the build side: window hashes in order, with their item and place."""

    def __init__(self, items: list[tuple[int, str]], units: np.ndarray):
        raw = [(t or "").encode() for _, t in items]
        buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64)
        h, self.kind, self.value, doc = templates(buf, offs, units)
        self.ids, self.h = [i for i, _ in items], h
        w, at = windows(h, self.kind, doc)
        order = np.argsort(w, kind="stable")
        self.hash, self.at, self.item = w[order], at[order], doc[at][order]
        self.total = np.bincount(self.item, minlength=len(items)) if len(w) else np.zeros(len(items), np.int64)
        self.length = np.bincount(doc, minlength=len(items))
        begin, literal = np.cumsum(self.length) - self.length, np.bincount(doc[self.kind == LITERAL], minlength=len(items))
        few = (self.total < FEW) & (self.length > 0)
        fit = few & ((literal >= LITERALS) | ((literal > 0) & (self.length >= WINDOW)))
        self.exact, self.alike = (Whole(x, begin[i], self.length[i], i, skip) if len(i) else None for x, i, skip in ((self.value, np.flatnonzero(few), 0), (h, np.flatnonzero(fit), 1)))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hash >> U(44)).astype(np.int64)] = True

    def whole(self, h: np.ndarray, kind: np.ndarray, value: np.ndarray, doc: np.ndarray) -> dict[tuple[int, int], bool]:
        """Whether any slot has another value, of each text and item that it holds whole."""
        out = {}
        if self.exact is not None:
            at, which = self.exact.hits(value, doc)
            out = dict.fromkeys(zip(doc[at].tolist(), self.exact.item[which].tolist()), False)
        if self.alike is not None:
            for m, k in zip(*(x.tolist() for x in self.alike.hits(h, doc))):
                item, q = int(self.alike.item[k]), int(self.alike.begin[k])
                pair = (int(doc[m]), item)
                if pair in out or (h[m] != self.h[q] and value[m] != self.value[q]):
                    continue
                slot = np.flatnonzero(self.kind[q : q + self.length[item]] != LITERAL)
                xy = set(zip(self.value[q + slot].tolist(), value[m + slot].tolist()))
                if len({x for x, _ in xy}) == len(xy):
                    out[pair] = any(x != y for x, y in xy)
        return out

    def consistent(self, mine: np.ndarray, theirs: np.ndarray, item: int, kind: np.ndarray, value: np.ndarray) -> tuple[int, bool] | None:
        """(consistent windows, whether any slot has another value) under the first mapping of slots that reaches the coverage.

        Tried are the most frequent values in the text, and then those of each occurrence: the windows
        at one distance of text and item, longest first. What an occurrence leaves out has the values of
        the nearest distance that has it (the text has more or fewer words there). Windows up to an
        item's length away count with it, those without slots wherever they are.
        """
        need = COVERAGE * self.total[item]
        at, far, slots = theirs.tolist(), (mine - theirs).tolist(), []  # of each window: (original value, value here)
        for m, q in zip(mine.tolist(), at):
            slots.append([(int(self.value[q + k]), int(value[m + k])) for k in range(WINDOW) if kind[m + k] != LITERAL])
        votes = _votes(slots)
        best = _best(votes)
        good = {q for q, s in zip(at, slots) if all(best[x] == y for x, y in s)}
        if len(good) >= need:
            return len(good), any(x != y for x, y in best.items())
        if all(len(c) == 1 for c in votes.values()):
            return None
        fixed = {q for q, s in zip(at, slots) if not s}
        lines = defaultdict(list)
        for q, d, s in zip(at, far, slots):
            if s:
                lines[d].append((q, s))
        order = sorted(lines)
        own = {d: _best(_votes(s for _, s in lines[d])) for d in order}
        for d in sorted(order, key=lambda d: (-len(lines[d]), d)):
            lo, hi = bisect_left(order, d - int(self.length[item])), bisect_right(order, d + int(self.length[item]))
            near = sorted(order[lo:hi], key=lambda x: (abs(x - d), x))
            if len(fixed | {q for x in near for q, _ in lines[x]}) < need:
                continue
            best = {}
            for x in near:
                best = own[x] | best
            good = fixed | {q for x in near for q, s in lines[x] if all(best[a] == b for a, b in s)}
            if len(good) >= need:
                return len(good), any(x != y for x, y in best.items())
        return None

    def leaks(self, buf: np.ndarray, offs: np.ndarray, units: np.ndarray) -> list[tuple[int, int, int, bool]]:
        """(text number, item number, consistent windows, whether any slot has another value) of each contaminated text and item.

        Items held whole have all their windows, and one at least.
        """
        h, kind, value, doc = templates(buf, offs, units)
        w, at = windows(h, kind, doc)
        hit = np.flatnonzero(self.maybe[(w >> U(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, w[hit], "left"), np.searchsorted(self.hash, w[hit], "right")
        mine, theirs = np.repeat(at[hit], hi - lo), _ranges(lo, hi)
        pair = doc[mine] * len(self.ids) + self.item[theirs]
        whole = self.whole(h, kind, value, doc)
        out = [(d, item, max(int(self.total[item]), 1), other) for (d, item), other in whole.items()]
        order = np.lexsort((self.at[theirs], pair))
        pair, mine, theirs = pair[order], mine[order], theirs[order]
        cut = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else []
        for a, b in zip(cut, [*cut[1:], len(pair)]):
            item = int(self.item[theirs[a]])
            if len(np.unique(self.at[theirs[a:b]])) < COVERAGE * self.total[item]:
                continue  # whatever the slots
            if (int(doc[mine[a]]), item) in whole:
                continue
            found = self.consistent(mine[a:b], self.at[theirs[a:b]], item, kind, value)
            if found:
                out.append((int(doc[mine[a]]), item, *found))
        return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_WINDOWS):
    """The benchmark's items, read one by one, in blocks of about ``limit`` windows at most."""
    units, held, size = unit_hashes(), [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"] or "") // 2 + 1  # no more windows than half the characters
        if size >= limit:
            yield Block(held, units)
            held, size = [], 0
    if held:
        yield Block(held, units)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, reparameterised) of each contaminated document and item.

    Null or empty texts on either side match nothing, nor do items without a token. An item without
    a window that counts has one in ``item_windows``, the whole of it. Repeated rows on either side: a row each. Other columns are ignored. No match, or an empty table: no rows.
    """
    spark = docs.sparkSession
    item = benchmark.schema["item_id"].dataType
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {item.simpleString()}, n_windows long, item_windows long, coverage double, reparameterised boolean"
    parts = []
    for block, more in _with_more(blocks(benchmark)):
        build = spark.sparkContext.broadcast(block)
        part = docs.select("doc_id", "text").mapInArrow(_finder(build, schema, to_arrow_type(item)), schema)
        if more or parts:  # one block at a time: this one is done with before the next is sent
            part = stored(part)
            build.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _with_more(items):
    """Each item, and whether another follows."""
    items = iter(items)
    now = next(items, None)
    while now is not None:
        after = next(items, None)
        yield now, after is not None
        now = after


def _finder(build, schema: str, item_type):
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        k, units = build.value, unit_hashes()
        for b in batches:
            ids = b.column("doc_id")
            for lo, _, buf, offs in tk.slices(b.column("text")):
                rows = k.leaks(buf, offs, units)
                if rows:
                    total = [max(int(k.total[i]), 1) for _, i, _, _ in rows]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([lo + d for d, *_ in rows])), pa.array([k.ids[i] for _, i, _, _ in rows]).cast(item_type), pa.array([n for _, _, n, _ in rows], pa.int64()), pa.array(total, pa.int64()), pa.array([n / t for (_, _, n, _), t in zip(rows, total)]), pa.array([r for *_, r in rows])], names)

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows; all columns as they are. Nothing is shuffled; each block of the benchmark beyond the first is a scan more."""
    spark = docs.sparkSession

    def keeper(build):
        def run(batches):
            units = unit_hashes()
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, _, buf, offs in tk.slices(b.column("text")):
                    for d, *_ in build.value.leaks(buf, offs, units):
                        keep[lo + d] = False
                yield b.filter(pa.array(keep))

        return run

    several = False
    for block, more in _with_more(blocks(benchmark)):
        build = spark.sparkContext.broadcast(block)
        docs = docs.mapInArrow(keeper(build), docs.schema)
        several |= more
        if several:
            docs = stored(docs)
            build.destroy()
    return docs
