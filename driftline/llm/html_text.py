"""HTML to text as laid out: a tree builder with implied tags, visibility rules, and a renderer.

The builder keeps the stack of open elements. It supplies end tags that HTML lets authors omit
(p, li, dt, dd, option, tr, td, th, table sections), closes what a misplaced end tag leaves open,
and treats script and style as raw text. Elements that are never displayed, or are hidden by
attribute or inline style, give no text. In svg only text and foreignObject are displayed, each text
on a line; tokens of a formula stand a space apart; a select has its options, a line each. In svg and
math '/>' closes an element, and HTML's own elements end them. The renderer keeps block spacing, line breaks, preformatted
text, nested list marks and numbers (indented up to ``MAX_INDENT`` levels), and sets table cells in aligned columns.

Nothing recurses, and no tag is looked for twice: ends of tags, open elements and free columns of a
table are found by places kept in order. Two rules bound what layout adds, so that time and text grow with a
page's length whatever its tags: a table that stands in ``MAX_NEST`` others is not aligned (its rows
are lines, its cells a space apart), and columns are aligned within the first ``MAX_PAD`` places of
a line (a longer cell does not widen its column; beyond, cells stand two spaces apart).
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
NEVER = frozenset("head script style template noscript title meta link base datalist iframe noembed noframes object audio video canvas".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd xmp".split())
BLOCK = CLOSES_P | frozenset("html body legend option optgroup textarea".split()) - {"hr"}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
# A start tag ends these, up to one of the limits.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "caption": ({"caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
FOREIGN = frozenset("svg math".split())
# What is HTML again within them.
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SVG_TEXT = frozenset("text foreignobject".split())
SVG_NEVER = frozenset("defs symbol clippath mask pattern marker metadata desc lineargradient radialgradient".split())
MATH_NEVER = frozenset("annotation annotation-xml mphantom".split())
MATH_TOKENS = frozenset("mi mo mn ms mtext".split())
SCOPE = frozenset("table td th caption button object template".split())
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534
# Tables aligned within one another, and the places of a line within which columns are aligned.
MAX_NEST, MAX_PAD = 8, 240

SPECIAL = re.compile(r"[>\"']")
NAME_END = re.compile(r"[\s/>]")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
UNQUOTED_END = re.compile(r"=\s*[^\s\"']\S*\Z")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
SPACE = re.compile(r"[ \t\n\f\r]+")
INDENT, MAX_INDENT = "  ", 40


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def hidden(tag: str, at: dict[str, str]) -> bool:
    return tag in NEVER or "hidden" in at or bool(HIDING.search(at.get("style", ""))) or (tag == "dialog" and "open" not in at)


def self_closing(text: str) -> bool:
    """Whether a tag's attributes end with '/' that belongs to no unquoted value."""
    if not text.endswith("/"):
        return False
    head, tail = re.match(r"(?s)(.*\s)?(\S*)\Z", QUOTED.sub('""', text)).groups()
    return not UNQUOTED_END.search(tail) and not ((head or "").rstrip().endswith("=") and tail[0] not in "\"'")


class Tags:
    """Tags of a source in turn. What begins like a tag and has no end is text."""

    def __init__(self, source: str):
        self.source, self.marks = source, [m.start() for m in SPECIAL.finditer(source)]
        self.mark = 0  # the first of them that may lie ahead
        self.dead: set[int] = set()  # quotes after which no tag ends
        self.over: dict[str, int] = {}  # after which place a quote, or '>', does not occur
        self.name_end = 0

    def end(self, at: int) -> int | None:
        """The place of the '>' that ends a tag whose name ends at ``at``; quoted stretches don't count."""
        source, marks, been = self.source, self.marks, []
        while self.mark < len(marks) and marks[self.mark] < at:
            self.mark += 1
        k = self.mark
        while k < len(marks):
            i = marks[k]
            q = source[i]
            if q == ">":
                return i
            if i in self.dead or i >= self.over.get(q, len(source)):
                break
            been.append(i)
            close = source.find(q, i + 1)
            if close < 0:
                self.over[q] = i
                break
            k = bisect_right(marks, close, k)
        self.dead.update(been)
        return None

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, '/' or '', name, attributes) of the first tag, comment or declaration from ``at`` on; the name is empty for those."""
        source = self.source
        while (lo := source.find("<", at)) >= 0:
            at = lo + 1
            if source.startswith("<!--", lo):
                if source.startswith((">", "->"), lo + 4):
                    return lo, source.index(">", lo) + 1, "", "", ""
                m = COMMENT_END.search(source, lo + 4)
                return lo, m.end() if m else len(source), "", "", ""
            slash = source[at : at + 1] == "/"
            first = source[at + slash : at + slash + 1]
            if first.isascii() and first.isalpha():
                if self.name_end < at + slash:
                    m = NAME_END.search(source, at + slash)
                    self.name_end = m.start() if m else len(source)
                end = self.end(self.name_end)
                if end is not None:
                    return lo, end + 1, "/" * slash, source[at + slash : self.name_end].lower(), source[self.name_end : end]
            if slash or first in ("!", "?"):  # an end tag without a name, a declaration
                k = source.find(">", at) if at < self.over.get(">", len(source)) else -1
                if k >= 0:
                    return lo, k + 1, "", "", ""
                self.over.setdefault(">", at)
        return None


def width(line: str) -> int:
    """Columns of a line: wide characters take two, combining marks none."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


class Flow:
    """Lines of one flow of blocks: a page, or a table cell."""

    def __init__(self):
        self.lines, self.now, self.space, self.gap, self.bullet, self.depth = [], [], False, 0, None, 0

    def text(self, t: str, pre: bool) -> None:
        if pre:
            head, *rest = t.split("\n")
            self.now += [" "] * self.space + [head] if head or self.now else []
            self.space = False
            for line in rest:
                self.line(keep=True)
                if line:
                    self.now.append(line)
            return
        t = SPACE.sub(" ", t)
        if t == " ":
            self.space = self.space or bool(self.now)
        elif t:
            if (self.space or t[0] == " ") and self.now:
                self.now.append(" ")
            self.now.append(t.strip(" "))
            self.space = t[-1] == " "

    def line(self, keep: bool = False) -> None:
        """End the line; an empty one counts only with ``keep``."""
        if self.now or keep:
            self.put(["".join(self.now)])
        self.now, self.space = [], False

    def put(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        pad = INDENT * min(self.depth, MAX_INDENT)
        for k, x in enumerate(lines):
            mark = self.bullet if k == 0 and self.bullet is not None else pad
            self.lines.append((mark + x).rstrip(" ") if x or mark.strip() else "")
        self.bullet = None

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)


class Taken:
    """Columns that cells of rows above reach down into: runs [lo, hi) in order, apart from each other."""

    def __init__(self):
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.until: list[tuple[int, int, int]] = []  # a heap of (row, lo, hi): free again from that row on

    def free(self, col: int) -> int:
        k = bisect_right(self.lo, col) - 1
        return self.hi[k] if k >= 0 and self.hi[k] > col else col

    def take(self, lo: int, hi: int, row: int) -> None:
        """The part of lo .. hi - 1 that is not taken yet, up to ``row``."""
        while lo < hi:
            lo = self.free(lo)
            k = bisect_right(self.lo, lo)
            stop = min(hi, self.lo[k]) if k < len(self.lo) else hi
            if lo >= stop:
                return
            heapq.heappush(self.until, (row, lo, stop))
            left, right = k > 0 and self.hi[k - 1] == lo, k < len(self.lo) and self.lo[k] == stop
            if left and right:
                self.hi[k - 1] = self.hi.pop(k)
                self.lo.pop(k)
            elif left:
                self.hi[k - 1] = stop
            elif right:
                self.lo[k] = lo
            else:
                self.lo.insert(k, lo)
                self.hi.insert(k, stop)
            lo = stop

    def pass_to(self, row: int) -> None:
        while self.until and self.until[0][0] <= row:
            _, lo, hi = heapq.heappop(self.until)
            k = bisect_right(self.lo, lo) - 1
            a, b = self.lo.pop(k), self.hi.pop(k)
            for x, y in ((hi, b), (a, lo)):
                if x < y:
                    self.lo.insert(k, x)
                    self.hi.insert(k, y)


class Table:
    """Rows of cells; a cell is [lines, columns, rows]."""

    def __init__(self, outer: Flow, flat: bool = False):
        self.outer, self.rows, self.flat = outer, [], flat

    def lines(self) -> list[str]:
        """Cells in a grid, columns two spaces apart; a cell with several lines takes several."""
        grid, taken = [], Taken()
        for k, row in enumerate(self.rows):
            placed, col, down = [], 0, []
            taken.pass_to(k)
            for lines, cols, rows in row:
                col = taken.free(col)
                placed.append((col, lines, cols))
                if rows > 1 and k + 1 < len(self.rows):
                    down.append((col, col + cols, min(k + rows, len(self.rows))))
                col += cols
            for x in down:
                taken.take(*x)
            grid.append(placed)
        wide: dict[int, int] = {}
        for placed in grid:
            for col, lines, cols in placed:
                if cols == 1:
                    wide[col] = max(wide.get(col, 0), max((w for w in map(width, lines) if w <= MAX_PAD), default=0))
        start, cols = {}, sorted({c for placed in grid for c, _, _ in placed} | set(wide))
        x = 0
        for c in cols:
            start[c] = min(x, MAX_PAD)
            x += wide.get(c, 0) + 2 if wide.get(c, 0) else 0
        out = []
        for placed in grid:
            for k in range(max((len(lines) for _, lines, _ in placed), default=0)):
                line, used = [], 0
                for col, lines, _ in placed:
                    if k < len(lines) and lines[k]:
                        pad = max(start[col] - used, 2 if used else 0)
                        line += [" " * pad, lines[k]]
                        used += pad + width(lines[k])
                out.append("".join(line))
        return out


class Page:
    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = []  # tag, hidden (2: in svg, outside its texts), pre
        self.places: dict[str, list[int]] = defaultdict(list)  # of each tag, where it is on the stack
        self.within: list[str | None] = []  # of each open element: svg or math, if its children belong to it
        self.flow = Flow()
        self.lists: list[list] = []  # of each open list: its flow, and the next number or None
        self.tables: list[Table] = []

    def foreign(self) -> str | None:
        """svg or math, if a child of the open element belongs to it."""
        return self.within[-1] if self.within else None

    def push(self, tag: str, hide: int, pre: bool) -> None:
        self.within.append(tag if tag in FOREIGN else None if tag in INTEGRATION else self.foreign())
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, hide, pre))

    def open(self, tag: str, at: dict[str, str], closed: bool = False) -> None:
        """``closed``: the tag ends with '/>', which counts in svg and math."""
        while tag in BREAKOUT and self.foreign():
            self.end_any(FOREIGN, set())
        within = self.foreign()
        if tag in ("html", "body") and self.places[tag]:
            return
        if tag in IMPLIED_END:
            ends, limits = IMPLIED_END[tag]
            self.end_any(ends, limits)
        if tag == "optgroup":
            self.end_any({"option"}, {"select", "optgroup"})
        if tag in CELLS and self.tables and not self.has("tr", {"table"}):
            self.open("tr", {})
        if tag in CLOSES_P:
            self.end_any({"p"}, SCOPE)
        if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self.pop()
        above = self.stack[-1][1] if self.stack else 0
        drawn = above == 2 or tag == "svg"
        if above == 1 or hidden(tag, at) or (within == "math" and tag in MATH_NEVER) or (drawn and (tag in SVG_NEVER or at.get("display") == "none" or at.get("visibility") in ("hidden", "collapse"))):
            hide = 1
        else:
            hide = 2 if drawn and tag not in SVG_TEXT else 0
        pre = bool(self.stack and self.stack[-1][2]) or tag in ("pre", "listing", "plaintext", "xmp", "textarea")
        if not hide:
            if above == 2:
                self.flow.block(0)
            elif within == "math" and tag in MATH_TOKENS:
                self.flow.text(" ", False)
            self.start(tag, at)
            if tag in ("option", "optgroup") and at.get("label", "").strip():
                self.flow.text(at["label"], False)
                if tag == "option":  # shown instead of its text
                    self.push(tag, 1, pre)
                    return
        if tag not in VOID:
            self.push(tag, hide, pre)
            if closed and (within or tag in FOREIGN):
                self.pop()

    def start(self, tag: str, at: dict[str, str]) -> None:
        f = self.flow
        if tag == "br":
            f.line(keep=True)
        elif tag == "hr":
            f.block(1)
        elif tag == "img":
            if at.get("alt", "").strip():
                f.text(at["alt"], False)
        elif tag == "table":
            f.block(1)
            self.tables.append(Table(f, len(self.tables) >= MAX_NEST))
        elif tag == "tr" and self.tables:
            if self.tables[-1].flat:
                f.block(0)
            else:
                self.tables[-1].rows.append([])
        elif tag in CELLS and self.tables and self.tables[-1].flat:
            f.text(" ", False)
        elif tag in CELLS and self.tables:
            num = lambda k, most: min(max(int(m[0]) if (m := re.match(r"\d{1,6}", at.get(k, "").strip())) else 1, 1), most)
            self.flow = Flow()
            if not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            self.tables[-1].rows[-1].append([[], num("colspan", MAX_COLSPAN), num("rowspan", MAX_ROWSPAN)])
        elif tag in ("ul", "ol", "menu", "dir"):
            f.block(0 if self.lists and self.lists[-1][0] is f else 1)
            first = re.match(r"-?\d{1,9}", at.get("start", "").strip())
            self.lists.append([f, (int(first[0]) if first else 1) if tag == "ol" else None])
            f.depth += 1
        elif tag == "li":
            f.block(0)
            number = self.lists[-1][1] if self.lists else None
            mark = "- " if number is None else f"{number}. "
            if number is not None:
                self.lists[-1][1] += 1
            f.bullet = INDENT * min(max(f.depth - 1, 0), MAX_INDENT) + mark
        elif tag == "dd":
            f.block(0)
            f.depth += 1
        elif tag == "blockquote":
            f.block(1)
            f.depth += 1
        elif tag in BLOCK:
            f.block(1 if tag in SPACED else 0)

    def pop(self) -> None:
        tag, hide, _ = self.stack.pop()
        self.places[tag].pop()
        self.within.pop()
        if hide:
            return
        f = self.flow
        if self.stack and self.stack[-1][1] == 2:
            f.block(0)
        if tag == "table" and self.tables:
            t = self.tables.pop()
            f = self.flow = t.outer
            if t.flat:
                f.line()
            lines = t.lines()
            if lines:
                f.put(lines)
            f.gap = max(f.gap, 1)
        elif tag in CELLS and self.tables and self.tables[-1].rows and self.tables[-1].rows[-1]:
            f.line()
            self.tables[-1].rows[-1][-1][0] = f.lines
            while self.lists and self.lists[-1][0] is f:
                self.lists.pop()
            self.flow = self.tables[-1].outer
        elif tag in ("ul", "ol", "menu", "dir") and self.lists:
            f.block(0)
            self.lists.pop()
            f.depth, f.bullet = max(f.depth - 1, 0), None
            f.gap = max(f.gap, 0 if self.lists and self.lists[-1][0] is f else 1)
        elif tag in ("dd", "blockquote"):
            f.block(1 if tag == "blockquote" else 0)
            f.depth = max(f.depth - 1, 0)
        elif tag in BLOCK:
            f.block(1 if tag in SPACED else 0)

    def nearest(self, tags) -> int:
        """Where the nearest open element of ``tags`` is on the stack; -1 if there is none."""
        top = -1
        for t in tags:
            if (at := self.places.get(t)) and at[-1] > top:
                top = at[-1]
        return top

    def has(self, tag: str, limits) -> bool:
        return bool(self.places[tag]) and self.places[tag][-1] > self.nearest(limits)

    def end_any(self, tags, limits) -> None:
        """Close up to and with the nearest of ``tags``, unless one of ``limits`` stands before it."""
        k = self.nearest(tags)
        if k >= 0 and k > self.nearest(limits):
            while len(self.stack) > k:
                self.pop()

    def close(self, tag: str) -> None:
        if tag == "p" and not self.has("p", SCOPE):
            self.flow.block(1)
        elif tag == "br":
            self.flow.line(keep=True)
        elif tag in ("table", "tr") or tag in CELLS or tag in SECTIONS:
            self.end_any({tag}, {"table"} - {tag})
        elif tag in HEADINGS:
            self.end_any(HEADINGS, SCOPE)
        elif tag not in ("html", "body"):
            self.end_any({tag}, SCOPE - {tag})

    def text(self, t: str) -> None:
        if self.stack and self.stack[-1][1]:
            return
        if self.tables and self.flow is self.tables[-1].outer and not self.tables[-1].flat:
            if t.strip(" \t\n\f\r"):  # text between cells goes before the table
                self.tables[-1].outer.text(t, False)
                self.tables[-1].outer.line()
            return
        self.flow.text(t, bool(self.stack and self.stack[-1][2]))


def render(source: str | None) -> str:
    """The visible text of a page. Null or empty: empty. What no tag claims is text."""
    page, at, source = Page(), 0, (source or "").replace("\0", "")
    tags = Tags(source)
    while at < len(source):
        m = tags.next(at)
        stop = m[0] if m else len(source)
        if stop > at:
            page.text(html.unescape(source[at:stop]))
        if not m:
            break
        _, at, slash, tag, rest = m
        if not tag:
            continue
        if slash:
            page.close(tag)
            continue
        within = page.foreign()
        page.open(tag, attributes(rest) if rest else {}, self_closing(rest))
        if (tag in RAW or tag in RCDATA) and not within:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            stop = end.start() if end else len(source)
            if tag == "textarea" and source.startswith("\n", at):
                at += 1
            if stop > at:
                page.text(html.unescape(source[at:stop]) if tag in RCDATA else source[at:stop])
            at = stop
    while page.stack:
        page.pop()
    page.flow.line()
    return "\n".join(page.flow.lines).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines) of every row of (page_id, url, html), whole pages.

    Null or empty html: empty text, no lines. Repeated rows: a row each. Empty table: no rows.
    Other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                text = [render(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
