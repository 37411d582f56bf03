"""WARC round trips and HTML rendering."""

import base64
import gzip
import hashlib
import random
import re
import time
from html.parser import HTMLParser

import pyarrow.fs as pafs
from pyspark.sql import functions as F

from driftline.llm import html_text, warc
from driftline.llm.store import shared_dir

SCHEMA = "page_id long, url string, html string"


def test_archives_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, f"https://www.h{i % 7}.example.com/p/{i % 11}?q={i}#f", f"<p>{'x' * rng.randint(0, 3)}</p>\r\n\r\n{i % 13}") for i in range(200)]
    rows += [(900, None, None), (901, "http://a.b/ x\n", ""), (902, "x", rows[0][2]), (None, "y", rows[0][2]), (902, "x", rows[0][2])]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("clash")).repartition(4)
    folder = f"{shared_dir(spark)}/warc"
    files = warc.write(pages, folder)
    got = warc.read(files, folder, 5).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 10**9), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        kind = "response" if i == first[h or ""] else "revisit"
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, first[h or ""] if kind == "revisit" else None))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    ordered = sorted(got, key=lambda r: (r["range_id"], r["seq"]))
    keys = [warc.order_key(r["url_key"], r["captured"], r["page_id"]) for r in ordered]
    assert keys == sorted(keys) and len({r["range_id"] for r in got}) > 1
    # Each entry's place holds its record, as a gzip member of its own.
    fs, path = pafs.FileSystem.from_uri(folder)
    for r in got[:20]:
        with fs.open_input_file(f"{path}/{r['file']}") as f:
            f.seek(r["offset"])
            content = gzip.decompress(f.read(r["length"]))
        assert warc.parse(content)["payload_digest"] == r["payload_digest"]


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "long enough"), (4, "d", "long enough")], SCHEMA)
    assert {r["page_id"]: r["record_type"] for r in warc.archive(pages, 5).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(8):
        runs = [sorted((f"{rng.randrange(50):03d}", r) for _ in range(rng.randrange(20))) for r in range(k)]
        tree, out = warc.LoserTree(runs), []
        late = sorted((f"{rng.randrange(50):03d}", 99) for _ in range(5))
        while (x := tree.peek()) is not None and x[0] < late[0][0]:
            out.append(tree.pop())
        tree.add(late)
        while tree.peek() is not None:
            out.append(tree.pop())
        assert [x[0] for x in out] == sorted(x[0] for r in [*runs, late] for x in r)


def test_url_keys():
    assert warc.url_key("HTTP://WWW.Example.com:80/a?b#c") == "com,example)/a?b"
    assert warc.url_key("https://user@x.org") == "org,x)/" and warc.url_key(None) == ""


def test_rendering():
    page = """<html><head><title>no</title><style>p{}</style></head><body><h1>Head &amp; tail</h1>para one<p>two <b>bold</b>
    x<br>next<p>three<ul><li>a<li>b<ol start=3><li>n1<li>n2</ol><li>c</ul><div hidden>no</div><span style="display: none">no</span>
    <table><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td>kiwi<br>fruit</td><td>12</table><pre>k
  l</pre><script>var x="</p>";</script>end"""
    want = """Head & tail

para one

two bold x
next

three

- a
- b
  3. n1
  4. n2
- c

Name   Qty
apple  3
kiwi   12
fruit

k
  l

end"""
    assert html_text.render(page) == want
    assert html_text.render(None) == html_text.render("") == ""
    assert html_text.render("<div>" * 30_000 + "deep") == "deep"
    assert html_text.render("a < b </i> & <3") == "a < b & <3"


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in html_text.NEVER and tag not in html_text.VOID

    def handle_endtag(self, tag):
        self.off -= tag in html_text.NEVER and tag not in html_text.VOID

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_all_visible_text_is_there(spark):
    rng = random.Random(4)
    tags = ["p", "div", "b", "ul", "li", "table", "tr", "td", "h2", "blockquote", "span", "script"]
    rows = []
    for i in range(150):
        parts = []
        for k in range(40):
            t = rng.choice(tags)
            parts.append(rng.choice([f"<{t}>", f"</{t}>" if t != "script" else "", f"word{k} ", f"<{t}>w{k}</{t}>"]) if t != "script" else f"<script>s{k}</script>")
        rows.append((i, "u", "".join(parts)))
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame([*rows, (900, None, None)], SCHEMA)).collect()}
    assert got[900]["text"] == "" and got[900]["n_lines"] == 0
    for i, _, h in rows:
        p = Plain()
        p.feed(h)
        p.close()
        assert sorted(re.findall(r"w(?:ord)?\d+", got[i]["text"])) == sorted(re.findall(r"w(?:ord)?\d+", " ".join(p.out)))
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_formulas_drawings_and_forms_are_text():
    r = html_text.render
    assert r("<p>so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>tex</annotation></math>, then") == "so x = 1 2, then"
    assert r("a<svg><title>t</title>raw<defs><text>d</text></defs><g><text>Label <tspan>one</tspan></text><text display='none'>no</text><text>two</text></g></svg>b") == "a\nLabel one\ntwo\nb"
    assert r("<svg><foreignObject><p>in</p><p>deep</p></foreignObject></svg>") == "in\n\ndeep"
    assert r("<form>Size <select><option>S<option selected>M<optgroup label='Big'><option>L<option label='Huge'>XL</select> now</form>") == "Size\nS\nM\nBig\nL\nHuge\nnow"
    assert r("<div>say <textarea>\nfirst  &amp;\n <b>raw</textarea> end</div>") == "say\nfirst  &\n <b>raw\nend"
    assert r("<datalist><option>no</datalist><select hidden><option>no</select><svg style='display:none'><text>no</text></svg><math hidden><mi>no</mi></math>yes") == "yes"


def test_self_closing_in_svg_and_math():
    r = html_text.render
    assert r("<body>a <svg viewBox='0 0 1 1'/>b <math/>c</body>") == "a b c"
    assert r("<p>a<svg><path d='M0=1 0'/><style/><script/><title/><g/></svg>b</p><p>c") == "ab\n\nc"
    assert r("<div>a<svg><g/><text>t</text></svg></div>b") == "a\nt\nb"
    assert r("<p>a<svg width=10/>gone</svg>b") == "ab"
    assert r("<div/>a<p/>b") == "a\n\nb"
    assert r("<svg><path><p>out</p>more") == "out\n\nmore"
    assert r("<title/>not text</title>x") == "x"


def test_time_grows_with_the_page():
    """Shapes that make scanners look twice, a megabyte each."""
    shapes = [
        "<table>" + "<tr><td rowspan=65534 colspan=1000>x" * 28_000, "<table>" + "<tr><td rowspan=9999>x" * 45_000, "<a " * 333_000, '<a "' * 250_000 + ">", "<a '\"" * 200_000 + ">", "<ul><li>x" * 111_000, "<a" * 500_000,
        "<table><tr><td>x" * 62_000, "<table><tr><td>x" * 31_000 + "</td></tr></table>" * 31_000, "<ul><li>a<table><tr><td>b" * 40_000, "<table><tr><td>left</td><td>r" * 36_000,
        "<table><tr><td>" + "w" * 500_000 + "</td></tr>" + "<tr><td></td><td>x</td></tr>" * 18_000, "<table><tr>" + ("<td>" + "w" * 100) * 5_000 + "<tr><td colspan=900></td><td>x" * 15_000, "<blockquote>q<table><tr><td>y" * 34_000,
        "<i><table><td>" + "<b>" * 140_000 + "</i>" * 140_000, "<a " + "=a" * 500_000 + " x/>", "<!x" * 333_000, "<ul><li>" * 50_000 + "<table>" + "<td>x" * 100_000, "<p>" + "<span>" * 160_000,
    ]
    for s in shapes:
        began = time.process_time()
        text = html_text.render(s)
        assert time.process_time() - began < 20 and len(text) < 16 * len(s), s[:40]


def test_tables_deep_in_tables_are_lines():
    r = html_text.render
    assert r("<table><tr><td>" * html_text.MAX_NEST + "<table><tr><td>a<td>b<tr><td>c<td>d</table>z") == "a b\nc d\n\nz"
    assert r("<table><tr><td>" * (html_text.MAX_NEST - 1) + "<table><tr><td>aa<td>b<tr><td>c<td>d</table>z") == "aa  b\nc   d\n\nz"


def test_long_cells_do_not_widen_their_column():
    long = "w" * (html_text.MAX_PAD + 1)
    assert html_text.render(f"<table><tr><td>{long}<td>b<tr><td>cc<td>d</table>") == f"{long}  b\ncc  d"


def test_tags_with_quotes_and_without_ends():
    r = html_text.render
    assert r("<p title='a>b'>x<p title=\"it's\">y") == "x\n\ny"
    assert r("<p t='q>one <b title=\"x>y\">two</b>") == "<p t='q>one two"
    assert r("a <b c") == "a <b c" and r("a <!-- b") == "a" and r("a <? b> c</ >d") == "a cd" and r("a <!b") == "a <!b"
    assert r("x<b a=\"1\" b='2'/>y</b>") == "xy" and r("<svg><g a=b/>t</svg>z") == "z"


def test_cells_that_span(spark):
    page = "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td colspan=2>f<td>g</table>"
    assert html_text.render(page) == "a  b  c\n   d  e\nf     g"
    rows = [(1, "u", page), (1, "u", page), (2, None, "<p>" + "long " * 200_000)]
    d = spark.createDataFrame(rows, SCHEMA)
    for c in ("text", "n_chars", "n_lines"):
        d = d.withColumn(c, F.lit("clash"))
    got = sorted(html_text.extract(d).collect())
    assert [r["page_id"] for r in got] == [1, 1, 2] and got[0] == got[1] and got[2]["n_chars"] == 5 * 200_000 - 1
