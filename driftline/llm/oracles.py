"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import quality_rules as q

_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {k}, 5) AS bigint) >> {s}) & 31), 1)" for k in range(1, 41, 5) for s in (15, 10, 5, 0))

_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]+)?([^#]*)"

OP1 = rf"""WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS bigint) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
  regexp_matches(coalesce(url, ''), '{_URL}') AS whole, regexp_replace(lower(regexp_extract(coalesce(url, ''), '{_URL}', 1)), '^www[0-9]*\.', '') AS host, regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path, lower(string_split(coalesce(url, ''), '#')[1]) AS bare FROM pages),
k AS (SELECT *, CASE WHEN whole THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END ELSE bare END AS url_key, strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0) % 3155760000), '%Y%m%d%H%M%S') AS captured FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to,
  url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS place FROM k"""

_BARE = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"
_STRATUM = "CASE " + " ".join(f"WHEN n_words < {b} THEN {k}" for k, b in enumerate(q.BANDS)) + f" ELSE {len(q.BANDS)} END"
_LEVEL = q.DELTA / (len(q.BANDS) + 1)
_PARTS = lambda w: [" + ".join(f"b{i}" for i in range(len(w)) if w[i] == x) for x in sorted(set(w))]
_WAY = "CASE " + " ".join(f"WHEN {' AND '.join(f'{p} >= {q.least_holdout(q.RISK, q.DELTA)}' for p in _PARTS(w))} THEN {w}" for w in q.joinings()) + f" ELSE [{', '.join(['NULL'] * (len(q.BANDS) + 1))}] END"
_TUNE = f"CAST('0x' || substr(h, 1, 2) AS int) % {q.TUNING} = 0"
_STEPS = ", ".join([f"(max(bin) + ({q.GRID} - max(bin)) * {x}) / {q.GRID}" for x in q.SLACK] + [f"min(CASE WHEN below >= {1 - x!r} * total THEN bin END) / {q.GRID}" for x in q.TAILS])
_UNDER = " UNION ALL ".join(f"SELECT h, stratum, '{r}' AS rule, {r} AS val FROM hd" for r in q.RULES)

OP6 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, md5(coalesce(text, '')) AS h, {_WORDS.format(text='text')} AS w, {_BARE} AS bare, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM win CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY 1),
m AS (SELECT doc_id, d.rid, h, CAST(len(w) AS bigint) AS n_words, CAST(length(bare) AS bigint) AS word_chars, CAST(length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS bigint) AS n_repeat_words, len(lines) AS n_lines,
  length(bare) - length(regexp_replace(bare, '[A-Z]', '', 'g')) AS n_upper, length(bare) - length(replace(bare, '!', '')) AS n_bang FROM d LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_STRATUM} AS stratum, n_symbols / greatest(word_chars, 1) AS symbol_share, n_upper / greatest(word_chars, 1) AS upper_share, n_bang / greatest(word_chars, 1) AS bang_share, n_repeat_words / greatest(n_words, 1) AS repeat_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share FROM m),
clean AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(coalesce(quality, 0)) = 1),
own AS (SELECT DISTINCT h, stratum, {', '.join(q.RULES)} FROM b JOIN clean USING (doc_id) WHERE NOT base_failed),
sz AS (SELECT {', '.join(f'count(*) FILTER (NOT ({_TUNE}) AND stratum = {i}) AS b{i}' for i in range(len(q.BANDS) + 1))} FROM own), mp AS (SELECT unnest(range({len(q.BANDS) + 1})) AS band, unnest({_WAY}) AS part FROM sz),
hd AS (SELECT own.* REPLACE (part AS stratum) FROM own JOIN mp ON mp.band = own.stratum WHERE part IS NOT NULL),
u AS (SELECT *, {_TUNE} AS tune FROM ({_UNDER})),
bins AS (SELECT stratum, rule, CAST(ceil(val * {q.GRID}) AS bigint) AS bin, count(*) AS c FROM u WHERE tune GROUP BY 1, 2, 3),
run AS (SELECT *, sum(c) OVER (PARTITION BY stratum, rule ORDER BY bin) AS below, sum(c) OVER (PARTITION BY stratum, rule) AS total FROM bins),
st AS (SELECT stratum, rule, [{_STEPS}] AS steps FROM run GROUP BY 1, 2),
cu AS (SELECT stratum, rule, unnest(steps) AS cutoff, unnest(range(len(steps))) AS step FROM st),
ov AS (SELECT u.stratum, u.h, step, bool_or(val > cutoff) AS over FROM u JOIN cu USING (stratum, rule) WHERE NOT tune GROUP BY 1, 2, 3),
k AS (SELECT stratum, step, count(*) AS n, sum(CAST(over AS bigint)) AS k FROM ov GROUP BY 1, 2),
t AS (SELECT *, k < n * {q.RISK} AND (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({q.RISK}) + (n - i) * ln(1 - {q.RISK}))) FROM range(0, CAST(k AS bigint) + 1) r(i)) <= {_LEVEL!r} AS holds FROM k),
s AS (SELECT stratum, coalesce(min(CASE WHEN NOT holds THEN step END), count(*)) - 1 AS step FROM t GROUP BY 1),
c AS (SELECT mp.band AS stratum, cu.rule, cu.cutoff FROM mp JOIN s ON s.stratum = mp.part JOIN cu ON cu.stratum = s.stratum AND cu.step = s.step),
o AS (SELECT rid, bool_or(CASE c.rule {' '.join(f"WHEN '{r}' THEN {r}" for r in q.RULES)} END > cutoff) AS over FROM b JOIN c USING (stratum) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(over, false) AS kept FROM b LEFT JOIN o USING (rid)"""

OP7 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i : least(i + 4, len(w))], ' ') AS sh FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid <> b.rid GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS bigint) AS n_shingles, min(o.doc_id) AS component_id FROM d LEFT JOIN n USING (rid) JOIN r ON r.x = d.rid JOIN d o ON o.rid = r.y GROUP BY d.rid, d.doc_id"""

_NGRAM = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP11 = rf"""WITH RECURSIVE tab AS (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) r(i)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_NGRAM} AS w, true AS mine FROM documents UNION ALL SELECT -1 - row_number() OVER (), NULL, {_NGRAM}, false FROM benchmark),
tok AS (SELECT rid, mine, i, w, lead(w, 1) OVER q AS x, lead(w, 2) OVER q AS y FROM (SELECT rid, mine, unnest(w) AS w, unnest(range(len(w))) AS i FROM d) WINDOW q AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT rid, mine, w AS f FROM tok UNION ALL SELECT rid, mine, w || ' ' || x FROM tok WHERE x IS NOT NULL UNION ALL SELECT rid, mine, w || ' ' || x || ' ' || y FROM tok WHERE y IS NOT NULL),
c AS (SELECT f, hex(encode(f)) AS hx, 0 AS k, 4294967295::bigint AS crc FROM (SELECT DISTINCT f FROM f) UNION ALL SELECT f, hx, k + 1, xor(crc >> 8, tab.v) FROM c JOIN tab ON tab.i = xor(crc & 255, CAST('0x' || substr(hx, 2 * k + 1, 2) AS bigint)) WHERE 2 * k < length(hx)),
b AS (SELECT f, xor(crc, 4294967295) % 10000 AS bucket FROM c WHERE 2 * k = length(hx)),
n AS (SELECT bucket, count(*) FILTER (mine) AS s, count(*) FILTER (NOT mine) AS t FROM f JOIN b USING (f) GROUP BY 1),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::double * ((SELECT sum(s) FROM n) + 10000)::double / ((s + 1)::double * ((SELECT sum(t) FROM n) + 10000)::double))) AS bigint) AS gain FROM n),
w AS (SELECT rid, count(*) AS n, sum(gain) AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE mine GROUP BY 1),
o AS (SELECT rid, doc_id, len(d.w) >= 20 AS long_enough, CAST(coalesce(n, 0) AS bigint) AS n_features, CAST(coalesce(weight, 0) AS bigint) AS weight, CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS varchar), '')), 1, 8) AS bigint) AS h FROM d LEFT JOIN w USING (rid) WHERE mine),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) AS bigint) AS score FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY long_enough ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY long_enough) AS all_of FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN long_enough AND place <= 5 * all_of // 100 THEN place END AS rank FROM r"""


def _rounds() -> str:
    """The assignments and the next centroids of each round, one after another."""
    out = []
    for r in range(4):
        out.append(f"a{r} AS (SELECT rid, min(d) AS distance, arg_min(c, d * 16 + c) AS cluster FROM (SELECT rid, c, sum((x.x - k.x) * (x.x - k.x)) AS d FROM x JOIN c{r} k USING (dim) GROUP BY 1, 2) GROUP BY 1)")
        if r < 3:
            out.append(f"m{r} AS (SELECT cluster AS c, dim, sum(x) AS s, count(*) AS n FROM x JOIN a{r} USING (rid) GROUP BY 1, 2)")
            out.append(f"c{r + 1} AS (SELECT k.c, k.dim, CASE WHEN n IS NULL THEN k.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} k LEFT JOIN m{r} m ON m.c = k.c AND m.dim = k.dim)")
    return ",\n".join(out)


OP13 = f"""WITH v AS (SELECT row_number() OVER () AS rid, vec_id, embedding, sha256('1:' || coalesce(CAST(vec_id AS varchar), '')) AS h, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS double)) AS bigint)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
x AS (SELECT rid, unnest(v) AS x, unnest(range(64)) AS dim FROM v),
c0 AS (SELECT c, unnest(v) AS x, unnest(range(64)) AS dim FROM (SELECT row_number() OVER (ORDER BY h, embedding) - 1 AS c, v FROM v) WHERE c < 16),
{_rounds()},
s AS (SELECT c AS cluster, sha256(string_agg(CAST(CAST(x AS bigint) AS varchar), ',' ORDER BY dim)) AS centroid_sha256 FROM c3 GROUP BY 1)
SELECT vec_id, CAST(cluster AS int) AS cluster, CAST(distance AS bigint) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS bigint) AS cluster_inertia, CAST(sum(distance) OVER () AS bigint) AS inertia, centroid_sha256 FROM a3 JOIN v USING (rid) JOIN s USING (cluster)"""

SQL: dict[str, str] = {"op1_warc_histories": OP1, "op6_quality_rules": OP6, "op7_ngram_join": OP7, "op11_importance_resampling": OP11, "op13_centroids": OP13}
