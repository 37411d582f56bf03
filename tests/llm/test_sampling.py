"""Resampling, token counts and centroids against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import centroids, importance, token_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, weight string, rank int, __row string"


def ngrams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = ["Alpha", "beta", "éa", "日本", "x9", "the", "of", "9", "longword" * 40, "Ω"]
    out = [(i, " ".join(rng.choice(vocab) + rng.choice(["", ",", "!"]) for _ in range(rng.randint(1, 60)))) for i in range(90)]
    return out + [(90, None), (91, ""), (92, "--- \n"), (93, "One"), (94, "one two"), (None, out[3][1]), (None, out[3][1]), (5, out[5][1]), (96, " ".join(rng.choice(vocab) for _ in range(20000)))]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1, "r") for i, t in texts], SCHEMA).repartition(4).persist()


def test_crcs_of_runs():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc é日9") for _ in range(rng.randint(0, 300))) for _ in range(40)] + ["", "a", "é" * 70000 + " b"]
    raw = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]).astype(np.int64)
    ids, n, words = importance.features(buf, offs)
    at = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        w, f = ngrams(t)
        assert words[i] == len(w) and sorted(ids[at[i] : at[i + 1]].tolist()) == sorted(zlib.crc32(x.encode()) % 10000 for x in f)


def expected_draw(texts, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for _, x in rows for f in ngrams(x)[1]) for rows in (texts, target))
    S, T = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, x in texts:
        w, f = ngrams(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= 20))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    place = {}
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        place.setdefault(r[:4], []).append(k + 1)
    return Counter((*r[:4], place[r[:4]].pop(0) if place.get(r[:4]) else None) for r in rows)


def test_resampling_against_a_plain_count(spark, docs, texts):
    target = [(0, "alpha beta, alpha beta the"), (1, None), (2, "日本 of x9 of x9")]
    got = importance.resample(docs, spark.createDataFrame(target, "item_id long, text string"))
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    rows = Counter(tuple(r) for r in got.collect())
    assert rows == expected_draw(texts, target) and sum(r[4] is not None for r in rows) >= 3


def test_resampling_of_empty_tables(spark, docs, texts):
    none = spark.createDataFrame([], SCHEMA)
    assert importance.resample(none, docs).count() == 0
    got = importance.resample(docs, none.select("text"))
    assert Counter(tuple(r) for r in got.collect()) == expected_draw(texts, [])


def test_places_are_one_order(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("a"), "id", F.lit("x").alias("place_")).repartition(9)
    got = importance.numbered(df, F.col("a").desc(), F.col("id")).collect()
    want = sorted(range(5000), key=lambda i: (-(i % 7), i))
    assert [r["id"] for r in sorted(got, key=lambda r: r["place"])] == want and sorted(r["place"] for r in got) == list(range(5000))


HARD = ["", " ", "  ", "a", " a", "a  b ", "\n\n a\nb", "<s> </s> <unk>", "▁a ▁▁ b", "ｆｏｏ日本語のテキスト", "é​", "\x00a\tb", "don't 12345,67 <|endoftext|>", "a" * 5000, "日本" * 3000, " " * 4000 + "x", "\n" * 3000]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_are_those_of_whole_texts(spark, name, monkeypatch):
    path = pytest.importorskip("public_tokenizers").path(name)
    rng = random.Random(2)
    parts = ["the", "Straße", " ", "  ", "\n", "日本", "12", ".", "naïve", "tokens", "\t", "'s", "ing"]
    texts = HARD + ["".join(rng.choice(parts) + " " * (rng.random() < 0.6) for _ in range(n)) for n in (10, 300, 4000)]
    if name.endswith(".model"):
        import sentencepiece

        plain = sentencepiece.SentencePieceProcessor(model_file=path)
        want = [len(plain.encode(t)) for t in texts]
    else:
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(path)
        want = [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    counter = token_counts.open_counter(path)
    for part, batch in ((1 << 15, 1 << 20), (50, 300), (7, 1), (1, 50)):
        monkeypatch.setattr(token_counts, "PART", part)
        monkeypatch.setattr(token_counts.cuts, "__defaults__", (part,))
        assert token_counts.lengths(counter, texts, len(texts), batch).tolist() == want
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (3, "a", "y"), (3, "a", "y")]
    got = token_counts.count(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), path, 1000)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    tail = [(None, 0, 0, False), (3, 1, want[3], False), (3, 1, want[3], False)]
    assert Counter(tuple(r) for r in got.collect()) == Counter([(i, len(t.encode()), k, k > 1000) for i, (t, k) in enumerate(zip(texts, want))] + tail)
    assert token_counts.count(spark.createDataFrame([], "doc_id string, text string"), path).count() == 0


def test_unknown_tokenizer_files():
    with pytest.raises(ValueError):
        token_counts.open_counter("x.bin")


def test_long_texts_are_cut_in_time():
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    counter = token_counts.open_counter(path)
    found, extra = counter.parts("word " * 400_000)
    assert max(map(len, found)) < token_counts.PART + 10 and extra == counter.head * (len(found) - 1)


def lloyd(rows, clusters, rounds):
    V = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    C = [v for _, v in sorted(V, key=key)[:clusters]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((gap(v, c), k) for k, c in enumerate(C))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in V]
        C = [[sum(col) // len(col) for col in zip(*m)] if (m := [v for (_, v), o in zip(V, own) if o == k]) else c for k, c in enumerate(C)]
    out = [(i, near(v)[1], near(v)[0]) for i, v in V]
    sums = Counter()
    for _, k, d in out:
        sums[k] += d
    return Counter((i, k, d, sums[k], sums.total(), hashlib.sha256(",".join(map(str, C[k])).encode()).hexdigest()) for i, k, d in out)


def test_clusters_against_a_plain_loop(spark):
    rng = random.Random(9)
    center = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in center[i % 6]]) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(150, 200)]  # ties and copies
    rows += [(0, rows[1][1]), (0, rows[1][1]), (None, rows[2][1]), (300, None), (301, []), (302, [0.1] * 63), (303, [0.1] * 65), (304, [0.1] * 63 + [None]), (305, [0.1] * 63 + [float("nan")]), (306, [float("-inf")] + [0.1] * 63), (307, [-1 / 64] * 64)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, cluster string").repartition(5)
    got = centroids.cluster(df)
    assert got.dtypes == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert Counter(tuple(r) for r in got.collect()) == lloyd(rows, 16, 3)
    few = df.where("vec_id < 5")
    assert Counter(tuple(r) for r in centroids.cluster(few).collect()) == lloyd([r for r in rows if r[0] is not None and r[0] < 5], 16, 3)
    assert centroids.cluster(df.where("vec_id = 302")).count() == 0
    assert centroids.cluster(df.limit(0)).count() == 0


def test_partial_distances_are_whole_ones_and_leave_early():
    rng = np.random.default_rng(4)
    V = rng.integers(-40, 40, (500, 64)) * (np.arange(64) < 8) + rng.integers(-1, 2, (500, 64))
    C = np.vstack([V[:10], V[:3]])
    D = ((V[:, None] - C[None]) ** 2).sum(2)
    order = np.argsort(-V.var(0), kind="stable")
    for step in (1, 8, 64):
        c, d = centroids.nearest(V, C, order, step)
        assert (c == D.argmin(1)).all() and (d == D.min(1)).all()  # argmin takes the first of ties
    assert set(order[:8]) == set(range(8))
