"""Centroid clustering, personal data and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm.centroids import Centroids, centroid_clusters, tame_limit
from weftgraph.llm.pii import KINDS, Homoglyphs, Rewritten, find_pii, identifiers, luhn, rewrite
from weftgraph.llm.queries import op12_pii
from weftgraph.llm.resample import CRC, features, importance_resample, ranked, word_bounds

# ---- centroids ----


def plain_clusters(rows, k, rounds, dims, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), w) for i, w in kept if i is not None)
    c = [w for _, w in start[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda w: min((far(w, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(w)[1] for _, w in kept]
        for j in range(len(c)):
            mine = [w for (_, w), o in zip(kept, of, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    last = [(i, *near(w)[::-1]) for i, w in kept]
    inertia = Counter()
    for _, j, d in last:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    total = sum(inertia.values())
    fits = lambda v: v if v < 2**63 else None
    return sorted((str(i), j, fits(d), fits(inertia[j]), fits(total), sha[j]) for i, j, d in last)


def clusters(df, **named):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in centroid_clusters(df, **named).collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_clusters(spark, parts):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(2) + 3 * (i % 4)]) for i in range(300)] + [(i, [1.0] * 6) for i in range(300, 420)]
    rows += [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 7), (504, [None] * 6), (505, [float("nan")] * 6), (506, [1.0] * 5 + [float("-inf")]), (None, [2.5] * 6), (7, [2.0] * 6), (7, [-9.0] * 6)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id bigint, embedding array<double>, cluster string, i int, e int").repartition(parts)
    assert clusters(df, k=8, rounds=3, dims=6) == plain_clusters(rows, 8, 3, 6)
    assert clusters(df, k=1000, rounds=1, dims=6) == plain_clusters(rows, 1000, 1, 6)
    assert clusters(df.limit(0), k=8, rounds=3, dims=6) == [] == clusters(df, k=8, rounds=1, dims=64)


def test_clusters_beyond_floating_point(spark):
    big = float(tame_limit(3))
    rows = [(0, [1e9, 5.0, -3.0]), (1, [1e9, 5.5, -3.0]), (2, [1.0, 2.0, 3.0]), (3, [big / 256, 0.0, 0.0]), (4, [1.5, 2.0, 3.0]), (5, [-1e12, 1.0, 1.0]), (6, [1e200, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    for k in (1, 2, 3, 7):
        assert clusters(df, k=k, rounds=2, dims=3) == plain_clusters(rows, k, 2, 3)


def test_nearest_is_exact_at_the_bound():
    rng = np.random.default_rng(4)
    limit = tame_limit(64)
    c = Centroids(rng.integers(-limit, limit, size=(5, 64)).tolist() + [[limit + 1] * 64], 64)
    x = rng.integers(-limit, limit, size=(50, 64)).astype(float)
    x[::7] *= 3
    label, far = c.nearest(x)
    for i, row in enumerate(x.tolist()):
        want = min((sum((int(a) - b) ** 2 for a, b in zip(row, m, strict=True)), j) for j, m in enumerate(c.rows))
        assert (far[i], label[i]) == want


# ---- personal data ----

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return [f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def spans(text, base):
    return [f"{k}:{a}:{b}" for a, b, k, is_base, _ in identifiers(text, Homoglyphs()) if is_base or not base]


def test_luhn():
    assert luhn("4111111111111111") and luhn("79927398713") and not luhn("4111111111111112")


def test_base_spans_of_random_texts():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "B", "7", "0", "12", "255", "256", "4111", ".", ".", "@", "@", "-", " ", "+", "(", ")", "%", "é", "\n"]) for _ in range(rng.randint(0, 40)))
        assert spans(text, True) == plain_base(text), text
    for text in ["4111 1111 1111 1111", "4111-1111-1111-1111 0", "+1 (771) 555-1655 on", "1.2.3.4.5.6.7.8.9", "001.02.3.0255", "a@b@c.d", "x@y.z@w.v", "a@b.c." * 5, "@" * 50, "1." * 100, "0" * 4000 + ".1.2.3"]:
        assert spans(text, True) == plain_base(text), text


@pytest.mark.parametrize(("text", "kind", "shown", "value"), [
    ("write to jоhn.dое@ехample.com now", "email", "jоhn.dое@ехample.com", "john.doe@example.com"),
    ("write to jane (at) example [dot] org now", "email", "jane (at) example [dot] org", "jane@example.org"),
    ("write to jane at example dot co dot uk now", "email", "jane at example dot co dot uk", "jane@example.co.uk"),
    ("ask nine at example dot com, one two three", "email", "nine at example dot com", "nine@example.com"),
    ("jane[@]example[.]org", "email", "jane[@]example[.]org", "jane@example.org"),
    ("ja​ne＠example.org", "email", "ja​ne＠example.org", "jane@example.org"),
    ("jane @ nothing, jane{AT}mail7.example.org.", "email", "jane{AT}mail7.example.org", "jane@mail7.example.org"),
    ("host 192[.]168[.]0[.]1 up", "ip", "192[.]168[.]0[.]1", "192.168.0.1"),
    ("host 10 dot 0 dot zero dot one-two up", "ip", "10 dot 0 dot zero dot one-two", "10.0.0.12"),
    ("host １０.20.30.40 up", "ip", "１０.20.30.40", "10.20.30.40"),
    ("call plus one five five five, two three four five six seven eight ok", "phone", "plus one five five five, two three four five six seven eight", "+15552345678"),
    ("call +1 (555) five five five-double one double two ok", "phone", "+1 (555) five five five-double one double two", "+1 (555) 5551122"),
    ("ruf +49 null drei null 555 1234 an", "phone", "+49 null drei null 555 1234", "+49 030 555 1234"),
    ("card 4l11 1111 llll IIII end", "card", None, None),
    ("card 4l11 1111 11l1 I111 end", "card", "4l11 1111 11l1 I111", "4111 1111 1111 1111"),
    ("card four one one one 1111 1111 one one one one", "card", "four one one one 1111 1111 one one one one", "4111 1111 1111 1111"),
    ("card ٤١١١ ١١١١ ١١١١ ١١١١", "card", "٤١١١ ١١١١ ١١١١ ١١١١", "4111 1111 1111 1111"),
])
def test_disguises(text, kind, shown, value):
    got = [(text[a:b], k, read) for a, b, k, base, read in identifiers(text, Homoglyphs()) if k == kind and not (base and read == text[a:b] and shown != read)]
    assert got == ([(shown, kind, value)] if shown else [])


@pytest.mark.parametrize("text", [
    "meet me at home. Then go.", "arrive at 5.30 pm", "look at example.com please", "one of two at three dots", "call +1 (555) 555-1655 one of these days", "plus one and two", "né à l'été à 12.30",
    "zero one two three four five six seven eight nine ten", "lol1 is 1O1", "Der Punkt ist null und nichtig", "at dot at dot", "a@b.c dot", "version 1.2 point four",
])
def test_clean_texts_gain_nothing(text):
    assert spans(text, False) == plain_base(text)


def test_spans_map_back_through_stages():
    a = rewrite("xx one yy", re.compile("one"), lambda m: "1")
    b = rewrite(a.text, re.compile("yy"), lambda m: "zzzz")
    assert (a.text, b.text) == ("xx 1 yy", "xx 1 zzzz")
    assert b.source(3, 4) == (3, 4, False) and a.source(3, 4) == (3, 6, True)
    assert b.source(6, 8) == (5, 7, True) and a.source(5, 7) == (7, 9, False)
    assert Rewritten("abc").source(1, 2) == (1, 2, False)
    gone = rewrite("a-b", re.compile("-"), lambda m: "")
    assert gone.text == "ab" and gone.source(0, 2) == (0, 3, True)


def test_pii_of_a_table(spark):
    texts = [None, "", " ", "mail a@b.cc and a@b.cc", "mail a (at) b.cc", "x" * 300_000 + "@", "@" * 200_000, "1" * 300_000, "1." * 100_000, "+1" + " " * 300_000, "one " * 60_000, "a at " * 60_000, "а" * 200_000, "O0" * 100_000, "[dot]" * 50_000]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "9.9.9.9", "k", 2), (3, "9.9.9.9", "k", 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, i int").repartition(3)
    got = {(r["doc_id"], i): r["pii"] for i, r in enumerate(find_pii(df).orderBy("doc_id", "pii").collect())}
    of = {}
    for (i, _), found in got.items():
        of.setdefault(i, []).append([(x["kind"], x["start"], x["end"], x["base"], x["text"], x["value"]) for x in found])
    assert len(got) == len(rows) and of[0] == of[1] == of[2] == [[]]
    assert of[None] == [[("ip", 0, 7, True, "9.9.9.9", "9.9.9.9")]]
    assert sorted(map(len, of[3])) == [1, 2] and of[4] == [[("email", 5, 16, False, "a (at) b.cc", "a@b.cc")]]
    assert [len(of[i][0]) for i in range(5, 8)] == [0, 0, 0] and len(of[8][0]) == 25_000
    assert find_pii(df.limit(0)).count() == 0


def test_pii_query(spark, data):
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = op12_pii(spark, data).collect()
    assert len(got) == len(text)
    for r in got:
        base = plain_base(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s.startswith(f"{k}:") for s in base) for k in KINDS]
        assert set(base) <= set(r["spans"].split(",")) | {""} and r["n_disguised"] == (len(r["spans"].split(",")) if r["spans"] else 0) - len(base)
    assert sum(r["n_email"] + r["n_ip"] + r["n_phone"] for r in got) > 0


# ---- resampling ----

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, width, buckets=10_000):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + r]) for r in range(1, width + 1) for i in range(len(words) - r + 1)]
    return len(words), [zlib.crc32(x.encode()) % buckets for x in runs]


def plain_resample(rows, target, width=1, least=20, percent=10):
    docs, goal = [(i, *plain_features(t, width)) for i, t in rows], [plain_features(t, width)[1] for t in target]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for f in goal for b in f)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in set(s) | set(t)}
    out, able = [], []
    for i, n, f in docs:
        w = sum(gain[b] for b in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            able += [(-score, i)] * (n >= least)
        out.append([i, len(f), w, score, n >= least])
    order = sorted(able)[: len(able) * percent // 100]
    places = {}
    for r, key in enumerate(order, 1):
        places.setdefault(key, []).append(r)
    return sorted(str((i, n, w, s, places[(-s, i)].pop(0) if ok and s is not None and places.get((-s, i)) else None)) for i, n, w, s, ok in out)


def resampled(df, target, **named):
    return sorted(str(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank"))) for r in importance_resample(df, target, **named).collect())


def texts_of(rng, n):
    words = ["The", "the", "a", "été", "x1", "Zürich", "日本", "foo-bar", "it's", "@", "q" * 70, "ab", "ß", "\U0001f600"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("width", [1, 2, 3])
def test_features_of_joined_texts(width):
    rng = random.Random(width)
    texts = [*texts_of(rng, 50), "", "word", "word", "ends", "", "x" * 5000 + "Y", "é"]
    col = pa.array(texts, pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)
    got = [[] for _ in texts]
    for text, bucket, words in features(data, offsets, width, 10_000):
        for i, b in zip(text.tolist(), bucket.tolist(), strict=True):
            got[i].append(b)
    assert got == [plain_features(t, width)[1] for t in texts]
    assert words.tolist() == [plain_features(t, width)[0] for t in texts]
    assert len(word_bounds(np.zeros(0, np.uint8), np.array([0, 0]))[0]) == 0


def test_crc_table():
    c = 0xFFFFFFFF
    for b in b"any bytes":
        c = int(CRC[(c ^ b) & 255]) ^ (c >> 8)
    assert c ^ 0xFFFFFFFF == zlib.crc32(b"any bytes")


@pytest.mark.parametrize("width", [1, 2])
def test_resampling(spark, width):
    rng = random.Random(9)
    rows = list(enumerate(texts_of(rng, 400))) + [(1000, None), (1001, ""), (1002, "one two"), (None, "many words " * 30), (5, "again " * 25), (5, "again " * 25), (1003, "W" * 300_000), (1004, "long text here " * 40_000)]
    target = ["the the a été"] * 20 + [None, "", "zürich x1 日本"]
    df = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], "doc_id bigint, text string, rank int, row int, source string").repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert resampled(df, goal, width=width) == plain_resample(rows, target, width)
    assert resampled(df, goal.limit(0), width=width, percent=100) == plain_resample(rows, [], width, percent=100)
    assert resampled(df.limit(0), goal) == []


def test_places_over_ranges(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS score").repartition(5)
    got = ranked(df, "score DESC", "id").orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in got] == list(enumerate(sorted(range(1000), key=lambda i: (-(i % 3), i)), 1))
