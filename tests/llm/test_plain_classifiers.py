"""Quality and language scores against versions in plain Python, from the text to the score."""

import math
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm.gbt import fit_trees
from weftgraph.llm.langid import identify_language
from weftgraph.llm.quality import STATISTICS, score_quality, statistics_of

# ---- language ----


def plain_grams(text):
    out, word = Counter(), ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            shown = f" {word} "
            out.update(word)
            out.update(shown[i : i + 2] for i in range(len(shown) - 1))
            out.update(shown[i : i + 3] for i in range(len(shown) - 2))
            word = ""
    return out


def plain_top(counts, size=300):
    packed = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], packed(g)))[:size]


def plain_language(rows, learn, size=300):
    profiles = {}
    for lang in sorted({g for _, _, g in learn if g is not None}):
        total = Counter()
        for i, t, g in learn:
            if g == lang and i is not None and t is not None:
                total += plain_grams(t)
        profiles[lang] = {g: r for r, g in enumerate(plain_top(total, size))}
    out = []
    for i, t in rows:
        mine = plain_top(plain_grams(t), size)
        if not mine or not profiles:
            out.append((i, "und", 0.0))
            continue
        far = {lang: sum(abs(p[g] - r) if g in p else size for r, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(far, key=lambda x: (far[x], x))
        out.append((i, best, 1 - far[best] / (size * len(mine))))
    return out


def test_language_of_plain_profiles(spark):
    learn = [
        (1, "the cat and the dog in the house; they're friends", "en"), (2, "Der Hund und die Katze im Häuschen, das ist schön", "de"), (3, "le chat et le chien dans la maison, ça va", "fr"),
        (4, "the the the", "en"), (5, None, "fr"), (6, "no language", None), (None, "no id der die das", "de"), (7, "12 34 !!", "es"), (8, "the cat and the dog", "en"), (8, "the cat and the dog", "en"), (9, "ΑΒΓ αβγ 日本語 дом", "xx"),
    ]
    texts = [None, "", "  \n", "42 !?", "the dog", "die Katze", "la maison", "ß", "ǅ İ", "日本", "a", "the " * 50_000, "Der-Hund_und  the", "x" * 100_000]
    rows = list(enumerate(texts)) + [(None, "the house"), (3, "le chien")]
    docs = spark.createDataFrame([(*r, "kept", 1) for r in rows], "doc_id bigint, text string, lang string, score int").repartition(3)
    table = spark.createDataFrame(learn, "doc_id bigint, text string, lang string")
    known = [r for r in learn]
    got = sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in identify_language(docs, table).collect())
    want = sorted((str(i), g, s) for i, g, s in plain_language(rows, known))
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    none = identify_language(docs, table.limit(0)).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


# ---- quality ----


def plain_statistics(text):
    text = text or b""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    size, n = len(text), len(words)
    is_letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    letters = max(1, sum(map(is_letter, text)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda holds: sum(map(holds, text)) / size
    return [
        math.log1p(size), math.log1p(n), sum(len(w) for w in words) / n, sum(65 <= c <= 90 for c in text) / letters, share(lambda c: 48 <= c <= 57), share(lambda c: c >= 128),
        share(lambda c: 32 < c < 128 and not is_letter(c) and not 48 <= c <= 57), text.count(b"|") / n, sum(text.count(x) for x in (b"*", b"#", b"$", b"%", b"&")) / n, text.count(b"!") / n,
        (text.count(b".") + text.count(b",")) / n, len(set(words)) / n, max(words.count(w) for w in set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, math.log1p(len(lines)), n / len(lines),
        len(set(lines)) / len(lines), sum(w[-1:] in (b"*", b"#", b"$", b"%", b"&", b"@", b"^", b"~", b"|", b"!") for w in words) / n, sum(w.isupper() and len(w) > 1 for w in words) / n, math.log1p(max(len(w) for w in words)),
    ]


TEXTS = [None, b"", b" \n", b"one", b"A b a b.\nA b a b.\n\nSHOUT!! $$$ x| x| 42", "Ünï größe ÄÖ".encode(), b"same same same other", b"\xff\xfe raw", b"w" * 5000 + b" end!", b"l1\nl2\nl1\n"]


def test_statistics():
    for text in TEXTS:
        assert statistics_of(text) == pytest.approx(plain_statistics(text)), text


def plain_boosting(x, y, n_trees=60, depth=3, bins=64, rate=0.15, least=5, ridge=1.0):
    """Each split by trying every feature and every cut."""
    n, width = len(x), len(x[0])
    share = (sum(y) + 0.5) / (n + 1)
    base = math.log(share / (1 - share))
    cuts = [np.unique(np.quantile([r[j] for r in x], np.linspace(0, 1, bins + 1)[1:-1])).tolist() for j in range(width)]
    trees, margin = [], [base] * n

    def grow(rows, g, h, d):
        gs, hs = sum(g[i] for i in rows), sum(h[i] for i in rows)
        node = {"value": -rate * gs / (hs + ridge)}
        if d == depth or len(rows) < 2 * least:
            return node
        best = None
        for j in range(width):
            for c in cuts[j]:
                left = [i for i in rows if x[i][j] <= c]
                if len(left) < least or len(rows) - len(left) < least:
                    continue
                a, b = sum(g[i] for i in left), sum(h[i] for i in left)
                gain = a * a / (b + ridge) + (gs - a) ** 2 / (hs - b + ridge) - gs * gs / (hs + ridge)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, j, c, left)
        if best is None or best[0] <= 1e-6:
            return node
        _, node["j"], node["cut"], left = best
        inside = set(left)
        node["left"], node["right"] = grow(left, g, h, d + 1), grow([i for i in rows if i not in inside], g, h, d + 1)
        return node

    def of(node, r):
        while "j" in node:
            node = node["left"] if r[node["j"]] <= node["cut"] else node["right"]
        return node["value"]

    if 0 < sum(y) < n:
        for _ in range(n_trees):
            p = [1 / (1 + math.exp(-m)) for m in margin]
            tree = grow(list(range(n)), [a - b for a, b in zip(p, y)], [a * (1 - a) for a in p], 0)
            trees.append(tree)
            margin = [m + of(tree, r) for m, r in zip(margin, x)]
    return lambda r: 1 / (1 + math.exp(-max(-50, min(50, base + sum(of(t, r) for t in trees)))))


def test_boosting_against_every_split():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(70, 3))
    y = ((x[:, 0] > 0.1) ^ (x[:, 1] > 0.3)).astype(float)
    score = plain_boosting(x.tolist(), y.tolist(), n_trees=5, bins=8)
    fresh = rng.normal(size=(200, 3))
    got = fit_trees(x, y, n_trees=5, bins=8).probability(fresh)
    assert got.tolist() == pytest.approx([score(r) for r in fresh.tolist()])


def test_quality_from_text_to_score(spark):
    rng = np.random.default_rng(8)
    bad = ["$$$", "!!!", "BUY", "now|", "***", "x"]
    good = ["river", "stone", "walks", "quiet,", "evening.", "old"]
    texts = [" ".join(rng.choice(bad if i % 3 == 0 else good, size=int(rng.integers(3, 30)))) for i in range(48)] + [None, "", "word " * 30_000]
    rows = list(enumerate(texts)) + [(None, "no id"), (2, "river stone")]
    labels = [(i, int(i % 3 != 0)) for i in range(36)] + [(40, None), (None, 1), (5, 1), (99, 0)]
    docs = spark.createDataFrame([(*r, 1.5, "x") for r in rows], "doc_id bigint, text string, score double, stats string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id bigint, quality int")
    # of a repeated id the smaller statistics are learned from, with its greatest label
    learned = {}
    for i, t in rows:
        if i is not None and i in dict(x for x in labels if x[1] is not None):
            s = plain_statistics(t.encode() if t else t)
            learned[i] = min(s, learned.get(i, s))
    y = {i: max(q for k, q in labels if k == i and q is not None) for i in learned}
    # splits of equal gain abound in so small a table, so the trees are the library's, walked plainly
    trees = fit_trees(np.array([learned[i] for i in sorted(learned)]), np.array([y[i] for i in sorted(learned)], dtype=float))

    def score(r):
        total = trees.base
        for node in trees.roots.tolist():
            while trees.left[node] != node:
                node = int(trees.left[node]) + (r[trees.feature[node]] > trees.cut[node])
            total += trees.value[node]
        return 1 / (1 + math.exp(-total))

    got = sorted((str(r["doc_id"]), r["score"], r["predicted"]) for r in score_quality(docs, table).collect())
    want = sorted((str(i), score(plain_statistics(t.encode() if t else t))) for i, t in rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)
    assert all(g[2] == (g[1] >= 0.3) for g in got)
