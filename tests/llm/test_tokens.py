"""Token counts, packing and BPE against the tokenizers library and plain versions."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftgraph.llm import packing
from weftgraph.llm.bpe import ByteBpe, bpe_round_trip, chunks_of
from weftgraph.llm.common import Recent
from weftgraph.llm.packing import OpenBins, best_fit_pack, pack_documents
from weftgraph.llm.tokencount import token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")

ODD = [
    None, "", " ", "\n\n", "a", "The the THE", "don't we'll I'M", "x y z", "a\x1cb\x1dc", "  two  spaces \n\n lines\r\n", "tail \n", "İstanbul ΣΣ ß",
    "é café", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", " <|endoftext|>  x", "123 4567 !!! ***", "\U0001f600 mixed 你好", "word " * 6000, "\x00 nul", "\nfirst", "a\n b", "a \nb",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(1, "again", "x", 1), (None, "no id", None, None), (1, "again", "x", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, row int")


def pairs(odd):
    return [(r["doc_id"], r["text"]) for r in odd.collect()]


def test_token_counts_of_odd_texts(odd):
    t = Tokenizer.from_file(WORDS)
    want = sorted((str(i), len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in pairs(odd))
    got = token_counts(odd, WORDS, limit=100).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 100) for r in got)
    assert token_counts(odd.limit(0), WORDS).count() == 0


def test_packing_of_odd_texts(odd):
    t = Tokenizer.from_file(WORDS)
    got = [r.asDict() for r in pack_documents(odd, WORDS, capacity=512).collect()]
    want = []
    for i, x in pairs(odd):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want += [(str(i), k, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes()), tuple(ids[a : a + 512].tolist())) for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == sorted(want)
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) == -(-sum(w[3] for w in want) // 512)
    assert pack_documents(odd.limit(0), WORDS).count() == 0


@given(st.lists(st.integers(1, 100), max_size=200), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_open_bins(lengths, limit):
    """Against a plain list of open bins: the tightest fit, and the fullest closes first."""
    bins, used, open_ = OpenBins(100, limit), {}, []
    for n in lengths:
        fits = [f for f, _ in open_ if f >= n]
        where, offset = bins.place(n)
        assert offset == used.get(where, 0)
        if fits:
            assert 100 - offset == min(fits)
            open_.remove((100 - offset, where))
        else:
            assert offset == 0 and where not in used
        used[where] = offset + n
        if used[where] < 100:
            open_.append((100 - used[where], where))
            if len(open_) > limit:
                # several may be as full; which of them closed shows in the counts only
                free = min(f for f, _ in open_)
                closed = [w for f, w in open_ if f == free and w not in bins.by_free.get(free, [])]
                assert len(closed) == 1
                open_.remove((free, closed[0]))
        assert bins.n_open == len(open_) <= limit


def test_few_sequences_and_a_hot_length(spark):
    pieces = spark.range(5000).selectExpr("id AS row", "0 AS piece", "CASE WHEN id % 3 = 0 THEN 7L ELSE 1 + id * 7919 % 100 END AS length")
    from weftgraph.plans.lineage import written

    packed = best_fit_pack(written(pieces), capacity=100, task_tokens=40_000).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 100
    assert packed.sequence_id.nunique() <= 1.02 * packed.length.sum() / 100 + 8


def test_bpe_of_odd_texts(odd):
    t = Tokenizer.from_file(BYTES)
    want = []
    for i, x in pairs(odd):
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest(), tuple(ids)))
    got = bpe_round_trip(odd, BYTES).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in got) == sorted(want)
    assert sorted(r["decoded"] for r in got) == sorted(x or "" for _, x in pairs(odd))
    assert bpe_round_trip(odd.limit(0), BYTES).count() == 0


BPE, LIBRARY = ByteBpe(BYTES), Tokenizer.from_file(BYTES)


@given(st.text(alphabet=st.one_of(st.sampled_from(list("abe the'sT \n\t\r!1<|endoftext|>")), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_is_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert BPE.encode(text) == want
    assert [i for c in chunks_of(BPE, text) for i in ([BPE.special[c]] if c in BPE.special else BPE.encode(c))] == want
    assert BPE.decode(want) == text


def test_a_cache_is_bounded_in_bytes():
    made = []

    def make(keys):
        made.extend(keys)
        return [k * 2 for k in keys]

    cache = Recent(make, limit=10 * (Recent.SLOT + 300))
    for i in range(200):
        keys = [b"%099d%d" % (i, j) for j in range(4)] + [b"often"]
        assert all(cache.fill(keys)[k] == k * 2 for k in keys)
        assert len(cache.young) + len(cache.old) <= 2 * (11 + 5)
    assert made.count(b"often") == 1 and len(made) == 801
    long = [b"x" * 10_000 + b"%d" % j for j in range(5)]
    assert set(long) <= set(cache.fill(long)) and cache.fill([b"a"])[b"a"] == b"aa" and len(cache.young) == 1


def test_words_in_other_case_or_marks_are_made_once(monkeypatch):
    made = []

    class Noting(Recent):
        def __init__(self, make, *args, **kwargs):
            super().__init__(lambda keys: (made.extend(keys), make(keys))[1], *args, **kwargs)

    monkeypatch.setattr(packing, "Recent", Noting)
    random.seed(4)
    letters = "".join(map(chr, range(0x21, 0x7F))) + "''ssTlLvVeErRdm<|>éÉßÀÿ×÷ÐÞªµ\x01\x1c\x7f\x85İ\u0301\u212a"
    odd = {"".join(random.choice(letters) for _ in range(random.randrange(1, 9))) for _ in range(5000)}
    odd |= {"<|startoftext|>", "a<|endoftext|>B", "<|ENDOFTEXT|>", "DON'T'll", "''s", "x" * 3000, "1" * 300}
    chunks = ["Thaneation", "THANEATION.", "(thaneation)", "Ächtung", "ÄCHTUNG!", "×ächtung", *sorted(odd)]
    known = packing.chunk_encoder.__wrapped__(WORDS).fill([c.encode() for c in chunks])
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.no_truncation()
    for c in chunks:
        assert np.frombuffer(known[c.encode()], "<u4").tolist() == tokenizer.encode(c, add_special_tokens=False).ids
    assert made.count("thaneation") == made.count("ächtung") == 1
