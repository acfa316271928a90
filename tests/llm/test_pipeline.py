"""The pipeline against its stages' decisions stated plainly."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline

BIG = "/root/testdata/sf0.01"


def jaccard_classes(rows):
    sets, cls = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()
    low = {i: i for i in sets}
    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    near = set()
    for group in by.values():
        if len(group) > 1:
            near |= {(a, b) for k, a in enumerate(group) for b in group[:k]}
    links = [(a, b) for a, b in near if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


def test_stages(spark):
    from weftgraph.plans.lineage import written

    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    names = [n for n, _ in pipeline.STAGES]
    assert [n.split("_")[0] for n in names] == ["op5", "op7", "op8", "op6"]
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, BIG))
        kept[name] = docs
        if name != names[-1]:
            assert docs.columns == before.columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    clean, toxic = set(), set()
    for i, t in labels.items():
        (toxic if t else clean).add(i)
    left = {r[0] for r in kept[names[0]].select("doc_id").collect()}
    assert len(clean & left) >= 0.98 * len(clean) and len(toxic & left) <= 0.25 * len(toxic)
    named = kept[names[1]].select("doc_id", "text")
    assert named.count() >= 0.99 * len(left)
    low = jaccard_classes([tuple(r) for r in named.collect()])
    alone = kept[names[2]].select("doc_id", "text").collect()
    assert {r[0] for r in alone} == {i for i, c in low.items() if i == c}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, x in alone:
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [1], dtype="<u4")
        want += [(i, k, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    packed = kept[names[3]]
    assert sorted(tuple(r) for r in packed.select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted(want)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{BIG}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_keep_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(7, text, "a"), (7, text, "a"), (9, text + " end", "b"), (3, other, "c"), (3, "a text of its own under the same id", "d")]
    rows += [(None, "unique and without an id", "e"), (None, text, "f"), (5, "", "g"), (6, None, "h"), (2, other + " x", "i")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = pipeline.near_duplicates(spark, docs, BIG)
    assert got.columns == docs.columns
    assert sorted(r["source"] for r in got.collect()) == ["a", "d", "e", "f", "g", "h", "i"]


def test_odd_documents_through_all_stages(spark, tmp_path):
    from weftgraph.plans.lineage import written

    spark.read.parquet(f"{BIG}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    plain = spark.read.parquet(f"{BIG}/documents.parquet").where("length(text) > 400")
    toxic = {r[0] for r in spark.read.parquet(f"{BIG}/labels.parquet").where("toxic = 1").collect()}
    some = [r for r in plain.where("lang = 'en'").orderBy("doc_id").collect() if r["doc_id"] not in toxic][:3]
    first, second, third = (r["text"] for r in some)
    odd = [
        (None, first + " with no id", "en", None, None), (10**6, None, None, "s", 1), (10**6 + 1, "", "en", "s", 2), (10**6 + 2, " \n\t", None, None, None),
        (10**6 + 3, second, "en", "s", 7), (10**6 + 3, second, "en", "s", 7), (10**6 + 4, second, None, "s", 8),
        (10**6 + 5, (" ".join(reversed(third.split())) + " ") * 300, "en", None, 9), (10**6 + 6, "x" * 300_000, None, None, None), (10**6 + 7, first, "de", "s", 3), (10**6 + 8, "123 !!", "en", "s", 4),
    ]
    docs = spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint").unionByName(plain)
    for i, name in enumerate(("score", "Predicted", "lang_pred", "component_id", "n_shingles", "row_of_near_duplicates")):
        docs = docs.withColumn(name, F.lit(float(i)))
    docs = written(docs)
    before = docs
    for _, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == before.columns
        assert docs.exceptAll(before).isEmpty()  # rows stay as they came, clashing columns too
    kept = [(r["doc_id"], r["lang"], len(r["text"])) for r in docs.where("doc_id >= 1000000 OR doc_id IS NULL").collect()]
    ids = [k[0] for k in kept]
    assert None in ids and 10**6 + 5 in ids and len(ids) == len(set(ids))
    assert not {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3, 10**6 + 4, 10**6 + 7, 10**6 + 8} & set(ids)  # no letter, a copy, another language
    packed = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 4096
