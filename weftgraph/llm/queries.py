"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.bpe import bpe_round_trip
from weftgraph.llm.centroids import centroid_clusters
from weftgraph.llm.common import in_fold, table
from weftgraph.llm.jaccard import jaccard_components
from weftgraph.llm.langid import identify_language
from weftgraph.llm.lm import score_texts
from weftgraph.llm.neardup import embedding_near_duplicates
from weftgraph.llm.packing import pack_documents
from weftgraph.llm.pii import KINDS, count_of, find_pii, listed
from weftgraph.llm.quality import score_quality
from weftgraph.llm.resample import importance_resample
from weftgraph.llm.tokencount import token_counts
from weftgraph.llm.topk import exact_top_k
from weftgraph.llm.toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold(F.col("doc_id"), 5, 0)
    learn = table(spark, sf_dir, "labels").where(~held_out)
    scored = score_quality(table(spark, sf_dir, "documents"), learn, threshold=0.3)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold(F.col("doc_id"), 3, 1)
    learn = table(spark, sf_dir, "labels").where(~held_out)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, learn, threshold=0.7).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = in_fold(F.col("doc_id"), 3, 1)
    named = identify_language(docs.select("doc_id", "text"), docs.where(~held_out))
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), percent=85, width=4)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = in_fold(F.col("doc_id"), 7, 2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id").isNotNull() & ~held_out).alias("learn"))
    return score_texts(docs, "learn").withColumn("held_out", held_out)


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=())


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, seed="2:")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, pii = find_pii(table(spark, sf_dir, "documents")), F.col("pii")
    return found.select(
        "doc_id", *[count_of(pii, k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(pii, base_only=True).cast("binary"), 256).alias("base_sha256"),
        listed(pii).alias("spans"), F.size(F.filter(pii, lambda x: ~x["base"])).cast("bigint").alias("n_disguised"),
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance_resample(docs, target, width=1, buckets=10_000, min_words=20, percent=10, seed="2024")


QUERIES: dict[str, Query] = {
    "op1_embedding_near_dup": op1_embedding_near_dup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_token_counts": op4_token_counts,
    "op5_toxicity": op5_toxicity,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_id": op7_language_id,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_lm_score": op9_lm_score,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_pii": op12_pii,
    "op13_importance_resampling": op13_importance_resampling,
}

#: SQL for DuckDB, where the operator's result is one that SQL can state.
_COMPONENTS = """
        r(id, c) USING KEY (id) AS (
            SELECT DISTINCT a, a FROM link
            UNION
            SELECT l.b, min(r.c) FROM r JOIN link l ON r.id = l.a JOIN recurring.r x ON x.id = l.b WHERE r.c < x.c GROUP BY l.b)
"""



def _centroid_sql(k: int, rounds: int, dims: int) -> str:
    """Every round as a table of assignments and one of centroids; all values are whole numbers
    under 2**53, so doubles hold them."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, w FROM (SELECT sha256('2:' || vec_id) AS h, w FROM v ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        near = "list_inner_product(v.w, v.w) - 2 * list_inner_product(v.w, c.w) + list_inner_product(c.w, c.w)"
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, w, m.j, m.d FROM (SELECT v.vec_id, v.w, min({{'d': {near}, 'j': c.j}}) AS m FROM v, c{i} c GROUP BY ALL))""")
        if i < rounds:
            mean = f"SELECT j, list(m ORDER BY p) AS w FROM (SELECT j, p, floor(sum(x) / count(*)) AS m FROM (SELECT j, unnest(w) AS x, unnest(range({dims})) AS p FROM a{i}) GROUP BY j, p) GROUP BY j"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.w, c.w) AS w FROM c{i} c LEFT JOIN ({mean}) n ON n.j = c.j)")
    return f"""WITH {", ".join(steps)}
        SELECT a.vec_id, CAST(a.j AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
            CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.w, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j"""


#: crc32 of each distinct word by its table, then counts, gains, weights and the draw.
_RESAMPLE = """
    WITH RECURSIVE step AS (
        SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i)
        UNION ALL
        SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM step WHERE k < 8),
    crc AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM step WHERE k = 8),
    texts AS MATERIALIZED (
        SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
    words AS MATERIALIZED (
        SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
    hashed AS MATERIALIZED (
        SELECT word, xor(list_reduce(list_transform(range(CAST(len(x) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
        FROM (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM words)), crc),
    f AS MATERIALIZED (SELECT side, id, bucket FROM words JOIN hashed USING (word)),
    n AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM f GROUP BY bucket),
    every AS (SELECT CAST(sum(s) AS DOUBLE) AS s_all, CAST(sum(t) AS DOUBLE) AS t_all FROM n),
    gain AS MATERIALIZED (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS g FROM n, every),
    w AS (SELECT id, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM f JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
    d AS (
        SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
        FROM documents LEFT JOIN w ON w.id = doc_id),
    z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5e0) / 4294967296))) AS BIGINT) AS score FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM z)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM r
"""

ORACLES: dict[str, str] = {
    "op1_embedding_near_dup": f"""
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        link AS MATERIALIZED (
            SELECT p.vec_id AS a, q.vec_id AS b
            FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id
            WHERE list_inner_product(p.e, q.e) / sqrt(list_inner_product(p.e, p.e)) / sqrt(list_inner_product(q.e, q.e)) >= 0.93),
        {_COMPONENTS}
        SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, coalesce(r.c, e.vec_id) AS component_id, e.vec_id = coalesce(r.c, e.vec_id) AS kept
        FROM embeddings e LEFT JOIN r ON r.id = e.vec_id
    """,
    "op8_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
            FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS g
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        link AS MATERIALIZED (
            SELECT p.doc_id AS a, q.doc_id AS b
            FROM (SELECT x.doc_id, y.doc_id AS other, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) z
            JOIN n p ON p.doc_id = z.doc_id JOIN n q ON q.doc_id = z.other
            WHERE 100 * k >= 85 * (p.n + q.n - k)),
        {_COMPONENTS}
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.c, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.id = d.doc_id
    """,
    "op3_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op11_centroid_clustering": _centroid_sql(40, 5, 64),
    "op13_importance_resampling": _RESAMPLE,
}
