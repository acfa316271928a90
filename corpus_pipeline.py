"""A corpus pipeline of four stages, each an operator of ``weftgraph.llm`` with its decisions.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame; the last returns the packed pieces, the others the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import in_fold, table
from weftgraph.llm.jaccard import jaccard_components
from weftgraph.llm.langid import UNKNOWN, identify_language
from weftgraph.llm.packing import pack_documents
from weftgraph.llm.toxicity import score_toxicity
from weftgraph.plans.lineage import written


#: Bytes of texts that go to a Python worker at a time.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what workers get at a time by bytes, as texts can be long; the session's bound in rows
    holds beside it.  This is a setting of the session, which takes effect when a stage's rows are
    asked for, so it stays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``docs`` has it, in any letter case."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go.  Labels of one fold of three are never learned."""
    bounded_batches(spark)
    learn = table(spark, sf_dir, "labels").where(~in_fold(F.col("doc_id"), 3, 1))
    score, predicted = unused(docs, "score"), unused(docs, "predicted")
    scored = score_toxicity(docs, learn, threshold=0.7, score_col=score, predicted_col=predicted)
    return scored.where(F.col(predicted) == 0).select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language is unknown or other than the one they name.  A document that
    names none stays if any language is recognised."""
    bounded_batches(spark)
    pred, score = unused(docs, "lang_pred"), unused(docs, "score")
    named = identify_language(docs, docs.where(~in_fold(F.col("doc_id"), 3, 1)), pred_col=pred, score_col=score)
    return named.where((F.col(pred) != UNKNOWN) & (F.col("lang").isNull() | (F.col("lang") == F.col(pred)))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, of the smallest id; of rows that repeat an
    id each is judged by its own text.  A row without words is a group of its own, and so is a
    row without an id, as in op8: these all stay."""
    bounded_batches(spark)
    key = unused(docs, "row_of_near_duplicates")
    keyed = written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    named = keyed.where("doc_id IS NOT NULL")
    classes = jaccard_components(named.select(key, "text"), percent=85, width=4, id_col=key)
    groups = classes.join(named.select(key, "doc_id"), key).groupBy("component_id")
    kept = groups.agg(F.min(F.struct("doc_id", key)).alias("r")).select(f"r.{key}")
    one = keyed.join(kept, key, "left_semi").select(docs.columns)
    return one.unionAll(keyed.where("doc_id IS NULL").select(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences of 4096 tokens."""
    bounded_batches(spark)
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("op5_toxicity", toxicity),
    ("op7_language_id", language_id),
    ("op8_ngram_jaccard_join", near_duplicates),
    ("op6_best_fit_packing", packing),
]

#: No SQL states what the classifiers learn; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
