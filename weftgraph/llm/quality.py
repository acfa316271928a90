"""Document quality: statistics of a text, scored by boosted trees."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes
from weftgraph.llm.gbt import Trees, fit_trees
from weftgraph.plans.lineage import written

#: The trees are fitted on at most about so many labelled rows, picked by a hash of the id.
SAMPLE_ROWS = 20_000

STATISTICS = [
    "log_bytes", "log_words", "mean_word", "upper", "digits", "non_ascii", "marks", "bars", "stars",
    "shouts", "stops", "distinct_words", "top_word", "same_as_last", "log_lines", "words_a_line",
    "distinct_lines", "marked_words", "upper_words", "longest_word",
]

_CODE = np.arange(256)
_UPPER, _DIGIT = (_CODE >= 65) & (_CODE <= 90), (_CODE >= 48) & (_CODE <= 57)
_LETTER = _UPPER | ((_CODE >= 97) & (_CODE <= 122)) | (_CODE >= 128)
_MARK = (_CODE > 32) & (_CODE < 128) & ~_LETTER & ~_DIGIT
_ENDS_MARKED = {bytes([c]) for c in b"*#$%&@^~|!"}


def statistics_of(text: bytes | None) -> list[float]:
    """The STATISTICS of a whole text; null and empty texts have zeros."""
    words = (text or b"").split()
    if not words:
        return [0.0] * len(STATISTICS)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, n = len(text), len(words)
    letters = max(1, int(seen[_LETTER].sum()))
    of = lambda which: float(seen[which].sum()) / size
    bag = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        np.log1p(size), np.log1p(n), sum(map(len, words)) / n, float(seen[_UPPER].sum()) / letters, of(_DIGIT), of(_CODE >= 128), of(_MARK),
        seen[124] / n, (seen[42] + seen[35] + seen[36] + seen[37] + seen[38]) / n, seen[33] / n, (seen[46] + seen[44]) / n,
        len(bag) / n, max(bag.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n, np.log1p(len(lines)), n / len(lines),
        len(set(lines)) / len(lines), sum(c for w, c in bag.items() if w[-1:] in _ENDS_MARKED) / n, sum(c for w, c in bag.items() if w.isupper() and len(w) > 1) / n, np.log1p(max(map(len, bag))),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, stats array of double) for every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics_of(t) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], names=[id_col, "stats"])

    return docs.select(id_col, F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"`{id_col}` {id_type}, stats array<double>")


def fit_quality(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on ``labels`` (ids and 0/1; nulls are left out), at most about ``sample_rows``."""
    use = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    n = use.count()
    if n > sample_rows:  # the same share everywhere, by a hash of the id
        use = use.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample_rows / n)))
    # of repeated ids one row is enough to learn from, so a join can't multiply the sample
    rows = stats.join(F.broadcast(use), id_col).groupBy(id_col).agg(F.min(F.struct(F.col("stats"), F.col("y"))).alias("r")).orderBy(id_col).select("r.stats", "r.y").toArrow()
    x = np.array(rows.column(0).to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
    return fit_trees(x, np.array(rows.column(1).to_pylist(), dtype=float))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, score (of label 1), predicted.

    ``labels`` holds the rows to learn from.  Only statistics of the text enter a score.  Null
    and empty texts get the score of an empty one; with no labels all get one constant score.
    """
    stats = written(document_statistics(docs, id_col, text_col), "stats")
    trees = docs.sparkSession.sparkContext.broadcast(fit_quality(stats, labels, id_col, label_col))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.value.probability(x), pa.float64())], names=[id_col, "score"])

    scored = stats.mapInArrow(run, f"`{id_col}` {id_type}, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
