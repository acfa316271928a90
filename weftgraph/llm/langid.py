"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import groups_of, trimmed

#: Profiles come from at most about so many texts of each language, picked by a hash of the id.
SAMPLE_ROWS = 2_000
#: So many of the most frequent n-grams (n from 1 to 3) make a profile.
PROFILE = 300
UNKNOWN = "und"

_BITS = np.int64(21)
_letters = np.zeros(0, bool)


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if not len(_letters):
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a whole text and how often each occurs.

    Letters are lower-cased; every run of other characters is one word break.  An n-gram of up to
    three code points is packed exactly into 63 bits; breaks stand alone in no n-gram.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(letters()[points], points, 32)
    points = np.r_[np.int64(32), points, np.int64(32)]
    points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]
    two = (points[:-1] << _BITS) | points[1:]
    three = (two[:-1] << _BITS) | points[2:]
    # a break inside an n-gram would join words; it may only begin or end one
    three = three[points[1:-1] != 32]
    keys = np.concatenate([points[points != 32], two, three])
    keys.sort()
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.r_[starts, len(keys)])


def most_frequent(keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` keys, the most frequent first, ties by key."""
    if len(keys) > n:
        # all that reach the n-th highest count, so that ties at the border go by key too
        enough = counts >= np.partition(counts, len(counts) - n)[len(counts) - n]
        keys, counts = keys[enough], counts[enough]
    return keys[np.lexsort((keys, -counts))[:n]]


class Profiles:
    """Ranks of each language's n-grams, for the out-of-place distance."""

    def __init__(self, of_language: dict[str, np.ndarray], size: int = PROFILE):
        self.size, self.languages = size, sorted(of_language)
        self.keys = np.unique(np.concatenate([of_language[x] for x in self.languages] or [np.zeros(0, np.int64)]))
        # an n-gram that a profile lacks is out of place by the most there can be
        self.ranks = np.full((len(self.languages), len(self.keys) + 1), -size, dtype=np.int64)
        for i, x in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.keys, of_language[x])] = np.arange(len(of_language[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least distance (ties: the first by name) and how near it is, from 0
        to 1; UNKNOWN and 0 for a text without letters or if no language is known."""
        keys, counts = grams(text)
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0
        mine = most_frequent(keys, counts, self.size)
        at = np.minimum(np.searchsorted(self.keys, mine), len(self.keys) - 1)
        at = np.where(self.keys[at] == mine, at, len(self.keys))
        ranks = self.ranks[:, at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(mine)))).sum(axis=1)
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (self.size * len(mine)))


def fit_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, size: int = PROFILE) -> Profiles:
    """Profiles of every language that ``docs`` (the rows to learn from) name.

    N-grams are counted where the texts are, added up by language and n-gram, and only each
    language's ``size`` most frequent ones come to the driver.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    per_million = known.groupBy(F.col(lang_col).alias("of")).agg((F.lit(1_000_000.0) * sample_rows / F.count("*")).alias("share"))
    chosen = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(1_000_000)).alias("at"))
    shares = {r["of"]: r["share"] for r in per_million.collect()}
    if not shares:
        return Profiles({}, size)
    limit = F.element_at(F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in shares.items())), F.col("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in groups_of(texts):
                for name in sorted(set(lang[a:b])):
                    got = [grams(texts[i]) for i in range(a, b) if lang[i] == name]
                    keys, slot = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
                    n = np.bincount(slot, np.concatenate([g[1] for g in got]), len(keys)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

    counted = chosen.where(F.col("at") < limit).select("lang", "text").mapInArrow(trimmed(run), "lang string, gram bigint, n bigint")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = total.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", "place").collect()
    of_language: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["place"])):
        of_language.setdefault(r["lang"], []).append(r["gram"])
    return Profiles({k: np.array(v, dtype=np.int64) for k, v in of_language.items()}, size)


def identify_language(docs: DataFrame, learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` with ``pred_col`` and ``score_col`` (0 to 1); columns of these names
    are replaced, so a caller who needs them picks other names.

    ``learn`` holds the rows to learn from, with their languages; of ``docs`` only the whole text
    enters a prediction.  A null text or one without a letter is ``und`` with score 0, and so is
    every text if there is nothing to learn from.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_profiles(learn, id_col, text_col, lang_col))
    bare = docs.drop(pred_col, score_col)
    names, at = bare.columns, bare.columns.index(text_col)
    schema = T.StructType([*bare.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model.value.predict
        for batch in batches:
            texts = batch.column(at)
            got = [predict(texts[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*names, pred_col, score_col])

    return bare.mapInArrow(trimmed(run), schema)
