"""Sums over a text's words of a number that belongs to each distinct word."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes

#: At most so many words, none longer than so many bytes, are broadcast.
TOP_WORDS, TOP_BYTES = 400_000, 48
#: A task's counter is handed on when it holds so many words.
COUNTER_WORDS = 400_000


def word_counts(docs: DataFrame, words: Callable[[bytes], list[bytes]], text_col: str = "text") -> DataFrame:
    """(word binary, n long): occurrences over all texts, counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            keys, values = list(seen), list(seen.values())
            for a in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 50_000], pa.binary()), pa.array(values[a : a + 50_000], pa.int64())], names=["word", "n"])
            seen.clear()

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                if text:
                    seen.update(words(text))
                    if len(seen) > COUNTER_WORDS:
                        yield from out()
        yield from out()

    source = docs.select(F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def top_words(table: DataFrame, value_col: str, limit: int = TOP_WORDS) -> dict[bytes, float]:
    """The ``value_col`` of the most frequent words, for a broadcast whose size is bounded by
    ``limit`` words of TOP_BYTES bytes; ties in frequency go by the word."""
    short = table.where(F.octet_length("word") <= TOP_BYTES).orderBy(F.desc("n"), "word").limit(limit).select("word", value_col).toArrow()
    return dict(zip(short.column(0).to_pylist(), short.column(1).to_pylist(), strict=True))


def sum_over_words(docs: DataFrame, table: DataFrame, value_cols: list[str], words: Callable[[bytes], list[bytes]], id_col: str = "doc_id", text_col: str = "text", top: int = TOP_WORDS) -> DataFrame:
    """For each row of ``docs``: ``id_col``, n_bytes, n_words and for each of ``value_cols`` the
    sum over the text's words of the word's value in ``table`` (a written table of word, n and
    the values); a word that is missing there adds nothing.

    The most frequent words are looked up in a broadcast of bounded size, in the task that reads
    the text.  Only what is left of a text's word frequencies is shuffled to meet the table, so
    neither a word that is everywhere nor a growing vocabulary is a bottleneck.
    """
    spark = docs.sparkSession
    k = len(value_cols)
    bundle = table.select("word", "n", F.array(*[F.col(c).cast("double") for c in value_cols]).alias("value"))
    # one value is kept as itself: a list for each word would take twice the memory
    common = spark.sparkContext.broadcast(top_words(bundle.withColumn("value", F.col("value")[0]) if k == 1 else bundle, "value", top))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"row bigint, id {id_type}, n_bytes bigint, n_words bigint, key binary, times bigint, known array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = common.value.get
        for batch in batches:
            at, n_bytes, n_words, key, times, known = [], [], [], [], [], []

            def out():
                take = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(n_bytes, pa.int64()), pa.array(n_words, pa.int64()), pa.array(key, pa.binary()), pa.array(times, pa.int64()), pa.array(known, pa.list_(pa.float64()))], names=["row", "id", "n_bytes", "n_words", "key", "times", "known"])

            rows = batch.column(0).to_pylist()
            for i, text in enumerate(as_bytes(batch.column(2))):
                bag = Counter(words(text or b""))
                sums = [0.0] * k
                for w, c in bag.items():
                    v = find(w)
                    if v is None:
                        at.append(i)
                        key.append(w)
                        times.append(c)
                    elif k == 1:
                        sums[0] += c * v
                    else:
                        for j in range(k):
                            sums[j] += c * v[j]
                more = len(at) - len(known)
                n_bytes += [None] * more
                n_words += [None] * more
                known += [None] * more
                # the text's own row: a key that holds a space is no word and is unlike any other
                at.append(i)
                key.append(b" %d" % rows[i])
                times.append(0)
                known.append(sums)
                n_bytes.append(len(text or b""))
                n_words.append(sum(bag.values()))
                if len(at) > 50_000:
                    yield out()
                    at, n_bytes, n_words, key, times, known = [], [], [], [], [], []
            if at:
                yield out()

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rest = bundle.select("word", "value")
    met = source.mapInArrow(run, schema).join(rest, F.col("key") == rest.word, "left")
    sums = [F.sum(F.coalesce(F.col("known")[j], F.col("times") * F.col("value")[j], F.lit(0.0))).alias(c) for j, c in enumerate(value_cols)]
    # a text has one row with its id and lengths, so max() only picks them
    total = met.groupBy("row").agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.max("n_words").alias("n_words"), *sums)
    return total.drop("row")
