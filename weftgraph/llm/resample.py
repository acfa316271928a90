"""Importance resampling of documents towards a target collection, by hashed word runs."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import GROUP_BYTES
from weftgraph.plans.lineage import written

#: Bytes of words: digits, letters and everything beyond ASCII.
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x41:0x5B] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True
#: A-Z become a-z, other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Words are followed side by side for so many bytes; what is left of longer ones goes one by one.
SIDE_BY_SIDE = 64


def _crc_table() -> np.ndarray:
    """What the low byte of a state adds to it, by the polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words in UTF-8 bytes, from where the class of a byte differs from its
    neighbour's; ``offsets`` cut the bytes into texts, which no word crosses."""
    inside = IN_WORD[data]
    step = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    begins, ends = step == 1, step == -1
    # a word goes on over a border of texts: it ends there, and another begins
    cuts = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    begins[cuts] = ends[cuts] = True
    return np.flatnonzero(begins), np.flatnonzero(ends)


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC states after the bytes of ``data`` from each start to its end, all starts at once: the
    longest first, so that those still under way are a prefix that shrinks byte by byte."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    at, left, c = starts[order], length[order], state[order].astype(np.uint32)
    most = int(left[0]) if len(left) else 0
    going = np.searchsorted(-left, -np.arange(min(most, SIDE_BY_SIDE)), side="left")
    for j, m in enumerate(going.tolist()):
        c[:m] = CRC[(c[:m] ^ data[at[:m] + j]) & np.uint32(255)] ^ (c[:m] >> np.uint32(8))
    for i in range(int(np.searchsorted(-left, -SIDE_BY_SIDE, side="left"))):
        rest = data[at[i] + SIDE_BY_SIDE : at[i] + left[i]].tobytes()
        c[i] = zlib.crc32(rest, int(c[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty(len(c), dtype=np.uint32)
    out[order] = c
    return out


def features(data: np.ndarray, offsets: np.ndarray, width: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of 1 to ``width`` words: (text of each run, its bucket, words of each text).

    The state of a longer run goes on from that of the run without its last word.
    """
    starts, ends = word_bounds(data, offsets)
    low = LOWER[data]
    text = np.searchsorted(offsets, starts, side="right") - 1
    words = np.bincount(text, minlength=len(offsets) - 1)
    state = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    for r in range(width):
        if r:
            more = np.flatnonzero(text[r:] == text[: len(text) - r]) if len(text) > r else np.zeros(0, dtype=np.int64)
            gone = CRC[(state[more] ^ np.uint32(0x20)) & np.uint32(255)] ^ (state[more] >> np.uint32(8))
            state = np.zeros(len(starts), dtype=np.uint32)
            state[more] = advance(gone, low, starts[more + r], ends[more + r])
        else:
            more = np.arange(len(starts))
            state = advance(state, low, starts, ends)
        yield text[more], ((state[more] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64), words


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, bytes, offsets) of groups of rows with about GROUP_BYTES each, without a
    copy; a null text has no bytes."""
    if not len(column):
        return
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP_BYTES, side="right")) - 1)
        j = min(j, len(column))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def bucket_counts(texts: DataFrame, text_col: str = "text", width: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs in all texts; ``buckets`` whole numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in _texts(batch.column(0)):
                for _, bucket, _ in features(data, offsets, width, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counts = texts.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, dtype=object)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets, in doubles."""
    b, s_all, t_all = len(source), int(sum(source)), int(sum(target))
    return np.array([math.floor(1000 * math.log(float((int(t) + 1) * (s_all + b)) / float((int(s) + 1) * (t_all + b)))) for s, t in zip(source, target, strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight): the sum of the gains over each text's features."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in _texts(batch.column(1)):
                n, weight, words = np.zeros(j - i, dtype=np.int64), np.zeros(j - i, dtype=np.int64), None
                for text, bucket, words in features(data, offsets, width, len(gains)):
                    n += np.bincount(text, minlength=j - i)
                    np.add.at(weight, text, gains[bucket])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words, pa.int64()), pa.array(n), pa.array(weight)], names=["i", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {kind}, n_words bigint, n_features bigint, weight bigint").withColumnRenamed("i", id_col)


def ranked(rows: DataFrame, *order: str, rank_col: str = "rank") -> DataFrame:
    """``rows`` with their place (1, 2, 3, ...) in the whole order, as a bigint column.

    Rows are dealt by ranges of the order and sorted in each, and that is written; a row's place is
    then its place in its range after the sizes of the ranges before.  No task sees more than a
    range, and the driver gets one number a range.  The order must tell all rows apart, or else
    equal rows can't be dealt to different ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *[F.expr(o) if " " not in o else F.col(o.split()[0]).desc() for o in order])
    dealt = dealt.sortWithinPartitions(*[F.expr(o) if " " not in o else F.col(o.split()[0]).desc() for o in order])
    # the upper bits of this id are the number of the range, the lower 33 the place in it
    stored = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    before, upto = [], 0
    for p, n in sorted(stored.groupBy(part.alias("p")).count().collect()):
        before.append((p, upto))
        upto += n
    # one row a range, and there are no more ranges than the session has shuffle partitions
    offsets = rows.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    placed = stored.join(F.broadcast(offsets), part == F.col("_part"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return placed.withColumn(rank_col, place.cast("bigint")).drop("_at", "_part", "_before")


def importance_resample(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every document, all bigint.

    Features are runs of 1 to ``width`` words (digits, letters, anything beyond ASCII; A-Z in lower
    case), joined by a space and hashed by crc32 into ``buckets``; a bucket's gain compares its
    share of the target's features with its share of the documents'.  ``weight`` is the sum of a
    document's gains; ``score`` adds Gumbel noise made from the id, so that the highest scores are
    a draw without replacement by weight.  Of the documents with an id and ``min_words`` words or
    more, ``percent`` in a hundred are drawn, and have their place in ``rank``.

    Null and empty texts have no features and weight 0.  A null id has a null score and is never
    drawn or counted.  Rows that repeat an id are documents of their own, with one noise; ties go
    to the smaller id.  Other columns are not returned.  A text is handled whole, in some 30 bytes
    of memory for each of its own.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, width, buckets), bucket_counts(target, target_col, width, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weigh(docs, gains, width, id_col, text_col).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    scored = written(scored, "scored")
    able = F.col("score").isNotNull() & (F.col("n_words") >= min_words)
    drawn = scored.where(able).count() * percent // 100
    placed = ranked(scored.where(able), "score DESC", id_col, "row")
    out = [id_col, "n_features", "weight", "score"]
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    return placed.select(*out, rank).unionAll(scored.where(~able).select(*out, F.lit(None).cast("bigint").alias("rank")))
