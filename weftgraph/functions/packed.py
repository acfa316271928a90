"""Sorted lists of ids, packed: blocks of bit-packed differences with an entry to skip by."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.phases import Partition, Phase, in_phases
from weftgraph.plans.lineage import written

#: Ids of a block, and of one packed value at most; a longer list is several values.
BLOCK, CHUNK = 128, 8192


def pack(ids: np.ndarray) -> bytes:
    """Strictly rising int64 ids as bytes.

    The number of ids; the first and last id and the width of each block; then, block by block,
    each difference less one in as many bits as the block's largest takes, from a whole byte on.
    """
    ids = np.asarray(ids, dtype=np.int64)
    if len(ids) > 1 and not (ids[1:] > ids[:-1]).all():
        raise ValueError("ids must rise strictly")
    starts = np.arange(0, len(ids), BLOCK)
    ends = np.minimum(starts + BLOCK, len(ids))
    widths, bodies = [], []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        # as unsigned numbers, so that no difference of two int64 is too large
        gaps = ids[a + 1 : b].view(np.uint64) - ids[a : b - 1].view(np.uint64) - np.uint64(1)
        width = int(gaps.max(initial=0)).bit_length()
        bits = (gaps[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        widths.append(width)
        bodies.append(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes())
    return b"".join([struct.pack("<I", len(ids)), ids[starts].tobytes(), ids[ends - 1].tobytes(), bytes(widths), *bodies])


class Packed:
    """A packed list; blocks are unpacked one by one, as they are asked for."""

    def __init__(self, data: bytes):
        (self.n,) = struct.unpack_from("<I", data)
        k = -(-self.n // BLOCK)
        self.firsts, self.lasts = np.frombuffer(data, np.int64, k, 4), np.frombuffer(data, np.int64, k, 4 + 8 * k)
        self.widths = np.frombuffer(data, np.uint8, k, 4 + 16 * k)
        self.counts = np.minimum(BLOCK, self.n - BLOCK * np.arange(k))
        size = ((self.counts - 1) * self.widths + 7) // 8
        self.offsets = 4 + 17 * k + np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.data, self.read = data, 0

    def block(self, i: int) -> np.ndarray:
        width, n = int(self.widths[i]), int(self.counts[i]) - 1
        self.read += 1
        raw = np.frombuffer(self.data, np.uint8, int(self.offsets[i + 1] - self.offsets[i]), int(self.offsets[i]))
        bits = np.unpackbits(raw, count=n * width, bitorder="little").reshape(n, width)
        gaps = (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) + np.uint64(1)
        return np.cumsum(np.concatenate([self.firsts[i : i + 1].view(np.uint64), gaps]), dtype=np.uint64).view(np.int64)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.block(i) for i in range(len(self.widths))]) if self.n else np.zeros(0, np.int64)

    def common(self, other: Packed) -> np.ndarray:
        """The ids of both lists.  Only blocks whose ranges meet are unpacked."""
        if len(self.widths) > len(other.widths):
            return other.common(self)
        found, held, at = [np.zeros(0, np.int64)], None, -1
        low = np.searchsorted(other.lasts, self.firsts)
        high = np.searchsorted(other.firsts, self.lasts, side="right")
        for i in np.flatnonzero(low < high).tolist():
            mine = self.block(i)
            for j in range(int(low[i]), int(high[i])):
                if j != at:
                    held, at = other.block(j), j
                found.append(np.intersect1d(mine, held, assume_unique=True))
        return np.concatenate(found)


def pack_lists(df: DataFrame, key: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """(key, first, last, n, packed): the distinct values of each key in packed lists of at most
    ``chunk`` ids, in ranges that do not overlap.  Keys and values are bigints; rows with a null go.

    A key's values are sorted by Spark and streamed, so a list of any length takes the memory of
    one chunk.
    """

    def run(part: Partition) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)

        def out(ids: np.ndarray) -> pa.RecordBatch:
            whole = lambda x: pa.array([int(x)], pa.int64())
            return pa.RecordBatch.from_arrays([whole(part.key[0]), whole(ids[0]), whole(ids[-1]), whole(len(ids)), pa.array([pack(ids)], pa.binary())], names=[key, "first", "last", "n", "packed"])

        for rows in part:
            held = np.unique(np.concatenate([held, np.asarray(rows.column(1))]))
            while len(held) > chunk:  # the last id stays, as it may come again
                yield out(held[:chunk])
                held = held[chunk:]
        if len(held):
            yield out(held)

    rows = df.select(F.col(key).cast("bigint").alias(key), F.col(value).cast("bigint").alias(value)).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    return in_phases(rows, [Phase(run, f"`{key}` bigint, first bigint, last bigint, n bigint, packed binary", (key,), (value,))])


def unpack_lists(lists: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of :func:`pack_lists`, a row a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = Packed(data).ids()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k)), pa.array(ids)], names=[key, value])

    return lists.select(key, "packed").mapInArrow(run, f"`{key}` bigint, `{value}` bigint")


def common_counts(pairs: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """(a, b, n): for each row (a, b) of ``pairs``, without repeats, how many values the packed lists of
    both have in common; pairs without any are left out.  Packed lists are what is shuffled."""
    side = lambda x: lists.select(F.col(key).alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("first", "last", "packed")])
    met = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where("first_a <= last_b AND first_b <= last_a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(Packed(x).common(Packed(y))) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["a", "b", "n"])

    counts = met.select("a", "b", "packed_a", "packed_b").mapInArrow(run, "a bigint, b bigint, n bigint").where("n > 0")
    return counts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def packed_triangle_count(forward: DataFrame) -> DataFrame:
    """(triangles), from (a, b): each undirected edge once, from the lower to the higher in some order of
    the nodes in which none has many later neighbours.  An edge has a triangle with each node that
    comes after both of its ends."""
    lists = written(pack_lists(forward, "a", "b"), "packed")
    pairs = forward.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).distinct()
    return common_counts(pairs, lists, "a").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("triangles"))
