"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in groups of about so many bytes, whatever a batch holds.
GROUP_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(n)


def in_fold(id_col: Column, n: int, k: int) -> Column:
    """Whether a row is in fold ``k`` of ``n``; a null id is in none."""
    return F.coalesce(fold(id_col, n) == F.lit(k), F.lit(False))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def groups_of(texts: Iterable[bytes | str | None]) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about GROUP_BYTES each, so that a batch of
    long documents takes no more memory than one of short ones."""
    start, held, i = 0, 0, -1
    for i, text in enumerate(texts):
        held += len(text) if text else 0
        if held >= GROUP_BYTES or i - start >= 4095:
            yield start, i + 1
            start, held = i + 1, 0
    if start <= i:
        yield start, i + 1


class Recent:
    """A dict of bounded size: two generations, of which the older is dropped when the
    younger is full.  What is asked for often moves on to the younger one.

    A generation is full at about ``limit`` bytes by ``cost`` (of an entry, beside what the dict
    itself takes; without it, the lengths of key and value); one call can go beyond it by the
    entries that it asks for.
    """

    #: Bytes of an entry's slot in the dict and of the two objects' headers.
    SLOT = 200

    def __init__(self, make: Callable[[list], Iterable], limit: int = 64 << 20, cost: Callable | None = None):
        self.make, self.limit, self.cost, self.young, self.old, self.held = make, limit, cost, {}, {}, 0

    def _keep(self, keys: list, values: list) -> None:
        self.young.update(zip(keys, values, strict=True))
        self.held += self.SLOT * len(keys) + (sum(map(self.cost, keys, values)) if self.cost else sum(map(len, keys)) + sum(map(len, values)))

    def fill(self, keys: Iterable) -> dict:
        """A dict that holds all ``keys``; those not known yet are made in one call."""
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        missing = [k for k in (keys if isinstance(keys, set) else dict.fromkeys(keys)) if k not in young]
        if old and missing:
            again = [k for k in missing if k in old]
            missing = [k for k in missing if k not in old]
            self._keep(again, [old[k] for k in again])
        if missing:
            self._keep(missing, list(self.make(missing)))
        return young


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, an Arrow function, whose worker hands the memory that its task no longer uses back
    to the system at the task's end, as workers outlive tasks and stages."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole
