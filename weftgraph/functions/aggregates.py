"""Exact products and greatest common divisors, as scalar functions and aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def gcd_of_series(x: pd.Series, y: pd.Series) -> pd.Series:
    some = (x.notna() & y.notna()).to_numpy()
    out = np.gcd(x.fillna(0).astype("int64").to_numpy(), y.fillna(0).astype("int64").to_numpy())
    if (out[some] < 0).any():
        raise OverflowError("2**63, the gcd of -2**63 with itself or 0, is no bigint")
    return pd.Series(pd.array(out, dtype="Int64")).where(some)


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two bigints: never negative, gcd(0, x) = |x|, null with null.  2**63
    is no bigint, so the one case that has it is an error."""
    return F.pandas_udf(gcd_of_series, "bigint")(a.cast("bigint"), b.cast("bigint"))


#: Python converts numbers of up to so many digits to and from text by itself.
DIGITS = 4_000


def to_text(n: int) -> str:
    """Decimal text of a whole number of any length."""
    if n < 0:
        return "-" + to_text(-n)
    if n.bit_length() < 3 * DIGITS:
        return str(n)
    half = n.bit_length() * 3 // 20
    high, low = divmod(n, 10**half)
    return to_text(high) + to_text(low).zfill(half)


def from_text(text: str) -> int:
    """The whole number that decimal text of any length states."""
    if len(text) <= DIGITS:
        return int(text)
    if text[0] == "-":
        return -from_text(text[1:])
    half = len(text) // 2
    return from_text(text[:-half]) * 10**half + from_text(text[-half:])


def _product(values: list[int]) -> int:
    return math.prod(values)


def _wrapped(values: list[int]) -> int:
    return math.prod(values) % (1 << 64)


def _gcd(values: list[int]) -> int:
    return math.gcd(*values)


def to_bytes(n: int) -> bytes:
    return n.to_bytes(n.bit_length() // 8 + 1, "big", signed=True)


class Folding:
    """A fold over values that come one by one.  Results are folded with results of as many values,
    so a long product is made of few long factors, not of one that grows with each value."""

    #: Values that are folded at a time.
    FEW = 64

    def __init__(self, fold: Callable[[list[int]], int]):
        self.fold, self.fresh, self.parts = fold, [], []

    def add(self, values: list[int]) -> None:
        self.fresh += values
        if len(self.fresh) >= self.FEW:
            value, size = self.fold(self.fresh), 1
            self.fresh = []
            while self.parts and self.parts[-1][0] == size:
                value, size = self.fold([self.parts.pop()[1], value]), size * 2
            self.parts.append((size, value))

    def result(self) -> int:
        out = self.fold(self.fresh) if self.fresh else None
        for _, value in reversed(self.parts):
            out = self.fold([value] if out is None else [value, out])
        return out


def _fold(df: DataFrame, keys: list[str], columns: list[str], name: str, fold: Callable[[list[int]], int]) -> DataFrame:
    """Fold whole numbers by key in two phases: in each task, then over the tasks' results, so
    that no key's rows come together in one place.  Results are decimal text of any length."""
    k = len(keys)
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch], last_phase: bool = False) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Folding] = {}

        def out() -> Iterator[pa.RecordBatch]:
            names = [*keys, name]
            shown, kind = (to_text, pa.string()) if last_phase else (to_bytes, pa.binary())
            rows = [(*key, shown(v.result())) for key, v in held.items()]
            held.clear()
            types = [schema.field(i).type for i in range(k)] + [kind]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[i]) for i in range(k + 1)], names=names)

        schema = None
        for batch in batches:
            schema = batch.schema
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                values = [from_text(v) if isinstance(v, str) else int.from_bytes(v, "big", signed=True) if isinstance(v, bytes) else int(v) for v in row[k:] if v is not None]
                if values:
                    if row[:k] not in held:
                        held[row[:k]] = Folding(fold)
                    held[row[:k]].add(values)
            if len(held) > 200_000:
                # in key order the last key may go on in the next batch
                last = held.popitem() if last_phase else None
                yield from out()
                held.update([last] if last else [])
        if held:
            yield from out()

    partial = df.select(*keys, *columns).mapInArrow(run, f"{types}, `{name}` binary")
    # a key has one row a task now
    dealt = partial.repartition(*keys).sortWithinPartitions(*keys) if keys else partial.coalesce(1)
    return dealt.mapInArrow(lambda batches: run(batches, True), f"{types}, `{name}` string")


def exact_product(df: DataFrame, keys: list[str], columns: str | list[str], name: str) -> DataFrame:
    """(keys, ``name``): the product of all non-null values, as decimal text; exact however long."""
    return _fold(df, keys, [columns] if isinstance(columns, str) else columns, name, _product)


def exact_gcd(df: DataFrame, keys: list[str], columns: str | list[str], name: str) -> DataFrame:
    """(keys, ``name``): the gcd of all non-null values, as decimal text; zeros count as nothing."""
    return _fold(df, keys, [columns] if isinstance(columns, str) else columns, name, _gcd)


def wrapped_product(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """The product modulo 2**64 as a signed bigint, as a 64-bit machine gives it."""
    text = _fold(df, keys, [column], name, _wrapped)

    @F.pandas_udf("bigint")
    def wrap(x: pd.Series) -> pd.Series:
        return x.map(lambda v: (int(v) + (1 << 63)) % (1 << 64) - (1 << 63))

    return text.withColumn(name, wrap(F.col(name)))


def register(spark: SparkSession) -> None:
    """SQL names: gcd(a, b), agg_gcd(x), agg_product(x) (bigint; error on overflow).

    An aggregate in Python has one phase in Spark: it gets a key's values together.  For keys of
    very many rows there are :func:`exact_gcd` and :func:`exact_product`, which fold in each task.
    """

    @F.pandas_udf("bigint")
    def agg_gcd(x: pd.Series) -> int:
        return math.gcd(*[int(v) for v in x.dropna()])

    @F.pandas_udf("bigint")
    def agg_product(x: pd.Series) -> int:
        return math.prod(int(v) for v in x.dropna())

    spark.udf.register("gcd", F.pandas_udf(gcd_of_series, "bigint"))
    spark.udf.register("agg_gcd", agg_gcd)
    spark.udf.register("agg_product", agg_product)
