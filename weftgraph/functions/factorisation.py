"""Whole numbers as prime exponents, so that a product is a sum and a gcd a minimum."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.aggregates import to_text

#: Primes up to this are divided out together; what is left over is split by Pollard's rho.
SMALL = 1 << 16


def small_primes(limit: int = SMALL) -> np.ndarray:
    sieve = np.ones(limit + 1, dtype=bool)
    sieve[:2] = False
    for p in range(2, math.isqrt(limit) + 1):
        if sieve[p]:
            sieve[p * p :: p] = False
    return np.flatnonzero(sieve)


def smallest_factors(limit: int) -> np.ndarray:
    """The smallest prime factor of each number up to ``limit``; 0 and 1 have themselves."""
    least = np.arange(limit + 1, dtype=np.int64)
    for p in small_primes(math.isqrt(limit)).tolist():
        at = least[p * p :: p]
        at[at == np.arange(p * p, limit + 1, p)] = p
    return least


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number under 2**64."""
    bases = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    if n < 2 or any(n % p == 0 for p in bases):
        return n in bases
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in bases:
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def split(n: int) -> list[int]:
    """The prime factors of ``n``, which has none up to SMALL, in order."""
    if n == 1:
        return []
    if n < SMALL * SMALL or is_prime(n):
        return [n]
    root = math.isqrt(n)
    if root * root == n:
        return sorted(2 * split(root))
    for c in range(1, n):
        x = y = 2
        d = 1
        while d == 1:
            x = (x * x + c) % n
            y = (y * y + c) % n
            y = (y * y + c) % n
            d = math.gcd(abs(x - y), n)
        if d != n:
            return sorted(split(d) + split(n // d))
    raise AssertionError(n)


#: Numbers up to this are taken apart by the sieve, which a task makes once.
SIEVED = 1 << 20


def factors_of(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, prime, exponent) of each positive number; 1 has none."""
    rest = numbers.astype(np.int64).copy()
    index, prime = [], []
    most = int(rest[rest <= SIEVED].max(initial=1))
    least = smallest_factors(most)
    at = np.flatnonzero((rest <= SIEVED) & (rest > 1))
    while len(at):
        p = least[rest[at]]
        index.append(at)
        prime.append(p)
        rest[at] //= p
        at = at[rest[at] > 1]
    at = np.flatnonzero(rest > 1)
    if len(at):
        for p in small_primes().tolist():
            hit = at[rest[at] % p == 0]
            while len(hit):
                index.append(hit)
                prime.append(np.full(len(hit), p))
                rest[hit] //= p
                hit = hit[rest[hit] % p == 0]
        for i in at[rest[at] > 1].tolist():
            found = split(int(rest[i]))
            index.append(np.full(len(found), i))
            prime.append(np.array(found, dtype=np.int64))
    if not index:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    pairs = np.stack([np.concatenate(index), np.concatenate(prime)], axis=1)
    pairs, n = np.unique(pairs, axis=0, return_counts=True)
    return pairs[:, 0], pairs[:, 1], n


def prime_exponents(ids: DataFrame, column: str = "id") -> DataFrame:
    """(id, prime, exponent) of each distinct non-null value of a column of positive bigints; 1 has no
    row.  A number under 1 is an error, as it has no such form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.asarray(batch.column(0))
            if len(numbers) and numbers.min() < 1:
                raise ValueError(f"{int(numbers.min())} has no prime exponents")
            i, p, e = factors_of(numbers)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[i]), pa.array(p, pa.int64()), pa.array(e, pa.int64())], names=["id", "prime", "exponent"])

    distinct = ids.select(F.col(column).cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    return distinct.mapInArrow(run, "id bigint, prime bigint, exponent bigint")


def power_text(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(key, ``name``): the product of prime ** exponent over a key's rows, as decimal text.  A key has
    a row a prime, so what is gathered is as short as its list of primes."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [to_text(math.prod(x["prime"] ** x["exponent"] for x in powers)) for powers in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, name])

    powers = rows.groupBy(key).agg(F.collect_list(F.struct("prime", "exponent")).alias("powers"))
    return powers.mapInArrow(run, f"`{key}` {kind}, `{name}` string")
