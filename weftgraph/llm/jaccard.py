"""Exact Jaccard join of word n-gram sets by prefixes under several global token orders."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, trimmed
from weftgraph.operators.components import component_labels
from weftgraph.plans.lineage import forget, release, written

#: So many of the most frequent shingles have their frequencies broadcast; they come last in the
#: first order.  Any set of shingles gives a valid order, so the bound costs no link.
FREQUENT, LEAST_FREQUENT = 200_000, 8
#: Seeds of the orders: each ranks shingles by a hash of its own, the first by frequency before.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Bits of the parity sketch that bounds overlaps from above.
SKETCH = 1_024
#: Up to so many texts to verify are found by a broadcast of ids, beyond it by a shuffle join.
BROADCAST_IDS = 1_000_000
#: A text is verified against at most so many others in one task; a list of more members than
#: BLOCK is compared in pairs of blocks.
STAR, BLOCK = 512, 4_096
#: A task remembers about so many pairs that it has handed on; others are handed on again.
DONE = 100_000
#: A task hands its hashes on when it holds so many.
HELD = 2_000_000


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of 64-bit numbers for each seed."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, width: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``width`` words; of the whole word
    sequence if it is shorter; nothing without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(words))
    total = np.full(len(words) - span + 1, span, np.uint64)
    for i in range(span):
        total = mix(total, ORDERS[0]) + h[i : len(words) - span + 1 + i]
    return np.unique(mix(total, ORDERS[1]))


def least_overlap(n: int, percent: int) -> int:
    """The overlap that a set of ``n`` needs with any set to reach the threshold."""
    return -(-percent * n // 100)


def prefix(s: np.ndarray, percent: int, seed: int, frequent: np.ndarray | None = None, bits: int = 0) -> np.ndarray:
    """The first tokens of a set under one order: two sets that reach the threshold share one.

    ``frequent`` holds the fingerprints of frequent shingles, the most frequent last.
    """
    k = len(s) - least_overlap(len(s), percent) + 1
    key = mix(s, seed)
    if frequent is not None and len(frequent):
        at = np.searchsorted(frequent["print"], prints(s, bits))
        at = np.minimum(at, len(frequent) - 1)
        rank = np.where(frequent["print"][at] == prints(s, bits), frequent["rank"][at], 0)
        return s[np.lexsort((key, rank))[:k]]
    return s[np.argpartition(key, k - 1)[:k]] if k < len(s) else s


def prints(s: np.ndarray, bits: int) -> np.ndarray:
    """The first 32 + bits bits: a bucket of ``bits`` and a number of 32 bits in it."""
    return s >> np.uint64(32 - bits)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's members in SKETCH slots: two sets differ in as many members at
    least as their sketches differ in slots."""
    return np.packbits((np.bincount((s >> np.uint64(7)).astype(np.int64) & (SKETCH - 1), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def fingerprint(s: np.ndarray, seed: int = 0) -> int:
    """A 64-bit number for the whole set."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed) - (1 << 63)


def short_prefix(s: np.ndarray, percent: int, seed: int) -> bytes:
    """The prefix under one order as sorted 32-bit numbers: two sets that share a token share a
    number, so what these rule out is out for certain."""
    return np.unique((mix(prefix(s, percent, seed), ORDERS[1]) >> np.uint64(32)).astype(np.uint32)).tobytes()


def may_link(n_a: int, bits_a: bytes, orders_a: list[bytes], n_b: int, bits_b: bytes, orders_b: list[bytes], percent: int) -> bool:
    """Whether two sets may reach the threshold by their sizes, their sketches and their prefixes
    under the orders after the first."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    apart = int(np.bitwise_count(np.frombuffer(bits_a, np.uint64) ^ np.frombuffer(bits_b, np.uint64)).sum())
    if apart * (100 + percent) > (n_a + n_b) * (100 - percent):
        return False
    return all(np.isin(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), assume_unique=True).any() for x, y in zip(orders_a, orders_b, strict=True))


def by_bucket(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice, np.ndarray]]:
    """Slices of the hashes in sorted order, one for each bucket that has any."""
    order = np.argsort(hashes)
    bucket = (hashes[order] >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(starts, np.r_[starts[1:], len(bucket)] if len(bucket) else [], strict=True):
        yield int(bucket[a]), slice(a, b), order


def frequent_shingles(texts: DataFrame, width: int, bits: int) -> np.ndarray:
    """Fingerprints of the shingles in most texts, with a rank that is higher for more texts.

    Every text's every shingle is counted, in each task first: tasks hand on 32 bits of each
    distinct one and its count, packed by bucket, so a shingle that is everywhere is a row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            got = [(b, prints(hashes[o[at]], bits).astype(np.uint32).tobytes(), n[o[at]].astype(np.uint32).tobytes()) for b, at, o in by_bucket(hashes, bits)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.binary())], names=["bucket", "low", "n"])

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                held.append(shingle_set(text, width))
                size += len(held[-1])
                if size > HELD:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, slot = np.unique(np.frombuffer(b"".join(pdf.low), np.uint32), return_inverse=True)
        n = np.bincount(slot, np.frombuffer(b"".join(pdf.n), np.uint32)).astype(np.int64)
        often = n >= LEAST_FREQUENT
        return pd.DataFrame({"print": (np.int64(key[0]) << 32) | low[often].astype(np.int64), "n": n[often]})

    rows = texts.select("text").mapInArrow(trimmed(run), "bucket bigint, low binary, n binary").groupBy("bucket").applyInPandas(count, "print bigint, n bigint")
    top = rows.orderBy(F.desc("n"), "print").limit(FREQUENT).toArrow()
    out = np.zeros(top.num_rows, dtype=[("print", np.uint64), ("rank", np.int64)])
    out["print"], out["rank"] = top.column(0).to_numpy().astype(np.uint64), top.column(1).to_numpy()
    return np.sort(out, order="print")


def described(texts: DataFrame, width: int, percent: int, bits: int, frequent, seed: int) -> DataFrame:
    """(id, n, fp, bits, first, orders) for each text: the size of its set, its fingerprint and
    sketch, and once a task for each distinct set its prefix under the first order and its short
    prefixes under the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            n, fp, marks, first, orders = [], [], [], [], []
            for named, text in zip(batch.column(0).is_valid().to_pylist(), as_bytes(batch.column(1)), strict=True):
                s = shingle_set(text, width)
                n.append(len(s))
                fp.append(fingerprint(s, seed) if len(s) else None)
                marks.append(sketch(s) if len(s) else None)
                new = named and len(s) > 0 and fp[-1] not in seen  # a row without an id can't stand for a set
                if new and len(seen) < 500_000:
                    seen.add(fp[-1])
                first.append(prefix(s, percent, ORDERS[0], frequent.value, bits).view(np.int64) if new else None)
                orders.append([short_prefix(s, percent, k) for k in ORDERS[1:]] if new else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(marks, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(orders, pa.list_(pa.binary()))],
                names=["id", "n", "fp", "bits", "first", "orders"],
            )

    id_type = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(trimmed(run), f"id {id_type}, n bigint, fp bigint, bits binary, first array<bigint>, orders array<binary>")


def sharing_lists(sets: DataFrame) -> DataFrame:
    """(list, fp, pivot): the distinct sets of each token that is in the first-order prefix of
    more than one, and the least of them.  Both sides read one shuffle."""
    entries = sets.where("first IS NOT NULL").select(F.explode("first").alias("list"), "fp").repartition("list")
    shared = entries.groupBy("list").agg(F.min("fp").alias("pivot"), F.max("fp").alias("last")).where("pivot < last").drop("last")
    return entries.join(shared, "list").distinct()


def let_through(pairs: DataFrame, marks: DataFrame, percent: int, orders: bool) -> DataFrame:
    """The pairs (a, b) that sizes and sketches let through, and with ``orders`` all further orders
    too; no text is read.  ``marks`` holds fp, n, bits and orders of each distinct set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True)
            keep = pa.array([may_link(*r, percent) for r in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    marks = marks.select("fp", "n", "bits", "orders" if orders else F.array().cast("array<binary>").alias("orders"))
    side = lambda x: marks.select(F.col("fp").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "bits", "orders")])
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return both.select("a", "b", "n_a", "bits_a", "orders_a", "n_b", "bits_b", "orders_b").mapInArrow(trimmed(run), "a bigint, b bigint")


def passing(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a written table that sizes, sketches and all further orders let through.
    Only marks of sets in these pairs are shuffled, unless there are very many."""
    ends = pairs.select("a").unionAll(pairs.select("b")).distinct().withColumnRenamed("a", "fp")
    few = marks.join(F.broadcast(ends), "fp", "left_semi") if ends.count() <= BROADCAST_IDS else marks
    return let_through(pairs, few, percent, True)


def partners(fp: np.ndarray, n: np.ndarray, bits: np.ndarray, comp: np.ndarray, percent: int, cap: int) -> tuple[list, bool]:
    """Pairs of one list that may reach the threshold and are in different components so far: for
    each member its first ``cap`` ones, and whether that left any out.

    The sizes and the sketches bound the overlap; what they rule out is out for certain.
    """
    pairs, more = [], False
    if len(fp) < 2 or (comp == comp[0]).all():
        return pairs, more
    found, rest = np.zeros(len(fp), np.int64), np.arange(len(fp))
    for i in range(len(fp) - 1):
        rest = rest[rest > i]
        at = rest[comp[rest] != comp[i]]
        at = at[(100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i]))]
        apart = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
        at = at[apart * (100 + percent) <= (n[at] + n[i]) * (100 - percent)]
        full = found[at] >= cap
        more |= bool(full.any())
        at = at[~full]
        pairs += [(int(fp[i]), int(fp[j])) for j in at]
        found[at] += 1
        if cap == 1:  # a first round: who has found a partner waits for what comes of it
            more |= len(at) > 0
            rest = rest[found[rest] < cap]
            if not len(rest):
                break
    return pairs, more


def candidate_pairs(members: DataFrame, percent: int, cap: int) -> DataFrame:
    """(a, b) from list members (list, fp, n, bits, comp, size).  A row with null a tells that pairs
    of the list b were left out for a later round; other lists are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        done: set = set()

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, whole, fp, n, comp = (table.column(c).to_numpy() for c in ("list", "whole", "fp", "n", "comp"))
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(fp), -1)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            pairs, more = [], []
            for a, b in zip(starts.tolist(), np.r_[starts[1:], len(key)].tolist(), strict=True):
                got, left = partners(fp[a:b], n[a:b], bits[a:b], comp[a:b], percent, cap)
                pairs += [p for p in got if p not in done]
                done.update(got)
                if left:
                    more.append((None, int(whole[a])))
            if len(done) > DONE:
                done.clear()
            rows = pairs + more
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in rows], pa.int64()), pa.array([p[1] for p in rows], pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            table = pa.Table.from_batches(kept)
            key = batch.column(0)
            if key[0] == key[-1] and len(kept) > 1 and kept[-2].column(0)[-1] == key[0]:
                continue
            # the last list may go on in the next batch
            key = table.column("list").to_numpy()
            whole = int(np.searchsorted(key, key[-1]))
            if whole:
                yield from work(table.slice(0, whole))
                kept = table.slice(whole).combine_chunks().to_batches()
        if kept:
            yield from work(pa.Table.from_batches(kept))

    # a long list becomes a list for each pair of its blocks
    cut = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.col("block")))
    cut = cut.withColumn("other", F.explode(other))
    part = F.xxhash64("list", F.least("block", "other"), F.greatest("block", "other"))
    cut = cut.withColumn("whole", F.col("list")).withColumn("list", F.when(F.col("blocks") == 1, F.col("list")).otherwise(part))
    dealt = cut.select("list", "whole", "fp", "n", "bits", "comp").repartition("list").sortWithinPartitions("list", "fp")
    return dealt.mapInArrow(trimmed(run), "a bigint, b bigint")


def verified(pairs: DataFrame, ids: DataFrame, texts: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold.

    ``ids`` has an id for each fp and ``texts`` (id, text).  Each a is the centre of a star of its
    partners; a star of many is cut into parts, so that no task holds them all.
    """
    size = pairs.groupBy("a").agg(F.count("*").alias("leaves"))
    star = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("leaves") / STAR)).alias("part"))
    rows = star.select("a", "part", F.col("b").alias("fp")).unionAll(star.select("a", "part", F.col("a").alias("fp")).distinct())
    need = written(rows.join(ids, "fp").select("id", "fp", "a", "part"), "need")
    n = need.count()
    met = texts.join(F.broadcast(need) if n <= BROADCAST_IDS else need, "id").select("a", "part", "fp", "text")
    dealt = met.repartition("a", "part").sortWithinPartitions("a", "part", F.col("fp") != F.col("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            left, right = [], []
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for (a, part, fp), text in zip(keys, batch.column(3), strict=True):
                if (a, part) != at:
                    at, centre = (a, part), None
                s = shingle_set(text.as_py(), width)
                if not len(s) or fingerprint(s, seed) != fp:
                    continue  # another text of an id that repeats
                if fp == a:
                    centre = s
                elif centre is not None:
                    both = len(np.intersect1d(s, centre, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(centre) - both):
                        left.append(a)
                        right.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(trimmed(run), "a bigint, b bigint").distinct()


def jaccard_components(docs: DataFrame, percent: int = 85, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_shingles, component_id.

    A text's words are what ASCII white space separates, with A-Z lower-cased; its set holds the
    distinct shingles of ``width`` words, or the whole sequence if it has fewer.  Two rows link
    when 100 * intersection >= ``percent`` * union.  Texts without words (null ones too) link
    with nothing, nor do rows with a null id (null component).  component_id is the smallest id
    reachable.  Rows that repeat an id are linked through it only if their texts link.

    Equal sets collapse first; should two unlike sets ever have one fingerprint, another seed is
    taken.  Distinct sets meet where they share a prefix token of the first order (rare shingles
    first); a pair goes on only if sizes, parity sketches and the prefixes under every other order
    allow it, and is then verified on the whole sets.  First each set meets the least set of the
    lists it is in, which settles most groups of copies in one linear pass; then pairs across
    components are taken up in rounds, each allowing more partners a member, until every one is
    ruled out or verified.  A list goes to the next round only if pairs of it were left out.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    named = texts.where("id IS NOT NULL AND text IS NOT NULL")
    bits = max(4, min(24, math.ceil(math.log2(max(2, docs.count() / 100)))))
    frequent = spark.sparkContext.broadcast(frequent_shingles(named, width, bits))
    release(spark)
    for seed in itertools.count():
        sets = written(described(texts, width, percent, bits, frequent, seed), "sets")
        able = sets.where("id IS NOT NULL AND fp IS NOT NULL")
        mark = F.struct("n", "bits")
        once = written(able.groupBy("fp").agg(F.min("id").alias("id"), F.min(mark).alias("low"), F.max(mark).alias("high")), "once")
        if once.where("low <> high").isEmpty():
            break
        forget(sets)
        forget(once)
    ids = once.select("fp", "id")
    lists = written(sharing_lists(able), "lists")
    release(spark)
    # each set meets the pivot with which it shares most lists
    met = lists.where("fp <> pivot").groupBy("fp", "pivot").agg(F.count("*").alias("k"))
    nearest = met.groupBy("fp").agg(F.max(F.struct("k", "pivot")).alias("m")).select(F.col("m.pivot").alias("a"), F.col("fp").alias("b"))
    marks = able.where("first IS NOT NULL").select("fp", "n", "bits", "orders")
    marks = written(marks.join(lists.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"]), "marks")
    near = written(let_through(nearest, marks, percent, False), "near")
    tested = written(passing(near, marks, percent), "candidates")
    edges = written(verified(tested, ids, named, width, percent, seed), "edges")
    labels = written(component_labels(edges, "a", "b"), "labels")
    release(spark)

    def still_open(rows: DataFrame) -> DataFrame:
        """(list, fp, comp, size) of the lists that reach over several components, one of each that
        have the same members."""
        of = labels.select(F.col("id").alias("fp"), F.col("component").alias("found"))
        at = rows.join(of, "fp", "left").select("list", "fp", F.coalesce("found", "fp").alias("comp"))
        same = [F.count("*").alias("size"), *[F.bit_xor(F.xxhash64("fp", F.lit(k))).alias(f"x{k}") for k in (1, 2)]]
        apart = at.groupBy("list").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), *same).where("low < high")
        apart = apart.groupBy("size", "x1", "x2").agg(F.min("list").alias("list")).select("list", "size")
        return written(at.join(apart, "list"), "open")

    open_lists, cap = still_open(lists), 1
    forget(lists)
    found = named
    while not open_lists.isEmpty():
        if cap > 1 and found is named:  # the first round closes most lists; only these texts can be needed from here on
            few = open_lists.select("fp").distinct().join(ids, "fp").select("id").distinct()
            found = written(named.join(F.broadcast(few) if few.count() <= BROADCAST_IDS else few, "id"), "texts")
        now = open_lists.join(marks.select("fp", "n", "bits"), "fp")
        got = written(candidate_pairs(now, percent, cap).distinct(), "candidates")
        pairs = written(got.where("a IS NOT NULL").join(tested, ["a", "b"], "left_anti"), "untested")
        new = written(verified(written(passing(pairs, marks, percent), "passed"), ids, found, width, percent, seed), "edges")
        left = got.where("a IS NULL").select(F.col("b").alias("list"))
        tested = tested.unionAll(pairs)
        if not new.isEmpty():
            edges = edges.unionAll(new)
            labels = written(component_labels(edges, "a", "b"), "labels")
        release(spark)
        if left.isEmpty():
            break
        before, open_lists, cap = open_lists, still_open(open_lists.select("list", "fp").join(left, "list", "left_semi")), cap * 4
        forget(before)
    whole = able.select("id", "n", "fp").join(labels.select(F.col("id").alias("label_of"), "component"), F.col("fp") == F.col("label_of"), "left")
    whole = whole.select("id", "n", F.coalesce("component", "fp").alias("root"))
    least = whole.groupBy("root").agg(F.min("id").alias("component_id"))
    out = whole.join(least, "root").select("id", "n", "component_id")
    apart = sets.where("id IS NULL OR fp IS NULL").select("id", "n", F.when(F.col("fp").isNull(), F.col("id")).alias("component_id"))
    return out.unionAll(apart).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
