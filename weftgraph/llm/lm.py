"""Language-model scores from a probabilistic suffix tree over tokens."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weftgraph.llm.common import as_bytes
from weftgraph.plans.lineage import forget, release, written

#: Contexts have at most DEPTH tokens and are followed at least so often in the texts to learn
#: from, whatever the corpus holds; so their number grows with it.
DEPTH, LEAST_COUNT = 3, 2
#: What each distinct token seen in a context gives up to those not seen there.
DISCOUNT = 0.75
#: Nats by which a context must be better than the next shorter one to be kept.
LEAST_GAIN = 2.0
#: So many of the most frequent words, and of the most frequent tokens after hot contexts, are
#: broadcast; the rest is met in a join.  Words of more bytes than LONG go by their hash alone.
TOP_WORDS, TOP_GRAMS, LONG = 400_000, 600_000, 48
#: A part of the tree is built from about so many tokens; a context that more tokens follow is
#: hot (at twice as many): its own distribution is counted apart, and what it branches into are parts of their own.
PART = 500_000
#: A task's counter is handed on when it holds so many words, its tokens when it holds so many.
COUNTER_WORDS, HELD = 700_000, 600_000
#: Bytes of a word's rank among TOP_WORDS.
CODE_BYTES = 3
#: A text is cut at white space into pieces of about so many bytes while it is read.
PIECE = 4 << 20

#: White space is in no token, so it can stand for the end of a text.
END = b"\n"
#: A word's number is its rank or, with the first bit set, its hash; no word has these two.
START, NONE, RARE = np.uint64(1 << 62), np.uint64((1 << 62) + 1), np.uint64(1 << 63)


def tokens_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then one END."""
    return [*text.lower().split(), END]


def pieces_of(text: bytes) -> Iterator[list[bytes]]:
    """The tokens of a text, a bounded piece at a time."""
    at, space = 0, re.compile(rb"[\x20\x09-\x0D]")
    while len(text) - at > PIECE and (cut := space.search(text, at + PIECE)):
        yield text[at : cut.start()].lower().split()
        at = cut.end()
    yield tokens_of(text[at:])


def word_hash(word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, seed)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def after(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """A number for a token in a context."""
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + mix(token) + np.uint64(1))


def is_in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where ``x`` stands in the sorted ``table``, or -1."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


class Words(dict):
    """Word to number: the rank of a frequent word, else its hash with the first bit set."""

    def __init__(self, short: dict[bytes, int], long: dict[int, int], seed: int):
        super().__init__(short)
        self.long, self.seed = long, seed

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word, self.seed)
        rank = self.long.get(h) if len(word) > LONG else None
        return h | (1 << 63) if rank is None else rank


@dataclass
class Tables:
    """What every task holds: of bounded size, whatever the corpus.

    ``words`` numbers the most frequent ones, whose ``hashes``, root probability ``p``, ``base``
    score and whether they are ``known`` go by that number; ``rare_p`` is above the probability of
    all others that were learned.  ``hot`` has for each length the hot contexts (sorted), whether they
    are kept, and above what no probability of a token after them lies that ``grams`` (sorted
    numbers of tokens in hot contexts, and ``gram_p``) lacks.
    """

    words: Words
    hashes: np.ndarray
    p: np.ndarray
    base: np.ndarray
    known: np.ndarray
    rare_p: float
    hot: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    grams: np.ndarray
    gram_p: np.ndarray

    def key_of(self, token: np.ndarray) -> np.ndarray:
        """The number by which the table of words knows a token."""
        rank = np.minimum(token, np.uint64(max(0, len(self.hashes) - 1))).astype(np.int64)
        return np.where(token < len(self.hashes), self.hashes[rank] if len(self.hashes) else token, token) | RARE

    def hot_depth(self, contexts: list[np.ndarray]) -> np.ndarray:
        """How many of the ever longer contexts before each token are hot."""
        depth = np.zeros(len(contexts[0]), np.int64)
        for length, (table, _, _) in enumerate(self.hot, 1):
            depth += (depth == length - 1) & (is_in(contexts[length - 1], table) >= 0)
        return depth

    def below(self, token: np.ndarray, contexts: list[np.ndarray], depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(p, sure, key, kept): the probability of each token in its hot context of that depth
        (the root for 0), or something above it where that isn't sure, the number by which the
        written tables know the pair, and whether that context is kept.  A rare word is never
        sure, as those tables alone know its base score."""
        top = token < len(self.p)
        p, sure = np.full(len(token), self.rare_p), top.copy()
        p[top] = self.p[token[top].astype(np.int64)]
        key, kept = self.key_of(token), np.ones(len(token), bool)
        for length, (table, is_kept, above) in enumerate(self.hot, 1):
            at = np.flatnonzero(depth >= length)
            if len(at):
                key[at] = after(contexts[length - 1][at], self.key_of(token[at]))
                slot = is_in(key[at], self.grams)
                which = is_in(contexts[length - 1][at], table)
                sure[at] = top[at] & (slot >= 0)
                p[at] = np.where(slot >= 0, self.gram_p[np.maximum(slot, 0)] if len(self.grams) else 0, above[which])
                kept[at] &= is_kept[which]
        return p, sure, key, kept


def chunks(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[tuple]:
    """(rows, learned, lengths, row of each token, the DEPTH tokens before it (nearest first), it,
    ids) for about HELD tokens at a time of (text, learned, id) batches; ids may be left out.  A
    row's number is that of its task and its place there."""
    first, n = TaskContext.get().partitionId() << 33, 0
    held: list[tuple] = []
    size = 0

    def out() -> tuple:
        x = np.concatenate([h[2] for h in held])
        lengths = np.array([len(h[2]) - DEPTH for h in held])
        starts = np.r_[0, np.cumsum(lengths + DEPTH)[:-1]]
        at = np.arange(lengths.sum()) + np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + DEPTH
        return np.array([h[0] for h in held]), np.array([h[1] for h in held]), lengths, np.repeat(np.arange(len(held)), lengths), [x[at - k] for k in range(1, DEPTH + 1)], x[at], [h[3] for h in held]

    for batch in batches:
        ids = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for text, learned, who in zip(batch.column(0), batch.column(1).to_pylist(), ids, strict=True):
            before = np.array([NONE] * (DEPTH - 1) + [START], np.uint64)
            for piece in pieces_of(text.as_py() or b""):
                x = np.r_[before, np.fromiter(map(words.__getitem__, piece), np.uint64, len(piece))]
                before = x[-DEPTH:]
                held.append((first + n, bool(learned), x, who))
                size += len(piece)
                if size > HELD:
                    yield out()
                    held, size = [], 0
            n += 1
    if held:
        yield out()


def contexts_of(before: list[np.ndarray], key_of) -> list[np.ndarray]:
    """Numbers of the contexts of 1 to DEPTH tokens before each token; 0 where a text is shorter."""
    out, c = [], np.zeros(len(before[0]), np.uint64)
    for length, x in enumerate(before, 1):
        special = (x == START) | (x == NONE)
        c = after(c + np.uint64(length), np.where(special, x, key_of(x)))
        c = np.where(x == NONE, np.uint64(0), c)
        out.append(c)
    return out


def pack(fixed: list[np.ndarray], loose: list[np.ndarray]) -> bytes:
    """Arrays of bytes of one length, one after another, and arrays of 64-bit numbers of any
    length, compressed; :func:`unpack` gives them back."""
    sizes = np.array([len(fixed[0]), *[len(x) for x in loose]], np.int64)
    return zstandard.compress(b"".join([sizes.tobytes(), *[x.tobytes() for x in fixed], *[x.tobytes() for x in loose]]), 1)


def unpack(data: bytes, n_fixed: int, n_loose: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    raw, at = zstandard.decompress(data), 8 * (n_loose + 1)
    n, *sizes = np.frombuffer(raw, np.int64, n_loose + 1).tolist()
    fixed = [np.frombuffer(raw, np.uint8, n, at + n * i) for i in range(n_fixed)]
    starts = at + n * n_fixed + 8 * np.r_[0, np.cumsum(sizes)]
    return fixed, [np.frombuffer(raw[a:b], np.uint64) for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]


def groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where one of each distinct number stands, the place of each number among those)."""
    order = np.argsort(x)
    inorder = x[order]
    new = np.ones(len(x), bool)
    new[1:] = inorder[1:] != inorder[:-1]
    slot = np.empty(len(x), np.int64)
    slot[order] = np.cumsum(new) - 1
    return order[new], slot


def grown(p: np.ndarray, token: np.ndarray, contexts: list[np.ndarray], depth: np.ndarray, learned: np.ndarray, kept: np.ndarray, least_gain: float = LEAST_GAIN) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) for each token of a part of the tree: its probability is a + b * (that in its hot
    context, or at the root).

    ``p`` is the latter or something above it.  From the first context longer than ``depth`` on,
    one is kept if the next shorter one is, if it is followed LEAST_COUNT times and if it gains
    more than ``least_gain`` over that.  The gain is in nats over the texts to learn from, each
    occurrence judged by the counts without it, so that chance does not look like divergence.  A
    kept context's distribution is its counts less DISCOUNT each, and what that frees goes by the
    next shorter one's.
    """
    a, b = np.zeros(len(p)), np.ones(len(p))
    alive = kept.copy()
    for length, context in enumerate(contexts, 1):
        at = np.flatnonzero(alive & (depth < length) & (context != 0))
        alive = alive & (depth >= length)
        # too seldom even with all that shares some bits: most contexts need no more than this
        few = (context[at] >> np.uint64(42)).astype(np.int64)
        at = at[np.bincount(few, learned[at], 1 << 22)[few] >= LEAST_COUNT]
        if not len(at):
            continue
        first, slot = groups(after(context[at], token[at]))
        t = np.bincount(slot, learned[at]).astype(float)
        mine = at[first]
        names, of = groups(context[mine])
        total, kinds = np.bincount(of, t), np.bincount(of, t > 0)
        share, freed, gain = smoothed(t, total[of], kinds[of], a[mine] + b[mine] * p[mine])
        keep = (total >= LEAST_COUNT) & (np.bincount(of, gain, len(names)) > least_gain)
        on = keep[of][slot]
        at, slot = at[on], slot[on]
        a[at] = share[slot] + freed[slot] * a[at]
        b[at] *= freed[slot]
        alive[at] = True
    return a, b


def smoothed(t: np.ndarray, total: np.ndarray, kinds: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share, freed, gain) of tokens seen ``t`` times in a context seen ``total`` times with
    ``kinds`` distinct tokens: their probability is share + freed * ``below``; their part of the gain."""
    n = np.maximum(total, 1.0)
    share, freed = np.maximum(t - DISCOUNT, 0) / n, kinds * DISCOUNT / n
    others, other_kinds = np.maximum(total - 1, 1.0), np.maximum(kinds - (t == 1), 1.0)
    without = np.maximum(t - 1 - DISCOUNT, 0) / others + other_kinds * DISCOUNT / others * below
    return share, np.where(total > 0, freed, 1.0), np.where(t > 0, t * np.log(without / below), 0.0)


def word_table(source: DataFrame, seed: int) -> DataFrame:
    """(word, key, n, t): how often each token is in all texts and in those to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for learned, found in enumerate(seen):
                keys, n = list(found), np.fromiter(found.values(), np.int64, len(found))
                for a in range(0, len(keys), 50_000):
                    part = n[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 50_000], pa.binary()), pa.array(part), pa.array(part * learned)], names=["word", "n", "t"])
                found.clear()

        for batch in batches:
            for text, learned in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for piece in pieces_of(text.as_py() or b""):
                    seen[bool(learned)].update(piece)
                if len(seen[0]) + len(seen[1]) > COUNTER_WORDS:
                    yield from out()
        yield from out()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.fromiter((word_hash(w, seed) for w in as_bytes(batch.column(0))), np.uint64, batch.num_rows) | RARE
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys.view(np.int64)), batch.column(1), batch.column(2)], names=["word", "key", "n", "t"])

    counted = source.mapInArrow(run, "word binary, n bigint, t bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    return counted.mapInArrow(named, "word binary, key bigint, n bigint, t bigint")


def hot_level(source: DataFrame, sent, length: int) -> DataFrame:
    """(context, shorter, key, parent, n, t) for each token after each hot context of ``length``
    tokens, and with a null context how often each context of one token more is met (key, n) that
    ends in one.  ``shorter`` is the next shorter context, ``parent`` the token's number in it."""

    names = ["context", "shorter", "key", "parent", "n", "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for _, learned, _, row, before, token, _ in chunks(batches, tables.words):
            at = np.flatnonzero(is_in(contexts_of(before[:1], tables.key_of)[0], tables.hot[0][0]) >= 0)
            contexts = contexts_of([x[at] for x in before], tables.key_of)
            deep = tables.hot_depth(contexts) >= length
            at, contexts = at[deep], [c[deep] for c in contexts]
            _, _, parent, _ = tables.below(token[at], contexts, np.full(len(at), length - 1))
            context = contexts[length - 1]
            key, first, slot = np.unique(after(context, tables.key_of(token[at])), return_index=True, return_inverse=True)
            t = np.bincount(slot, learned[row[at]], len(key)).astype(np.int64)
            signed = lambda x: pa.array(x.view(np.int64))
            shorter = contexts[length - 2] if length > 1 else np.zeros(len(at), np.uint64)
            yield pa.RecordBatch.from_arrays([signed(context[first]), signed(shorter[first]), signed(key), signed(parent[first]), pa.array(np.bincount(slot, minlength=len(key))), pa.array(t)], names=names)
            if length < DEPTH:
                longer, n = np.unique(contexts[length], return_counts=True)
                none = pa.nulls(len(longer), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, signed(longer), none, pa.array(n), pa.array(n)], names=names)

    rows = source.mapInArrow(run, "context bigint, shorter bigint, key bigint, parent bigint, n bigint, t bigint")
    return rows.groupBy("context", "shorter", "key", "parent").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def with_hot_contexts(source: DataFrame, tables: Tables, values: DataFrame, hot: np.ndarray, limit: int, least_gain: float) -> DataFrame:
    """Fills ``tables`` with the contexts that more than ``limit`` tokens follow, level by level,
    and returns ``values`` (key, p of each word at the root, its base score and whether it is
    known) with those of tokens in hot contexts.

    There are no more hot contexts of a length than tokens / ``limit``.
    """
    spark = source.sparkSession
    top: list[tuple[np.ndarray, np.ndarray]] = []
    for length in range(1, DEPTH + 1):
        if not len(hot):
            break
        tables.hot.append((np.sort(hot), np.ones(len(hot), bool), np.ones(len(hot))))
        sent = spark.sparkContext.broadcast(tables)
        counts = written(hot_level(source, sent, length), "hot")
        rows = counts.where("context IS NOT NULL")
        of = rows.groupBy("context").agg(F.sum("t").cast("double").alias("total"), F.count(F.when(F.col("t") > 0, 1)).cast("double").alias("kinds"))
        # few and bounded as the hot contexts are, so the counts of a hot one need no hot join key
        met = rows.join(F.broadcast(of), "context").join(values.select(F.col("key").alias("parent"), F.col("p").alias("below"), "base", "known"), "parent")
        n = F.greatest("total", F.lit(1.0))
        p = F.greatest(F.col("t") - DISCOUNT, F.lit(0.0)) / n + F.col("kinds") * DISCOUNT / n * F.col("below")
        others, kinds = F.greatest(F.col("total") - 1, F.lit(1.0)), F.greatest(F.col("kinds") - F.when(F.col("t") == 1, 1).otherwise(0), F.lit(1.0))
        without = F.greatest(F.col("t") - 1 - DISCOUNT, F.lit(0.0)) / others + kinds * DISCOUNT / others * F.col("below")
        met = met.withColumns({"own": F.when(F.col("total") > 0, p).otherwise(F.col("below")), "gain": F.when(F.col("t") > 0, F.col("t") * F.log(without / F.col("below"))).otherwise(0.0)})
        met = written(met.select("context", "shorter", "key", "n", "total", "kinds", "below", "own", "gain", "base", "known"), "smoothed")
        stat = met.groupBy("context").agg(F.sum("gain").alias("gain"), F.first("total").alias("total"), F.first("kinds").alias("kinds"), F.first("shorter").alias("shorter")).toPandas()
        keep = (stat.total >= LEAST_COUNT) & (stat.gain > least_gain)
        if length > 1:
            table, is_kept, _ = tables.hot[-2]
            keep &= is_kept[is_in(stat.shorter.to_numpy().view(np.uint64), table)]
        kept = spark.createDataFrame(stat.assign(kept=keep)[["context", "kept"]], "context bigint, kept boolean") if len(stat) else None
        level = met.join(F.broadcast(kept), "context").select("key", F.when(F.col("kept"), F.col("own")).otherwise(F.col("below")).alias("p"), "base", "known", "n") if kept is not None else met.select("key", F.col("own").alias("p"), "base", "known", "n")
        before, values = values, written(values.unionAll(level.select("key", "p", "base", "known")), "values")
        best = level.orderBy(F.desc("n"), "key").limit(max(1, TOP_GRAMS // DEPTH)).select("key", "p", "n").toArrow()
        top.append((best.column(0).to_numpy().view(np.uint64), best.column(1).to_numpy()))
        table = tables.hot[-1][0]
        at = is_in(stat.context.to_numpy().view(np.uint64), table)
        is_kept, above = np.ones(len(table), bool), np.ones(len(table))
        least = float(best.column(2).to_numpy().min()) if best.num_rows else 1.0
        is_kept[at] = keep
        above[at] = np.minimum(1.0, (least + stat.kinds * DISCOUNT) / np.maximum(stat.total, 1))
        tables.hot[-1] = (table, is_kept, above)
        keys, ps = np.concatenate([k for k, _ in top]), np.concatenate([v for _, v in top])
        order = np.argsort(keys)
        tables.grams, tables.gram_p = keys[order], ps[order]
        more = counts.where((F.col("context").isNull()) & (F.col("n") > limit) & (F.col("key") != 0)).select("key").toPandas()
        hot = more.key.to_numpy().view(np.uint64)
        sent.destroy()
        for table in [counts, met, *([before] if length > 1 else [])]:
            forget(table)
    return values


def score_texts(docs: DataFrame, learn_col: str, id_col: str = "doc_id", text_col: str = "text", least_gain: float = LEAST_GAIN) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_tokens, n_known, train_tokens, base_score, score.

    ``learn_col`` (boolean; null is false) marks the rows to learn from.  Tokens are the words
    between ASCII white space with A-Z lower-cased, then one END; those never learned are one
    symbol.  base_score is the unigram model with one added to each count.  score is log10 of the
    suffix tree's probability: each token is predicted by the longest kept context before it.
    Contexts of up to DEPTH tokens are kept when they gain ``least_gain`` nats over the next shorter one and are
    followed LEAST_COUNT times.

    The tree falls into parts, each the contexts that end in the same tokens, so every token is
    dealt to one part, as a few bytes, and all contexts before it are judged there; nothing is
    held for the whole corpus but the most frequent words.  A rare word's root probability is not
    known there: the tests take a value above it, and its score is settled in a join afterwards.
    Contexts that a great many tokens follow are counted apart and split by what is before them.

    A null text counts as empty and has the END alone; repeated rows and null ids stay.  With
    nothing to learn from all scores are 0, as there is one symbol only.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(text_col).cast("binary"), F.coalesce(F.col(learn_col), F.lit(False)))
    seed = 0
    root = written(word_table(source, seed), "words")
    while root.select("key").distinct().count() < root.count():  # two words of one number
        forget(root)
        seed += 1
        root = written(word_table(source, seed), "words")
    n, v, tokens = root.agg(F.coalesce(F.sum("t"), F.lit(0)), F.count(F.when(F.col("t") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    freed = DISCOUNT * v / n if n else 1.0
    p = F.when(F.col("t") > 0, (F.col("t") - DISCOUNT) / F.lit(float(max(n, 1)))).otherwise(F.lit(freed))
    base, known = F.log10((F.col("t") + 1) / F.lit(float(n + v + 1))), F.when(F.col("t") > 0, 1.0).otherwise(0.0)
    rows = root.select("word", "key", "n", "t", p.alias("p"), base.alias("base"), known.alias("known"))
    short = F.when(F.octet_length("word") <= LONG, F.col("word")).alias("word")
    top = rows.orderBy(F.desc("n"), "word").limit(TOP_WORDS).select(short, *rows.columns[1:]).toArrow()
    names, keys, often = top.column(0).to_pylist(), top.column(1).to_numpy().view(np.uint64), top.column(2).to_numpy()
    xs = [top.column(i).to_numpy() for i in (4, 5, 6)]
    short_names = {w: i for i, w in enumerate(names) if w is not None}
    # a long word's rank goes by its whole hash, whose first bit the key has lost: look both up
    long_names = {h: i for i, w in enumerate(names) if w is None for h in (int(keys[i]), int(keys[i]) ^ (1 << 63))}
    rare_p = float(often.min() if len(often) else 1) / max(n, 1)
    tables = Tables(Words(short_names, long_names, seed), keys, *xs, rare_p, [], np.zeros(0, np.uint64), np.zeros(0))
    limit = max(2 * PART, tokens // 10_000_000)
    values = rows.select("key", "p", "base", "known")
    hot = contexts_of([keys[often > limit]], lambda x: x | RARE)[0] if len(often) else np.zeros(0, np.uint64)
    start = contexts_of([np.array([START])], lambda x: x)[0]
    if tokens and docs.count() > limit:
        hot = np.r_[hot, start]
    values = with_hot_contexts(source, tables, values, hot, limit, least_gain)
    release(spark)
    sums = tree_scores(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.coalesce(F.col(learn_col), F.lit(False)).alias("learn")), tables, max(1, math.ceil(tokens / PART)), least_gain)
    sums = written(sums, "scores")
    told = values.select(F.col("key").alias("of"), "p", F.col("base").alias("word_base"), F.col("known").alias("word_known"))
    rest = sums.where("key IS NOT NULL").join(told, F.col("key") == F.col("of"))
    is_rare, null = F.col("known") == 1, F.lit(None)
    settled = rest.select(
        "row", null.cast(sums.schema["id"].dataType).alias("id"), null.cast("bigint").alias("n_tokens"),
        F.log10(F.col("a") + F.col("b") * F.col("p")).alias("score"),
        F.when(is_rare, F.col("word_base")).alias("base_score"), F.when(is_rare, F.col("word_known")).alias("known"),
    )
    every = sums.where("key IS NULL").select("row", "id", "n_tokens", "score", "base_score", "known").unionAll(settled)
    total = every.groupBy("row").agg(F.max("id").alias(id_col), F.sum("n_tokens").alias("n_tokens"), F.sum("known").cast("long").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return total.select(id_col, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def tree_scores(source: DataFrame, tables: Tables, parts: int, least_gain: float) -> DataFrame:
    """Rows (row, id, n_tokens, score, base_score, known) to be added up by row; and rows with a
    key, for a token whose probability is a + b * p(key); where known is 1 it is a rare word, whose
    base score and whether it is known come with p."""
    spark = source.sparkSession
    sent = spark.sparkContext.broadcast(tables)
    id_type = source.schema["id"].dataType.simpleString()
    arrow_id = to_arrow_type(source.schema["id"].dataType)
    out_names = ["row", "id", "n_tokens", "score", "base_score", "known", "key", "a", "b"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for rows, learned, lengths, row, before, token, ids in chunks(batches, tables.words):
            # the first context that isn't hot says where a token goes; without one it may go anywhere
            route = contexts_of(before[:1], tables.key_of)[0]
            hot = np.flatnonzero(is_in(route, tables.hot[0][0]) >= 0) if tables.hot else np.zeros(0, np.int64)
            if len(hot):
                contexts = contexts_of([x[hot] for x in before], tables.key_of)
                depth = tables.hot_depth(contexts)
                onward = np.array(contexts)[np.minimum(depth, DEPTH - 1), np.arange(len(hot))]
                route[hot] = np.where((depth == DEPTH) | (onward == 0), hot.astype(np.uint64), onward)
            part = (mix(route) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            of = row[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(part[order].astype(np.int64)) > 0]), len(order)]
            places = part[order[cuts[:-1]]]
            new = np.r_[True, np.diff(of) != 0]
            new[cuts[:-1]] = True
            planes, loose = [new.view(np.uint8), learned[of].astype(np.uint8)], [rows[of[new]].astype(np.uint64)]
            ends = [np.r_[0, np.cumsum(new)][cuts]]
            for x in (token, *before):
                x = x[order]
                code = np.where(x == START, 1, np.where(x == NONE, 2, np.where(x >= RARE, 0, x + np.uint64(3)))).astype("<u4")
                planes += list(code.view(np.uint8).reshape(len(code), 4).T[:CODE_BYTES].copy())
                loose.append(x[x >= RARE])
                ends.append(np.r_[0, np.cumsum(x >= RARE)][cuts])
            blocks = [pack([x[a:b] for x in planes], [x[e[i] : e[i + 1]] for x, e in zip(loose, ends, strict=True)]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            firsts = np.zeros(len(blocks), np.int64)
            top = token < RARE
            rank = token[top].astype(np.int64)
            base, known = np.bincount(row[top], tables.base[rank], len(rows)), np.bincount(row[top], tables.known[rank], len(rows))
            n, m = len(blocks), len(rows)
            none = pa.nulls
            whole, real = pa.int64(), pa.float64()
            columns = [
                pa.array(np.r_[places, rows % parts].astype(np.int32)),
                pa.concat_arrays([pa.array(blocks, pa.binary()), none(m, pa.binary())]),
                pa.array(np.r_[firsts, rows]),
                pa.concat_arrays([none(n, arrow_id), pa.array(ids, arrow_id)]),
                pa.concat_arrays([none(n, whole), pa.array(lengths, whole)]),
                pa.concat_arrays([none(n, real), pa.array(base)]),
                pa.concat_arrays([none(n, real), pa.array(known)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "data", "row", "id", "n_tokens", "base_score", "known"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        held: list[bytes] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at = None

        def work() -> pa.RecordBatch:
            token, before, row, learned = decode(held)
            contexts = contexts_of(before, tables.key_of)
            depth = tables.hot_depth(contexts)
            p, sure, key, kept = tables.below(token, contexts, depth)
            a, b = grown(p, token, contexts, depth, learned, kept, least_gain)
            add(row[sure], np.log10(a[sure] + b[sure] * p[sure]))
            left = np.flatnonzero(~sure)
            is_rare = (token[left] >= RARE).astype(float)
            return batch_of(row[left], np.zeros(len(left)), key[left].view(np.int64), a[left], b[left], is_rare)

        def batch_of(row, score, key, a, b, is_rare=None) -> pa.RecordBatch:
            none = lambda t: pa.nulls(len(row), t)
            columns = [pa.array(row), none(arrow_id), none(pa.int64()), pa.array(score), none(pa.float64()), none(pa.float64()) if is_rare is None else pa.array(is_rare), none(pa.int64()) if key is None else pa.array(key), pa.array(a), pa.array(b)]
            return pa.RecordBatch.from_arrays(columns, names=out_names)

        def add(row, score) -> None:
            first, slot = groups(row)
            found.append((row[first], np.bincount(slot, score, len(first))))

        def summed(least: int) -> Iterator[pa.RecordBatch]:
            """Adds up by row what was found, once it is much, and hands on ``least`` rows or more."""
            if found and sum(len(x[0]) for x in found) >= 4 * least:
                row, score = (np.concatenate(x) for x in zip(*found, strict=True))
                found.clear()
                add(row, score)
                if (n := len(found[0][0])) >= least:
                    yield batch_of(*found.pop(), None, np.zeros(n), np.ones(n))

        for batch in batches:
            is_block = batch.column(1).is_valid()
            rest = batch.filter(pc.invert(is_block))
            if rest.num_rows:
                real, key = pa.nulls(rest.num_rows, pa.float64()), pa.nulls(rest.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([rest.column(2), rest.column(3), rest.column(4), real, rest.column(5), rest.column(6), key, real, real], names=out_names)
            batch = batch.filter(is_block)
            for part, data in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if part != at and held:
                    yield work()
                    held = []
                    yield from summed(HELD * 2 // 3)
                at = part
                held.append(data)
        if held:
            yield work()
        yield from summed(0)

    dealt = source.select("text", "learn", "id").mapInArrow(deal, f"part int, data binary, row bigint, id {id_type}, n_tokens bigint, base_score double, known double")
    dealt = dealt.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(settle, f"row bigint, id {id_type}, n_tokens bigint, score double, base_score double, known double, key bigint, a double, b double")


def decode(held: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(token, tokens before it, row, learned) of packed blocks."""
    out: list[list[np.ndarray]] = [[] for _ in range(DEPTH + 3)]
    for data in held:
        (new, flag, *planes), (rows, *rare) = unpack(data, 2 + CODE_BYTES * (DEPTH + 1), DEPTH + 2)
        for i, odd in enumerate(rare):
            code = sum(p.astype(np.uint64) << np.uint64(8 * k) for k, p in enumerate(planes[CODE_BYTES * i : CODE_BYTES * (i + 1)]))
            x = code - np.uint64(3)
            x[code == 1], x[code == 2] = START, NONE
            x[code == 0] = odd
            out[i].append(x)
        out[-2].append(rows.astype(np.int64)[np.cumsum(new, dtype=np.int64) - 1])
        out[-1].append(flag)
    token, *before, row, learned = (np.concatenate(x) for x in out)
    return token, before, row, learned.astype(float)
