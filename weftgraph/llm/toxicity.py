"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import as_bytes

#: The model is fitted on at most about so many labelled rows of each class, picked by a hash of
#: the id; their texts are learned whole.
SAMPLE_ROWS = 1_200
#: Subwords are character n-grams of these lengths, hashed into BITS bits; each bucket has a vector.
LENGTHS, BITS, WIDTH = (3, 4, 5, 6), 20, 8
#: A text's n-grams are made at so many starts at a time, whatever its length.
PIECE = 1 << 16
#: Doubts of a subword's vector: its steps are scaled by (g / (g + DOUBT)) ** 3, where g is its
#: log-likelihood ratio between class and presence; a chance companion of a class hardly moves.
DOUBT = 30.0
#: The averages are multiplied by this, as a toxic word is a small part of a text.
SCALE = 200.0

_WHITE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def subwords(text: bytes | None) -> Iterator[np.ndarray]:
    """Buckets of all character n-grams of a whole text, lower-cased, in bounded pieces.

    An n-gram may begin or end with the white space around a word, which marks the word's ends,
    but none reaches from word to word.  A misspelling shares most of them with the word meant.
    """
    s = f" {(text or b'').decode('utf-8', 'replace').lower()} "
    for a in range(0, len(s), PIECE):
        code = np.frombuffer(s[a : a + PIECE + max(LENGTHS) - 1].encode("utf-32-le"), np.uint32)
        white = _WHITE[np.minimum(code, len(_WHITE) - 1)]
        code = np.where(white, 32, code).astype(np.uint64) + np.uint64(1)
        before = np.r_[0, np.cumsum(white)]
        h = code
        for n in range(2, max(LENGTHS) + 1):
            if len(code) < n:
                break
            h = h[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
            if n in LENGTHS:
                inside = before[n - 1 : len(code)] - before[1 : len(code) - n + 2]  # white space within
                x = h[:PIECE][inside[:PIECE] == 0]
                yield (((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)


def bag(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct subwords of a text and the share of each in all its subwords."""
    total = None
    pieces = list(subwords(text)) if text is None or len(text) <= PIECE else None
    if pieces is not None:
        at, n = np.unique(np.concatenate(pieces or [np.zeros(0, np.int32)]), return_counts=True)
    else:
        total = np.zeros(1 << BITS, np.int64)
        for p in subwords(text):
            total += np.bincount(p, minlength=1 << BITS)
        at = np.flatnonzero(total).astype(np.int32)
        n = total[at]
    return at, (n / max(1, n.sum())).astype(np.float32)


def packed(at: np.ndarray, share: np.ndarray) -> bytes:
    """A bag in a few bytes a subword: steps between buckets, and shares, of which few differ."""
    columns = np.concatenate([np.diff(at, prepend=0).astype("<u4"), share.astype("<f4").view("<u4")])
    return zstandard.compress(columns.view(np.uint8).reshape(len(columns), 4).T.tobytes(), 3)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    step, share = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(2, -1)
    return np.cumsum(step).astype(np.int32), share.view("<f4")


@dataclass
class Softmax:
    """``vectors`` (one a bucket), ``weights`` (width x 2), ``bias`` (2).

    The average of a text's vectors enters the softmax linearly, so scoring needs one number a
    bucket: its vector's part of the difference between the two logits.
    """

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    parts: np.ndarray = field(init=False)

    def __post_init__(self):
        self.parts = (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)

    def probability(self, text: bytes | None) -> float:
        """Probability of label 1: the softmax of the average over all the text's subwords."""
        return score_by_parts(self.parts, float(self.bias[1] - self.bias[0]), text)


def score_by_parts(parts: np.ndarray, bias: float, text: bytes | None) -> float:
    total, n = 0.0, 0
    for p in subwords(text):
        total += float(parts[p].sum(dtype=np.float64))
        n += len(p)
    z = (total / n if n else 0.0) + bias
    return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def told_apart(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """For each bucket how well its presence tells the classes apart: a log-likelihood ratio."""
    with0, with1 = (np.zeros(1 << BITS, np.int64) for _ in range(2))
    for (at, _), k in zip(bags, y, strict=True):
        (with1 if k else with0)[at] += 1
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    share = (with0 + with1) / len(y)
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-12)), 0)
    return np.maximum(0, 2 * (part(with1, n1 * share) + part(with0, n0 * share) + part(n1 - with1, n1 * (1 - share)) + part(n0 - with0, n0 * (1 - share))))


def fit_softmax(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 16, batch: int = 32, rate: float = 3.0, decay: float = 1e-4, seed: int = 1) -> Softmax:
    """Vectors and softmax weights trained together by gradient steps on the mean log loss, the
    classes weighted alike.  Bags that repeat are learned from once.

    Each step moves the vectors of all subwords in its texts, by as much as DOUBT says.  With two
    classes the two errors of a softmax are opposite, so a subword's gradient is one number times
    the difference of the two weight columns.  With no rows or one class the score is constant.
    """
    once = {(at.tobytes(), share.tobytes(), int(k)): i for i, ((at, share), k) in reversed(list(enumerate(zip(bags, y, strict=True))))}
    keep = sorted(once.values())
    bags, y = [bags[i] for i in keep], np.asarray(y, np.int64)[keep]
    rng = np.random.default_rng(seed)
    weights, bias = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32), np.zeros(2, np.float32)
    part = (y.sum() + 0.5) / (len(y) + 1.0)
    if not len(y) or y.min() == y.max():
        return Softmax(np.zeros((1 << BITS, WIDTH), np.float32), weights, np.array([0, np.log(part / (1 - part))]))
    g = told_apart(bags, y)
    trust = ((g / (g + DOUBT)) ** 3).astype(np.float32)
    vectors = rng.standard_normal((1 << BITS, WIDTH), np.float32)
    vectors *= 0.01 * trust[:, None]
    weight = np.where(y == 1, 0.5 / part, 0.5 / (1 - part)).astype(np.float32)
    g_w, g_b = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    batches = []
    for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
        at, slot = np.unique(np.concatenate([bags[r][0] for r in rows]), return_inverse=True)
        batches.append((rows, at, slot.astype(np.int32), np.concatenate([bags[r][1] for r in rows]) * np.float32(SCALE), np.array([len(bags[r][0]) for r in rows])))
        for r in rows:
            bags[r] = None  # the batch holds it now
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        small = step / np.float32(rate) * np.float32(0.5)
        for b in rng.permutation(len(batches)):
            rows, at, slot, amount, size = batches[b]
            owner = np.repeat(np.arange(len(rows)), size)
            mine, apart = vectors[at], weights[:, 1] - weights[:, 0]
            z = np.bincount(owner, amount * (mine @ apart)[slot], len(rows)) + (bias[1] - bias[0])
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            err = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            back = np.bincount(slot, amount * err[owner], len(at)).astype(np.float32)
            into = mine.T @ back
            grad_w, grad_b = np.stack([-into, into], axis=1) + decay * weights, np.array([-err.sum(), err.sum()], np.float32)
            g_w += grad_w**2
            weights -= small * grad_w / np.sqrt(g_w)
            g_b += grad_b**2
            bias -= small * grad_b / np.sqrt(g_b)
            vectors[at] = mine * (1 - np.float32(decay) * step) - (step * trust[at] * back)[:, None] * apart
    vectors *= np.float32(SCALE)
    return Softmax(vectors, weights, bias.astype(float))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Softmax:
    """A model of ``labels`` (ids and 0/1), from at most about ``sample_rows`` texts of each class.

    Tasks turn the sampled texts into bags; the driver gets those, none over one entry a bucket.
    """
    use = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in use.groupBy("y").count().collect()}
    share = F.lit(0)
    for k in n:
        share = F.when(F.col("y") == k, F.lit(int(1_000_000 * min(1.0, sample_rows / n[k])))).otherwise(share)
    picked = use.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share).select(id_col, "y")

    def bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(as_bytes(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([packed(*bag(text))], pa.binary()), batch.column(2).slice(i, 1)], names=["id", "bag", "y"])

    id_type = labels.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    # a repeated id has one text to learn from, the smallest, so a join can't multiply the sample
    rows = texts.join(F.broadcast(picked), id_col).groupBy(id_col).agg(F.min(F.struct("text", "y")).alias("r")).select(F.col(id_col).cast(id_type), "r.text", "r.y")
    got = rows.mapInArrow(bags_of, f"id {id_type}, bag binary, y int").orderBy("id").select("bag", "y").toArrow()
    return fit_softmax([unpacked(x.as_py()) for x in got.column(0)], got.column(1).to_numpy())


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """All columns of ``docs`` with ``score_col`` (of label 1) and ``predicted_col``; a column of
    either name is replaced, so a caller who needs it picks other names.

    ``labels`` holds the rows to learn from; only the text enters a score.  Every whole text is
    averaged over all its subwords.  Null and empty texts, and those of a single letter without
    white space around it, get the score of the bias alone or of what little they hold.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, label_col)
    sent = docs.sparkSession.sparkContext.broadcast((model.parts, float(model.bias[1] - model.bias[0])))

    @F.arrow_udf(T.DoubleType())
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parts, bias = sent.value
        for texts in batches:
            yield pa.array([score_by_parts(parts, bias, t.as_py()) for t in texts], pa.float64())
        pa.default_memory_pool().release_unused()

    # only texts go to Python and only scores come back; all else stays where it is
    bare = docs.drop(score_col, predicted_col).withColumn(score_col, scored(F.col(text_col).cast("binary")))
    return bare.withColumn(predicted_col, F.when(F.col(score_col) >= threshold, 1).otherwise(0))
