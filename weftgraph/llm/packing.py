"""Best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import functools
import json
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.bpe import byte_letters
from weftgraph.llm.common import Recent, as_bytes, groups_of, trimmed
from weftgraph.plans.lineage import written

#: A packing task gets about so many tokens, so their number follows the corpus.
TASK_TOKENS = 16_000_000
OPEN_BINS = 4096
#: Bytes of a generation in the cache of words.
WORD_BYTES = 32 << 20


class OpenBins:
    """Bounded-space best fit.

    At most ``limit`` bins are open.  Bit ``f`` of ``mask`` is set while some open bin has
    exactly ``f`` tokens free, so the tightest bin that still fits a piece is the lowest set
    bit at or above its length.  When a bin more than ``limit`` would be open, the fullest
    closes: the lowest set bit of all.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.mask, self.by_free, self.n_open, self.n_bins = 0, {}, 0, 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_id = stack.pop()
        if not stack:
            del self.by_free[free]
            self.mask ^= 1 << free
        self.n_open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece of ``length`` tokens."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            bin_id, free = self.n_bins, self.capacity
            self.n_bins += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(bin_id)
            self.mask |= 1 << left
            self.n_open += 1
            if self.n_open > self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
        return bin_id, self.capacity - free


#: What a vocabulary's file says if all that happens to PLAIN chunks (printable ASCII and the Latin
#: letters of U+00C0 to U+00FF, which are composed already) before the model is lower-casing,
#: breaking into words as PLAIN_WORD does, and writing bytes as letters.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
PLAIN = re.compile(r"[!-~\xc0-\xff]+")
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")


def breaks_plainly(spec: dict) -> bool:
    """Whether PLAIN_WORD finds the words of lower-cased PLAIN chunks without added tokens."""
    parts = [(spec.get("normalizer") or {}).get("normalizers"), (spec.get("pre_tokenizer") or {}).get("pretokenizers")]
    return parts == [NORMALIZERS, PRE_TOKENIZERS] and spec.get("post_processor") is None and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")


@functools.lru_cache(maxsize=1)
def chunk_encoder(tokenizer_path: str) -> Recent:
    """A bounded cache from chunks without white space to their ids, as bytes of little-endian
    uint32.  For tokenizers that drop white space a text's ids are those of its chunks.  A worker
    process keeps it from task to task.

    Chunks of Latin letters differ mostly in case and in the marks around a word.  Where the
    vocabulary breaks them plainly, their words have a cache of their own, which the tokenizer's
    model fills; all other chunks, and those with added tokens, go to the whole tokenizer.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    plainly, model, letters = breaks_plainly(spec), tokenizer.model, dict(enumerate(byte_letters()))
    added = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])) or "(?!)")

    def tokenised(new: list[str]) -> list[bytes]:
        spelled = (w if w.isascii() else w.encode().decode("latin-1").translate(letters) for w in new)
        return [array("I", [t.id for t in model.tokenize(w)]).tobytes() for w in spelled]

    words = Recent(tokenised, limit=WORD_BYTES)

    def make(chunks: list[bytes]) -> list[bytes]:
        texts = [c.decode("utf-8", "replace") for c in chunks]
        parts = [PLAIN_WORD.findall(t.lower()) if plainly and PLAIN.fullmatch(t) and not added.search(t) else None for t in texts]
        coded = iter(tokenizer.encode_batch_fast([t for t, p in zip(texts, parts, strict=True) if p is None], add_special_tokens=False))
        known = words.fill({w for p in parts if p is not None for w in p})
        return [array("I", next(coded).ids).tobytes() if p is None else known[p[0]] if len(p) == 1 else b"".join([known[w] for w in p]) for p in parts]

    return Recent(make)


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: row (of the document in this table), ``id_col``, piece, start, length,
    ids_crc32 and, with ``keep_ids``, ids (array of ints).

    A document's ids are the tokenizer's without special tokens around them, then ``end_id``.
    Only documents longer than ``capacity`` are cut.  A null text counts as empty and becomes
    one piece that holds ``end_id`` alone.  Rows that repeat an id are documents of their own.
    The tokenizer must drop white space, as word-level BPE does; special strings in a text are
    handled by its own default.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col), F.col(text_col).cast("binary").alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"row bigint, `{id_col}` {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, tail, step = chunk_encoder(tokenizer_path), np.asarray([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for a, b in groups_of(texts):
                bags = [(t or b"").split() for t in texts[a:b]]
                known = cache.fill({w for bag in bags for w in bag})
                src, piece, length, crc, ids = [], [], [], [], []
                for i, bag in enumerate(bags, a):
                    coded = b"".join(map(known.__getitem__, bag)) + tail
                    for k, at in enumerate(range(0, len(coded), step)):
                        part = coded[at : at + step]
                        src.append(i)
                        piece.append(k)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(np.frombuffer(part, dtype="<i4"))
                at = pa.array(src, pa.int64())
                number = np.asarray(piece, dtype=np.int64)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(piece, pa.int32()), pa.array(number * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["row", id_col, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(trimmed(run), schema)


def best_fit_pack(pieces: DataFrame, capacity: int = 4096, open_bins: int = OPEN_BINS, task_tokens: int = TASK_TOKENS, key: tuple[str, ...] = ("row", "piece")) -> DataFrame:
    """``pieces`` (a written table with a ``length`` from 0 to ``capacity``) with sequence_id and offset.

    Pieces are dealt by a hash of ``key``, which should tell all rows apart, to as many tasks as
    the token total asks for; each deals the longest first, so short pieces fill what the long
    ones leave.  A sequence is gapless from offset 0.  Null lengths are an error of the caller.
    """
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, math.ceil(total / task_tokens))
    names = pieces.columns
    at = names.index("length")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 40, OpenBins(capacity, open_bins)
        for batch in batches:
            placed = np.array([bins.place(n) for n in batch.column(at).to_pylist()], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(placed[:, 0] + base), pa.array(placed[:, 1])], names=[*names, "sequence_id", "offset"])

    dealt = pieces.repartition(tasks, F.xxhash64(*key)).sortWithinPartitions(F.desc("length"), *key)
    return dealt.mapInArrow(trimmed(run), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Documents tokenised, cut where longer than ``capacity``, and packed into few sequences.

    Returns the rows of :func:`tokenised_pieces` with sequence_id and offset.  An empty table
    gives no rows.  Other columns of ``docs`` are not read, whatever their names.
    """
    pieces = written(tokenised_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    return best_fit_pack(pieces, capacity, open_bins)
