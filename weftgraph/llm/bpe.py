"""Byte-pair encoding and decoding with a priority queue over linked symbols."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import Recent, groups_of

#: Fixed value: how byte-level BPE vocabularies of this kind break a text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: a printable
    Latin-1 byte stands for itself, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary read from a ``tokenizers`` JSON file.

    ``encode`` gives the ids of a whole text: special strings in it become their ids, the rest
    is broken into pre-tokens, and in each the pair of lowest merge rank is merged until none
    is left.  ``decode`` concatenates vocabulary strings.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self.ids: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        # a pair of ids as one number, to the rank and the new id as one number
        self.merges = {self.ids[a] << 32 | self.ids[b]: rank << 32 | self.ids[a + b] for rank, (a, b) in enumerate(pairs)}
        self.byte_id = [self.ids[c] for c in letters]
        of_letter = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        special_ids = set(self.special.values())
        self.raw = {i: bytes(of_letter[c] for c in s) for s, i in self.ids.items() if i not in special_ids} | {i: s.encode() for s, i in self.special.items()}
        self.breaks = regex.compile(PRE_TOKEN)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token.

        Symbols form a doubly linked list.  The queue holds rank and left position of adjacent
        pairs, as one number each; an entry is stale, and skipped, if the pair that is now at its
        position has another rank.
        """
        sym = [self.byte_id[b] for b in word]
        n = len(sym)
        rank_of, low = self.merges.get, (1 << 32) - 1
        queue = [(m >> 32 << 32) | i for i in range(n - 1) if (m := rank_of(sym[i] << 32 | sym[i + 1])) is not None]
        if not queue:
            return sym
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = pop(queue)
            i = entry & low
            j = after[i]
            if sym[i] < 0 or j >= n:
                continue
            m = rank_of(sym[i] << 32 | sym[j])
            if m is None or m >> 32 != entry >> 32:
                continue
            new = sym[i] = m & low
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := rank_of(new << 32 | sym[k])) is not None:
                    push(queue, (m >> 32 << 32) | i)
            h = before[i]
            if h >= 0 and (m := rank_of(sym[h] << 32 | new)) is not None:
                push(queue, (m >> 32 << 32) | h)
        return [s for s in sym if s >= 0]

    def pre_tokens(self, text: str) -> Iterator[str | int]:
        """Pre-tokens in order; a special string comes as its id."""
        parts = self.specials.split(text) if self.specials else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part]
            elif part:
                yield from self.breaks.findall(part)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.pre_tokens(text):
            out += [p] if isinstance(p, int) else self.merge(p.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")


#: Where white space stands beside white space, a pre-token can span several of both.
_SPANNING = re.compile(r"\s\s")


def chunks_of(bpe: ByteBpe, text: str) -> list[str]:
    """A text cut at places where every pre-token ends: before single spaces and around single
    line ends.

    Joining the encodings of the chunks gives that of the text.  Where white space is beside
    white space, or a special string occurs, the pre-tokens themselves are the chunks.
    """
    if _SPANNING.search(text) or any(s in text for s in bpe.special):
        return [p if isinstance(p, str) else bpe.raw[p].decode() for p in bpe.pre_tokens(text)]
    out: list[str] = []
    for line in text.split("\n"):
        first, *rest = line.split(" ")
        if first:
            out.append(first)
        out += [" " + r for r in rest]
        out.append("\n")
    out.pop()
    return out


@functools.lru_cache(maxsize=1)
def coder(tokenizer_path: str) -> tuple[ByteBpe, Recent]:
    """A vocabulary, and a bounded cache from chunks to (ids as text, their number, decoded bytes).
    A worker process keeps both from task to task."""
    bpe = ByteBpe(tokenizer_path)
    of_word = Recent(lambda pre: [[bpe.special[p]] if p in bpe.special else bpe.merge(p.encode()) for p in pre], cost=lambda p, ids: len(p) + 8 * len(ids))

    def coded(chunks: list[str]) -> list[tuple[str, int, bytes]]:
        pre = [[c] if c in bpe.special else bpe.breaks.findall(c) for c in chunks]
        known, raw, out = of_word.fill({p for ps in pre for p in ps}), bpe.raw.__getitem__, []
        for ps in pre:
            ids = known[ps[0]] if len(ps) == 1 else [i for p in ps for i in known[p]]
            out.append((",".join(map(str, ids)), len(ids), b"".join(map(raw, ids))))
        return out

    return bpe, Recent(coded, 128 << 20, lambda chunk, value: len(chunk) + len(value[0]) + len(value[2]) + 150)


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode every whole text and decode the ids again.

    One row per input row: ``id_col``, n_tokens, ids_sha256 (of decimal ids joined by commas),
    decoded_sha256 and, as ``keep`` asks, ids (array of ints) and decoded (text).  A null text
    counts as empty: no ids, digests of the empty string.  Repeated rows stay.  Each chunk's ids
    are found once and kept in a cache of bounded size; nothing is shuffled.
    """
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * ("ids" in keep) + ", decoded string" * ("decoded" in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, of_chunk = coder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups_of(texts):
                n, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
                chunked = [chunks_of(bpe, text) if text else [] for text in texts[a:b]]
                known = of_chunk.fill(set().union(*chunked)).__getitem__
                for chunks in chunked:
                    ids, counts, raw = zip(*map(known, chunks), strict=True) if chunks else ((), (), ())
                    ids = ",".join(ids)
                    n.append(sum(counts))
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    # bytes that are no UTF-8 can't come from a text; were there any, they'd be replaced
                    decoded = b"".join(raw).decode("utf-8", "replace")
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if "ids" in keep:
                        all_ids.append([int(i) for i in ids.split(",")] if ids else [])
                    if "decoded" in keep:
                        all_text.append(decoded)
                columns = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if "ids" in keep:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                if "decoded" in keep:
                    columns.append(pa.array(all_text, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)
