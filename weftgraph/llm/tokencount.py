"""Token counts without token ids."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes
from weftgraph.llm.wordbag import sum_over_words, word_counts
from weftgraph.plans.lineage import written


def piece_counts(counts: DataFrame, tokenizer_path: str) -> DataFrame:
    """``counts`` (word, n) with n_pieces: the tokens that the tokenizer makes of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            coded = tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in as_bytes(batch.column(0))], add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(c) for c in coded], pa.int64())], names=["word", "n", "n_pieces"])

    return counts.mapInArrow(run, "word binary, n bigint, n_pieces bigint")


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes (UTF-8), n_tokens, over_limit.

    Pre-tokens are the runs between ASCII white space, at which the tokenizer (one that drops
    white space) always breaks.  The pieces of each distinct one are counted once; a text's count
    is the sum over its pre-token frequencies, so no ids are kept.  A null text is empty; empty
    texts have no tokens; repeated rows and null ids stay; an empty table gives no rows.
    """
    pieces = written(piece_counts(word_counts(docs, bytes.split, text_col), tokenizer_path), "pieces")
    sums = sum_over_words(docs, pieces, ["n_pieces"], bytes.split, id_col, text_col)
    n = F.col("n_pieces").cast("long")
    return sums.select(id_col, "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
