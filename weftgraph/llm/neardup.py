"""Embedding near-duplicates: cells of a spherical k-means, blocked cosine products, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import component_labels
from weftgraph.plans.lineage import written

#: Centres are fitted on at most about so many vectors; a cell is meant to hold so many.
SAMPLE_ROWS, CELL_ROWS, MAX_CELLS = 50_000, 4_000, 256
#: Products are taken between blocks of so many vectors.
BLOCK = 1_024


def unit_rows(vectors: list) -> list[bytes | None]:
    """Each vector scaled to length 1 in double precision, as bytes; None for those that can't
    link: null, empty, zero, or with null or non-finite components.  What becomes of a vector does
    not depend on the others."""
    out: list[bytes | None] = [None] * len(vectors)
    of_width: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            of_width.setdefault(len(v), []).append(i)
    for at in of_width.values():
        x = np.array([[np.nan if c is None else c for c in vectors[i]] for i in at], dtype=np.float64)
        big = np.abs(x).max(axis=1)
        ok = np.isfinite(big) & (big > 0)
        x[ok] /= big[ok, None]  # so that squares neither overflow nor vanish
        x[ok] /= np.sqrt((x[ok] ** 2).sum(axis=1))[:, None]
        for j in np.flatnonzero(ok):
            out[at[j]] = x[j].tobytes()
    return out


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """``k`` centres of length 1 (fewer if there are fewer distinct rows)."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        length = np.sqrt((sums**2).sum(axis=1))
        centres = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centres)
    return centres


def cells_of(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): each row's own cell, and every other cell that can hold a partner.

    A partner is within chord d = sqrt(2 - 2 threshold).  It can be in another cell only if the
    row is within d of the plane between the two centres, so no link is lost.
    """
    d = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    dots = x @ centres.T
    own = dots.argmax(axis=1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T)))
    near = dots[np.arange(len(x)), own][:, None] - dots <= d * gap[own] + 1e-12
    row, cell = np.nonzero(near)
    return row, cell, cell == own[row]


def links_in_blocks(home: np.ndarray, ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray, other_n: np.ndarray, threshold: float, keys: np.ndarray | None = None, other_keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each home row the copies that it links with, and pairs (id, smaller id) that connect
    what the links connect: within a block every row with the least id that it reaches there, so
    a group in which all are linked gives no more pairs than it has rows in a block.  Rows with
    one key are the same row; unless ``keys`` are given, ids are keys."""
    keys, other_keys = (ids, other_ids) if keys is None else (keys, other_keys)
    count, pairs = np.zeros(len(home), np.int64), []
    for a in range(0, len(home), BLOCK):
        for b in range(0, len(other), BLOCK):
            mine, theirs = ids[a : a + BLOCK], other_ids[b : b + BLOCK]
            hit = home[a : a + BLOCK] @ other[b : b + BLOCK].T >= threshold
            hit &= keys[a : a + BLOCK, None] != other_keys[None, b : b + BLOCK]
            rows, cols = np.nonzero(hit)
            if not len(rows):
                continue
            count[a : a + BLOCK] += np.bincount(rows, other_n[b : b + BLOCK][cols], len(mine)).astype(np.int64)
            low, low_other, before = mine.copy(), theirs.copy(), -1
            while before != (before := int(low.sum() + low_other.sum())):
                np.minimum.at(low_other, cols, low[rows])
                np.minimum.at(low, rows, low_other[cols])
            pairs += [np.stack([mine, low], axis=1)[low < mine], np.stack([theirs, low_other], axis=1)[low_other < theirs]]
    return count, np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)


def embedding_near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, n_links, component_id, kept.

    Rows link when their labels are equal and not null and their cosine, in double precision, is
    at least ``threshold``.  Vectors of unlike width never link.  Vectors that are null,
    empty, zero, or that hold null or non-finite components link with nothing, nor do rows with a
    null id (which have a null component and are not kept).  Rows that repeat an id are told
    apart as rows, each with the links of its own vector, those to rows of its id too, but are one
    node for components.

    Copies of one vector under one label collapse to the least id before anything is compared.
    Cells are (label, width, centre); a cell's home rows meet all that can link with them, in tasks of a
    block of home rows each.
    """
    spark = vectors.sparkSession
    label_type = vectors.schema[label_col].dataType.simpleString()

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = unit_rows(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(unit, pa.binary()), batch.column(2)], names=["id", "unit", "label"])

    rows = written(vectors.select(F.col(id_col), F.col(vector_col), F.col(label_col)).mapInArrow(scale, f"id bigint, unit binary, label {label_type}"), "vectors")
    able = rows.where("id IS NOT NULL AND unit IS NOT NULL AND label IS NOT NULL")
    distinct = written(able.groupBy("label", "unit").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("key", F.monotonically_increasing_id()), "distinct")
    n = distinct.count()
    width = F.octet_length("unit").alias("width")
    sizes = {r["width"]: (r["n"], r["labels"]) for r in distinct.groupBy(width).agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).collect()}
    share = int(1_000_000 * min(1.0, SAMPLE_ROWS / max(1, n)))
    sample: dict[int, list[bytes]] = {}
    for u in distinct.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share).orderBy("id", "label", "unit").select("unit").toArrow().column(0).to_pylist():
        sample.setdefault(len(u), []).append(u)
    # each width has its own centres; one of which too few are sampled is a single cell
    fitted = {}
    for w, units in sample.items():
        of_width, labels = sizes[w]
        k = int(min(MAX_CELLS, max(1, math.ceil(of_width / labels / CELL_ROWS))))
        fitted[w] = spherical_kmeans(np.array([np.frombuffer(u) for u in units]), k)
    centres = spark.sparkContext.broadcast(fitted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(1).to_pylist()
            of_width: dict[int, list[int]] = {}
            for i, u in enumerate(units):
                of_width.setdefault(len(u), []).append(i)
            for w, at in of_width.items():
                x = np.array([np.frombuffer(units[i]) for i in at])
                row, cell, home = cells_of(x, centres.value.get(w, np.ones((1, w // 8))), threshold)
                take = pa.array(np.array(at)[row])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.full(len(row), w, np.int32)), pa.array(cell.astype(np.int32)), pa.array(home), batch.column(1).take(take), batch.column(2).take(take), batch.column(3).take(take), batch.column(4).take(take)], names=["label", "width", "cell", "home", "unit", "id", "n", "key"])

    dealt = written(distinct.select("label", "unit", "id", "n", "key").mapInArrow(deal, f"label {label_type}, width int, cell int, home boolean, unit binary, id bigint, n bigint, key bigint"), "cells")
    # a cell is cut into blocks by a hash, and each task compares two blocks of it: a cell of any
    # size is never in one task
    size = dealt.groupBy("label", "width", "cell").agg(F.count("*").alias("size"))
    blocks = dealt.join(size, ["label", "width", "cell"]).withColumn("blocks", F.ceil(F.col("size") / (2 * CELL_ROWS)).cast("int")).drop("size")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    as_home = blocks.where("home").withColumn("x", F.col("block")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(True))
    as_other = blocks.withColumn("y", F.col("block")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(False))
    task = as_home.unionByName(as_other).select("label", "width", "cell", "x", "y", "side", "id", "n", "unit", "key")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        home, other = pdf[pdf.side], pdf[~pdf.side]
        unit = lambda p: np.frombuffer(b"".join(p.unit)).reshape(len(p), -1)
        count, pairs = links_in_blocks(unit(home), home.id.to_numpy(), unit(other), other.id.to_numpy(), other.n.to_numpy(), threshold, home.key.to_numpy(), other.key.to_numpy()) if len(home) and len(other) else (np.zeros(len(home), np.int64), np.zeros((0, 2), np.int64))
        some = count > 0
        a = np.r_[home.key.to_numpy()[some], pairs[:, 0]]  # counts go by key, pairs by id
        b = pd.arrays.IntegerArray(np.r_[np.zeros(some.sum(), np.int64), pairs[:, 1]], np.arange(len(a)) < some.sum())
        return pd.DataFrame({"label": pd.Series([key[0]] * len(a), dtype=object), "width": np.full(len(a), key[1], np.int32), "a": a, "b": b, "links": np.r_[count[some], np.zeros(len(pairs), np.int64)]})

    found = written(task.groupBy("label", "width", "cell", "x", "y").applyInPandas(compare, f"label {label_type}, width int, a bigint, b bigint, links bigint"), "links")
    counted = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("others"))
    reps = distinct.select("label", "unit", F.col("id").alias("rep"), "n", "key").join(counted, "key", "left").drop("key")
    linked = written(able.join(reps, ["label", "unit"]).select("id", "rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "nodes")
    edges = found.where("b IS NOT NULL").select("a", "b").unionAll(linked.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    component = component_labels(edges, "a", "b").select(F.col("id").alias("node"), "component")
    unable = rows.where("NOT (id IS NOT NULL AND unit IS NOT NULL AND label IS NOT NULL)").select("id", F.lit(0).cast("long").alias("n_links"))
    out = linked.drop("rep").unionAll(unable).join(component, F.col("id") == F.col("node"), "left")
    component_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), "n_links", component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(False)).alias("kept"))
