"""Hard negatives by a full sort of every anchor's scores, in cells of anchors by rows.

Anchors and rows are dealt to blocks by a hash of their place, and each cell (block of anchors, block of rows) is one
group of a cogrouped join: integer scores by one matrix product, a sort of each anchor's scores by (score, id), and binary
searches in it. A cell returns a few rows for each anchor, and the cells of an anchor are merged by rank, which Spark
limits before the shuffle. No key, label or copy of a vector decides where a row goes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm import text as T
from graphloom.plans.scratch import Scratch
from graphloom.plans.ship import ship

#: Anchors and rows of a cell, about; a task holds one cell.
ANCHORS, ROWS = 4096, 8192
#: Anchors that are scored at once within a cell.
_STRIP = 256
_LONG = 2**63


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors one below another; shorter ones are filled up with zeros."""
    column = column.combine_chunks()
    lists = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), sizes), T.places(sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _widest(*columns: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max(initial=0)) for column in columns for c in column.chunks), default=0)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of vectors of whole numbers; beyond 64 bits the nearest long."""
    most = (np.abs(x).max(initial=0) * np.abs(y).max(initial=0)) * max(1, x.shape[1])
    if most < 2.0**53:
        return (x @ y.T).astype(np.int64)  # every partial sum is exact
    if most < 2.0**62:
        return x.astype(np.int64) @ y.astype(np.int64).T
    whole = [[int(v) for v in row] for row in y.tolist()]
    return np.array([[min(_LONG - 1, max(-_LONG, sum(map(int.__mul__, map(int, a), b)))) for b in whole] for a in x.tolist()], np.int64).reshape(len(x), len(y))


def _cells(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray]]:
    """Strips of anchors with the scores of all rows; rows are in the order of ids."""
    rows = rows.sort_by([("id", "ascending"), ("place", "ascending")])
    width = _widest(anchors["vector"], rows["vector"])
    y = _matrix(rows["vector"], width)
    for a in range(0, len(anchors), _STRIP):
        strip = anchors.slice(a, _STRIP)
        yield strip, rows, scores(_matrix(strip["vector"], width), y)


def _table(parts: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (zip(*parts) if parts else [[] for _ in names])]
    return pa.table({n: pa.array(c.astype(np.int64), pa.int64()) for n, c in zip(names, columns)})


_FOUND = "a_place bigint, p bigint, id bigint, place bigint, score bigint"
_NAMES = ["a_place", "p", "id", "place", "score"]


def _best_of_label(count: int):
    def run(_, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """The first rows of the anchor's own label in this cell."""
        parts = []
        for strip, rows, score in _cells(anchors, rows):
            label, place, ids = (rows[c].to_numpy() for c in ("label", "place", "id"))
            for k, (own_label, own_place) in enumerate(zip(strip["label"].to_pylist(), strip["place"].to_pylist())):
                same = np.flatnonzero((label == own_label) & (place != own_place))
                order = same[np.lexsort((ids[same], ~score[k, same]))][:count]  # ~s rises where s falls, without overflow
                n = len(order)
                parts.append((np.full(n, own_place), np.zeros(n), ids[order], place[order], score[k, order]))
        return _table(parts, _NAMES)

    return run


def _limits(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the largest negative score for a positive one, as longs."""
    return max(-_LONG, -(-low * score // 100)), min(_LONG - 1, high * score // 100)


def _below_limit(count: int, low: int, high: int):
    def run(_, anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """For each positive the first rows of other labels between its limits in this cell."""
        parts = []
        for strip, rows, score in _cells(anchors, rows):
            label, place, ids = (rows[c].to_numpy() for c in ("label", "place", "id"))
            for k, (own_label, own_place, positives) in enumerate(zip(strip["label"].to_pylist(), strip["place"].to_pylist(), strip["positives"].to_pylist())):
                other = np.flatnonzero(label != own_label)
                falling = ~score[k, other]
                order = np.lexsort((ids[other], falling))
                other, falling = other[order], falling[order]
                for p, positive in enumerate(positives):
                    least, most = _limits(positive, low, high)
                    first, last = np.searchsorted(falling, ~most, "left"), np.searchsorted(falling, ~least, "right")
                    at = other[first : max(first, min(last, first + count))]
                    parts.append((np.full(len(at), own_place), np.full(len(at), p), ids[at], place[at], score[k, at]))
        return _table(parts, _NAMES)

    return run


def _ranked(found: DataFrame, by: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def _dealt(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """Every row once for each block of the other side."""
    return rows.withColumn(own, F.expr(f"pmod(xxhash64(place), {blocks})")).withColumn(other, F.expr(f"explode(sequence(0L, {others - 1}L))"))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x). The positives of an anchor are the first rows of its label, itself left out, by
    falling inner product, ties by key. For each, the first rows of another label with a score between low and high
    per cent of the positive one's, both included, are its negatives, ranked from 1.

    Rows with a null key, label, vector or component, or with a component that is not finite, take no part. Rows of one
    key are rows of their own: a copy of an anchor is an anchor too, and may be a positive. Vectors of unequal length
    are filled up with zeros, an empty one scores 0. Scores beyond 64 bits become the nearest long. Anchors without
    positives and positives without negatives give no row; an empty table gives none. Other columns are not read.

    Cost: anchors x rows products, as the full sort asks for; each row is sent once for each block of anchors and each
    anchor once for each block of rows.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    ship(spark)
    finite = F.forall("vector", lambda x: F.coalesce(x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    base = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    base = base.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(finite)
    # floor() itself gives longs, which large components do not fit
    whole = F.transform("vector", lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale))
    base = scratch.save(base.withColumn("vector", whole).withColumn("place", F.monotonically_increasing_id()), "rows")
    n, n_anchors = base.agg(F.count("*"), F.count_if("anchor")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_blocks = max(1, math.ceil(n / ROWS), min(tasks, math.ceil(n / 64)))  # cells for all tasks, also of a small table
    anchor_blocks = max(1, math.ceil(n_anchors / ANCHORS))
    cells = ["a_block", "r_block"]
    dealt_rows = _dealt(base.select("id", "label", "vector", "place"), "r_block", row_blocks, "a_block", anchor_blocks)
    anchors = base.where("anchor").select("id", "label", "vector", "place")

    def in_cells(side: DataFrame, run) -> DataFrame:
        side = side.select(*[F.col(c).alias(c) for c in side.columns])  # both sides come from one table
        dealt = _dealt(side, "a_block", anchor_blocks, "r_block", row_blocks)
        return dealt.groupBy(*cells).cogroup(dealt_rows.groupBy(*cells)).applyInArrow(run, _FOUND)

    best = scratch.save(_ranked(in_cells(anchors, _best_of_label(positives)), ["a_place"], positives), "positives")
    lists = best.groupBy("a_place").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("positives"))
    known = anchors.join(lists, F.col("place") == F.col("a_place")).drop("a_place")
    found = _ranked(in_cells(known, _below_limit(negatives, low, high)), ["a_place", "p"], negatives)
    chosen = best.select("a_place", (F.col("rank") - 1).cast("long").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("place").alias("a_place"), F.col("id").alias("anchor_id"))
    return (
        found.select("a_place", "p", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(chosen, ["a_place", "p"])
        .join(named, "a_place")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def op11_score_sort(spark, sf_dir: str) -> DataFrame:
    """Every anchor against all rows; a seventh of the labels is moved on, as the contract says."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH rows AS (
    SELECT row_number() OVER () AS place, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.place AS anchor, a.id AS anchor_id, r.place, r.id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
    FROM rows a JOIN rows r ON a.id % 50 = 0 AND a.place <> r.place
), positives AS (
    SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, place) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.id, n.place)
QUALIFY row_number() OVER w <= 3
"""
