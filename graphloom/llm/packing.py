"""Optimal length buckets: boundaries by dynamic programming, token-budget batches inside each bucket."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.quality import WORD
from graphloom.plans.scratch import Scratch

BUCKETS, TOKEN_BUDGET = 16, 65_536
#: Rows that one task numbers; buckets are dealt over as many shards as that needs.
SHARD_ROWS = 50_000


def _layer(cost: np.ndarray, weight: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(least of cost[i] + weight(i, j) over i < j, the first such i) for every j; 0 for j = 0.

    The weights meet the quadrangle inequality, so the best i never falls as j grows: each step halves the distance of
    the known j and looks for those between two known ones only between their i. A step looks at 2 * len(cost) i at most.
    """
    n = len(cost) - 1
    after, cut = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    step = 1 << (n.bit_length() - 1)
    while step:
        j = np.arange(step, n + 1, 2 * step)
        low = cut[j - step]
        high = np.minimum(np.where(j + step <= n, cut[np.minimum(j + step, n)], n), j - 1)
        size = high - low + 1
        start = np.cumsum(size) - size
        i = np.arange(size.sum()) + np.repeat(low - start, size)
        options = cost[i] + weight(i, np.repeat(j, size))
        after[j] = np.minimum.reduceat(options, start)
        places = np.flatnonzero(options == np.repeat(after[j], size))
        cut[j] = i[places[np.searchsorted(places, start)]]
        step //= 2
    return after, cut


def optimal_boundaries(length: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets with the least padding.

    Distinct lengths in order, the number of texts, and the sum of their lengths. A bucket pads all of its texts to its
    longest one. cost[j] is the least padding of the first j lengths; ties go to fewer buckets.
    """
    n = len(length)
    if not n:
        return []
    c, s = (np.concatenate([[0], np.cumsum(np.asarray(x, np.int64))]) for x in (count, total))
    ends = np.concatenate([[0], np.asarray(length, np.int64)])
    weight = lambda i, j: (c[j] - c[i]) * ends[j] - (s[j] - s[i])
    cost, choice = c * ends - s, [np.zeros(n + 1, np.int64)]
    for _ in range(min(buckets, n) - 1):
        after, cut = _layer(cost, weight)
        if after[n] >= cost[n]:
            break
        choice.append(cut)
        cost = after
    found, j = [], n
    for cut in reversed(choice):
        if j:
            found.append(int(ends[j]))
            j = int(cut[j])
    return sorted(set(found))


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, count, sum) of every distinct length over all rows.

    The driver gets a row for each; k distinct lengths take k * k / 2 words, so a terabyte of text has under a million.
    """
    rows = lengths.groupBy("length").agg(F.count("*").alias("c"), F.sum("length").alias("s")).orderBy("length").collect()
    return tuple(np.array([r[k] for r in rows], np.int64) for k in ("length", "c", "s"))


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pack_buckets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    budget: int = TOKEN_BUDGET,
    length: Column | None = None,
) -> DataFrame:
    """Per row: key, length, bucket (from 0), bucket_length, batch (from 0, all buckets), slot in the batch.

    The boundaries minimise the padding of the whole table, over all distinct lengths. A batch has budget // bucket_length rows, at least one; only the last batch of a bucket has fewer. The
    order within a bucket follows a hash of the key and then the key, and is numbered in shards, so no bucket is
    gathered in one task. `length` defaults to words. Null and empty texts have length 0; repeated rows get a slot
    each; an empty table gives an empty result; other columns are not read and may have any names.
    """
    scratch = Scratch(docs.sparkSession)
    measured = docs.select(F.col(key).alias("key"), (word_count(F.col(text)) if length is None else length.cast("long")).alias("length"))
    measured = scratch.save(measured, "lengths")
    ends = optimal_boundaries(*histogram(measured), buckets) or [0]
    places = F.array(*[F.lit(e).cast("long") for e in ends])
    number = F.size(F.filter(places, lambda e: e < F.col("length")))
    sized = measured.withColumn("bucket", number)
    counts = {r.bucket: r["count"] for r in sized.groupBy("bucket").count().collect()}
    capacity = [max(1, budget // max(1, e)) for e in ends]
    shards = [max(1, -(-counts.get(b, 0) // SHARD_ROWS)) for b in range(len(ends))]
    batches = [-(-counts.get(b, 0) // capacity[b]) for b in range(len(ends))]
    offset = np.concatenate([[0], np.cumsum(batches)]).tolist()

    def per_bucket(values: list[int]) -> Column:
        return F.get(F.array(*[F.lit(v).cast("long") for v in values]), F.col("bucket"))

    sharded = sized.withColumn("shard", F.pmod(F.xxhash64("key"), per_bucket(shards)))
    sizes = sharded.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = sizes.select(
        "bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before")
    )
    own = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("key", "length")) - 1
    numbered = sharded.withColumn("own", own).join(before, ["bucket", "shard"]).withColumn("place", F.col("before") + F.col("own"))
    return numbered.select(
        F.col("key").alias(key),
        "length",
        F.col("bucket").cast("long").alias("bucket"),
        per_bucket(ends).alias("bucket_length"),
        (per_bucket(offset[:-1]) + F.floor(F.col("place") / per_bucket(capacity))).alias("batch"),
        F.pmod("place", per_bucket(capacity)).alias("slot"),
    )


def op6_length_buckets(spark, sf_dir: str) -> DataFrame:
    return pack_buckets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
