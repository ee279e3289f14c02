"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Symbols are words. The patterns are the windows of the benchmark items. For each pattern length a shift table over
blocks of two words says how far a search may skip, a bucket by the hash of the suffix block selects the windows that
may end at a position, and a direct comparison of words and then of bytes confirms an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import text as T
from graphloom.plans.ship import ship

WINDOW = 13
#: Benchmark text that one search holds at a time; larger benchmarks are searched block by block.
BLOCK_BYTES = 32 << 20
_SEGMENT = 256
_TABLE_BITS = 18
_MULTIPLY = np.uint64(0xD1342543DE82EF95)


@dataclass
class Table:
    """Windows of one length m, sorted by the hash of their suffix block of b words."""

    m: int
    b: int
    shift: np.ndarray
    keys: np.ndarray
    hashes: np.ndarray
    norm: list[bytes]
    items: list[list[str]]

    def block(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the block of words that ends at each position."""
        value = h[last]
        for k in range(1, self.b):
            value = value * _MULTIPLY + h[last - k]
        return T.mix(value)


def build_tables(items: list[tuple[str, str]], window: int = WINDOW) -> list[Table]:
    """Shift tables and buckets for the distinct windows of (item id, text) pairs."""
    column = pa.array([text or "" for _, text in items], pa.large_string())
    w = T.words(*T.buffers(column), T.ALNUM)
    found: dict[int, dict[bytes, tuple[np.ndarray, list[str]]]] = {}
    for d, (name, _) in enumerate(items):
        a, b = int(w.at[d]), int(w.at[d + 1])
        m = min(window, b - a)
        for i in range(a, b - m + 1) if m else ():
            norm = b" ".join(w.data[w.start[k] : w.end[k]].tobytes() for k in range(i, i + m))
            _, names = found.setdefault(m, {}).setdefault(norm, (w.hash[i : i + m], []))
            if name not in names:
                names.append(name)
    tables = []
    for m, windows in found.items():
        b, hashes = min(2, m), np.stack([h for h, _ in windows.values()])
        table = Table(m, b, np.zeros(0), np.zeros(0), hashes, list(windows), [names for _, names in windows.values()])
        order = np.argsort(table.block(hashes.T.ravel(order="F"), np.arange(1, len(hashes) + 1) * m - 1), kind="stable")
        table.hashes, table.norm, table.items = hashes[order], [table.norm[i] for i in order], [table.items[i] for i in order]
        flat, ends = table.hashes.ravel(), np.arange(1, len(hashes) + 1) * m - 1
        table.keys = table.block(flat, ends)
        table.shift = np.full(1 << _TABLE_BITS, m - b + 1, np.uint8)
        for q in range(b, m + 1):
            np.minimum.at(table.shift, (table.block(flat, ends - (m - q)) & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64), m - q)
        tables.append(table)
    return tables


def _candidates(table: Table, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions where a window may end: those that the shift table does not skip. Segments are searched in step."""
    low, high = at[:-1] + table.m - 1, at[1:]
    n = np.maximum(0, -(-(high - low) // _SEGMENT))
    doc = np.repeat(np.arange(len(n)), n)
    pos = low[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * _SEGMENT
    end = np.minimum(pos + _SEGMENT, high[doc])
    found, mask = [pos[:0]], np.uint64((1 << _TABLE_BITS) - 1)
    while len(pos):
        step = table.shift[(table.block(h, pos) & mask).astype(np.int64)]
        found.append(pos[step == 0])
        pos = pos + np.maximum(step, 1)
        live = pos < end
        pos, end = pos[live], end[live]
    return np.concatenate(found)


def _occurrences(table: Table, w: T.Words, norm: list) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every confirmed occurrence."""
    last = _candidates(table, w.hash, w.at)
    key = table.block(w.hash, last)
    low, high = np.searchsorted(table.keys, key, "left"), np.searchsorted(table.keys, key, "right")
    n = high - low
    last, window = np.repeat(last, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    for k in range(table.m):
        same = w.hash[last - k] == table.hashes[window, table.m - 1 - k]
        last, window = last[same], window[same]
    first = last - table.m + 1
    if len(first):
        if not norm:
            norm.append(_normalised(w))
        data, start, end = norm[0]
        same = [data[start[a] : end[b]] == table.norm[k] for a, b, k in zip(first.tolist(), last.tolist(), window.tolist())]
        first, window = first[same], window[same]
    return first, window


def _normalised(w: T.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words, a space after each, as bytes, and their places."""
    length = w.end - w.start
    end = np.cumsum(length + 1) - 1
    start = end - length
    out = np.full(int(end[-1]) + 1, 0x20, np.uint8)
    take = np.repeat(w.start - start, length) + (np.arange(length.sum()) + np.repeat(np.arange(len(length)), length))
    out[np.repeat(np.arange(len(length)), length) + np.arange(length.sum())] = w.data[take]
    return out.tobytes(), start, end


def search(tables: list[Table], data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
    """For documents data[at[i]:at[i+1]]: words, words hit, [start, end) word spans hit, item ids."""
    w = T.words(data, at, T.ALNUM)
    docs, norm = len(at) - 1, []
    edge, names = np.zeros(len(w.hash) + 1, np.int32), [set() for _ in range(docs)]
    for table in tables:
        first, window = _occurrences(table, w, norm)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + table.m, -1)
        for d, k in zip((np.searchsorted(w.at, first, "right") - 1).tolist(), window.tolist()):
            names[d].update(table.items[k])
    covered = np.cumsum(edge)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(covered)])
    hit = total[w.at[1:]] - total[w.at[:-1]]
    spans = [[] for _ in range(docs)]
    for d in np.flatnonzero(hit):
        a = int(w.at[d])
        inside = np.concatenate([[0], covered[a : w.at[d + 1]].astype(np.int8), [0]])
        turn = np.diff(inside)
        spans[d] = [{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1))]
    return np.diff(w.at), hit, spans, [sorted(x) for x in names]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = "n_words bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _scan(docs: DataFrame, tables: list[Table]) -> DataFrame:
    """docs (key, t, h, h2) with n_words, n_hit, spans and items."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = T.buffers(batch.column(1))
            for i, j in T.chunks(at):
                n, hit, spans, names = search(held.value, data, at[i : j + 1])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(name).slice(i, j - i) for name in ("key", "h", "h2")), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, _SPANS), pa.array(names, pa.list_(pa.string()))],
                    names=["key", "h", "h2", "n_words", "n_hit", "spans", "items"],
                )

    key = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {key}, h bigint, h2 bigint, {_FOUND}")


def _blocks(benchmark: DataFrame, item: str, text: str, size: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of about size bytes; the driver holds one block at a time."""
    block, held = [], 0
    for name, words in benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string"), text).toLocalIterator():
        block.append((name, words))
        held += len(words.encode())
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    share: int = 20,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: key, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted strings), spans.

    A benchmark window is `window` consecutive words of an item, or all words of a shorter one; document words inside
    an occurrence are hit; contaminated: n_hit > 0 and share * n_hit >= n_words. The whole benchmark is searched in
    every document, in blocks of block_bytes; with more than one block, the blocks' spans are united by key and text, a
    row for each input row. Null or empty texts have no words; items with a null id or text are ignored; repeated items
    count apart if their ids differ; an empty benchmark hits nothing. Only key and text are read, so other columns
    may have any names.
    """
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    base = base.withColumns({"h": F.xxhash64("t"), "h2": F.xxhash64("t", F.lit(1))})
    scans = [_scan(base, build_tables(block, window)) for block in _blocks(benchmark, item, item_text, block_bytes)]
    if not scans:
        scans = [_scan(base, [])]
    found = scans[0] if len(scans) == 1 else _united(scans)
    items = F.array_sort("items")
    return found.select(
        F.col("key").alias(key),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        items.alias("items"),
        "spans",
    )


def _united(scans: list[DataFrame]) -> DataFrame:
    """Results of several blocks as one: spans are merged within each document.

    Rows of one key and text have one result, which is given as often as each block has it.
    """
    every = scans[0]
    for scan in scans[1:]:
        every = every.unionByName(scan)
    grouped = every.groupBy("key", "h", "h2").agg(
        F.count("*").alias("rows"),
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    merged = F.aggregate(
        "s",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] >= x["start"]), F.concat(
            F.slice(a, F.lit(1), F.size(a) - 1),
            F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["end"], x["end"]).alias("end"))),
        )).otherwise(F.concat(a, F.array(x))),
    )
    spans = grouped.withColumn("spans", merged)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    spans = spans.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("rows") / len(scans)))))
    return spans.select("key", "n_words", hit.alias("n_hit"), "spans", "items")


def op2_wu_manber(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).drop("items", "spans")


ORACLE = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i:i+least(13, len(ws))-1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 12))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM p),
g AS (SELECT doc_id, m, i, array_to_string(ws[i:i+m-1], ' ') AS k
  FROM (SELECT doc_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM d, sizes WHERE len(ws) >= m)),
o AS (SELECT doc_id, item_id, i, p.m FROM g JOIN p ON g.m = p.m AND g.k = p.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS j FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s COLLATE "C") AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
