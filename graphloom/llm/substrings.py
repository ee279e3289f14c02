"""Exact removal of repeated byte strings by merging Burrows-Wheeler transforms of shards.

1. Every string of LENGTH bytes has an anchor among its first WINDOW positions, the one with the smallest hash of GRAM
   bytes, so equal strings have their anchors at equal offsets. The bytes that all strings of one anchor share, its
   core, are LENGTH - WINDOW + 1 long. Anchors whose core is found nowhere else own no repeated string.
2. Anchors are one class if core and surroundings agree as far as any of their strings goes. The strings of a class of
   two or more anchors are all repeated.
3. Classes of one core that differ somewhere are written as short texts in which one symbol stands for the core, so
   that each string of LENGTH bytes is one of WINDOW symbols. Texts of equal cores meet in one block. A block is cut into
   shards; each has its Burrows-Wheeler transform. All transforms of a block are merged by refining their interleave
   WINDOW times (Holt and McMillan): a round reads the transforms in the order of the last interleave and deals the
   rows out by symbol, which sorts them by one symbol more; suffixes are never sorted again. Neighbours that no round
   has told apart share a prefix of WINDOW symbols; these intervals are the repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import text as T
from graphloom.llm.bounded import counted
from graphloom.plans.scratch import Scratch
from graphloom.plans.ship import ship

LENGTH, WINDOW, GRAM = 200, 50, 12
#: Texts of one block at least, symbols of a shard, and classes of one core from which each string is a text of its own.
BLOCK, SHARD, HOT = 16_384, 1 << 16, 20_000
#: Rows of the table of 64-bit masks that says which cores may be repeated; this bounds its broadcast.
MASKS = 1 << 20
_CHUNK = 1 << 19
_LOW = np.uint64((1 << 32) - 1)


class Hashes:
    """Hashes of byte ranges of a buffer."""

    def __init__(self, raw: np.ndarray, salt: int = 0):
        value = raw.astype(np.uint64) + np.uint64(1)
        if salt:
            value = T.mix(value + np.uint64(salt))
        up, self.down = T._powers.get(len(raw) + 1)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[: len(raw)])])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return T.mix((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(np.uint64))


def anchors(raw: np.ndarray, own: np.ndarray, limit: int | None = None, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(doc, first, last, anchor, core hash, class hash) of the anchors of documents raw[own[i]:own[i+1]].

    first and last are the first and last position whose string has this anchor; positions from limit on are left out.
    """
    hashes = Hashes(raw)
    starts = np.arange(max(0, len(raw) - GRAM + 1))
    low = (hashes.of(starts, starts + GRAM) & ~_LOW) | starts.astype(np.uint64)
    width = 1
    while width < window and len(low):
        step = min(width, window - width)
        low, width = np.minimum(low[: max(0, len(low) - step)], low[step:]), width + step
    at = (low & _LOW).astype(np.int64)
    doc = np.repeat(np.arange(len(own) - 1), np.diff(own))[: len(at)]
    ok = np.arange(len(at)) + length <= own[doc + 1]
    if limit is not None:
        ok[limit:] = False
    a, at, doc = np.flatnonzero(ok), at[ok], doc[ok]
    if not len(a):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (a[1:] != a[:-1] + 1)]))
    first, last, at, doc = a[new], a[np.append(new[1:], len(a)) - 1], at[new], doc[new]
    core = hashes.of(at, at + length - window + 1)
    whole = T.mix(hashes.of(first, last + length) * np.uint64(0xD1342543DE82EF95) + (at - first).astype(np.uint64))
    return doc, first, last, at, core, whole


def _pieces(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int | None]]:
    """(first document, bytes, where documents begin, offset in the document, limit): whole documents or parts of one."""
    for i, j in T.chunks(at, _CHUNK):
        size = int(at[j] - at[i])
        if j > i + 1 or size <= 2 * _CHUNK:
            yield i, data[at[i] : at[j]], at[i : j + 1] - at[i], 0, None
            continue
        for offset in range(0, size, _CHUNK):
            part = data[at[i] + offset : at[i] + min(size, offset + _CHUNK + length)]
            yield i, part, np.array([0, len(part)]), offset, _CHUNK


def _anchor_rows(base: DataFrame, length: int, window: int) -> DataFrame:
    """(key, th, first, last, at, f, g) of every anchor of base (key, th, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = T.buffers(batch.column(2))
            for i, raw, own, offset, limit in _pieces(data, at, length):
                doc, first, last, q, f, g = anchors(raw, own, limit, length, window)
                begin = offset - own[doc]
                rows = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x + begin, pa.int64()) for x in (first, last, q)), pa.array(f.view(np.int64)), pa.array(g.view(np.int64))],
                    names=["key", "th", "first", "last", "at", "f", "g"],
                )

    return base.mapInArrow(run, f"key {base.schema['key'].dataType.simpleString()}, th bigint, first bigint, last bigint, at bigint, f bigint, g bigint")


def shard_transform(sym: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rotations and Burrows-Wheeler transform of texts that begin at `begin` and end with symbol 0."""
    n = len(sym)
    ends = np.append(begin[1:], n) - 1
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends], before[begin] = begin, ends
    rank, jump, known, longest = sym.astype(np.int64), after, 1, int((ends - begin).max()) + 1
    while True:
        key = rank * (rank.max() + 1) + rank[jump]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        jump, known = jump[jump], 2 * known
        if known >= longest or rank[order[-1]] == n - 1:
            return order, sym[before[order]]


def merge_transforms(transforms: list[np.ndarray], depth: int) -> np.ndarray:
    """For each row of the transforms, one after another, the number of its interval of rows with equal first `depth` symbols."""
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(x) for x in transforms])
    rows = np.concatenate(transforms)
    interval, found = np.zeros(len(rows), np.int32), 1
    for _ in range(depth):
        symbol = np.empty_like(rows)
        symbol[np.argsort(shard, kind="stable")] = rows
        dealt = np.argsort(symbol, kind="stable")
        symbol, interval, shard = symbol[dealt], interval[dealt], shard[dealt]
        interval = np.concatenate([[0], np.cumsum((symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1]), dtype=np.int32)])
        if interval[-1] + 1 == found:
            break
        found = int(interval[-1]) + 1
    return interval[np.argsort(shard, kind="stable")]


def repeated_starts(texts: list[tuple[bytes, object, bytes]], depth: int = WINDOW, shard: int = SHARD) -> list[list[tuple[int, int]]]:
    """For texts (left, core, right) the runs [start, end] of starts of `depth` symbols that are found elsewhere too."""
    number: dict = {}
    core = [257 + number.setdefault(c, len(number)) for _, c, _ in texts]
    kind = np.uint16 if len(number) < 65_000 else np.int32
    size = np.array([len(x) + len(y) + 2 for x, _, y in texts])
    sym = np.frombuffer(b"".join(x + b"\0" + y + b"\0" for x, _, y in texts), np.uint8).astype(kind) + kind(1)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    sym[begin + [len(x) for x, _, _ in texts]] = core
    sym[begin + size - 1] = 0
    cuts = [0, *(np.flatnonzero(np.diff(begin // shard)) + 1).tolist(), len(texts)]
    orders, transforms = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        low, high = begin[a], begin[b - 1] + size[b - 1]
        order, rows = shard_transform(sym[low:high], begin[a:b] - low)
        orders.append(order + low)
        transforms.append(rows)
    interval = merge_transforms(transforms, depth)
    many = np.bincount(interval)[interval] > 1
    flag = np.zeros(len(sym) + 1, bool)
    flag[np.concatenate(orders)[many]] = True
    out = []
    for a, n in zip(begin.tolist(), size.tolist()):
        turn = np.diff(np.concatenate([[0], flag[a : a + max(0, n - depth)].astype(np.int8), [0]]))
        out.append(list(zip(np.flatnonzero(turn == 1).tolist(), (np.flatnonzero(turn == -1) - 1).tolist())))
    return out


_TEXT = "bucket bigint, f bigint, g bigint, off bigint, x binary, core bigint, y binary"
_RUNS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


def _texts(homes: DataFrame, length: int, window: int) -> DataFrame:
    """The short texts of homes (t, list of f, g, first, last, at, hot); those of hot cores string by string."""
    core_size = length - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split(" ")[0] for part in _TEXT.split(", ")]
        for batch in batches:
            data, at = T.buffers(batch.column(0))
            rows = []
            for d, wanted in enumerate(batch.column(1).to_pylist()):
                raw, base = data[at[d] : at[d + 1]], 0
                low, high = min(w["first"] for w in wanted), max(w["last"] for w in wanted) + length
                raw, base = raw[low:high], low
                second = Hashes(raw, 77)
                q = np.array([w["at"] for w in wanted]) - base
                cores = second.of(q, q + core_size).view(np.int64).tolist()
                for w, core in zip(wanted, cores):
                    first, last, at_ = w["first"] - base, w["last"] - base, w["at"] - base
                    ranges = [(a, a) for a in range(first, last + 1)] if w["hot"] else [(first, last)]
                    for a, b in ranges:
                        x, y = raw[a:at_].tobytes(), raw[at_ + core_size : b + length].tobytes()
                        rows.append((w["f"] if not w["hot"] else _place(w["f"], x, y), w["f"], w["g"], a - first, x, core, y))
                if len(rows) > 20_000:
                    yield _batch(rows, names)
                    rows = []
            yield _batch(rows, names)

    return homes.mapInArrow(run, _TEXT)


def _place(f: int, x: bytes, y: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x + b"|" + y, digest_size=8, key=f.to_bytes(8, "big", signed=True)).digest(), "big", signed=True)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.binary() if n in ("x", "y") else pa.int64() for n in names]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _merged(texts: DataFrame, window: int) -> DataFrame:
    """(bucket, x, core, y, runs): the repeated starts of the distinct texts, which are sorted by bucket in their partition."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        runs = repeated_starts([(x, (b, c), y) for b, x, c, y in rows], window) if rows else []
        kept = [(*row, [{"s": s, "e": e} for s, e in found]) for row, found in zip(rows, runs) if found]
        columns = list(zip(*kept)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), _RUNS))], names=["bucket", "x", "core", "y", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= BLOCK and held[-1][0] != row[0]:
                    yield solve(held)
                    held = []
                held.append(row)
        yield solve(held)

    return texts.mapInArrow(run, "bucket bigint, x binary, core bigint, y binary, runs array<struct<s:bigint,e:bigint>>")


def _mask_place() -> tuple[Column, Column]:
    """Row and bit of the core f in the table of masks."""
    mixed = F.xxhash64("f")
    return F.pmod(F.shiftrightunsigned(mixed, 6), F.lit(MASKS)), F.expr("shiftleft(1L, cast(xxhash64(f) & 63 as int))")


def repeated_spans(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(key, th, spans) of the documents (key, th, t) that hold repeated strings: spans of [s, e) bytes, unsorted."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    every = _anchor_rows(docs, length, window)
    row, bit = _mask_place()
    repeated = every.select("f").groupBy("f").count().where("count > 1").select(row.alias("m"), bit.alias("bit"))
    masks = scratch.save(repeated.groupBy("m").agg(F.bit_or("bit").alias("mask")), "masks")
    near = every.withColumn("m", row).withColumn("bit", bit).join(F.broadcast(masks), "m").where("mask & bit <> 0")
    met = scratch.save(near.select("key", "th", "first", "last", "at", "f", "g"), "met")

    groups = met.groupBy("f").agg(F.count("*").alias("c"), F.min("g").alias("g"), F.max("g").alias("high")).where("c > 1")
    groups = scratch.save(groups, "groups")
    alike = groups.where("g = high").select("f", "g")
    mixed = scratch.save(groups.where("g <> high").select("f"), "mixed")
    rep = F.min(F.struct("key", "th", "first", "last", "at")).alias("rep")
    classes = met.join(counted(mixed), "f", "left_semi").groupBy("f", "g").agg(F.count("*").alias("n"), rep)
    classes = scratch.save(classes.select("f", "g", "n", "rep.*"), "classes")
    hot_cores = scratch.save(classes.groupBy("f").count().where(F.col("count") > hot).select("f", F.lit(True).alias("hot")), "hot")
    wanted = classes.join(counted(hot_cores), "f", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    per_home = wanted.groupBy("key", "th").agg(F.collect_list(F.struct("f", "g", "first", "last", "at", "hot")).alias("wanted"))
    texts = scratch.save(_texts(at_home(docs, scratch.save(per_home, "homes")).select("t", "wanted"), length, window), "texts")
    distinct = texts.select("bucket", "x", "core", "y").distinct()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.count() // (2 * BLOCK))
    ordered = distinct.repartition(n, "bucket").sortWithinPartitions("bucket")
    found = scratch.save(_merged(ordered, window), "found")
    runs = texts.join(found, ["bucket", "x", "core", "y"]).select("f", "g", "off", F.explode("runs").alias("run"))
    shared = texts.groupBy("bucket", "x", "core", "y").agg(F.count("*").alias("c")).where("c > 1")
    again = texts.join(shared, ["bucket", "x", "core", "y"], "left_semi").select("f", "g", "off", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e"))
    runs = runs.select("f", "g", (F.col("off") + F.col("run.s")).alias("s"), (F.col("off") + F.col("run.e")).alias("e"))
    if hot_cores.limit(1).count():
        again = again.join(counted(hot_cores), "f", "left_semi").select("f", "g", F.col("off").alias("s"), F.col("off").alias("e"))
        runs = runs.union(again)
    runs = runs.union(classes.where("n > 1").select("f", "g", F.lit(0).cast("long"), F.col("last") - F.col("first")))
    runs = runs.union(alike.select("f", "g", F.lit(0).cast("long"), F.lit(window).cast("long")))
    flags = runs.groupBy("f", "g").agg(F.collect_set(F.struct("s", "e")).alias("runs"))
    hits = met.join(flags, ["f", "g"]).select("key", "th", "first", "last", F.explode("runs").alias("run"))
    span = F.struct((F.col("first") + F.col("run.s")).alias("s"), (F.least(F.col("first") + F.col("run.e"), F.col("last")) + length).alias("e"))
    return hits.groupBy("key", "th").agg(F.collect_set(span).alias("spans"))


def at_home(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that found has rows (key, th, ...) for, with these; texts of others are not moved if found is small."""
    names = found.select(F.col("key").alias("k"), F.col("th").alias("h"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    near = docs.join(counted(names), same("key", "k") & same("th", "h"), "left_semi")
    other = found.withColumnRenamed("key", "k").withColumnRenamed("th", "h")
    return near.join(other.hint("merge"), same("key", "k") & same("th", "h")).drop("k", "h")


_CUT = "row_key {}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<s:bigint,e:bigint>>, kept binary"


def _cut(hit: DataFrame, with_kept: bool) -> DataFrame:
    """The documents (key, t, spans) without their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = T.buffers(batch.column(1))
            n, removed, spans, sha, kept = [], [], [], [], []
            for d, found in enumerate(batch.column(2).to_pylist()):
                raw, merged = data[at[d] : at[d + 1]], []
                for s, e in sorted((x["s"], x["e"]) for x in found):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                edges = [0, *(x for pair in merged for x in pair), len(raw)]
                rest = b"".join(raw[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2]))
                n.append(len(raw))
                removed.append(len(raw) - len(rest))
                spans.append([{"s": s, "e": e} for s, e in merged])
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_kept else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(sha, pa.string()), pa.array(spans, _RUNS), pa.array(kept, pa.binary())],
                names=["row_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"],
            )

    return hit.mapInArrow(run, _CUT.format(hit.schema["key"].dataType.simpleString()))


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW, with_kept: bool = True) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256, spans ([s, e) of removed bytes) and kept (the bytes left).

    Every byte that is covered by a string of `length` bytes which also starts anywhere else in the table is removed;
    overlaps and repeats within a document count; strings are judged on the input and never cross documents. A null
    or short text loses nothing. Repeated rows, with equal or null keys too, are repeats of each other. An empty table
    gives an empty result. Other columns are not read. Equality of anchors rests on two 64-bit hashes.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(key).alias("key"), F.xxhash64(t).alias("th"), t.alias("t"))
    spans = Scratch(docs.sparkSession).save(repeated_spans(base, length, window), "spans")
    gone = counted(spans.select(F.col("key").alias("k"), F.col("th").alias("h")))
    whole = base.join(gone, F.col("key").eqNullSafe(F.col("k")) & F.col("th").eqNullSafe(F.col("h")), "left_anti")
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    kept = F.encode("t", "UTF-8") if with_kept else F.lit(None).cast("binary")
    untouched = whole.select("key", F.octet_length("t").cast("long"), zero, zero, F.sha2("t", 256), empty, kept)
    cut = _cut(at_home(base, spans).select("key", "t", "spans"), with_kept)
    return cut.union(untouched).withColumnRenamed("row_key", key)


def op8_bwt_merge(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, with_kept=False).drop("spans", "kept")
