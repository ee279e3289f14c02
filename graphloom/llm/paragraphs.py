"""Substring deduplication: MinHash bands over paragraphs, exact Jaccard, connected components, and passages within them.

A paragraph is a line of MIN_WORDS words or more (white-space words, A to Z lower-cased), and also a block of several
lines between blank ones, read as one text wherever it is wrapped. Its set holds the hashes of its runs of SHINGLE words.
With 14 bands of 4 rows, paragraphs of similarity 0.8 miss each other with a probability of (1 - 0.8**4)**14, 0.06 %, those
of similarity 0.85 with 0.003 %; `tuned` computes the bands for another recall. Members of one bucket that stars have not
joined are compared with each other only if their bitmaps of 4,096 bits allow the similarity, which loses no pair.

A text that is repeated inside longer paragraphs is found by its passages: PASSAGE words from an anchor on, a word where
the hash of it and the next one is the smallest within AROUND words. Anchors depend on the words around only, so equal
texts have equal anchors whatever surrounds them. One changed word takes two passages below similarity 0.8, so only
equal ones are linked.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from graphloom.llm import text as T
from graphloom.llm.bounded import counted, small_batches
from graphloom.llm.buckets import linked, touched
from graphloom.llm.packing import word_count
from graphloom.llm.substrings import at_home
from graphloom.plans.components import named
from graphloom.plans.scratch import Scratch
from graphloom.plans.ship import ship

SHINGLE, PERCENT, MIN_WORDS, RECALL = 5, 80, 20, 0.999
PASSAGE, AROUND = 25, 5
#: Longs of a set's bitmap.
LONGS = 64
#: Rows whose sets or spans a task turns into Python objects at a time.
ROWS = 500
#: Members of a bucket up to which all meet all at once; the sets of pairs are shuffled, so they are few.
SMALL = 4


def tuned(percent: int, recall: float, rows: int = 4) -> int:
    """Bands of so many rows that meet at this similarity with that recall."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - (percent / 100) ** rows)))


def some(value: np.ndarray, cut: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen ones of sets value[cut[i]:cut[i+1]]."""
    n = np.diff(cut)[which]
    begin = np.concatenate([[0], np.cumsum(n)])
    return value[np.repeat(cut[which] - begin[:-1], n) + np.arange(n.sum())], begin


def paragraphs(data: np.ndarray, at: np.ndarray, size: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first byte, byte after it, set, where each set begins) of the paragraphs of documents data[at[i]:at[i+1]]."""
    for i, j in T.chunks(at):
        own = at[i : j + 1]
        breaks = own[0] + np.flatnonzero(data[own[0] : own[-1]] == 10) + 1
        starts = np.union1d(own[:-1], breaks)
        starts = starts[starts < own[-1]]
        if not len(starts):
            continue
        doc = np.searchsorted(own, starts, "right") - 1
        edge = np.append(starts, own[-1])
        w = T.words(data, edge, T.NOT_SPACE)
        lines = np.arange(len(starts))
        filled = np.flatnonzero(np.diff(w.at) > 0)
        new = np.ones(len(filled), bool)
        new[1:] = (np.diff(filled) > 1) | (np.diff(doc[filled]) > 0)
        last = np.append(np.flatnonzero(new)[1:], len(filled)) - 1
        blocks, after = filled[new], filled[last] + 1 if len(filled) else filled
        for begin, end in ((lines, lines + 1), (blocks, after)):
            sized = replace(w, at=np.append(w.at[begin], w.at[-1]))
            long = np.flatnonzero((np.diff(sized.at) >= least) & ((begin is lines) | (end - begin > 1)))
            if len(long):
                value, of = T.shingles(sized, size)
                value, cut = some(*T.distinct_sets(value, of, len(begin)), long)
                home = doc[begin[long]]
                yield i + home, edge[begin[long]] - own[home], edge[end[long]] - own[home], value, cut


def passages(data: np.ndarray, at: np.ndarray, length: int = PASSAGE, around: int = AROUND) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, first byte, byte after it, digest) of the passages of documents data[at[i]:at[i+1]]."""
    for i, j in T.chunks(at):
        w = T.words(data, at[i : j + 1], T.NOT_SPACE)
        doc, n = w.doc(), len(w.hash)
        if n < length:
            continue
        two = T.mix(w.hash[:-1] * np.uint64(0xD1342543DE82EF95) + w.hash[1:])
        least = np.ones(n - 1, bool)
        for k in range(1, around + 1):
            same = doc[k : n - 1] == doc[: n - 1 - k]
            least[k:] &= ~same | (two[k:] < two[:-k])
            least[:-k] &= ~same | (two[:-k] <= two[k:])
        first = np.flatnonzero(least[: n - length + 1])
        first = first[doc[first] == doc[first + length - 1]]
        value = np.zeros(len(first), np.uint64)
        for k in range(length):
            value = value * np.uint64(0xD1342543DE82EF95) + w.hash[first + k]
        begin = (at[i:j] - at[i])[doc[first]]
        yield i + doc[first], w.start[first] - begin, w.end[first + length - 1] - begin, T.mix(value ^ np.uint64(length)).view(np.int64)


def digest(value: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(value))])
    return (total[cut[1:]] - total[cut[:-1]]).view(np.int64)


def _minima(value: np.ndarray, cut: np.ndarray, number: int) -> Iterator[np.ndarray]:
    """For each of so many hash functions the least hash of each set; no set is empty."""
    for seed in T.mix(np.arange(1, number + 1, dtype=np.uint64)) | np.uint64(1):
        yield np.minimum.reduceat(value * seed, cut[:-1])


def band_keys(value: np.ndarray, cut: np.ndarray, bands: int, rows: int = 4) -> np.ndarray:
    """MinHash band keys, a column for each set."""
    keys = np.repeat(np.arange(bands, dtype=np.uint64)[:, None], len(cut) - 1, axis=1)
    for k, low in enumerate(_minima(value, cut, bands * rows)):
        keys[k // rows] = T.mix(keys[k // rows] * np.uint64(0xD1342543DE82EF95) + low)
    return keys.view(np.int64)


def bitmaps(value: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """LONGS longs for each set, a column each, with a bit for each element."""
    out = np.zeros((LONGS, len(cut) - 1), np.uint64)
    bit = (value & np.uint64(64 * LONGS - 1)).astype(np.int64)
    np.bitwise_or.at(out, (bit >> 6, np.repeat(np.arange(len(cut) - 1), np.diff(cut))), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out.view(np.int64)


def _profiles(base: DataFrame, size: int, least: int, bands: int, percent: int) -> DataFrame:
    """(key, th, s, e, h, bk, passage) of base (key, th, t): bytes [s, e), digest and band keys of every paragraph and passage.

    Passages have no band keys, nor have sets so small that one element more or less takes their similarity below percent.
    """
    names, lists = ["key", "th", "s", "e", "h", "bk", "passage"], pa.list_(pa.int64())

    def rows(batch: pa.RecordBatch, doc, s, e, h, bk: pa.Array, passage: bool = False) -> pa.RecordBatch:
        doc, flag = pa.array(doc), pa.array(np.full(len(doc), passage))
        return pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(h), bk, flag], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = T.buffers(batch.column(2))
            for doc, s, e, value, cut in paragraphs(data, at, size, least):
                h, large = digest(value, cut), np.diff(cut) * (100 - percent) >= percent
                for which in (np.flatnonzero(large), np.flatnonzero(~large)):
                    if len(which) and large[which[0]]:
                        keys = band_keys(*some(value, cut, which), bands)
                        yield rows(batch, doc[which], s[which], e[which], h[which], pa.FixedSizeListArray.from_arrays(pa.array(keys.T.ravel()), bands).cast(lists))
                    elif len(which):
                        yield rows(batch, doc[which], s[which], e[which], h[which], pa.nulls(len(which), lists))
            for doc, s, e, h in passages(data, at):
                yield rows(batch, doc, s, e, h, pa.nulls(len(h), lists), True)

    return base.mapInArrow(run, f"key {base.schema['key'].dataType.simpleString()}, th bigint, s bigint, e bigint, h bigint, bk array<bigint>, passage boolean")


def _sets(base: DataFrame, size: int, least: int) -> DataFrame:
    """(h, value): digest and set of every paragraph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, value, cut in paragraphs(*T.buffers(batch.column(0)), size, least):
                sets = [value[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(digest(value, cut)), pa.array(sets, pa.binary())], names=["h", "value"])

    return base.mapInArrow(run, "h bigint, value binary")


def _outlines(sets: DataFrame) -> DataFrame:
    """(h, n, more, b0, b1, ...): the sizes of sets (h, value), what of them has no bit of its own, and their bitmaps."""
    longs = [f"b{k}" for k in range(LONGS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                h, sets = batch.column(0).slice(i, ROWS), [np.frombuffer(x, np.uint64) for x in batch.column(1).slice(i, ROWS).to_pylist()]
                cut = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
                bits, n = bitmaps(np.concatenate(sets), cut), np.diff(cut)
                more = n - np.bitwise_count(bits.view(np.uint64)).sum(axis=0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([h, pa.array(n, pa.int64()), pa.array(more), *map(pa.array, bits)], names=["h", "n", "more", *longs])

    return sets.mapInArrow(run, f"h bigint, n bigint, more bigint, {', '.join(f'{c} bigint' for c in longs)}")


def possible(percent: int) -> str:
    """SQL for sets x and y whose sizes and bitmaps allow the similarity: each element without a bit of its own may be common too."""
    common = " + ".join(f"bit_count(x.b{k} & y.b{k})" for k in range(LONGS))
    sized = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    return f"({sized} AND {100 + percent} * ({common} + least(x.more, y.more)) >= {percent} * (x.n + y.n))"


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, x, y) whose sets x and y are similar, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                place = np.searchsorted(x, y)
                common = int((x[np.minimum(place, len(x) - 1)] == y).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def repeated_spans(base: DataFrame, size: int, percent: int, least: int, recall: float, scratch: Scratch) -> DataFrame:
    """(key, th, spans): for documents (key, th, t) the repeated paragraphs and passages: bytes [s, e), passage, gone, stays.

    The first occurrence of each group, by key and position, stays; what overlaps it in its document is not gone by this
    group. Passages inside a removed paragraph go with it, so the first one elsewhere is the one that stays.
    """
    every = scratch.save(_profiles(base, size, least, tuned(percent, recall), percent), "paragraphs")
    scratch.forget()
    banded = every.where("bk IS NOT NULL")

    def prepare(items: DataFrame):
        homes = banded.join(counted(items), "h", "left_semi").groupBy("h").agg(F.min(F.struct("key", "th")).alias("at"))
        homes = scratch.save(homes.select("at.key", "at.th").distinct(), "homes")
        sets = _sets(base.join(counted(homes), ["key", "th"], "left_semi").select("t"), size, least)
        sets = scratch.save(sets.join(counted(items), "h", "left_semi").dropDuplicates(["h"]), "sets")
        scratch.drop(homes)

        def verify(pairs: DataFrame) -> DataFrame:
            ends = touched(sets.select("h", "value"), pairs, scratch)
            both = pairs.join(ends.select(F.col("h").alias("a"), F.col("value").alias("x")), "a").join(ends.select(F.col("h").alias("b"), F.col("value").alias("y")), "b")
            return _similar(both.select("a", "b", "x", "y"), percent)

        return verify, sets

    label = linked(banded.select("h", F.explode("bk").alias("bk")), prepare, scratch, possible(percent), small=SMALL, outline=_outlines)
    groups = named(every.select("key", "th", "s", "e", "h", "passage"), "h", None if label is None else counted(label), "g").drop("h")
    place = F.xxhash64("key", "th", "s", "e")  # rows that are repeated have one place
    many = scratch.save(groups.groupBy("g").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("g"), "many")
    near = scratch.save(groups.join(counted(many), "g"), "near")
    scratch.drop(every, many)
    scratch.forget()
    lines = _judged(near.where("NOT passage"))
    inside = _uncovered(lines.unionByName(near.where("passage"), allowMissingColumns=True))
    inside = scratch.save(inside, "inside")
    texts = _judged(inside.where("NOT covered")).unionByName(inside.where("covered").withColumns({"gone": F.lit(True), "stays": F.lit(False)}), allowMissingColumns=True)
    spans = lines.unionByName(texts, allowMissingColumns=True).groupBy("key", "th").agg(F.collect_set(F.struct("s", "e", "passage", "gone", "stays")).alias("spans"))
    spans = scratch.save(spans, "spans")
    scratch.drop(near, inside)
    scratch.forget()
    return spans


def _judged(near: DataFrame) -> DataFrame:
    """near (key, th, s, e, g, ...) with stays, the first of each g, and gone, what does not overlap the first."""
    first = near.groupBy("g").agg(F.min(F.struct("key", "th", "s", "e")).alias("first"))
    stays = F.expr("key = first.key AND th = first.th AND s = first.s AND e = first.e")
    gone = F.expr("NOT (key = first.key AND th = first.th AND s < first.e AND e > first.s)")
    return near.join(first, "g").withColumn("gone", gone).withColumn("stays", stays).drop("first")


def _uncovered(spans: DataFrame) -> DataFrame:
    """The passages of spans (key, th, s, e, g, passage, gone, stays), each once, with covered: within removed paragraphs."""
    item = F.struct("s", "e", "g", "passage", "gone", "stays")
    texts = spans.groupBy("key", "th").agg(F.collect_set(item).alias("spans"), F.max("passage").alias("any")).where("any").drop("any")
    schema = StructType([*spans.select("key", "th", "s", "e", "g", "passage").schema, StructField("covered", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            of, rows = [], []
            for i, found in enumerate(batch.column(2).to_pylist()):
                gone = removed([x for x in found if not x["passage"]])
                ends = [e for _, e in gone]
                for x in found:
                    if x["passage"]:
                        k = bisect_left(ends, x["e"])
                        of.append(i)
                        rows.append((x["s"], x["e"], x["g"], True, k < len(gone) and gone[k][0] <= x["s"]))
            home = pa.array(of, pa.int64())
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, [pa.int64()] * 3 + [pa.bool_()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(home), batch.column(1).take(home), *columns], names=schema.names)

    return texts.mapInArrow(run, schema)


def united(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Sorted ranges without overlaps that cover the same bytes."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def outside(spans: list[list[int]], kept: list[list[int]]) -> list[list[int]]:
    """What of sorted ranges without overlaps lies in none of the others, which are so too."""
    out = []
    for s, e in spans:
        for a, b in kept[bisect_right(kept, s, key=lambda x: x[1]) :]:
            if a >= e:
                break
            if a > s:
                out.append([s, a])
            s = b
        if s < e:
            out.append([s, e])
    return out


def removed(spans: list[dict]) -> list[list[int]]:
    """The bytes that go: removed paragraphs but for first ones, and removed passages but for first ones of either kind."""
    ranges = lambda passages_, flag: united([(x["s"], x["e"]) for x in spans if x[flag] and (passages_ is None or x["passage"] == passages_)])
    whole, some = outside(ranges(False, "gone"), ranges(False, "stays")), outside(ranges(True, "gone"), ranges(None, "stays"))
    return united([(s, e) for s, e in whole + some])


def _cut(hit: DataFrame) -> DataFrame:
    """(row, n_words, n_repeated, n_removed, clean_text) of hit (row, t, spans)."""
    schema = StructType([hit.schema["row"], *(StructField(c, LongType()) for c in ("n_words", "n_repeated", "n_removed")), StructField("clean_text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            data, at = T.buffers(batch.column(1))
            figures, kept = [], []
            for d, found in enumerate(batch.column(2).to_pylist()):
                raw = data[at[d] : at[d + 1]]
                w = T.words(data, at[d : d + 2], T.NOT_SPACE)
                inside = lambda ranges: sum(int(np.searchsorted(w.start, e) - np.searchsorted(w.start, s)) for s, e in ranges)  # noqa: E731,B023
                gone = removed(found)
                edges = [0, *(x for pair in gone for x in pair), len(raw)]
                figures.append((len(w.start), inside(united([(x["s"], x["e"]) for x in found])), inside(gone)))
                kept.append(b"".join(raw[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2])).decode())
            columns = list(zip(*figures)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(kept, pa.string())], names=schema.names)

    return hit.mapInArrow(run, schema)


def paragraph_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, least: int = MIN_WORDS, recall: float = RECALL
) -> DataFrame:
    """One row per input row: `row` (the input row), n_words, n_repeated, n_removed (words) and clean_text.

    Paragraphs with equal sets are one; others are linked if they share a band and their exact Jaccard similarity is
    percent or more; passages are linked if equal. Of each component the occurrence with the smallest (key, position)
    stays, the others are removed from their texts. Where a removed paragraph overlaps the first one of another
    component, the bytes of that one stay. Passages inside removed bytes of paragraphs do not count as first ones: the
    first elsewhere stays, and where there is none they go with their paragraphs, of which similar ones stay. n_repeated counts the words of all occurrences, those that stay
    included. Lines and blocks (of several lines between blank ones) of fewer than `least` words are no paragraphs.
    Rows of one key and text are one document, so they lose the same. Rows with a null key or text keep their text;
    empty tables give empty results; extra columns stay in `row` under whatever name.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    with small_batches(docs.sparkSession):
        spans = repeated_spans(base.select("key", "th", "t").where("key IS NOT NULL AND t IS NOT NULL"), size, percent, least, recall, scratch)
    names = counted(spans.select(F.col("key").alias("k"), F.col("th").alias("h")))
    whole = base.join(names, F.col("key").eqNullSafe(F.col("k")) & F.col("th").eqNullSafe(F.col("h")), "left_anti")
    zero = F.lit(0).cast("long")
    untouched = whole.select("row", word_count(F.col("t")).alias("n_words"), zero.alias("n_repeated"), zero.alias("n_removed"), F.col("t").alias("clean_text"))
    return _cut(at_home(base, spans).select("row", "t", "spans")).union(untouched)


def op10_paragraph_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return paragraph_dedup(docs).select("row.doc_id", "n_words", "n_repeated", "n_removed", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("kept_sha256"))
