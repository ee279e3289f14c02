"""Alignment of two tokenizers: which tokens of one cover which tokens of the other, and how often ids meet.

Both tokenizers end a token before every space that stands between two other characters. A text is cut there, the
distinct segments of a chunk of texts are encoded and merged once, and everything about a text is a sum over its segments.
The ends of the tokens of both sides are merged as two sorted lists: each stretch between neighbouring ends is one link
between the two tokens that cover it, and an end of both sides closes a group. Ids that are linked are counted by
Spark over all texts; counts and maxima come back to the chunks by joins, where texts and segments wait as numbers.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import text as T
from graphloom.llm.bounded import small_batches
from graphloom.llm.tokenpack import WORDS
from graphloom.plans.scratch import Scratch
from graphloom.plans.ship import ship

FOLDER = "/opt/tokenizers"
A, B = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
#: Bytes of text of a chunk, and of those whose groups are written out at once; segments that are encoded at once.
CHUNK, _PART, _SEGMENTS = 8 << 20, 1 << 20, 1 << 13
_MARK = "▁"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Side:
    """A tokenizer that encodes segments with their leading space, and the bytes of its tokens."""

    def __init__(self, name: str, content: bytes):
        if name.endswith(".tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
            made = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda texts: [made.encode_ordinary(t) for t in texts]
            known = {i: b for b, i in ranks.items()}
        elif name.endswith(".json"):
            from tokenizers import Tokenizer

            made, letters = Tokenizer.from_str(content.decode()), _byte_letters()
            if json.loads(content).get("normalizer") or (json.loads(content)["pre_tokenizer"] or {}).get("type") != "ByteLevel":
                raise ValueError("only byte-level vocabularies without a normalizer can be aligned")
            made.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in made.encode_batch_fast(texts, add_special_tokens=False)]
            known = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in made.get_vocab().items()}
        else:
            import sentencepiece

            made = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.encode = lambda texts: made.encode([t[1:] for t in texts], num_threads=1)  # it adds the space again
            known = {}
            for i, piece in ((i, made.id_to_piece(i)) for i in range(made.vocab_size())):
                if _MARK in piece.lstrip(_MARK):
                    raise ValueError("pieces that go on after a space can't be aligned")
                known[i] = bytes([int(piece[3:5], 16)]) if made.is_byte(i) else piece.replace(_MARK, " ").encode()
        self.bytes = pa.array([known.get(i, b"") for i in range(max(known) + 1)], pa.large_binary())
        self.sizes = pc.binary_length(self.bytes).to_numpy().astype(np.int64)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        ids = self.encode(texts)
        return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


@lru_cache(4)
def side(name: str, content: bytes) -> Side:
    return Side(name, content)


def _buffer(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = T.buffers(strings)
    return data[int(at[0]) : int(at[-1])], at - at[0]


def segments(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Segments of texts data[at[i]:at[i+1]] that begin with a space, and how many each text has.

    A cut lies before a space with an ASCII or Latin-1 letter or sign before it and no white space after it; other
    borders are not tried, which costs speed only.
    """
    low, at = data[int(at[0]) : int(at[-1])], at - at[0]
    n = len(low)
    sign = (low > 0x20) & (low < 0x7F)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = sign[:-1]
    before[2:] |= (low[1:-1] >= 0x80) & (low[:-2] == 0xC3)
    after[:-1] = sign[1:] | (low[1:] >= 0xC3) & ((low[1:] < 0xE1) | (low[1:] > 0xE3))
    cut = (low == 0x20) & before & after
    cut[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(cut)
    offsets = np.append(starts, n).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low)])
    return found, np.diff(np.searchsorted(starts, at))


def _equal(own: Side, ids: np.ndarray, sizes: np.ndarray, text: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which segments are spelt by the bytes of their tokens."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    good = np.bincount(of, weights=own.sizes[ids], minlength=len(sizes)).astype(np.int64) == length
    spelt = _buffer(own.bytes.take(pa.array(ids[good[of]])))[0]
    place = np.repeat(np.arange(len(length)), length)
    given = good[place]
    good[place[given][spelt != text[given]]] = False
    return good


@dataclass
class Merged:
    """Of some segments: tokens, groups and links of each, the linked ids, and the groups written out."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    written: pa.Array


@lru_cache(2)
def _signs(n_a: int, n_b: int) -> pa.Array:
    """How ids are written: those of a before others and at the end of their group, then those of b."""
    return pa.array([f"{i}{c}".encode() for n, kinds in ((n_a, ",|"), (n_b, ",;")) for c in kinds for i in range(n)], pa.large_binary())


def merge(a: Side, b: Side, found: pa.Array) -> tuple[Merged, np.ndarray]:
    """Everything about distinct segments, some at a time; and which of them both sides spell right."""
    parts, good = zip(*(_merge(a, b, pa.concat_arrays([found.slice(k, _SEGMENTS)])) for k in range(0, max(1, len(found)), _SEGMENTS)))
    numbers = [np.concatenate([getattr(m, f) for m in parts]) for f in ("n_a", "n_b", "n_groups", "n_links", "pairs")]
    return Merged(*numbers, pa.concat_arrays([m.written for m in parts])), np.concatenate(good)


def _merge(a: Side, b: Side, found: pa.Array) -> tuple[Merged, np.ndarray]:
    """Merge the token ends of both sides over segments that stand one after another."""
    text, at = _buffer(found)
    length = np.diff(at)
    strings = [s.decode(errors="replace") for s in found.to_pylist()]
    (ids_a, sizes_a), (ids_b, sizes_b) = a.encoded(strings), b.encoded(strings)
    good = _equal(a, ids_a, sizes_a, text, length) & _equal(b, ids_b, sizes_b, text, length)
    ids_a, ids_b = ids_a[np.repeat(good, sizes_a)], ids_b[np.repeat(good, sizes_b)]
    sizes_a, sizes_b = np.where(good, sizes_a, 0), np.where(good, sizes_b, 0)
    ends = np.concatenate([np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])])
    order = np.argsort(ends, kind="stable")  # merges two sorted runs; an end of a comes before the same end of b
    of_a = order < len(ids_a)
    last = np.flatnonzero(np.diff(ends[order], append=-1) != 0)
    common = np.diff(last, prepend=-1) == 2
    passed = np.cumsum(of_a)[last]
    at_a, at_b = passed - (common | of_a[last]), last + 1 - passed - (common | ~of_a[last])
    group = np.cumsum(common) - common
    segment = np.repeat(np.arange(len(good)), sizes_a)[at_a]
    count = lambda of: np.bincount(of, minlength=len(good))
    # the groups in order, of each its ids of a and then those of b
    group_a, group_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    group_a[at_a], group_b[at_b] = group, group
    in_a, in_b = (np.bincount(g, minlength=int(common.sum())) for g in (group_a, group_b))
    n_a, n_b = len(a.bytes), len(b.bytes)
    signs = np.empty(len(ids_a) + len(ids_b), np.int64)
    ends_group = lambda g: np.diff(g, append=-1) != 0
    signs[np.arange(len(ids_a)) + (np.cumsum(in_b) - in_b)[group_a]] = ids_a + n_a * ends_group(group_a)
    signs[np.arange(len(ids_b)) + np.cumsum(in_a)[group_b]] = 2 * n_a + ids_b + n_b * ends_group(group_b)
    letters, to = _buffer(_signs(n_a, n_b).take(pa.array(signs)))
    offsets = to[np.concatenate([[0], np.cumsum(sizes_a + sizes_b)])].astype(np.int64)
    written = pa.Array.from_buffers(pa.large_binary(), len(good), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])
    return Merged(sizes_a, sizes_b, count(segment[common]), count(segment), ids_a[at_a] << 32 | ids_b[at_b], written), good


_NUMBERS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
_GATHERED = f"chunk bigint, key {{key}}, {_NUMBERS}, groups_sha256 string, written string, items array<int>, sizes array<int>, pair bigint, n bigint"


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _gather(names: tuple[str, str], contents, chunk: int, keep: bool, schema: pa.Schema):
    def batch(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of three kinds for each chunk: its texts as numbers of segments, its segments as numbers of pairs, its pairs with their links."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a, b = (side(n, c) for n, c in zip(names, contents.value))
        for number, table in T.runs(batches, 1, chunk):
            data, at = T.buffers(table["t"])
            every, counts = segments(data, at)
            coded = every.dictionary_encode()
            own, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            of = np.repeat(np.arange(len(counts)), counts)
            m, good = merge(a, b, own)
            bad = np.zeros(len(counts), bool)
            bad[of[~good[index]]] = True
            kept = ~bad[of]
            index, of, counts = index[kept], of[kept], np.where(bad, 0, counts)
            begin = np.concatenate([[0], np.cumsum(counts)])
            here = lambda size: pa.array(np.full(size, number))
            for i, j in T.chunks(at, _PART):
                items = index[begin[i] : begin[j]]
                per = lambda of_segment: pa.array(np.bincount(of[begin[i] : begin[j]] - i, weights=of_segment[items], minlength=j - i).astype(np.int64))  # noqa: E731, B023
                letters, to = _buffer(m.written.take(pa.array(items)))
                cuts = to[np.concatenate([[0], np.cumsum(counts[i:j])])].tolist()
                texts = [letters[p : q - 1].tobytes() if q > p else b"" for p, q in zip(cuts[:-1], cuts[1:])]
                digests = pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts])
                more = {"written": pa.array([t.decode() for t in texts])} if keep else {}
                yield batch(j - i, chunk=here(j - i), key=table["key"].combine_chunks().slice(i, j - i), n_a=per(m.n_a), n_b=per(m.n_b), n_groups=per(m.n_groups), n_links=per(m.n_links), groups_sha256=digests, items=_lists(items, counts[i:j]), **more)
            pairs, place = np.unique(m.pairs, return_inverse=True)
            times = np.bincount(index, minlength=len(own))
            links = np.bincount(place, weights=np.repeat(times, m.n_links), minlength=len(pairs)).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(m.n_links)])
            for i in range(0, len(own), 1 << 12):
                sizes = m.n_links[i : i + (1 << 12)]
                yield batch(1, chunk=here(1), n=pa.array([i]), items=_lists(place[ends[i] : ends[i + len(sizes)]], [int(sizes.sum())]), sizes=_lists(sizes, [len(sizes)]))
            for i in range(0, len(pairs), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield batch(len(pairs[part]), chunk=here(len(pairs[part])), pair=pa.array(pairs[part]), n=pa.array(links[part]))

    return run


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and the size of each."""
    return pc.list_flatten(column).to_numpy().astype(np.int64), pc.list_value_length(column).to_numpy().astype(np.int64)


_COUNTED = f"key {{key}}, {_NUMBERS}, n_best bigint, count_sum bigint, groups_sha256 string, written string"


def _counted(own: pa.Table, given: pa.Table) -> pa.Table:
    """Sums over links for the texts of one chunk: of its pairs' counts, of its segments, of its texts."""
    given = given.sort_by("pair")
    pairs = own.filter(pc.is_valid(own["sizes"])).sort_by("n")
    texts = own.filter(pc.is_null(own["sizes"]))
    place, sizes = _flat(pairs["items"])[0], _flat(pairs["sizes"])[0]
    items, counts = _flat(texts["items"])
    out = {}
    for name in ("best", "count"):
        of_segment = _sums(given[name].to_numpy().astype(np.int64)[place], sizes)
        out[name] = _sums(of_segment[items], counts)
    numbers = {c: texts[c] for c in ("key", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(numbers | {"n_best": out["best"], "count_sum": out["count"], "groups_sha256": texts["groups_sha256"], "written": texts["written"]})


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str = A, b: str = B, groups: bool = False, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of the tokenizers whose files the driver reads at the paths a and b.

    documents: key, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair of ids has the most links of its b id
    over all texts, ties included), count_sum (over the links, how many links hold their pair of ids over all texts),
    groups_sha256 of the groups written as `a1,a2|b1;a3|b2,b3`, and with `groups` these as a column `groups`.
    pairs: a_id, b_id, count (links), best.

    Texts are encoded with one space before them. A text that is null or empty, or that the tokens of one side do not
    spell byte by byte, has no tokens: zeros and ''. Rows are taken one by one, repeated rows and null keys too; an empty
    table gives two empty ones; other columns are not read. a and b must be byte-level vocabularies or pieces that
    end before spaces, else it is an error. A text longer than `chunk` is a chunk alone.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    ship(spark)
    contents = tuple(Path(p).read_bytes() for p in (a, b))
    for name, content in zip((a, b), contents):
        side(name, content)  # errors come before any job
    spaced = F.when(F.length(text) > 0, F.concat(F.lit(" "), F.col(text))).otherwise("").alias("t")
    base = docs.select(F.col(key).alias("key"), spaced)
    kind = base.schema["key"].dataType.simpleString()
    empty = spark.createDataFrame([], _GATHERED.format(key=kind))
    gather = _gather((a, b), spark.sparkContext.broadcast(contents), chunk, groups, empty.toArrow().schema)
    with small_batches(spark):
        gathered = scratch.save(base.mapInArrow(gather, empty.schema), "gathered")
    found = gathered.where("pair IS NOT NULL").select("chunk", "pair", "n")
    counts = scratch.save(found.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b_id", F.col("pair").bitwiseAND(F.lit(2**32 - 1))), "counts")
    most = counts.groupBy("b_id").agg(F.max("count").alias("most"))
    pairs = scratch.save(counts.join(most, "b_id").select("pair", "b_id", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")
    given = found.join(pairs, "pair").select("chunk", "pair", "count", F.col("best").cast("long").alias("best"))
    own = gathered.where("pair IS NULL").select(F.col("chunk").alias("chunk"), "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "written", "items", "sizes", "n")
    documents = own.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(_counted, _COUNTED.format(key=kind))
    documents = documents.withColumnRenamed("written", "groups") if groups else documents.drop("written")
    seen = pairs.where("count > 0").select(F.shiftright("pair", 32).alias("a_id"), "b_id", "count", "best")
    return documents, seen


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents, byte-level pairs of bytes against pieces."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0].withColumnRenamed("key", "doc_id")
