"""Packed token matrices: best-fit-decreasing with a segment tree over free capacities.

Every task tokenises its own documents, gathers pieces up to a block of tokens, packs the block and goes on: nothing is
shuffled, memory is bounded by the block and the longest document, and a lost task packs the same rows again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import Scratch
from graphloom.plans.ship import ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LENGTH, BLOCK_TOKENS = 2048, 1 << 21
#: Characters that are tokenised at once; longer texts are cut where the tokenizer's own words end.
_SLICE = 1 << 18


class Capacities:
    """Segment tree over capacities 1 to length: how many open rows have so much room; finds the tightest fit."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.some = [0] * (2 * self.leaves)

    def add(self, capacity: int, count: int) -> None:
        k = self.leaves + capacity
        while k:
            self.some[k] += count
            k >>= 1

    def best(self, least: int) -> int:
        """The smallest capacity of an open row that is `least` or more, 0 if there is none."""
        k = self.leaves + least
        if not self.some[k]:
            while k & 1 or not self.some[k ^ 1]:  # up, until an open row lies to the right
                k >>= 1
                if k <= 1:
                    return 0
            k ^= 1
            while k < self.leaves:
                k = 2 * k if self.some[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices of sizes, each of at most `length` in sum; longer sizes first, ties in the given order."""
    tree, rows = Capacities(length), []
    open_rows: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        room = tree.best(sizes[i]) if sizes[i] < length else 0
        if room:
            row = open_rows[room].pop()
            tree.add(room, -1)
        else:
            row, room = len(rows), length
            rows.append([])
        rows[row].append(i)
        if room > sizes[i]:
            open_rows.setdefault(room - sizes[i], []).append(row)
            tree.add(room - sizes[i], 1)
    return rows


def slices(text: str, size: int = _SLICE) -> list[str]:
    """Parts of a text that are cut before single spaces between other characters, where words of byte-level BPE end."""
    out, a = [], 0
    while len(text) - a > size:
        b = a + size
        while b < len(text) - 1 and not (text[b] == " " and not text[b - 1].isspace() and not text[b + 1].isspace()):
            b += 1
        if b >= len(text) - 1:
            break
        out.append(text[a:b])
        a = b
    return [*out, text[a:]]


# Fixed value: how byte-level tokenizers cut a text into words (the published pattern).
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class Encoder:
    """Token ids of texts by the content of a .tiktoken, .json (tokenizers) or .model (sentencepiece) file."""

    def __init__(self, name: str, content: bytes):
        if name.endswith(".tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
            made = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
            self.ids, self.size = made.encode_ordinary, max(ranks.values()) + 1
        elif name.endswith(".json"):
            from tokenizers import Tokenizer

            made = Tokenizer.from_str(content.decode())
            made.encode_special_tokens = True
            self.ids, self.size = lambda t: made.encode(t, add_special_tokens=False).ids, made.get_vocab_size()
        else:
            import sentencepiece

            made = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.ids, self.size = lambda t: made.encode(t, num_threads=1), made.vocab_size()
        self.kind = np.uint16 if self.size < 1 << 16 else np.uint32

    def encode(self, text: str) -> np.ndarray:
        parts = [np.array(self.ids(s), self.kind) for s in slices(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


_ROWS = "part bigint, block bigint, row bigint, n_tokens bigint, ids binary, cu_seqlens array<int>, doc_ids array<{key}>, pieces array<int>"


def _packed(block: list[tuple], length: int, at: tuple[int, int], pad: int, kind: type, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of one block of pieces (key, piece number, ids)."""
    rows = best_fit_decreasing([len(ids) for *_, ids in block], length)
    for first in range(0, len(rows), 256):
        part = rows[first : first + 256]
        matrix = np.full((len(part), length), pad, kind)
        ends = []
        for r, members in enumerate(part):
            joined = np.concatenate([block[i][2] for i in members])
            matrix[r, : len(joined)] = joined
            ends.append(np.concatenate([[0], np.cumsum([len(block[i][2]) for i in members])]).astype(np.int32))
        n = len(part)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([at[0]] * n, pa.int64()),
                pa.array([at[1]] * n, pa.int64()),
                pa.array(range(first, first + n), pa.int64()),
                pa.array([int(e[-1]) for e in ends], pa.int64()),
                pa.array([row.tobytes() for row in matrix], pa.binary()),
                pa.array(ends, pa.list_(pa.int32())),
                pa.array([[block[i][0] for i in members] for members in part], pa.list_(key)),
                pa.array([[block[i][1] for i in members] for members in part], pa.list_(pa.int32())),
            ],
            names=["part", "block", "row", "n_tokens", "ids", "cu_seqlens", "doc_ids", "pieces"],
        )


def pack_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH, pad: int | None = None, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """One row for each packed row: part, block, row (its place), n_tokens, ids (little-endian, padded to `length`, 2
    bytes a token if the vocabulary allows, else 4), cu_seqlens (0 and the end of every segment; positions restart at
    each), doc_ids and pieces (the key and the number of the piece in its document, by segment).

    `tokenizer` is the path of a tokenizer file that the driver reads. Texts longer than `length` tokens are split
    into pieces of `length` and a rest, so the pieces of a document in order are its tokens. pad defaults to the first
    id after the vocabulary. Rows depend on how the input is partitioned, as each task packs blocks of
    block_tokens of its own documents. Null and empty texts have no tokens and so no segment; repeated rows and null
    keys are packed as they come; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    content = Path(tokenizer).read_bytes()
    size = Encoder(tokenizer, content).size
    held = spark.sparkContext.broadcast(content)
    filler = size if pad is None else pad
    if filler >= 1 << 16 > size:
        raise ValueError("pad does not fit 2 bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = Encoder(tokenizer, held.value)
        number, block, tokens = 0, [], 0
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        kind_of_key = None
        for batch in batches:
            kind_of_key = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = own.encode(text or "")
                for piece, a in enumerate(range(0, len(ids), length)):
                    block.append((name, piece, ids[a : a + length]))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield from _packed(block, length, (part, number), filler, own.kind, kind_of_key)
                    number, block, tokens = number + 1, [], 0
        if block:
            yield from _packed(block, length, (part, number), filler, own.kind, kind_of_key)

    base = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    return base.mapInArrow(run, _ROWS.format(key=base.schema["key"].dataType.simpleString()))


def position_ids(cu_seqlens: Column) -> Column:
    """Positions of a row's tokens, from 0 in each segment."""
    sizes = F.transform(F.slice(cu_seqlens, F.lit(2), F.size(cu_seqlens) - 1), lambda e, i: e - F.get(cu_seqlens, i))
    return F.flatten(F.transform(sizes, lambda n: F.sequence(F.lit(0), n - 1)))


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet files, zstd-compressed: an id matrix row by row, with segment ends and position resets."""
    resets = F.slice("cu_seqlens", F.lit(1), F.size("cu_seqlens") - 1)
    packed.withColumn("position_resets", resets).write.option("compression", "zstd").parquet(path)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The written rows: places, segments, and a digest of the id matrix row."""
    path = f"{Scratch(spark).root}/packed"
    write_packed(pack_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet")), path)
    packed = spark.read.parquet(path)
    return packed.select(
        "part", "block", "row", "n_tokens", F.size("doc_ids").cast("long").alias("n_segments"), "doc_ids", "pieces", "cu_seqlens", "position_resets", F.sha2("ids", 256).alias("ids_sha256")
    )
