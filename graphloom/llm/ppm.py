"""Language-model scores by prediction by partial matching over bytes, beside a unigram base.

A text is coded as its lower-cased words, one space between them, and an end. The model is a trie of byte contexts of
0 to `order` bytes, kept as tables: the counts of all runs of order + 1 bytes, summed up to shorter ones, hold every
node. A byte that a context has not seen is reached by an escape to the next shorter context, in which the symbols of the
longer one are excluded. As a context's symbols are among those of its suffix, the excluded mass of a node depends on
the node alone, so the code length of a run of order + 1 bytes is the same in every text and comes from one join for each order.

Texts are read in chunks. A chunk sends its distinct runs and words, gets back their code lengths and counts, and
meets its own texts again; nothing that grows with the corpus is broadcast or held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm import text as T
from graphloom.llm.bounded import small_batches
from graphloom.plans.scratch import Scratch
from graphloom.plans.ship import ship

#: Bytes of the longest context, at most 6: a run of bytes and a flag must fit a long.
ORDER = 5
#: Bytes of text of a chunk, and of a part whose runs are sorted at once.
CHUNK, _PART = 24 << 20, 2 << 20
_SPACE, _END = 32, 10
_SYMBOLS = 256


def coded_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """What is coded of texts that end in a line end, and where each begins: words, a space after each, an end instead of the last."""
    data, at = T.buffers(column)
    low = T.LOWER[data[int(at[0]) : int(at[-1])]]
    at, n_texts = at - at[0], len(at) - 1
    inside = T.NOT_SPACE[low]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    low[~inside] = _SPACE
    sizes = np.add.reduceat(keep, at[:-1], dtype=np.int64) if n_texts else np.zeros(0, np.int64)
    keep[at[1:][sizes == 0] - 1] = True
    out, to = low[keep], np.concatenate([[0], np.cumsum(np.maximum(sizes, 1))]).astype(np.int64)
    out[to[1:] - 1] = _END
    return out, to


def words_of(coded: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of coded texts, and how many each has."""
    gap = (coded == _SPACE) | (coded == _END)
    ends = np.flatnonzero(gap)
    counts = np.diff(np.searchsorted(ends, at[1:]), prepend=0)  # each text ends in a gap
    sizes = np.diff(ends, prepend=-1) - 1
    del ends
    counts -= sizes[np.cumsum(counts) - 1] == 0  # a text without words is an end alone
    offsets = np.concatenate([[0], np.cumsum(sizes[sizes > 0])])
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(coded[~gap])])
    return words, counts


def byte_runs(coded: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """For every coded byte the run of order bytes before it and itself, as a number: the byte on top, the oldest one
    lowest. Ends stand before the first byte of a text."""
    n = len(coded)
    padded = np.concatenate([np.full(8, _END, np.uint8), coded])
    run = np.ndarray((n,), "<u8", padded, 1, (1,)).copy()
    run >>= np.uint64(8 * (7 - order))
    for p in range(order):
        rows = at[:-1][np.diff(at) > p] + p
        low = (1 << 8 * (order - p)) - 1
        run[rows] = run[rows] & np.uint64(~low & (1 << 64) - 1) | np.uint64(low // 255 * _END)
    return run


class Lookup:
    """Values by distinct keys below 2**63, in tables that take what the tables before have no free place for."""

    _MULTIPLY = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.tables = []
        while len(keys):
            by, bits = np.uint64(self._MULTIPLY[len(self.tables) % 4] + 2 * len(self.tables)), (2 * len(keys)).bit_length()
            shift = np.uint64(64 - bits)
            slot = keys * by >> shift
            own, held = np.full(1 << bits, (1 << 64) - 1, np.uint64), np.zeros(1 << bits)
            own[slot] = keys
            won = own[slot] == keys
            held[slot[won]] = values[won]
            self.tables.append((by, shift, own, held))
            keys, values = keys[~won], values[~won]

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.empty(len(keys)), np.arange(len(keys))
        for by, shift, own, held in self.tables:
            slot = keys * by >> shift
            out[open_] = held[slot]
            left = np.flatnonzero(own[slot] != keys)
            keys, open_ = keys[left], open_[left]
            if not len(keys):
                return out
        if len(keys):
            raise KeyError("a run of bytes has no code length")
        return out


_GATHERED = "chunk bigint, keys array<{key}>, learn array<boolean>, sizes array<int>, coded binary, run bigint, word binary, n bigint"


def _gather(order: int, chunk: int, schema: pa.Schema):
    def batch(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of three kinds for each chunk: its coded texts part by part, its distinct runs, its distinct words, with their counts in texts to learn from."""
        for number, table in T.runs(batches, 2, chunk):
            runs, words = [], []
            here = lambda size: pa.array(np.full(size, number))  # noqa: E731, B023
            for i, j in T.chunks(T.buffers(table["t"])[1], _PART):
                part = table.slice(i, j - i)
                learn = part["learn"].to_numpy()
                coded, at = coded_bytes(part["t"])
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), values)  # noqa: E731, B023
                keys, flags = (part[c].combine_chunks() for c in ("key", "learn"))
                yield batch(1, chunk=here(1), keys=one(keys), learn=one(flags), sizes=one(pa.array(np.diff(at))), coded=pa.array([pa.compress(coded, "zstd", asbytes=True)], pa.large_binary()))
                own = byte_runs(coded, at, order)
                own <<= np.uint64(1)
                own |= np.repeat(learn, np.diff(at)).view(np.uint8)
                own.sort()
                first, sizes = _distinct(own)
                runs.append((own[first] >> np.uint64(1), (sizes * (own[first] & np.uint64(1)).astype(np.int64)).astype(np.int32)))
                found, sizes = words_of(coded, at)
                words.append((found.dictionary_encode(), sizes))
            own, counts = map(np.concatenate, zip(*runs))
            runs.clear()
            by = np.argsort(own)
            own, counts = own[by], counts[by]
            first, _ = _distinct(own)
            own, counts = own[first].astype(np.int64), np.add.reduceat(counts, first).astype(np.int64)
            del by
            for a in range(0, len(own), 1 << 16):
                part = slice(a, a + (1 << 16))
                yield batch(len(own[part]), chunk=here(len(own[part])), run=pa.array(own[part]), n=pa.array(counts[part]))
            names, _, _, seen = _counted_words(words, table["learn"].to_numpy())
            rows = pa.table({"word": names, "n": seen})
            del words, own, counts
            for part in rows.to_batches(1 << 16):
                yield batch(len(part), chunk=here(len(part)), word=part["word"], n=part["n"])

    return run


def _counted_words(parts: list[tuple[pa.DictionaryArray, np.ndarray]], learn: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of parts of a chunk: the distinct ones and, last, the end; the number of each word; the text of each; and how
    often each distinct one comes in texts to learn from."""
    every = pa.chunked_array([words for words, _ in parts]).unify_dictionaries()
    names = pa.concat_arrays([every.chunk(0).dictionary, pa.array([bytes([_END])], pa.large_binary())])
    index = np.concatenate([c.indices.to_numpy() for c in every.chunks])
    of = np.repeat(np.arange(len(learn), dtype=np.int32), np.concatenate([sizes for _, sizes in parts]))
    seen = np.bincount(index[learn[of]], minlength=len(names))
    seen[-1] = learn.sum()
    return names, index, of, seen


def _distinct(rising: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of a sorted array begins, and how often it comes."""
    new = np.ones(len(rising), bool)
    new[1:] = rising[1:] != rising[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(rising))


def code_lengths(runs: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """(run, value): the log10 probability of the last byte of each run after the others; runs: (run, c), c 0 for runs that were not learned.

    Escapes as in variant D: of a context with T occurrences of D symbols that are not excluded, a symbol seen c times
    has (2c - 1) / 2T and the escape D / 2T. Below the empty context the symbols that are left are alike.
    """
    levels = [scratch.save(runs, "runs")]
    for _ in range(order):
        levels.append(scratch.save(levels[-1].groupBy(F.shiftrightunsigned("run", 8).alias("run")).agg(F.sum("c").alias("c")), "runs"))
    levels.reverse()
    total, symbols = F.sum("c").over(Window.partitionBy()), F.count_if(F.col("c") > 0).over(Window.partitionBy())
    node = levels[0].select("run", "c", total.alias("T"), symbols.alias("D")).withColumn("tail", -F.log10(F.greatest(F.lit(1), _SYMBOLS - F.col("D"))))
    saved = []
    for k in range(1, order + 1):
        node = scratch.save(node, "nodes")
        saved.append(node)
        above = node.select(F.col("run").alias("up"), F.col("c").alias("pc"), F.col("T").alias("pT"), F.col("D").alias("pD"), F.col("tail").alias("ptail"))
        rows = levels[k].withColumn("up", F.shiftrightunsigned("run", 8)).join(above, "up")
        own = Window.partitionBy(F.col("run").bitwiseAND(F.lit((1 << 8 * k) - 1)))
        rows = rows.withColumns({"T": F.sum("c").over(own), "D": F.count_if(F.col("c") > 0).over(own), "X": F.sum(F.when(F.col("c") > 0, F.col("pc")).otherwise(0)).over(own)})
        twice = F.nullif(2.0 * (F.col("pT") - F.col("X")), F.lit(0.0))
        tail = F.when(F.col("pc") > 0, F.log10((2 * F.col("pc") - 1) / twice)).when(F.col("pD") > F.col("D"), F.log10((F.col("pD") - F.col("D")) / twice) + F.col("ptail"))
        node = rows.select("run", "c", "T", "D", tail.otherwise(F.col("ptail")).alias("tail"))
    twice = F.nullif(2.0 * F.col("T"), F.lit(0.0))
    value = F.when(F.col("c") > 0, F.log10((2 * F.col("c") - 1) / twice)).when(F.col("D") > 0, F.log10(F.col("D") / twice) + F.col("tail")).otherwise(F.col("tail"))
    codes = scratch.save(node.select("run", value.alias("value")), "codes", "zstd")
    scratch.drop(*levels, *saved)
    return codes


_SCORED = "key {key}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(order: int, tokens: int, distinct: int):
    def run(texts: pa.Table, given: pa.Table) -> pa.Table:
        """The scores of one chunk's texts by the code lengths of its runs and the counts of its words, its own where none is given."""
        is_run = given["run"].is_valid()
        runs, others = given.filter(is_run), given.filter(pc.invert(is_run))
        lookup = Lookup(runs["run"].to_numpy().astype(np.uint64), runs["value"].to_numpy())
        score, parts = [], []
        for sizes, coded in zip(texts["sizes"], texts["coded"]):
            at = np.concatenate([[0], np.cumsum(sizes.values.to_numpy(), dtype=np.int64)])
            coded = np.frombuffer(pa.decompress(coded.as_buffer(), int(at[-1]), "zstd"), np.uint8)
            score += [np.add.reduceat(lookup.find(byte_runs(coded[at[i] : at[j]], at[i : j + 1] - at[i], order)), at[i:j] - at[i]) for i, j in T.chunks(at)]
            found, sizes = words_of(coded, at)
            parts.append((found.dictionary_encode(), sizes))
        learn = pc.list_flatten(texts["learn"]).to_numpy()
        names, index, of, count = _counted_words(parts, learn)
        place = pc.index_in(names, value_set=others["word"].combine_chunks().cast(pa.large_binary())).fill_null(-1).to_numpy()
        count[place >= 0] = others["value"].to_numpy()[place[place >= 0]]
        value, n = np.log10((count + 0.1) / (tokens + 0.1 * (distinct + 1))), len(learn)
        base_score = np.bincount(of, weights=value[index], minlength=n) + value[-1]
        known = np.bincount(of, weights=(count > 0)[index], minlength=n).astype(np.int64) + (count[-1] > 0)
        return pa.table({"key": pc.list_flatten(texts["keys"]), "held_out": pc.invert(pc.list_flatten(texts["learn"])), "n_tokens": np.bincount(of, minlength=n) + 1, "n_known": known, "base_score": base_score, "score": np.concatenate(score)})

    return run


def adaptive_code_length(coded: bytes, order: int) -> float:
    """log10 probability of the coded bytes by a trie that begins empty and takes in each byte after it was coded."""
    trie: dict[bytes, dict[int, int]] = {}
    padded, total = bytes([_END]) * order + coded, 0.0
    for i, symbol in enumerate(coded):
        excluded: set[int] = set()
        contexts = [padded[i + order - k : i + order] for k in range(order, -1, -1)]
        for context in contexts:
            open_ = {s: c for s, c in trie.get(context, {}).items() if s not in excluded}
            if open_:
                twice = 2 * sum(open_.values())
                if symbol in open_:
                    total += np.log10((2 * open_[symbol] - 1) / twice)
                    break
                total += np.log10(len(open_) / twice)
                excluded |= open_.keys()
        else:
            total -= np.log10(_SYMBOLS - len(excluded))
        for context in contexts:
            seen = trie.setdefault(context, {})
            seen[symbol] = seen.get(symbol, 0) + 1
    return float(total)


def _base(docs: DataFrame, key: str, text: str, learn: Column) -> DataFrame:
    ended = F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n")).alias("t")
    return docs.select(F.col(key).alias("key"), F.coalesce(learn, F.lit(False)).alias("learn"), ended)


def adaptive_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """key, n_bytes coded, score: every text coded by a model of its own, which learns as it goes. Null and empty texts
    are one end; rows are scored one by one, repeated ones and null keys too; an empty table gives an empty result."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded, at = coded_bytes(batch.column(2))
            values = [adaptive_code_length(coded[a:b].tobytes(), order) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(values, pa.float64())], names=["key", "n_bytes", "score"])

    base = _base(docs, key, text, F.lit(True))
    return base.mapInArrow(run, f"key {base.schema['key'].dataType.simpleString()}, n_bytes bigint, score double")


def lm_scores(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, chunk: int = CHUNK) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of every row's whole text.

    The rows where `learn` holds are counted, all rows are scored; held_out is its contrary. Words are runs without
    ASCII white space, A-Z lower-cased; tokens are the words and an end. base_score: the sum over the tokens of
    log10((c + 0.1) / (N + 0.1 (V + 1))). score: that of the coded bytes by the trie. Both are over the same events, as
    the words tell the coded bytes and the other way round.

    Null and empty texts and those of white space are one end. Rows are scored one by one, so repeated rows count
    as often as they come and null keys are kept; a null in `learn` is not learned. With nothing to learn all bytes are
    alike. An empty table gives an empty result; other columns are not read. A text longer than `chunk` is a chunk alone.
    """
    if not 0 < order <= 6:
        raise ValueError("order must be from 1 to 6")
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    base = _base(docs, key, text, learn)
    kind = base.schema["key"].dataType.simpleString()
    empty = docs.sparkSession.createDataFrame([], _GATHERED.format(key=kind))
    with small_batches(docs.sparkSession):
        gathered = scratch.save(base.mapInArrow(_gather(order, chunk, empty.toArrow().schema), empty.schema), "gathered", "zstd")
    runs, words = (gathered.where(F.col(c).isNotNull()).select("chunk", c, "n") for c in ("run", "word"))
    counts = scratch.save(words.groupBy("word").agg(F.sum("n").alias("c")), "words")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    others = words.join(counts, "word").where("c <> n").select("chunk", F.lit(None).cast("long").alias("run"), "word", F.col("c").cast("double").alias("value"))
    others = scratch.save(others, "others", "zstd")
    codes = code_lengths(runs.groupBy("run").agg(F.sum("n").alias("c")), order, scratch)
    scratch.drop(counts)
    scratch.forget()
    given = runs.join(codes, "run").select("chunk", "run", F.lit(None).cast("binary").alias("word"), "value").union(others)
    texts = gathered.where("coded IS NOT NULL").select(F.col("chunk").alias("chunk"), "keys", "learn", "sizes", "coded")
    scored = texts.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(_score(order, tokens, distinct), _SCORED.format(key=kind))
    return scored.select("key", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op12_ppm_scores(spark, sf_dir: str) -> DataFrame:
    """All documents, by a model of those whose crc32 does not end in 0. A null doc_id has no such remainder and is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0).withColumnRenamed("key", "doc_id")
