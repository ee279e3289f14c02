"""Exact n-gram Jaccard self-join with signature trees.

1. Every text becomes its set of shingle hashes, a digest of the set, and a token bitmap. Equal sets form one class.
2. Two sets of similarity t share a token among the first n - ceil(t n) + 1 of each under any common order, so the
   representatives meet at those tokens only. Tokens that a sample shows to be frequent come last in the order.
3. In a few rounds, the members of each token are compared with its smallest one that is still in another component; at
   each token, only members that are then still in different components go on. Two are compared directly, more form a
   signature tree: leaves are documents, inner nodes hold the OR of the bitmaps and the range of sizes. A dual traversal
   drops node pairs whose largest possible overlap is too small.
4. What is left is verified on the whole sets; links and classes give the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import text as T
from graphloom.llm.bounded import counted
from graphloom.llm.buckets import touched
from graphloom.plans.components import merged, named
from graphloom.plans.scratch import Scratch
from graphloom.plans.ship import ship

SHINGLE, PERCENT = 5, 80
#: The order of tokens is fitted on so many documents at most; it changes the cost, never the result.
SAMPLE_DOCS, FREQUENT = 50_000, 100_000
#: Members of one token that one task compares; larger groups are split into pairs of blocks.
BLOCK = 4096
#: Rows up to which a table of integers is broadcast; its size is counted first.
BROADCAST_ROWS = 500_000
FANOUT = 8
#: Rounds of stars before the trees.
ROUNDS = 4
_SEED = np.uint64(0xA24BAED4963EE407)


def _sets(batch: pa.RecordBatch, column: int, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingle hashes, where each row's begin), chunk by chunk."""
    data, at = T.buffers(batch.column(column))
    for i, j in T.chunks(at):
        value, of = T.shingles(T.words(data, at[i : j + 1], T.NOT_SPACE), size)
        yield i, j, *T.distinct_sets(value, of, j - i)


def _ragged(value: np.ndarray, count: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(value))


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n must share with any similar set."""
    return -(-percent * n // 100)


def frequent_tokens(base: DataFrame, size: int) -> np.ndarray:
    """Tokens seen four times or more in a bounded sample of documents; FREQUENT of them at most."""
    total = base.count()
    sample = base.where(F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1 << 20)) < int((1 << 20) * min(1 / 16, SAMPLE_DOCS / max(1, total))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, value, _ in _sets(batch, 1, size):
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64))], names=["tok"])

    top = sample.mapInArrow(run, "tok bigint").groupBy("tok").count().where("count >= 4").orderBy(F.desc("count"), "tok").limit(FREQUENT)
    return np.sort(np.array([r.tok for r in top.collect()], np.int64).view(np.uint64))


def profiles(base: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, n, d1, d2, prefix, bits): set size, digest, tokens to meet at, and the token bitmap."""
    spark = base.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(frequent_tokens(base, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(frequent & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for batch in batches:
            for i, j, value, cut in _sets(batch, 1, size):
                n = np.diff(cut)
                doc = np.repeat(np.arange(j - i), n)
                digests = []
                for seed in (np.uint64(0), _SEED):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(T.mix(value ^ seed))])
                    digests.append((total[cut[1:]] - total[cut[:-1]]).view(np.int64))
                late = maybe[(value & np.uint64((1 << 20) - 1)).astype(np.int64)]
                some = np.flatnonzero(late)
                late[some] = np.isin(value[some], frequent)
                before = np.concatenate([[0], np.cumsum(~late)])
                rare = (before[cut[1:]] - before[cut[:-1]])[doc]
                rank = np.where(late, rare + np.arange(len(value)) - cut[:-1][doc] - (before[:-1] - before[cut[:-1]][doc]), before[:-1] - before[cut[:-1]][doc])
                length = np.where(n > 0, n - needed(n, percent) + 1, 0)
                take = rank < length[doc]
                bits = [bitmap(value[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(digests[0]), pa.array(digests[1]), _ragged(value[take].view(np.int64), length), pa.array(bits, pa.binary())],
                    names=["key", "n", "d1", "d2", "prefix", "bits"],
                )

    key = base.schema["key"].dataType.simpleString()
    return base.mapInArrow(run, f"key {key}, n bigint, d1 bigint, d2 bigint, prefix array<bigint>, bits binary")


def bitmap(value: np.ndarray) -> bytes:
    """A bit for each token, in a power of two of bits, 256 and four times the number of tokens at least."""
    width = max(256, 1 << (4 * len(value) - 1).bit_length()) if len(value) else 256
    flags = np.zeros(width, bool)
    flags[(value & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words folded to fewer words by OR."""
    return bits if bits.shape[1] == words else np.bitwise_or.reduce(bits.reshape(len(bits), bits.shape[1] // words, words), axis=1)


def _possible(common: np.ndarray, excess_a, excess_b, low_a, low_b, percent: int) -> np.ndarray:
    """Whether an overlap of common bits, with so many tokens beyond the bits, can reach the similarity."""
    overlap = common + np.minimum(excess_a, excess_b)
    return (100 + percent) * overlap >= percent * (low_a + low_b)


class SignatureTree:
    """Documents of one bitmap width in order of size; each level joins FANOUT nodes of the one below."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, group: np.ndarray, height: int):
        excess = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, excess, group, group)]
        while len(self.levels) < height:
            b, low, high, more, first, last = self.levels[-1]
            cut = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(more, cut), np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)))


def _excess(nodes: tuple, k: np.ndarray, folded: np.ndarray, words: int, level: int) -> np.ndarray:
    """Tokens of a document beyond its bits, after folding; for inner nodes a bound on that."""
    bits, _, n, excess, *_ = nodes
    if bits.shape[1] == words:
        return excess[k]
    if not level:
        return n[k] - np.bitwise_count(folded).sum(axis=1, dtype=np.int64)
    return excess[k] + np.bitwise_count(bits[k]).sum(axis=1, dtype=np.int64)


def _height(n: int) -> int:
    height = 1
    while n > 1:
        n, height = -(-n // FANOUT), height + 1
    return height


def dual(a: SignatureTree, b: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs (i of a, j of b) that no bound excludes; a is b for pairs i < j within one tree."""
    same, words = a is b, min(a.levels[0][0].shape[1], b.levels[0][0].shape[1])
    top = len(a.levels) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    step = max(1, (1 << 21) // words)
    while stack:
        level, i, j = stack.pop()
        if len(i) > step:
            stack += [(level, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]
            continue
        x, y = a.levels[level], b.levels[level]
        ok = (100 * x[2][i] >= percent * y[1][j]) & (100 * y[2][j] >= percent * x[1][i])
        ok &= ~((x[4][i] == x[5][i]) & (y[4][j] == y[5][j]) & (x[4][i] == y[4][j]))
        ok &= (i < j) if same and not level else True
        i, j = i[ok], j[ok]
        fx, fy = fold(x[0][i], words), fold(y[0][j], words)
        common = np.bitwise_count(fx & fy).sum(axis=1, dtype=np.int64)
        ex, ey = (_excess(*part, words, level) for part in ((x, i, fx), (y, j, fy)))
        ok = _possible(common, ex, ey, x[1][i], y[1][j], percent)
        i, j = i[ok], j[ok]
        if not level:
            if len(i):
                yield i, j
        elif len(i):
            ni, nj = len(a.levels[level - 1][0]), len(b.levels[level - 1][0])
            k = np.arange(FANOUT)
            ci = (i[:, None, None] * FANOUT + k[None, :, None] + 0 * k[None, None, :]).ravel()
            cj = (j[:, None, None] * FANOUT + k[None, None, :] + 0 * k[None, :, None]).ravel()
            inside = (ci < ni) & (cj < nj) & ((ci <= cj) if same else True)
            stack.append((level - 1, ci[inside], cj[inside]))


def group_pairs(n: np.ndarray, bits: list[bytes], group: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs of members in different groups that may be similar; with side, only pairs across the two sides."""
    widths = np.array([len(b) for b in bits])
    parts = {}
    for width in np.unique(widths):
        for s in (0, 1) if side is not None else (None,):
            own = np.flatnonzero((widths == width) & ((side == s) if s is not None else True))
            if len(own):
                own = own[np.argsort(n[own], kind="stable")]
                matrix = np.frombuffer(b"".join(bits[k] for k in own), np.uint64).reshape(len(own), -1)
                parts[int(width), s] = own, matrix
    height = max(_height(len(own)) for own, _ in parts.values())
    trees = {k: (own, SignatureTree(n[own], matrix, group[own], height)) for k, (own, matrix) in parts.items()}
    pairs = []
    for (width, s), (own, tree) in trees.items():
        for (other_width, other_s), (other, other_tree) in trees.items():
            near = other_width == 2 * width or (other_width == width and ((s is None) or (s, other_s) == (0, 1)))
            if near and (s is None or s != other_s):
                for i, j in dual(tree, other_tree, percent):
                    pairs += zip(own[i].tolist(), other[j].tolist())
    return pairs


def _attach(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps allow the similarity. Of reps only the rows that the pairs name are shuffled."""
    scratch = Scratch(reps.sparkSession)
    pairs = scratch.save(pairs, "pairs")
    reps = touched(reps.withColumnRenamed("key", "h"), pairs, scratch).withColumnRenamed("h", "key")
    sides = [reps.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "bitsa", "bitsb"))):
                x, y = np.frombuffer(x, np.uint64)[None], np.frombuffer(y, np.uint64)[None]
                words = min(x.shape[1], y.shape[1])
                common = int(np.bitwise_count(fold(x, words) & fold(y, words)).sum())
                ex, ey = (m - int(np.bitwise_count(v if v.shape[1] == words else fold(v, words)).sum()) for m, v in ((na, x), (nb, y)))
                keep.append((100 + percent) * (common + min(ex, ey)) >= percent * (na + nb))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = reps.schema["key"].dataType.simpleString()
    return both.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def verify(pairs: DataFrame, base: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of different keys whose whole sets are similar, compared on the texts in base (key, t).

    Texts meet at a; where one a has many partners, they are dealt over several places, each with a copy of a's text.
    """
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("places"))
    dealt = pairs.join(spread, "a").select("a", F.pmod(F.hash("b"), F.col("places")).alias("place"), F.lit(1).alias("role"), F.col("b").alias("key"))
    heads = spread.select("a", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(0).alias("role"), F.col("a").alias("key"))
    wanted = Scratch(base.sparkSession).save(dealt.union(heads), "wanted")
    small = wanted.count() <= BROADCAST_ROWS
    met = base.join(F.broadcast(wanted) if small else wanted, "key").select("a", "place", "role", "key", "t")
    met = met.repartition("a", "place").sortWithinPartitions("a", "place", "role", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []
        for batch in batches:
            a, place, role, key = (batch.column(k).to_pylist() for k in range(4))
            found = []
            for i, j, value, cut in _sets(batch, 4, size):
                for d in range(i, j):
                    own = value[cut[d - i] : cut[d - i + 1]]
                    if at != (a[d], place[d]):
                        at, heads = (a[d], place[d]), []
                    if role[d] == 0:
                        heads.append(own.copy())
                    elif any(_similar(head, own, percent) for head in heads):
                        found.append((a[d], key[d]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], batch.schema.field(0).type), pa.array([y for _, y in found], batch.schema.field(3).type)], names=["a", "b"])

    kind = base.schema["key"].dataType.simpleString()
    return met.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    place = np.searchsorted(x, y)
    common = int((x[np.minimum(place, len(x) - 1)] == y).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _tree_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) left by the signature trees of rows (tok, c, key, n, comp, bits)."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.hash("key"), F.col("blocks"))
    dealt = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = dealt.select("tok", "i", "j", "own", "key", "n", "comp", "bits").repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j")

    def solve(rows: list) -> list[tuple]:
        _, i, j, own, key, n, comp, bits = zip(*rows)
        _, group = np.unique(np.array(comp), return_inverse=True)
        side = np.array(own) == j[0] if i[0] != j[0] else None
        if len(rows) < 2 or (side is not None and (side.all() or not side.any())):
            return []
        return [(key[x], key[y]) for x, y in group_pairs(np.array(n), list(bits), group, percent, None if side is None else side.astype(int))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, kind = [], None
        for batch in batches:
            kind, found = batch.schema.field(4).type, []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and rows[0][:3] != row[:3]:
                    found += solve(rows)
                    rows = []
                rows.append(row)
            yield _pairs(found, kind)
        if rows:
            yield _pairs(solve(rows), kind)

    kind = members.schema["key"].dataType.simpleString()
    return dealt.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _pairs(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    ends = [(min(p), max(p)) for p in found if p[0] != p[1]]
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in ends], kind), pa.array([b for _, b in ends], kind)], names=["a", "b"])


def _starred(shared: DataFrame, links: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame | None:
    """(node, component) of the links that ROUNDS of stars find among members (tok, key) of tokens; None without any.

    In each round the open members of a token are compared with its smallest one, in the first round each with one
    smallest partner only; those that are then in its component are closed. So near copies end up in one component at
    the cost of a few comparisons for each member, and the trees need not list their pairs.
    """
    label, rest = None, shared.select("tok", "key")
    for turn in range(ROUNDS):
        now = named(rest, "key", label, "comp")
        pivots = now.groupBy("tok").agg(F.min(F.struct("key", "comp")).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        pivots = scratch.save(pivots.select("tok", F.col("p.key").alias("a"), F.col("p.comp").alias("pcomp")), "pivots")
        stars = now.join(pivots, "tok").where("comp <> pcomp").select("a", F.col("key").alias("b"))
        stars = stars.distinct() if turn else stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        found = scratch.save(links(stars), "found")
        if found.isEmpty():
            break
        label = counted(merged(label, found, "a", "b"))
        again = named(rest.join(pivots.select("tok", "a"), "tok"), "key", label, "comp")
        rest = scratch.save(named(again, "a", label, "pcomp").where("comp <> pcomp").select("tok", "key"), "rest")
        scratch.forget()
    return label


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: key, n_shingles, component_id, n_copies (rows with the same set, itself included).

    Sets are distinct runs of `size` words; a shorter text is one run; a text without words, or null, has an empty set
    and links with nothing. Rows link when 100 * intersection >= percent * union; component_id is the smallest key
    reachable. Rows with one key are one node, even if their texts differ; a null key gets no component and links nobody. Extra columns are not
    read, so they may have any names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    profile = scratch.save(profiles(base, size, percent), "profile")
    classes = scratch.save(profile.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("key").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = profile.join(classes.select(F.col("rep").alias("key"), "d1", "d2"), ["key", "d1", "d2"], "left_semi").select("key", "n", "prefix", "bits")
    reps = scratch.save(reps, "reps")
    scratch.forget()
    light = reps.select("key", "n", "bits")
    tokens = reps.select("key", F.explode("prefix").alias("tok"))
    met = tokens.select("tok", "key", F.count("*").over(Window.partitionBy("tok")).alias("c"))  # one shuffle of all tokens, not a second one of their counts
    shared = scratch.save(met.where("c > 1"), "shared")
    scratch.forget()

    label = _starred(shared, lambda pairs: verify(_attach(pairs, light, percent), base, size, percent), scratch)
    comp = named(shared, "key", label, "comp")
    ends = comp.groupBy("tok", "c").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    mixed = scratch.save(ends.select("tok", "c", "a", "b"), "mixed")
    twos = mixed.where("c = 2").select("a", "b").distinct()
    members = comp.join(mixed.where("c > 2").select("tok"), "tok", "left_semi").select("tok", "c", "key", "comp").join(light, "key")
    rest = scratch.save(_attach(twos, light, percent).union(_tree_pairs(members, percent)).distinct(), "rest")
    second = verify(rest, base, size, percent)
    ends = profile.where("n > 0").groupBy("key").agg(F.min("d1").alias("low"), F.max("d1").alias("high"))
    split = profile.join(ends.where("low <> high").select("key"), "key", "left_semi").join(classes, ["d1", "d2", "n"])
    links = scratch.save(second.union(split.select(F.col("rep").alias("a"), F.col("key").alias("b"))), "links")
    label = merged(label, links, "a", "b")
    scratch.drop(shared, mixed, rest, links)
    scratch.forget()
    rows = profile.select("key", "n", "d1", "d2").join(classes, ["d1", "d2", "n"], "left")
    rows = rows.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    return rows.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "rep", "key").alias("component_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_copies")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS k FROM (
  SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r AS (SELECT x AS node, x AS reach FROM (SELECT DISTINCT x FROM e) UNION SELECT node, y FROM r JOIN e ON e.x = r.reach),
m AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = d.doc_id
"""
