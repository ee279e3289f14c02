"""Fuzzy line deduplication: pigeonhole blocks of words, SimHash, edit similarity, connected groups. Native.

Every line is normalised to its lower-cased words. Equal normalised lines are one line. Of two lines with an edit
similarity of 0.8 in words, the longer one of n words, n // 5 words differ at most. So by the pigeonhole principle they
have two of their three rarest words in common up to 9 words, and three of the five rarest up to 14 words; longer lines
with a fifth of their words changed at random have two of the five in common with a probability of 98.7 %. Such pairs
and triples are a line's blocks, at which lines meet. A line that may be similar to one of a longer class has the blocks
of both: triples from 8 words on (to meet lines of 10 and 11), pairs of the five from 12 on (lines of 15 to 17). Frequent words are the least rare; else a longer word is rarer.
Each line that meets another has a 64-bit SimHash of its words; lines of 10 words or more that meet are compared by bits
first, and all by edit distance of the whole lines: word by word, where in a line's code each word is one character that
its hash chooses, or else letter by letter.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bounded import counted
from graphloom.llm.buckets import Apart, linked, repeated_positions, touched, without_lines
from graphloom.llm.quality import let
from graphloom.plans.scratch import Scratch

BITS = 64
SIMILARITY = 0.8
#: Bits in which the hashes of compared lines may differ: lines with a fifth of their words changed differ in 13 on
#: average (standard deviation 3.3), lines that meet by chance in 32 (4).
MAX_BITS = 22
#: Share of the words that lines similar in letters have in common.
SOME_WORDS = 0.5
#: Pairs of lines that one task compares by letters: no more than DEALT, and so few as SHARE if there are cores for them.
DEALT, SHARE = 4_000, 250
#: Pairs that are compared by letters although links by words may have joined their components, as that costs some jobs.
FEW = 8_000
#: Lines of fewer words are compared without regard to bits.
LEAST_BITS = 10
#: A word that makes up one of FREQUENT words of all documents, or more, is frequent; so there are FREQUENT such words at
#: most, whatever the size of the corpus. They come last in the order of rarity, so that lines with a common passage meet
#: at their other words. They share SLOTS bits.
FREQUENT, SLOTS = 500_000, 1 << 20
#: Digits of a word's character beyond its last 16 bits: 15 planes of 65,536 characters.
PLANES = "123456789ABCDEF"


def tokens(line: Column) -> Column:
    """Lower-cased runs of letters and digits. Splitting at single spaces is much cheaper than at a pattern."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(line), r"[^a-z \p{L}\p{N}]+", " "), " "), "")


def values(words: Column) -> Column:
    """A number for each word that is less for a longer word: 6 bits of its length before the last 56 of its hash."""

    def value(w: Column) -> Column:
        lacking = F.lit(63) - F.least(F.length(w), F.lit(63))
        return F.shiftleft(lacking.cast("long"), 56).bitwiseOR(F.xxhash64(w).bitwiseAND(F.lit((1 << 56) - 1)))

    return F.transform(words, value)


def _ones(lane: int) -> int:
    return sum(1 << (lane * k) for k in range(BITS // lane))


def _majority(sums: list[Column], words: Column, lane: int) -> Column:
    """SimHash from the bit sums of fewer than 2**(lane - 1) words, 64 / lane in each long: bit i is set if more than half have it."""
    top, half = lane * (BITS // lane - 1), F.floor(words / 2).cast("long")
    ones = _ones(lane) ^ (1 << top)  # the topmost sum is compared apart, as adding to it would overflow
    most = (1 << (lane - 1)) - 1
    add = (F.lit(most).cast("long") - half) * F.lit(ones).cast("long")
    out = F.lit(0).cast("long")
    for k, total in enumerate(sums):
        lower = F.shiftrightunsigned((total.bitwiseAND(F.lit(ones * most)) + add).bitwiseAND(F.lit(ones << (lane - 1))), lane - 1)
        upper = F.when(F.shiftrightunsigned(total, top) > half, F.lit(1 << top).cast("long")).otherwise(F.lit(0).cast("long"))
        out = out.bitwiseOR(F.shiftleft(lower.bitwiseOR(upper), k))
    return out


def simhash(hashes: Column) -> Column:
    """SimHash of an array of word hashes: a bit for each that is set in more than half of the words.

    The bits are summed in lanes of 8 bits for fewer than 128 words, of 16 or 32 bits for more.
    """

    def sums(lane: int) -> Column:
        ones = F.lit(_ones(lane)).cast("long")
        add = lambda k: lambda a, x: a + F.shiftrightunsigned(x, k).bitwiseAND(ones)
        return _majority([F.aggregate(hashes, F.lit(0).cast("long"), add(k)) for k in range(lane)], F.size(hashes), lane)

    return F.when(F.size(hashes) < 128, sums(8)).when(F.size(hashes) < 1 << 15, sums(16)).otherwise(sums(32))


def frequent_words(words: DataFrame, scratch: Scratch) -> list[int]:
    """SLOTS bits, 64 in each number: those of the hashes of the words (w, or v, their values) that are frequent among all."""
    found = F.col("v") if "v" in words.columns else values(F.col("w"))
    counts = scratch.save(words.select(F.explode(found).alias("h")).groupBy("h").count(), "counts")
    total = counts.agg(F.sum("count")).first()[0] or 0
    bits = np.zeros(SLOTS, bool)
    often = counts.where(F.col("count") * FREQUENT >= total).select("h").collect()  # FREQUENT rows at most
    bits[np.array([r.h for r in often], np.int64) & (SLOTS - 1)] = True
    scratch.drop(counts)
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def rarest(values: Column, frequent: list[int]) -> Column:
    """The values of a line's rarest words, bit 62 telling frequent ones: three of a line of fewer than 8 words, else five."""
    slots = F.split(F.lit(",".join(map(str, frequent))), ",").cast("array<bigint>")  # one constant for all numbers

    def ranked(v: Column) -> Column:
        common = F.getbit(F.get(slots, F.shiftrightunsigned(v, 6).bitwiseAND(F.lit(SLOTS // 64 - 1)).cast("int")), v.bitwiseAND(F.lit(63)).cast("int"))
        return F.shiftleft(common.cast("long"), 62).bitwiseOR(v)

    return F.slice(F.sort_array(F.transform(values, ranked)), F.lit(1), F.when(F.size(values) < 8, F.lit(3)).otherwise(F.lit(5)))


def meeting_keys(words: Column, frequent: list[int]) -> Column:
    """Where a line meets those that are similar to it: some of its rarest words (see the module's head)."""
    return _keys(F.size(words), rarest(values(words), frequent))


def _keys(n: Column, top: Column) -> Column:
    """meeting_keys of a line of n words from its rarest ones."""

    def chosen(few: int, of: int) -> Column:
        return let(top, lambda v: F.array_distinct(F.array(*[F.xxhash64(*[F.get(v, F.lit(i)) for i in some]) for some in combinations(range(of), few)])))

    few = F.when(n < 2, F.array().cast("array<bigint>")).when(n == 2, chosen(2, 2)).when(n < 8, chosen(2, 3))
    border = few.when(n < 10, F.array_union(chosen(2, 3), chosen(3, 5))).when(n < 12, chosen(3, 5))
    return border.when(n < 15, F.array_union(chosen(3, 5), chosen(2, 5))).otherwise(chosen(2, 5))


def _split(base: DataFrame) -> DataFrame:
    """(key, pos, line) of every line that has a letter or digit."""
    return base.select("key", F.posexplode(F.split("t", "\n")).alias("pos", "line")).where(F.rlike("line", F.lit(r"[\p{L}\p{N}]")))


def code(hashes: Column) -> Column:
    """A text with one character for each word hash: one of 983,040, so unequal words are hardly ever equal."""
    plane = lambda h: F.substring(F.lit(PLANES), F.pmod(F.shiftrightunsigned(h, 16), F.lit(len(PLANES))) + 1, F.lit(1))
    units = F.transform(hashes, lambda h: F.concat(F.lit("000"), plane(h), F.right(F.hex(h.bitwiseOR(F.lit(1 << 62))), F.lit(4))))
    return F.decode(F.unhex(F.array_join(units, "")), "UTF-32")


def _near(similarity: float) -> str:
    """SQL for pairs x, y (sim, n, size) that may be similar."""
    ratio = lambda c: f"least(x.{c}, y.{c}) >= {similarity} * greatest(x.{c}, y.{c})"
    bits = f"greatest(x.n, y.n) < {LEAST_BITS} OR bit_count(x.sim ^ y.sim) <= {MAX_BITS}"
    return f"({bits}) AND ({ratio('n')} OR {ratio('size')})"


def _distance(x: str, y: str, longer: str, similarity: float) -> str:
    """SQL for the edit distance of two texts, -1 if it is more than this similarity allows."""
    return f"levenshtein({x}, {y}, cast(floor({longer} * {1 - similarity:.6f} + 1e-9) as int))"


def _profiles(items: DataFrame, lines: DataFrame, base: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, n, size, sim, line) of the wanted lines (h), cut again from one occurrence each in base (key, t)."""
    items = counted(items)
    first = lines.join(items, "h", "left_semi").groupBy("h").agg(F.min(F.struct("key", "pos")).alias("at"))
    wanted = counted(scratch.save(first.select("at.key", "at.pos").distinct(), "wanted"))
    homes = base.join(wanted.select("key"), "key", "left_semi")
    met = _split(homes).join(wanted, ["key", "pos"], "left_semi").select(tokens(F.col("line")).alias("w"))
    found = met.select(F.xxhash64(values(F.col("w"))).alias("h"), "w").join(items, "h", "left_semi").dropDuplicates(["h"])  # rows of one key may have unlike lines at one position
    hashed = found.select("h", F.array_join("w", " ").alias("line"), F.transform("w", lambda w: F.xxhash64(w)).alias("hs"))
    return scratch.save(hashed.select("h", F.size("hs").alias("n"), F.length("line").alias("size"), simhash(F.col("hs")).alias("sim"), "line"), "side")


def _alike(pairs: DataFrame, side: DataFrame, scratch: Scratch, similarity: float, apart: Apart | None = None) -> DataFrame:
    """Pairs (a, b) of line identities whose lines are similar in words or, where not in words, in letters.

    Letters are dear to compare. With apart (see buckets.linked) the links by words are joined first, and only pairs in
    different components are compared by letters; where these are many, first the closest one of every two components.
    The links that apart has joined are not returned again.
    """
    coded = touched(side, pairs, scratch).withColumn("code", code(F.transform(F.split("line", " "), lambda w: F.xxhash64(w))))
    coded = scratch.save(coded, "coded")

    def joined(some: DataFrame, *names: str) -> DataFrame:
        x, y = coded.select("h", *names).alias("x"), coded.select("h", *names).alias("y")
        return some.join(x, F.expr("a = x.h")).join(y, F.expr("b = y.h"))

    def lettered(some: DataFrame) -> DataFrame:
        # Some lines have many such pairs, so they are dealt out evenly once they have met.
        n, tasks = some.count(), 4 * scratch.spark.sparkContext.defaultParallelism
        met = joined(some, "line", "size").repartition(1 + max(n // DEALT, min(n // SHARE, tasks)))
        letters = scratch.save(met.select("a", "b", F.expr(_distance("x.line", "y.line", "greatest(x.size, y.size)", similarity)).alias("d")), "letters")
        return letters.where("d >= 0").select("a", "b")

    both = joined(pairs, "n", "size", "sim", "code").where(F.expr(_near(similarity)))
    apart_by = F.expr(_distance("x.code", "y.code", "greatest(x.n, y.n)", SOME_WORDS))
    judged = both.select("a", "b", apart_by.alias("d"), F.expr("greatest(x.n, y.n)").alias("n"), F.expr(f"least(x.size, y.size) >= {similarity} * greatest(x.size, y.size)").alias("sized"))
    judged = judged.where("d >= 0").select("a", "b", "sized", (F.col("d") / F.col("n")).alias("share"), (F.col("d") <= F.floor(F.col("n") * (1 - similarity) + 1e-9)).alias("alike"))
    judged = scratch.save(judged, "judged")
    alike, open_ = judged.where("alike").select("a", "b"), judged.where("sized AND NOT alike").select("a", "b", "share")
    if apart is None or open_.count() <= FEW:
        return alike.union(lettered(open_.select("a", "b")))
    open_ = scratch.save(apart(alike, open_), "open")
    if open_.count() > FEW:
        closest = open_.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min_by(F.struct("a", "b"), F.struct("share", "a", "b")).alias("p"))
        closest = scratch.save(closest.select("p.a", "p.b"), "closest")
        others = open_.select("a", "b").join(counted(closest), ["a", "b"], "left_anti")
        open_ = scratch.save(apart(lettered(closest), others), "open")
    return lettered(open_.select("a", "b"))


def line_groups(docs: DataFrame, key: str, text: str, similarity: float, scratch: Scratch) -> DataFrame:
    """(key, pos, g, g2): every line with words and the connected group it belongs to."""
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).where(F.col("key").isNotNull() & F.col("t").isNotNull())
    split = _split(base).select("key", "pos", values(tokens(F.col("line"))).alias("v"))
    words = scratch.save(split.select("key", "pos", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2")), "words")
    # The rarest words are a column of their own: put into every choice of them, the plan would hold all frequent words as often.
    ranked = words.select("key", "pos", "h", "h2", F.size("v").alias("n"), rarest(F.col("v"), frequent_words(words, scratch)).alias("top"))
    lines = scratch.save(ranked.select("key", "pos", "h", "h2", _keys(F.col("n"), F.col("top")).alias("keys")), "lines")
    scratch.drop(words)
    scratch.forget()

    def prepare(items: DataFrame):
        side = _profiles(items, lines, base, scratch)
        return lambda pairs, apart: _alike(pairs, side, scratch, similarity, apart), side.select("h", "sim", "n", "size")

    label = linked(lines.select("h", F.explode("keys").alias("bk")), prepare, scratch, _near(similarity), steps=True)
    plain = lines.select("key", "pos", "h", "h2")
    if label is None:
        return plain.select("key", "pos", F.col("h").alias("g"), F.col("h2").alias("g2"))
    grouped = plain.join(counted(label).withColumnRenamed("node", "h"), "h", "left")
    return grouped.select("key", "pos", F.coalesce("component", "h").alias("g"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(F.lit(0).cast("long")).alias("g2"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: `row` (the input row), n_lines, n_removed and clean_text.

    Lines are the parts between newlines; those without a letter or digit always stay. Two lines are linked if they
    are equal after normalisation, or meet (see the module's head; lines of one word do not) and 1 - distance / longer
    length is `similarity` or more, counted in words or, failing that, in characters of the normalised lines. Of each
    connected group the occurrence with the smallest (key, position) stays, all others go.
    Rows with one key count as one document, so equal lines at one position of them stay or go together. Rows with a
    null key or text keep their text (null stays null) and remove nothing elsewhere; empty tables give empty results;
    extra columns stay in `row`.
    """
    scratch, work = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    groups = work.save(line_groups(docs, key, text, similarity, work), "groups")
    removed = repeated_positions(groups, scratch)
    work.clear()
    scratch.forget()
    return without_lines(docs, removed, key, text)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("kept_sha256"))
