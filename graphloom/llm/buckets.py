"""Links between items that share buckets, without listing all pairs of a bucket, and removal of lines by position."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.bounded import counted
from graphloom.llm.quality import let
from graphloom.plans.components import merged, named
from graphloom.plans.scratch import Scratch


#: Members of a bucket up to which all meet all at once.
SMALL = 16
#: Pairs for each member of all buckets that are verified without rounds of stars, and for each of them pairs that may be listed.
PAIRS, LISTED = 1, 32
#: Rounds of stars before the members that are left meet all others, and members of one bucket that meet in one cell.
ROUNDS, CELL = 3, 512
#: Rounds in which what is outside the largest component of a bucket meets so many members of it, if it has four times as many.
WIDE_ROUNDS, WIDE = 2, 8

Apart = Callable[[DataFrame, DataFrame], DataFrame]
Verify = Callable[[DataFrame], DataFrame] | Callable[[DataFrame, Apart], DataFrame]


def touched(side: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (h, ...) of side that the written pairs (a, b) name, so that a few pairs do not shuffle all of it."""
    ends = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "ends")
    return side.join(counted(ends), "h", "left_semi")


def _wide_stars(members: DataFrame, label: DataFrame | None, turn: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of WIDE members of each bucket's largest component, others in each turn, and the members outside of it."""
    every = named(members, "h", label, "comp")
    sizes = every.groupBy("bk", "comp").count().groupBy("bk").agg(F.max(F.struct("count", "comp")).alias("top"), F.count("*").alias("comps"))
    top = scratch.save(sizes.where(f"comps > 1 AND top.count > {4 * WIDE}").select("bk", F.col("top.comp").alias("pcomp")), "tops")
    both = scratch.save(every.join(counted(top), "bk"), "wide")
    order = Window.partitionBy("bk").orderBy(F.xxhash64("h", F.lit(turn)), "h")
    pivots = both.where("comp = pcomp").select("bk", "h", F.row_number().over(order).alias("k")).where(F.col("k") <= WIDE)
    stars = both.where("comp <> pcomp").select("bk", F.col("h").alias("o")).join(pivots.select("bk", "h"), "bk")
    stars = scratch.save(stars.select(F.least("h", "o").alias("a"), F.greatest("h", "o").alias("b")).distinct(), "stars")
    scratch.drop(top, both)
    return stars


def linked(keyed: DataFrame, prepare: Callable[[DataFrame], tuple[Verify, DataFrame]], scratch: Scratch, near: str = "true", rounds: int = ROUNDS, small: int = SMALL, outline: Callable[[DataFrame], DataFrame] | None = None, steps: bool = False) -> DataFrame | None:
    """(node, component) of the verified links between items h that share a bucket bk of keyed (bk, h); None without any.

    Members of a bucket of `small` or fewer meet all others at once. In larger ones all meet the
    smallest one; what is still in different components of one bucket then meets all others, in cells of CELL by CELL members,
    so no link between components is lost. Where that were more than PAIRS pairs for each member, rounds of stars come
    before: every open member is compared with the smallest one in each round, and those that are now in its component are
    closed. Then the members outside a bucket's largest component are compared with a few of it.
    prepare(items) is called once with all items (h) that share a bucket. It gives verify, which keeps the pairs (a, b)
    of a written table that are links, and a table (h, ...) of the columns that near, SQL over x.* and y.*, asks of a pair.
    The first pairs are judged by near where they meet; but with outline, which derives these columns from the rows of
    that table and is used for few of them, by verify alone. With steps, verify has a second argument apart(links, pairs),
    which joins links at once and gives the rows of pairs whose ends are still in different components, ca and cb.
    The last pairs are none that was verified before.
    """
    bucket = Window.partitionBy("bk")  # one shuffle of all keys; joined with the keys of several items they would be shuffled twice
    shared = keyed.select("bk", "h", F.min("h").over(bucket).alias("low"), F.max("h").over(bucket).alias("high")).where("low <> high")
    sized = shared.select("bk", "h", "low").distinct().withColumn("c", F.count("*").over(bucket))
    members = scratch.save(sized, "members")
    scratch.forget()
    verify, side = prepare(scratch.save(members.select("h").distinct(), "items"))
    scratch.forget()

    def joined(label: DataFrame | None, stars: DataFrame) -> tuple[DataFrame | None, bool]:
        new = False

        def join(links: DataFrame) -> None:
            nonlocal label, new
            if not links.isEmpty():
                label, new = counted(merged(label, links, "a", "b")), True

        def apart(links: DataFrame, pairs: DataFrame) -> DataFrame:
            join(links)
            return named(named(pairs, "a", label, "ca"), "b", label, "cb").where("ca <> cb")

        found = scratch.save(verify(stars, apart) if steps else verify(stars), "links")
        join(found)
        scratch.drop(found)
        done.append(stars)
        scratch.forget()
        return label, new

    met = members if outline else members.join(side, "h")
    x, y = met.where(f"c <= {small} OR h = low").alias("x"), met.alias("y")
    first = x.join(y, F.expr(f"x.bk = y.bk AND x.h < y.h AND {'true' if outline else near}")).select(F.col("x.h").alias("a"), F.col("y.h").alias("b"))
    done: list[DataFrame] = []  # tables of the pairs that were verified
    label, new = joined(None, scratch.save(first.distinct(), "first"))
    limit, members = PAIRS * members.count(), members.where(f"c > {small}").select("bk", "h")

    def crossed() -> DataFrame | None:
        """The near pairs of all members of one bucket that are in different components; None if there are too many to list."""
        rest = scratch.save(_open(members, label), "rest")
        if (rest.agg(F.sum("c")).first()[0] or 0) > LISTED * limit and not last:
            return None
        ends = touched(side, rest.select(F.col("h").alias("a"), F.col("h").alias("b")), scratch)
        dealt = rest.join(outline(ends) if outline else ends, "h").withColumn("cells", F.ceil(F.col("c") / CELL).cast("int")).withColumn("own", F.expr("pmod(hash(h), cells)"))
        every_cell = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
        x, y = dealt.withColumn("other", every_cell).alias("x"), dealt.withColumn("other", every_cell).alias("y")
        same_cell = "x.bk = y.bk AND x.own = y.other AND x.other = y.own"
        pairs = x.join(y, F.expr(f"{same_cell} AND x.h < y.h AND x.comp <> y.comp AND {near}")).select(F.col("x.h").alias("a"), F.col("y.h").alias("b"))
        pairs = scratch.save(pairs.distinct().join(reduce(DataFrame.union, done), ["a", "b"], "left_anti"), "crossed")
        return pairs if last or pairs.count() <= limit else None

    last = False
    pairs = crossed() if not members.isEmpty() else members
    if pairs is None:
        last, rest = True, _open(members, label).select("bk", "h", "comp")
        for _ in range(rounds):
            pivots = rest.groupBy("bk").agg(F.min(F.struct("h", "comp")).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high"))
            pivots = scratch.save(pivots.where("low <> high").select("bk", F.col("p.h").alias("a"), F.col("p.comp").alias("pcomp")), "pivots")
            stars = rest.join(counted(pivots), "bk").where("comp <> pcomp").select("a", F.col("h").alias("b")).distinct()
            label, new = joined(label, scratch.save(stars, "stars"))
            if not new:
                break
            now = named(rest.select("bk", "h").join(counted(pivots.select("bk", "a")), "bk"), "h", label, "comp")
            rest = scratch.save(named(now, "a", label, "pcomp").where("comp <> pcomp").select("bk", "h", "comp"), "rest")
        for turn in range(WIDE_ROUNDS if label is not None else 0):
            stars = _wide_stars(members, label, turn, scratch)
            if stars.isEmpty():
                break
            label, _ = joined(label, stars)
        pairs = crossed()
    if not pairs.isEmpty():
        label, _ = joined(label, pairs)
    scratch.drop(members, *done)
    return label


def _open(members: DataFrame, label: DataFrame | None) -> DataFrame:
    """(bk, h, comp, c) of the c members (bk, h) of the buckets that hold several components."""
    every = named(members, "h", label, "comp")
    mixed = every.groupBy("bk").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c")).where("low <> high")
    return every.join(mixed.select("bk", "c"), "bk")


def repeated_positions(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(removed_key, removed): for each document the sorted positions of lines of a group (g, g2) that is seen before.

    groups: (key, pos, g, g2). The first occurrence, by key and position, of every group stays.
    """
    several = groups.groupBy("g", "g2").agg(F.min(F.struct("key", "pos")).alias("first"), F.count("*").alias("c")).where("c > 1")
    gone = groups.join(several, ["g", "g2"]).where((F.col("key") != F.col("first.key")) | (F.col("pos") != F.col("first.pos")))
    removed = gone.groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("removed")).withColumnRenamed("key", "removed_key")
    return scratch.save(removed, "removed")


def without_lines(docs: DataFrame, removed: DataFrame, key: str, text: str) -> DataFrame:
    """`row` (the input row), n_lines, n_removed, clean_text: the text without the lines at the removed positions."""
    base = docs.select(F.struct("*").alias("row"), F.col(key).alias("own_key"), F.col(text).alias("t"))
    joined = base.join(counted(removed), F.col("own_key") == F.col("removed_key"), "left")
    parts = F.split("t", "\n")

    def kept(p: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("removed")), lambda i: F.get(p, i))

    return joined.select(
        "row",
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("removed").isNull(), F.col("t")).otherwise(F.array_join(let(parts, kept), "\n")).alias("clean_text"),
    )
