"""The universal token scan as DataFrame operations: no Python runs, one file is one window partition, read in one order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from graphloom.functions.names import looks_like_markup
from graphloom.schemas import FACTS, conform

IDENT = "[A-Za-z_][A-Za-z0-9_]*"
JUNK = "[^A-Za-z_(){}.,:<>]*"
# The words that the scan goes by.
CLASS_WORDS = ["class", "struct", "interface", "trait", "enum", "namespace", "union", "object"]
FUNCTION_WORDS = ["fn", "def", "func", "function", "method"]
MODIFIERS = ["public", "private", "protected", "static", "final", "abstract", "virtual", "override", "const", "inline"]
NOISE = ["if", "for", "while", "return", "true", "false", "null", "this", "self"]


def without_markup(files: DataFrame, content: str = "content") -> DataFrame:
    return files.where(~looks_like_markup(F.col(content)))


def may_have_facts(content: Column) -> Column:
    """False only for texts without facts: those with no opening parenthesis and no class or function word."""
    words = "|".join(CLASS_WORDS + FUNCTION_WORDS)
    return F.contains(content, F.lit("(")) | F.rlike(content, F.lit(f"(?<![A-Za-z_])(?:{words})(?![A-Za-z0-9_])"))


def _in_file() -> WindowSpec:
    """All windows over a file share this order, and the partitions that tokens() makes: one shuffle and one sort for all of them."""
    return Window.partitionBy("path").orderBy("line", "i")


def tokens(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, n, token, line, col, i): identifiers and ( ) { } . , : < > in order; n counts from 0, line and col from 1, i from 0 in its line."""
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(content), "\n")).alias("line", "text"))
    chunks = lines.select("path", (F.col("line") + 1).cast("long").alias("line"), F.posexplode(F.regexp_extract_all("text", F.lit(f"{JUNK}({IDENT}|[(){{}}.,:<>])"), F.lit(0))).alias("i", "chunk"))
    token = F.regexp_replace("chunk", f"\\A{JUNK}", "")
    in_line = Window.partitionBy("path", "line").orderBy("i")
    placed = chunks.repartition("path").select("path", "line", "i", token.alias("token"), (F.sum(F.length("chunk")).over(in_line) - F.length(token) + 1).alias("col"))
    return placed.select("path", (F.row_number().over(_in_file()) - 1).cast("long").alias("n"), "token", "line", "col", "i")


def scopes(tokens_: DataFrame) -> DataFrame:
    """tokens with scope: the depth of braces, never below 0 (the running sum less its lowest value so far)."""
    step = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    summed = tokens_.withColumn("sum", F.sum(step).over(_in_file()))
    return summed.withColumn("scope", (F.col("sum") - F.least(F.min("sum").over(_in_file()), F.lit(0))).cast("long")).drop("sum")


def _is_ident(token: Column) -> Column:
    return F.rlike(token, F.lit("\\A[A-Za-z_]"))


def structures(tokens_: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(path, n, kind, name, line, col): for each class or function word the next identifier that is no noise or modifier.

    Identifiers between < and > that open after the word are passed over. A word without such an identifier gives nothing.
    """
    words = words or CLASS_WORDS + FUNCTION_WORDS
    turn = F.when(F.col("token") == "<", 1).when(F.col("token") == ">", -1).otherwise(0)
    named = _is_ident(F.col("token")) & ~F.col("token").isin(NOISE + MODIFIERS)
    # The next name of a word is the first one after the word or after a change of depth, so only such names are compared.
    after_word = F.coalesce(F.lag("token").over(_in_file()).isin(words), F.lit(True))
    deep = tokens_.withColumns({"depth": F.sum(turn).over(_in_file()), "named": named, "before": F.sum(named.cast("int")).over(_in_file()) - named.cast("int"), "turned": after_word | (turn != 0)})
    counted = deep.withColumns({"word": F.col("token").isin(words), "since": F.max(F.when(F.col("turned"), F.col("before"))).over(_in_file())})
    first = F.col("named") & (F.col("before") == F.col("since"))
    role = lambda depth, word: F.struct(depth.alias("depth"), F.lit(word).alias("word"))
    roles = F.array_compact(F.array(F.when(first, role(F.col("depth"), False)), *[F.when(F.col("word"), role(d, True)) for d in (F.col("depth"), F.col("depth") - 1)]))
    rows = counted.where(F.col("word") | first).select("path", "n", "token", "line", "col", F.explode(roles).alias("r")).select("path", "n", "token", "line", "col", "r.*")
    # Backwards, so that each frame grows by a row; frames that end with the file are read again for every row.
    behind = Window.partitionBy("path", "depth").orderBy(F.desc("n"), F.desc("word")).rowsBetween(Window.unboundedPreceding, -1)
    found = F.when(~F.col("word"), F.struct("n", F.col("token").alias("name"), "col"))
    best = rows.withColumn("next", F.last(found, ignorenulls=True).over(behind)).where("word").groupBy("path", "n", "token", "line").agg(F.min("next").alias("next")).where("next IS NOT NULL")
    kind = F.when(F.col("token").isin(CLASS_WORDS), "Class").otherwise("Function")
    return best.select("path", "n", kind.alias("kind"), F.col("next.name").alias("name"), "line", F.col("next.col").alias("col"))


def calls(tokens_: DataFrame, noise: list[str] = NOISE) -> DataFrame:
    """(path, n, kind, name, line, col): identifiers followed by an opening parenthesis, with the dotted names before them.

    Names in noise are no calls. Each name is put together once, from the identifiers of its chain.
    """
    ident, behind = _is_ident(F.col("token")), lambda k: F.coalesce(F.lag("token", k).over(_in_file()), F.lit(""))
    marked = tokens_.withColumns({"next": F.lead("token").over(_in_file()), "last": behind(1), "second": behind(2)}).withColumn("ident", ident)
    linked = F.when(F.col("token") == ".", _is_ident(F.col("last"))).otherwise(F.col("ident") & (F.col("last") == ".") & _is_ident(F.col("second")))
    chained = marked.withColumn("chain", F.sum((~linked).cast("int")).over(_in_file()))
    links = chained.where(F.col("ident") & F.col("next").isin("(", "."))
    parts = F.array_sort(F.collect_list(F.struct("n", "token"))).alias("parts")
    ends = links.groupBy("path", "chain").agg(parts, F.max_by(F.struct("n", "next", "line", "col"), "n").alias("end")).where("end.next = '('")
    found = ends.select("path", "end.n", F.lit("CallSite").alias("kind"), F.array_join("parts.token", ".").alias("name"), "end.line", "end.col")
    return found.where(~F.col("name").isin(noise)) if noise else found


def heuristic_facts(files: DataFrame, markup_filter: bool = True, language: str | None = None) -> DataFrame:
    """Facts of files (path, content): classes (namespaces too), functions, calls, the first of each (name, line, kind); no nesting."""
    source = without_markup(files) if markup_filter else files
    scanned = tokens(source.where(may_have_facts(F.col("content"))))
    every = structures(scanned).withColumn("pass", F.lit(0)).unionByName(calls(scanned).withColumn("pass", F.lit(1)))
    first = every.groupBy("path", "name", F.col("line").alias("start_line"), "kind").agg(F.min(F.struct("pass", "n", "col")).alias("f"))
    number = F.row_number().over(Window.partitionBy("path").orderBy("f.pass", "f.n")) - 1
    rows = first.select(
        "path", number.alias("fact_id"), F.lit(language or "Unknown").alias("language"), "kind", "name", "start_line", F.col("f.col").alias("start_col"),
        F.col("start_line").alias("end_line"), (F.col("f.col") + 1).alias("end_col"), F.col("path").alias("source_file"),
    )
    return conform(rows, FACTS)
