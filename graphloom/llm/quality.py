"""Line-first cleaning: judge every line, drop failures, reject documents that lose too much text. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Phrases of boilerplate and navigation lines, looked for in lower-cased lines.
BOILERPLATE = [
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "enable javascript",
    "terms of use",
    "terms of service",
    "privacy policy",
    "lorem ipsum",
    "click here",
    "subscribe to our",
    "sign up for our newsletter",
    "share this article",
    "follow us on",
]
NAVIGATION = r"(^|[^a-z])(home|menu|login|log in|sign in|sitemap|read more|next page|previous page|back to top|skip to content)([^a-z]|$)"
SEPARATOR = r" [|»›] | > "
ENDING = r"""[.!?…:;,"'”»)\]][\x20\x09-\x0D]*\z"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def _windows(words: Column, size: int) -> Column:
    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))

    return F.when(F.size(words) >= size, let(F.transform(words, lambda w: F.xxhash64(w)), hashed)).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column, size: int) -> Column:
    """Words inside windows whose hash occurs twice or more; sorting keeps it O(n log n) within the row."""
    paired = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        marked = F.transform(
            s,
            lambda x, k: F.when(
                F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)),
                x["i"],
            ),
        )
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    def span(p: Column) -> Column:
        gaps = F.transform(p, lambda i, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - i, F.lit(size))).cast("long"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)

    return let(let(paired, repeated), span)


def line_fails(line: Column, max_symbols: float = 0.1, short: int = 3, nav_words: int = 8) -> Column:
    """True for a line that a rule rejects; a line without words passes (it carries no text).

    punctuation: no closing punctuation in a line of fewer than `short` words, or more than `max_symbols` of its
    word characters are one of SYMBOLS. navigation: two separators such as " | ", or a menu word in a line of at
    most `nav_words` words. boilerplate: one of the phrases of BOILERPLATE.
    """
    space, word = r"[\x20\x09-\x0D]+", WORD
    has = lambda n: F.rlike(line, F.lit(word + (space + word) * (n - 1)))  # noqa: E731  n words or more
    chars = F.length(F.regexp_replace(line, space, ""))
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    punctuation = (~has(short) & ~F.rlike(line, F.lit(ENDING))) | (F.rlike(line, F.lit(f"[{SYMBOLS}]")) & (symbols > chars * F.lit(max_symbols)))
    separated = F.rlike(line, F.lit(f"(?s)({SEPARATOR}).*?({SEPARATOR})"))

    def phrases(low: Column) -> Column:
        found = ~has(nav_words + 1) & F.rlike(low, F.lit(NAVIGATION))
        for phrase in BOILERPLATE:
            found = found | F.contains(low, F.lit(phrase))
        return found

    return has(1) & (punctuation | separated | let(F.translate(line, UPPER, LOWER), phrases))


def line_quality(
    docs: DataFrame,
    text: str = "text",
    window: int = 5,
    min_words: int = 10,
    max_repeat: float = 0.2,
    max_lost: float = 0.3,
) -> DataFrame:
    """One row per input row: `row` (the input row), the figures, the verdict and `clean_text`.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: counts over the whole text. base_failed: fewer than
    min_words words, or more than max_repeat of them in repeated windows. lost_chars: word characters of lines
    that line_fails() rejects. kept: not base_failed, and at most max_lost of the word characters lost.

    Null and empty texts have zero counts and fail; repeated rows are judged alike, row by row; extra columns stay in
    `row` under whatever name; an empty table gives an empty one. No shuffle: everything happens within the row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.struct("*").alias("row"), t.alias("t"))
    split = base.select(
        "row",
        "t",
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
        F.split("t", "\n").alias("lines"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    worded = F.filter("lines", lambda x: F.rlike(x, F.lit(WORD)))
    measured = split.select(
        "row",
        _size(F.col("w")).alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        let(worded, lambda x: _size(x) - _size(F.array_distinct(x))).alias("n_dup_lines"),
        let(
            _windows(F.col("w"), window),
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h, window)).otherwise(F.lit(0).cast("long")),
        ).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails"))).alias("lines"),
    )
    lost = F.array_join(F.filter("lines", lambda x: x["fails"])["line"], "")
    judged = measured.withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > round(100 * max_repeat) * F.col("n_words"))
    )
    judged = judged.withColumn("lost_chars", F.length(F.regexp_replace(lost, r"[\x20\x09-\x0D]+", "")).cast("long"))
    judged = judged.withColumn("clean_text", F.array_join(F.filter("lines", lambda x: ~x["fails"])["line"], "\n")).drop("lines")
    return judged.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= round(100 * max_lost) * F.col("word_chars")))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_quality(docs).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"
    )


def _sql_line_fails() -> str:
    low = f"translate(line, '{UPPER}', '{LOWER}')"
    phrases = " OR ".join(f"contains({low}, '{p}')" for p in BOILERPLATE)
    ending = ENDING.replace("'", "''")
    return rf"""(n > 0 AND ((n < 3 AND NOT regexp_matches(line, '{ending}'))
      OR length(line) - length(translate(line, '{SYMBOLS}', '')) > chars * 0.1
      OR len(regexp_extract_all(line, '{SEPARATOR}')) >= 2 OR (n <= 8 AND regexp_matches({low}, '{NAVIGATION}')) OR {phrases}))"""


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws FROM d),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
l1 AS (SELECT doc_id, line, len(regexp_extract_all(line, '{WORD}')) AS n,
  length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM l0),
l AS (SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines,
  coalesce(sum(chars) FILTER ({_sql_line_fails()}), 0) AS lost FROM l1 GROUP BY doc_id),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(generate_series(0, 4)) AS j) GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(lost AS BIGINT) AS lost_chars
  FROM w JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= 30 * word_chars AS kept, lost_chars FROM b
"""
