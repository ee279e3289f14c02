"""Licence recognition by sentence rules. Native.

Texts are cut into sentences; each normalised sentence that is a known licence sentence becomes its identifier, and
ordered rules are matched against the sequence of identifiers of a text. Sentences end at full stops, exclamation and
question marks and blank lines. Semicolons, colons and single newlines may end a sentence or lie within one, as in
wrapped notices, so a known sentence may go on over them; of several, the longest is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences, normalised (lower case, one space for everything but letters and digits).
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "spdx license identifier mit": "mit-ref",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache-ref",
    "this project is licensed under the apache license version 2 0": "apache-ref",
    "spdx license identifier apache 2 0": "apache-ref",
    "licensed under the apache license version 2 0 the license": "apache-head",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "spdx license identifier gpl 3 0 only": "gpl3-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-head",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope",
    "see the gnu general public license for more details": "gpl-see",
    "licensed under cc by nc 4 0": "ccbync-ref",
    "this work is licensed under cc by nc 4 0": "ccbync-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync-ref",
    "licensed under cc by 4 0": "ccby-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-head",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
}
# Ordered rules, the longer before the shorter; a matched run of identifiers is used once.
RULES = [
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("Apache-2.0", ["apache-head", "apache-comply", "apache-copy", "apache-warranty"]),
    ("Apache-2.0", ["apache-head", "apache-comply"]),
    ("GPL-3.0-or-later", ["gpl3-head", "gpl-hope", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl3-head"]),
    ("MIT", ["mit-title", "mit-ref"]),
    ("MIT", ["mit-ref"]),
    ("MIT", ["mit-title"]),
    ("Apache-2.0", ["apache-ref"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("CC-BY-NC-4.0", ["ccbync-ref"]),
    ("CC-BY-4.0", ["ccby-ref"]),
]
#: Every known sentence holds one of these words; texts without any are not cut up.
TRIGGER = "licen|permission|warrant|redistribut|copyright"
END = r"([.!?;:])[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends of sentences, and places where a sentence may end or go on.
_HARD, _SOFT = "\x01", "\x02"


def _pattern(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    low = F.translate(text, _UPPER + _HARD + _SOFT, _LOWER + "  ")
    cut = F.regexp_replace(F.regexp_replace(low, r"[.!?][\x20\x09-\x0D]+", _HARD), r"[;:][\x20\x09-\x0D]+|\n", _SOFT)
    plain = F.regexp_replace(cut, f"[^a-z0-9{_HARD}{_SOFT}]+", " ")
    left = F.regexp_replace(F.concat(F.lit(_HARD), plain, F.lit(_HARD)), f" ?([{_HARD}{_SOFT}]) ?", "$1")
    left = F.regexp_replace(left, f"{_SOFT}{{2,}}", _HARD)
    for sentence in sorted(SENTENCES, key=lambda x: (-len(x), x)):
        words = sentence.replace(" ", f"[ {_SOFT}]")
        left = F.regexp_replace(left, f"(?<=[{_HARD}{_SOFT}]){words}(?=[{_HARD}{_SOFT}])", f"<{SENTENCES[sentence]}>")
    found = F.regexp_extract_all(left, F.lit("<([^>]+)>"), F.lit(1))
    return F.when(F.rlike(text, F.lit(f"(?i)({TRIGGER})")), found).otherwise(F.array().cast("array<string>"))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_sentences (known ones), sequence (their identifiers), licenses (sorted, comma-joined), license.

    Rules are tried in order on the sequence; each takes all its non-overlapping matches out of it. license is the
    first rule's that matches, null if none. Null and empty texts have no sentences; unknown sentences in between do
    not break a match; repeated rows are scanned alike; no shuffle; extra columns are not read.
    """
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_pattern(ids)).alias("ids")) for name, ids in RULES])
    start = lambda seq: F.struct(seq.alias("left"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, rule: F.when(
        F.contains(acc["left"], rule["ids"]),
        F.struct(F.replace(acc["left"], rule["ids"], F.lit("|")).alias("left"), F.array_append(acc["found"], rule["name"]).alias("found")),
    ).otherwise(acc)
    named = docs.select(F.col(key).alias("key"), identifiers(F.coalesce(F.col(text), F.lit(""))).alias("ids"))
    joined = named.select("key", F.size("ids").cast("long").alias("n_sentences"), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("sequence"))
    matched = joined.withColumn("found", F.when(F.col("sequence") == "", F.array().cast("array<string>")).otherwise(F.aggregate(rules, start(F.col("sequence")), step, lambda acc: acc["found"])))
    return matched.select(
        F.col("key").alias(key), "n_sentences", "sequence", F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("licenses"), F.get("found", F.lit(0)).alias("license")
    )


def op4_sentence_rules(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    steps, last = [], "q"
    for n, (name, ids) in enumerate(RULES):
        p = _pattern(ids)
        steps.append(f"r{n} AS (SELECT doc_id, n, seq, replace(left_, '{p}', '|') AS left_, CASE WHEN contains(left_, '{p}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})")
        last = f"r{n}"
    return rf"""
WITH known(s, id) AS (VALUES {known}),
p AS (SELECT doc_id, unnest(generate_series(1, len(parts))) AS i, unnest(parts) AS s FROM (
  SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{END}', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents)),
m AS (SELECT doc_id, count(*) AS n, string_agg('<' || id || '>', '' ORDER BY i) AS seq
  FROM p JOIN known ON known.s = trim(regexp_replace(p.s, '[^a-z0-9]+', ' ', 'g')) GROUP BY doc_id),
q AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(seq, '') AS seq, coalesce(seq, '') AS left_, CAST([] AS VARCHAR[]) AS found FROM documents LEFT JOIN m USING (doc_id)),
{', '.join(steps)}
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, seq AS sequence, array_to_string(list_sort(list_distinct(found)), ',') AS licenses, found[1] AS license FROM {last}
"""


ORACLE = _oracle()
