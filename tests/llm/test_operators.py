"""The operators against brute force, on small tables with nulls, empty, repeated and clashing values."""

import hashlib
import os
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import buckets, decontam, jaccard, licenses, linededup, packing, paragraphs, quality, substrings, tokenpack, toxicity
from graphloom.llm import text as T
from graphloom.plans.scratch import Scratch

EXTRA = "doc_id long, text string, row string, key string, t string, lang string"


def table(spark, rows):
    """Rows (doc_id, text) with columns of names that the operators use inside."""
    return spark.createDataFrame([(i, t, "r", "k", "x", "en") for i, t in rows], EXTRA)


def words(rng, n, v=300):
    return " ".join(f"w{rng.randrange(v)}" for _ in range(n))


def changed(rng, text, k):
    out = text.split(" ")
    for _ in range(k):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.randint(25, 90)) for _ in range(6)]
    out = [(i, rng.choice(base)) for i in range(8)] + [(10 + i, changed(rng, rng.choice(base), rng.randint(1, 3))) for i in range(14)]
    out += [(30, words(rng, 3)), (31, words(rng, 3)), (32, ""), (33, None), (34, "  \n\n "), (35, "a b c"), (36, "a  B\tc"), (37, "\n".join(base[:3])), (None, base[0]), (3, base[1]), (3, base[1])]
    return out + [(38, words(rng, 4000)), (39, "é ñ 漢字 " * 30), (40, base[2] + "\n" + base[2])]


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(links, nodes):
    label = {v: v for v in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_jaccard_components(spark, rows):
    keyed = [(i, t) for i, t in rows if i is not None]
    sets = [(i, shingle_set(t)) for i, t in keyed]
    links = [(a, b) for a, x in sets for b, y in sets if x and y and 100 * len(x & y) >= 80 * len(x | y)]
    label = components(links, {i for i, _ in keyed})
    expected = sorted((i, len(s), label[i] if s else i) for i, s in sets)
    got = jaccard.jaccard_components(table(spark, rows)).where("doc_id IS NOT NULL")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == expected
    assert jaccard.jaccard_components(table(spark, [])).count() == 0


def test_large_groups_are_dealt_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    base = words(rng, 60)
    rows = [(i, changed(rng, base, rng.randint(0, 4))) for i in range(60)]
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    sets = [(i, shingle_set(t)) for i, t in rows]
    label = components([(a, b) for a, x in sets for b, y in sets if 100 * len(x & y) >= 80 * len(x | y)], range(60))
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(table(spark, rows)).collect()} == label


def brute_contamination(text, items, window=13):
    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in s or ""))
    w, hit, found = cut(text), set(), set()
    for name, item in items:
        p = cut(item)
        m = min(window, len(p))
        for i in range(len(p) - m + 1) if m and name is not None else ():
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(str(name))
    return len(w), len(hit), ",".join(sorted(found))


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination(spark, rows, block):
    rng = random.Random(2)
    items = [(i, words(rng, n)) for i, n in enumerate((20, 13, 5, 1, 40))] + [(9, None), (10, ""), (None, "w1 w2"), (11, "a b c")]
    docs = [(i, t) for i, t in rows if i not in (None, 3)] + [(50, "x " + items[0][1] + " y"), (51, items[1][1].upper() + "." + items[2][1]), (52, " ".join(items[4][1].split()[5:30]))]
    got = decontam.contamination(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    expected = {}
    for i, t in docs:
        n, hit, names = brute_contamination(t, items)
        expected[i] = (n, hit, hashlib.sha256(names.encode()).hexdigest(), hit > 0 and 20 * hit >= n)
    assert {r.doc_id: (r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in got.collect()} == expected
    empty = decontam.contamination(table(spark, docs), spark.createDataFrame([], "item_id long, text string"))
    assert empty.where("n_hit > 0 OR contaminated").count() == 0


def test_repeated_and_null_keys_at_any_benchmark_size(spark):
    rng = random.Random(51)
    items = [(i, words(rng, 20, 10**6)) for i in range(3)]
    rows = [(1, items[0][1]), (1, items[0][1]), (1, f"x {items[1][1]}"), (None, items[2][1]), (None, "y"), (None, None), (2, None), (2, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(decontam.contamination(table(spark, rows), benchmark, block_bytes=b).collect(), key=str) for b in (1 << 20, 60))
    assert one == many and len(many) == len(rows)


def test_quality(spark, rows):
    extra = [(60, "Home | Menu | Login\n" + "This is a fine sentence with many words in it. " * 2), (61, "x # y\nx # y\n" + "one two three four five six seven eight nine ten."), (62, "a b c d e a b c d e f")]
    got = {r["row"].doc_id: r for r in quality.line_quality(table(spark, [x for x in rows if x[0] not in (None, 3)] + extra)).collect()}
    for i, t in [x for x in rows if x[0] not in (None, 3)] + extra:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(grams) < 500 else set()
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines))), i
        assert len(grams) >= 500 or r.n_repeat_words == len(covered), i
        assert r.base_failed == (len(w) < 10 or 100 * r.n_repeat_words > 20 * len(w))
    assert got[60].clean_text.startswith("This is") and not got[32].kept and not got[33].kept
    assert quality.line_quality(table(spark, [])).count() == 0


def test_line_dedup(spark):
    rng = random.Random(8)
    long, other = words(rng, 120), words(rng, 120)
    near = long + " extra"
    rows = [(1, f"{long}\nHello, world\n---"), (2, f"hello   WORLD!\n{near}\n---\n{other}"), (3, f"{other}\n{other}"), (4, None), (5, ""), (None, long), (6, "---")]
    got = {r["row"].doc_id: r for r in linededup.line_dedup(table(spark, rows)).collect()}
    assert got[1].clean_text == rows[0][1] and got[1].n_removed == 0
    assert got[2].clean_text == f"---\n{other}" and got[3].clean_text == "" and got[3].n_removed == 2
    assert got[4].clean_text is None and got[5].clean_text == "" and got[None].clean_text == long and got[6].clean_text == "---"
    assert linededup.line_dedup(table(spark, [])).count() == 0


def test_similar_lines_are_linked_at_any_distance_up_to_the_limit(spark):
    rng = random.Random(21)
    rows = []
    for n in (5, 9, 10, 14, 19, 20, 50, 100):
        for k in range(1, n // 5 + 1):
            base = [f"v{rng.randrange(10**6)}" for _ in range(n)]
            other = list(base)
            for i in rng.sample(range(n), k):
                other[i] = f"z{rng.randrange(10**6)}"
            rows += [(2 * len(rows), " ".join(base)), (2 * len(rows) + 1, " ".join(other))]
    got = {r["row"].doc_id: r.n_removed for r in linededup.line_dedup(table(spark, rows)).collect()}
    assert [i for i, _ in rows[1::2] if got[i] != 1] == [] and all(got[i] == 0 for i, _ in rows[::2])


def test_lines_are_linked_alike_beside_other_lines(spark):
    rng = random.Random(22)
    base = [f"v{k}" for k in range(50)]
    pair = [(1, " ".join(base)), (2, " ".join(f"z{k}" if k % 6 == 3 else w for k, w in enumerate(base)))]
    for more in (0, 300):
        rows = pair + [(10 + i, words(rng, 30, 10**6)) for i in range(more)]
        assert [r["row"].doc_id for r in linededup.line_dedup(table(spark, rows)).where("n_removed > 0").collect()] == [2]


def test_lines_similar_in_letters_are_linked(spark):
    long = [f"considerable{k}" for k in range(24)]
    wrong = [w.replace("s", "x", 1) if k % 4 == 0 else w for k, w in enumerate(long)]
    rows = [(1, "subscribe to our newsletter"), (2, "Subscribe to our newsletters"), (3, " ".join(long)), (4, " ".join(wrong)), (5, "subscribe to our channel")]
    got = {r["row"].doc_id: r.n_removed for r in linededup.line_dedup(table(spark, rows)).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


def test_simhash_counts_bits(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, n)) for i, n in enumerate((1, 2, 3, 127, 128, 300, 33000))]
    lines = spark.createDataFrame(rows, "key long, line string").select("key", F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("hs"))
    got = {r.key: r.sim for r in lines.select("key", linededup.simhash(F.col("hs")).alias("sim")).collect()}
    hashes = {r.w: r.h for r in spark.createDataFrame([(f"w{i}",) for i in range(300)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for i, t in rows:
        bits = np.array([[hashes[w] >> b & 1 for b in range(64)] for w in t.split()])
        assert got[i] & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * bits[:, b].sum() > len(bits)), i


def test_lines_of_any_two_lengths_meet(spark):
    """One to three words more, or other, at every length: similar lines share a block, also across the borders of classes."""
    rng, rows = random.Random(48), []
    for n in range(2, 41):
        for more in range(4):
            for other in range(4):
                if more + other and 5 * (more + other) <= min(n + more, 19):
                    for _ in range(6):
                        line = words(rng, n, 10**6).split()
                        like = changed(rng, " ".join(line), other).split()
                        for _ in range(more):
                            like.insert(rng.randrange(len(like) + 1), f"y{rng.randrange(10**6)}")
                        rows.append((n, more, other, line, like))
    frequent = [0] * (linededup.SLOTS // 64)
    pairs = spark.createDataFrame(rows, "n int, more int, other int, x array<string>, y array<string>")
    keys = lambda c: linededup.meeting_keys(F.col(c), frequent)
    apart = pairs.where(F.size("y") < 20).where(~F.arrays_overlap(keys("x"), keys("y"))).select("n", "more", "other").collect()
    assert len(rows) > 1000 and not apart


def test_one_word_more_is_a_similar_line(spark):
    rng, rows = random.Random(49), []
    for n in range(4, 41):
        line = words(rng, n, 10**6)
        rows += [(2 * n, line), (2 * n + 1, f"{line} more")]
    got = {r["row"].doc_id: r.n_removed for r in linededup.line_dedup(table(spark, rows)).collect()}
    assert got == {i: i % 2 for i, _ in rows}


def test_paragraph_dedup(spark):
    rng = random.Random(9)
    p, q = words(rng, 60), words(rng, 60)
    rows = [(1, f"{p}\nshort line"), (2, f"{changed(rng, p, 1)}\nshort line\n{q}"), (3, f"{q}\n{q}"), (4, None), (5, ""), (None, p), (6, changed(rng, p, 30)), (3, f"{q}\n{q}")]
    got = {r["row"].doc_id: r for r in paragraphs.paragraph_dedup(table(spark, rows)).collect()}
    assert got[1].n_removed == 0 and got[1].n_repeated >= 60 and got[2].clean_text == f"short line\n{q}" and got[3].clean_text == "" and got[6].n_removed == 0
    assert got[4].clean_text is None and got[None].clean_text == p and got[2].n_removed == 60
    assert paragraphs.paragraph_dedup(table(spark, [])).count() == 0


def test_wrapped_paragraphs_and_passages(spark):
    rng = random.Random(41)
    long, other, shared = words(rng, 60, 10**6), words(rng, 60, 10**6), words(rng, 70, 10**6)
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, 60, n))
    rows = [(1, f"short\n\n{wrap(long, 11)}\n\nend"), (2, f"{wrap(changed(rng, long, 1), 8)}\n\n{other}"), (3, f"x\n\nshort\n\n{long}"), (4, f"{other}\n{other}\n\ny")]
    rows += [(10 + i, f"{words(rng, 90, 10**6)} {shared} {words(rng, 80, 10**6)}") for i in range(6)] + [(20, words(rng, 5000, 10**6))]
    got = {r["row"].doc_id: r for r in paragraphs.paragraph_dedup(table(spark, rows)).collect()}
    assert {i: got[i].clean_text for i in range(1, 5)} == {1: rows[0][1], 2: f"\n{other}", 3: "x\n\nshort\n\n", 4: "\ny"}
    assert got[10].n_removed == 0 and got[10].n_repeated > 25 and got[20].n_repeated == 0
    for i in range(11, 16):
        left = got[i].clean_text.split()
        assert 25 <= got[i].n_removed <= 70 and left[:90] == rows[i - 6][1].split()[:90] and left[-80:] == rows[i - 6][1].split()[-80:]


def test_passages_of_over_fifty_words_are_found():
    rng = random.Random(42)
    import pyarrow as pa

    missed = 0
    for _ in range(300):
        shared = words(rng, 55, 10**6)
        digests = []
        for _ in range(2):
            data, at = T.buffers(pa.array([f"{words(rng, 40, 10**6)} {shared} {words(rng, 40, 10**6)}"]))
            digests.append({int(x) for *_, h in paragraphs.passages(data, at) for x in h})
        missed += not digests[0] & digests[1]
    assert missed <= 15


def test_paragraph_links_against_brute_force(spark):
    rng = random.Random(43)
    base = [words(rng, rng.randint(20, 120), 10**6) for _ in range(12)]
    rows = [(i, changed(rng, base[i % 12], rng.randint(0, 2))) for i in range(90)]
    sets = [shingle_set(t) for _, t in rows]
    label = components([(i, j) for i in range(90) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])], range(90))
    got = {r["row"].doc_id: r for r in paragraphs.paragraph_dedup(table(spark, rows)).collect()}
    assert {i for i in label if label[i] != i} == {i for i in got if got[i].clean_text == ""}


def test_first_occurrences_stay_within_near_copies(spark):
    rng = random.Random(45)
    lines, extra = [words(rng, 30, 10**6) for _ in range(12)], words(rng, 30, 10**6)
    rows = [(0, "\n".join(lines)), (1, "\n".join([*lines[:11], extra])), (2, f"{extra}\n\n{words(rng, 30, 10**6)}")]
    got = {r["row"].doc_id: r for r in paragraphs.paragraph_dedup(table(spark, rows)).collect()}
    assert got[0].clean_text == rows[0][1] and got[1].clean_text.strip() == extra and got[2].n_removed == 30


def test_no_component_loses_its_last_text(spark):
    rng = random.Random(46)
    pool, rows = [words(rng, rng.randint(20, 60), 10**6) for _ in range(30)], []
    for i in range(120):
        lines = [changed(rng, t, rng.choice([0, 0, 0, 1])) for t in rng.choices(pool, k=rng.randint(1, 9))]
        if i % 3 and rows:
            lines = [t for t in rows[rng.randrange(len(rows))][1].split("\n") if rng.random() < 0.9] + lines[:2]
        rows.append((i, rng.choice(["\n", "\n\n"]).join(lines)))
    base = spark.createDataFrame(rows, "key long, t string").withColumn("th", F.xxhash64("t"))
    spans = paragraphs.repeated_spans(base.select("key", "th", "t"), 5, 80, 20, 0.999, Scratch(spark)).collect()
    clean = {r["row"].doc_id: r.clean_text for r in paragraphs.paragraph_dedup(table(spark, rows)).collect()}
    stays, gone, left = {}, {}, {i: set(zip(t.split(), t.split()[1:])) for i, t in clean.items()}
    pairs = {p for x in left.values() for p in x}
    for r in spans:
        raw = dict(rows)[r.key]
        areas = paragraphs.removed([x for x in r.spans if not x.passage])
        for x in r.spans:
            own = raw[x.s : x.e].split()
            (stays if x.stays else gone if x.gone else {}).setdefault(x.passage, []).append(own)
            if x.stays and not x.passage:  # the first of its component is there in full
                assert set(zip(own, own[1:])) <= left[r.key], (r.key, x)
            if x.gone and x.passage and not any(s <= x.s and x.e <= e for s, e in areas):  # so is every passage outside removed paragraphs, somewhere
                lost = set(zip(own, own[1:])) - pairs
                assert not lost or any(s < x.e and e > x.s for s, e in areas), (r.key, x)
    assert len(stays[False]) > 20 and len(gone[False]) > 100 and len(gone[True]) > 100
    firsts = [shingle_set(" ".join(t)) for t in stays[False]]
    for own in map(shingle_set, map(" ".join, gone[False])):  # every removed paragraph has a first one that is like it, or like one that is like it
        assert any(10 * len(own & y) >= 6 * len(own | y) for y in firsts)


def test_ranges_outside_others():
    rng = random.Random(47)
    for _ in range(300):
        some = lambda: paragraphs.united([(s, s + rng.randint(1, 9)) for s in rng.choices(range(60), k=rng.randint(0, 8))])  # noqa: E731,B023
        spans, kept = some(), some()
        inside = lambda ranges: {i for s, e in ranges for i in range(s, e)}
        out = paragraphs.outside(spans, kept)
        assert inside(out) == inside(spans) - inside(kept) and all(s < e for s, e in out)


def test_bitmaps_never_exclude_similar_sets(spark):
    rng = np.random.default_rng(44)
    pool = rng.integers(0, 2**63, 12_000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[: 2 * n], n)) for n in (4, 40, 400, 4000) for _ in range(6)]
    sets += [np.unique(np.append(x[len(x) // 12 :], pool[:1])) for x in sets]
    value, cut = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    bits = paragraphs.bitmaps(value, cut)
    rows = [(k, len(x), len(x) - int(np.bitwise_count(bits[:, k].view(np.uint64)).sum()), *bits[:, k].tolist()) for k, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "k int, n long, more long, " + ", ".join(f"b{i} long" for i in range(paragraphs.LONGS)))
    met = {(r.a, r.b) for r in table.alias("x").join(table.alias("y"), F.expr(f"x.k < y.k AND {paragraphs.possible(80)}")).selectExpr("x.k AS a", "y.k AS b").collect()}
    similar = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))}
    assert len(similar) >= 20 and similar <= met and len(met) < 200


def test_licenses(spark):
    texts = {
        1: "Licensed under the MIT License.",
        2: "Permission is hereby granted, free of charge, to any person. Licensed under CC BY 4.0; see also. This work is licensed under the GNU General Public License version 3.",
        3: "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        4: None, 5: "", 6: "the mitten license", 7: "MIT License\nReleased under the MIT license",
    }
    got = {r.doc_id: r for r in licenses.license_scan(table(spark, texts.items())).collect()}
    assert {i: got[i].licenses for i in texts} == {1: "MIT", 2: "CC-BY-4.0,GPL-3.0-only", 3: "Apache-2.0", 4: "", 5: "", 6: "", 7: "MIT"}
    assert got[4].license is None and got[7].sequence == "<mit-title><mit-ref>"


def test_every_licence_sentence_and_rule_is_reachable(spark):
    wrap = lambda t: "\n".join(" * " + x for x in textwrap.wrap(t, 40))
    sentences = list(licenses.SENTENCES)
    by = {}
    for x, i in licenses.SENTENCES.items():
        by[i] = x if i not in by else by[i]
    rules = [(name, ".\n".join(wrap(by[i]) for i in ids)) for name, ids in licenses.RULES]
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
    rows = [*enumerate(map(wrap, sentences)), *((100 + k, t) for k, (_, t) in enumerate(rules))]
    rows += [(200, gpl), (201, "# SPDX-License-Identifier: MIT\nimport os"), (202, "SPDX-License-Identifier: Apache-2.0"), (203, "the\n\nmit licenses")]
    got = {r.doc_id: r for r in licenses.license_scan(table(spark, rows)).collect()}
    assert [x for k, x in enumerate(sentences) if got[k].sequence != f"<{licenses.SENTENCES[x]}>"] == []
    assert [name for k, (name, _) in enumerate(rules) if got[100 + k].license != name] == []
    assert got[200].sequence == "<gpl3-head><gpl-hope><gpl-see>" and got[200].licenses == "GPL-3.0-or-later"
    assert (got[201].licenses, got[202].licenses, got[203].licenses) == ("MIT", "Apache-2.0", "")


def brute_repeats(rows, n=200):
    raws = [(t or "").encode() for _, t in rows]
    seen = {}
    for r in raws:
        for a in range(len(r) - n + 1):
            seen[r[a : a + n]] = seen.get(r[a : a + n], 0) + 1
    out = []
    for (k, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for a in range(len(r) - n + 1):
            if seen[r[a : a + n]] > 1:
                gone[a : a + n] = b"\1" * n
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(r, gone) if not x)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_substrings(spark, monkeypatch, hot):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(0, 900))) for _ in range(10)]
    rows = []
    for i in range(40):
        parts = [(x, rng.randint(0, max(0, len(x) - 1))) for x in rng.choices(base, k=3)]
        rows.append((i, "".join(x[p : p + rng.randint(0, 500)] for x, p in parts)))
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, None), (None, "q" * 250), (41, ""), (42, "x" * 700), (43, "y" * 199), (44, rows[3][1] * 3)]
    monkeypatch.setattr(substrings.repeated_spans, "__defaults__", (substrings.LENGTH, substrings.WINDOW, hot))
    got = substrings.substring_dedup(table(spark, rows))
    assert sorted((tuple(r) for r in got.drop("spans", "kept").collect()), key=str) == brute_repeats(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(substrings, "_CHUNK", 1000)
    text = "".join(rng.choice("abcdef") for _ in range(5000))
    data, at = np.frombuffer((text + text[1500:2600]).encode(), np.uint8), np.array([0, 6100])
    rows = set()
    for _, raw, own, offset, limit in substrings._pieces(data, at, 200):
        _, first, last, *_ = substrings.anchors(raw, own, limit)
        rows |= {a + offset for x, y in zip(first.tolist(), last.tolist()) for a in range(x, y + 1)}
    assert rows == set(range(6100 - 199))


def test_merged_transforms_find_equal_prefixes():
    rng = random.Random(6)
    for _ in range(20):
        texts = [(bytes(rng.choices(b"ab", k=rng.randint(0, 9))), rng.randrange(2), bytes(rng.choices(b"ab", k=rng.randint(6, 12)))) for _ in range(12)]
        strings = [[*x, ("core", c), *y] for x, c, y in texts]
        depth = 6
        every = {}
        for s in strings:
            for a in range(len(s) - depth + 1):
                every[tuple(s[a : a + depth])] = every.get(tuple(s[a : a + depth]), 0) + 1
        for found, s in zip(substrings.repeated_starts(texts, depth, shard=40), strings):
            starts = {a for x, y in found for a in range(x, y + 1)}
            assert starts == {a for a in range(len(s) - depth + 1) if every[tuple(s[a : a + depth])] > 1}


def test_optimal_buckets():
    rng = random.Random(3)
    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 7)))
        count = [rng.randint(1, 5) for _ in lengths]
        total = [n * c for n, c in zip(lengths, count)]
        ends = packing.optimal_boundaries(np.array(lengths), np.array(count), np.array(total), 3)
        waste = lambda e: sum(c * (min(x for x in e if x >= n) - n) for n, c in zip(lengths, count))
        from itertools import combinations

        best = min(waste((*some, lengths[-1])) for k in range(min(3, len(lengths))) for some in combinations(lengths[:-1], k))
        assert len(ends) <= 3 and waste(ends) == best


def padding(lengths, ends):
    return sum(min(e for e in ends if e >= n) - n for n in lengths)


def test_one_long_text_does_not_coarsen_the_buckets(spark):
    rng = random.Random(31)
    lengths = [rng.randint(1, 60) for _ in range(80)] + [5000, 5003, 200_000]
    got = packing.pack_buckets(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, text long"), buckets=6, length=F.col("text")).collect()
    distinct = sorted(set(lengths))
    best = {0: 0}  # least padding of the lengths up to each one, in at most so many buckets
    for _ in range(6):
        best = {e: min(best[a] + sum(e - n for n in lengths if a < n <= e) for a in best if a < e or a == e == 0) for e in [0, *distinct] if any(a < e for a in best) or e == 0}
    assert padding(lengths, {r.bucket_length for r in got}) == best[200_000]


def test_many_distinct_lengths():
    rng = np.random.default_rng(32)
    length = np.sort(rng.choice(np.arange(1, 20_000_000), 500, replace=False))
    count = rng.integers(1, 1000, 500)
    c, s = (np.concatenate([[0], np.cumsum(x)]) for x in (count, length * count))
    cost = [0, *(c[1:] * length - s[1:])]
    for _ in range(15):
        cost = [0, *(min(cost[i] + (c[j] - c[i]) * int(length[j - 1]) - (s[j] - s[i]) for i in range(j)) for j in range(1, 501))]
    ends = packing.optimal_boundaries(length, count, length * count, 16)
    end = np.array(ends)[np.searchsorted(ends, length)]
    assert len(ends) <= 16 and int(((end - length) * count).sum()) == cost[-1]


def test_batches_are_full(spark, rows, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 5)
    got = packing.pack_buckets(table(spark, rows), buckets=3, budget=200).collect()
    assert len(got) == len(rows) and len({(r.batch, r.slot) for r in got}) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.bucket, r.batch), []).append(r)
        assert r.length <= r.bucket_length
    sizes = {}
    for (bucket, batch), members in sorted(by.items()):
        sizes.setdefault(bucket, []).append(len(members))
        assert sorted(r.slot for r in members) == list(range(len(members)))
    ends = {r.bucket: r.bucket_length for r in got}
    for bucket, found in sizes.items():
        capacity = max(1, 200 // max(1, ends[bucket]))
        assert sorted(found, reverse=True)[:-1] == [capacity] * (len(found) - 1) and max(found) <= capacity
    assert packing.pack_buckets(table(spark, [])).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        length = rng.choice([1, 2, 7, 16, 100])
        sizes = [rng.randint(1, length) for _ in range(rng.randint(0, 40))]
        rows, bins = tokenpack.best_fit_decreasing(sizes, length), []
        for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            fit = [b for b in bins if b[0] >= sizes[i]]
            if fit:
                min(fit, key=lambda b: b[0])[0] -= sizes[i]
            else:
                bins.append([length - sizes[i]])
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in r) for r in rows) == sorted(b[0] for b in bins)


def test_packed_tokens_round_trip(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    docs = [(i, t) for i, t in rows if i not in (None, 3)]
    tokenpack.write_packed(tokenpack.pack_tokens(table(spark, docs), length=64, block_tokens=3000), str(tmp_path / "p"))
    packed = spark.read.parquet(str(tmp_path / "p")).withColumn("pos", tokenpack.position_ids(F.col("cu_seqlens"))).collect()
    parts = {}
    for r in packed:
        ids = np.frombuffer(r.ids, np.uint16)
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64 and r.position_resets == r.cu_seqlens[:-1] and (ids[r.n_tokens :] == 50256).all()
        for d, p, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            parts[d, p] = ids[a:b].tolist()
            assert r.pos[a:b] == list(range(b - a))
    tokenizer = Tokenizer.from_file(tokenpack.TOKENIZER.replace(".tiktoken", ".json"))
    for i, t in docs:
        ids = [x for k in sorted(k for k in parts if k[0] == i) for x in parts[k]]
        assert tokenizer.decode(ids, skip_special_tokens=False) == (t or "")
    assert tokenpack.pack_tokens(table(spark, [])).count() == 0


def encoder(name):
    path = f"{tokenpack.TOKENIZER.rsplit('/', 1)[0]}/{name}"
    with open(path, "rb") as f:
        return tokenpack.Encoder(path, f.read())


def test_tokenizers():
    one, two = encoder("byte_bpe_50k.tiktoken"), encoder("byte_bpe_50k.json")
    rng = random.Random(13)
    for _ in range(60):
        text = "".join(rng.choice(["it's", " we'll", "  ", "\n\n", "\t", " é漢", "²½", " 42", "<|endoftext|>", "_x-", "...", " word", "\u00a0", "\u2003 "]) for _ in range(40))
        assert one.encode(text).tolist() == two.encode(text).tolist()
    assert len(one.encode("")) == 0 and len(encoder("piece_bpe_32k.model").encode("a word")) > 0
    text = "a b  c " * 3000 + "dd ee" * 100 + "x" * 3000
    assert "".join(tokenpack.slices(text, 500)) == text
    assert [i for s in tokenpack.slices(text, 500) for i in one.ids(s)] == one.ids(text)


def insulting(rng, style):
    text = [words(rng, 8) + "." for _ in range(4)]
    for k in (0, 2):
        bad = rng.choice(["wretch", "dimwit"])
        bad = {"plain": bad, "dots": ".".join(bad), "gap": bad[:3] + "*" + bad[3:]}[style]
        text[k] = f"You {bad} {words(rng, 6)}."
    return " ".join(text)


def test_toxicity(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, insulting(rng, "plain") if toxic else " ".join(words(rng, 9) + "." for _ in range(4))))
        labels.append((i, int(toxic)))
    rows += [(1000 + i, insulting(rng, ("dots", "gap")[i % 2])) for i in range(20)] + [(2000, None), (2001, ""), (None, "x")]
    labels += [(None, 1), (5, None)]
    got = toxicity.toxicity(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels[:400])
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [i for i in truth if by[i].held_out]
    assert sum(by[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert sum(by[1000 + i].predicted for i in range(20)) >= 17
    assert not by[2000].predicted and not by[2001].predicted
    alone = toxicity.toxicity(table(spark, rows[:3]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in alone.collect()} == {0}


def test_collapsed_weights_are_the_kernel_expansion():
    rng = random.Random(12)
    held = toxicity.Landmarks.of(["idiot", "réeux", "ab"])
    beta = np.array([0.5, -1.0, 2.0])
    raw = np.frombuffer(" ".join(rng.choice(["idiot", "réeuxon", "other", "i.d.i.o.t"]) for _ in range(30)).encode(), np.uint8)
    sym, _, _ = toxicity.laid_out(raw, np.array([0, len(raw)]))
    value = toxicity.decisions(sym, held.table(beta))
    size = toxicity.WINDOW + toxicity.SPAN
    windows = np.stack([np.pad(sym[p : p + size], (0, size - len(sym[p : p + size]))) for p in range(len(value))]).astype(np.uint8)
    assert np.allclose(held.kernel(windows) @ beta, value, atol=1e-3)


def test_words_of_chunks():
    column_texts = ["Ab c", None, "", "  ", "é9 x"]
    import pyarrow as pa

    data, at = T.buffers(pa.array(column_texts))
    w = T.words(data, at, T.NOT_SPACE)
    assert np.diff(w.at).tolist() == [2, 0, 0, 0, 2] and w.data[w.start[0] : w.end[0]].tobytes() == b"ab"


def test_frequent_words_count_all_documents(spark, monkeypatch):
    texts = [(d, f"every unit w{d % 7} x{d}") for d in range(40)] + [(40, None), (41, "")]
    words = spark.createDataFrame(texts, "doc_id long, t string").select(linededup.tokens(F.col("t")).alias("w"))
    for share in (10, 50, 1000):
        monkeypatch.setattr(linededup, "FREQUENT", share)
        bits = np.unpackbits(np.array(linededup.frequent_words(words, Scratch(spark)), np.int64).view(np.uint8), bitorder="little")
        count = Counter(w for _, t in texts for w in (t or "").split())
        often = [w for w, c in count.items() if c * share >= sum(count.values())]
        assert len(often) <= share
        hashes = [r.h for r in spark.createDataFrame([(w,) for w in often], "w string").select(F.xxhash64("w").alias("h")).collect()]
        assert set(np.flatnonzero(bits)) == {h & (linededup.SLOTS - 1) for h in hashes}
    assert not any(linededup.frequent_words(words.limit(0), Scratch(spark)))


def test_frequent_words_are_one_constant_of_the_plan(spark, monkeypatch):
    """The plan of the meeting keys holds the numbers once, not once for each choice of words."""
    frequent, plans, save = [1 << 40] * (linededup.SLOTS // 64), [], Scratch.save
    monkeypatch.setattr(linededup, "frequent_words", lambda words, scratch: frequent)
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, codec=None: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or save(self, df, name, codec))
    linededup.line_dedup(spark.createDataFrame([(1, "one two three four five"), (2, "one two three four six")], "doc_id long, text string"))
    size = len(dict(plans)["lines"])
    assert size < 1.5 * len(str(1 << 40)) * len(frequent)


def test_odd_members_of_large_buckets_meet_a_few_of_the_others_first(spark):
    members, asked = 400, []
    keyed = spark.range(members).selectExpr("1L AS bk", "id AS h").union(spark.createDataFrame([(2, 1000), (2, 1001), (3, 1000), (3, 1002)], "bk long, h long"))

    def prepare(items):
        def verify(pairs):
            asked.append(pairs.count())
            return pairs.where("(least(a, b) > 0 OR greatest(a, b) % 10 < 9) AND greatest(a, b) <> 1002")  # the smallest is not like every tenth

        return verify, items

    label = {r.node: r.component for r in buckets.linked(keyed, prepare, Scratch(spark)).collect()}
    assert label == {**dict.fromkeys(range(members), 0), 1000: 1000, 1001: 1000}
    assert sum(asked) < 5 * members


def _written(spark, before):
    root = spark.conf.get("spark.checkpoint.dir")
    return {re.sub(r"-[0-9a-f]{8}$", "", t) for d in set(os.listdir(root)) - before for t in os.listdir(f"{root}/{d}")}


@pytest.mark.parametrize(
    "name, gone", [("line_dedup", {"words", "lines", "members", "side", "groups", "counts"}), ("paragraph_dedup", {"paragraphs", "members", "homes", "near", "inside"})]
)
def test_large_scratch_tables_go_when_their_work_is_done(spark, name, gone):
    line = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{line} {i}\nline of its own {i * 7919}") for i in range(6)]
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    run = linededup.line_dedup if name == "line_dedup" else paragraphs.paragraph_dedup
    result = run(table(spark, rows))
    assert not _written(spark, before) & gone
    assert result.where("n_removed > 0").count() == 5


def test_pairs_of_small_buckets_are_verified_in_one_round(spark):
    """Members of small buckets meet all others at once: one call of verify, where stars took three rounds and cells a fourth."""
    asked = []
    keyed = spark.range(40).selectExpr("id DIV 4 AS bk", "id AS h")

    def prepare(items):
        def verify(pairs):
            asked.append(pairs.count())
            return pairs.where("a % 4 <> 0")  # the smallest of each bucket is like no other

        return verify, items

    label = {r.node: r.component for r in buckets.linked(keyed, prepare, Scratch(spark)).collect()}
    assert label == {h: h - h % 4 + 1 for h in range(40) if h % 4} and asked == [60]


def test_members_apart_in_buckets_beyond_the_small_ones_meet_without_rounds(spark):
    """A star, and then the pairs that are left, if they are few: two calls of verify."""
    asked = []
    keyed = spark.range(30).selectExpr("1L AS bk", "id AS h")

    def prepare(items):
        def verify(pairs):
            asked.append(pairs.count())
            return pairs.where("a <> 29 AND b <> 29 AND (a % 2 = b % 2)")

        return verify, items.withColumn("even", F.col("h") % 2)

    label = {r.node: r.component for r in buckets.linked(keyed, prepare, Scratch(spark), "x.even = y.even OR x.h = 29 AND y.h < 2").collect()}
    assert label == {h: h % 2 for h in range(29)}


def test_lines_are_compared_by_letters_in_even_shares(spark, monkeypatch):
    """One line that meets many others by letters: the pairs are dealt over tasks whatever line they have in common."""
    monkeypatch.setattr(linededup, "DEALT", 10)
    parts, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, codec=None: parts.setdefault(name, []).append(len(save(self, df, name, codec).inputFiles())) or save(self, df, name, codec))
    side = [(h, 5, 30, 0, f"aaaaaa bbbbbb cccccc d{h:05d} e{h:05d}") for h in range(60)]
    side = spark.createDataFrame(side, "h long, n int, size int, sim long, line string")
    pairs = Scratch(spark).save(spark.range(1, 60).selectExpr("0L AS a", "id AS b"), "pairs")
    found = linededup._alike(pairs, side, Scratch(spark), 0.8).collect()
    assert len(found) == 59 and parts["letters"][-1] >= 5


def test_sets_are_shuffled_without_bitmaps_and_spans_come_in_small_batches(spark, monkeypatch):
    """Bitmaps are made for members that are still apart only; spans become Python objects a few rows at a time."""
    saved, save = {}, Scratch.save
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, codec=None: saved.setdefault(name, (df.columns, int(spark.conf.get(limit)))) and save(self, df, name, codec))
    monkeypatch.setattr(paragraphs, "ROWS", 2)
    line = " ".join(f"word{i}" for i in range(60))
    result = paragraphs.paragraph_dedup(table(spark, [(i, f"{line} {i}\nline of its own {i * 7919}") for i in range(6)]))
    assert result.where("n_removed > 0").count() == 5
    assert saved["sets"][0] == ["h", "value"] and saved["inside"][1] <= 1000


def test_jaccard_tokens_are_shuffled_once(spark, monkeypatch):
    plans, save = {}, Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, codec=None: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and save(self, df, name, codec))
    rows = [(i, " ".join(f"w{k}" for k in range(30)) + f" x{i}") for i in range(4)] + [(9, None)]
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(table(spark, rows)).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
    assert plans["shared"].count("Exchange hashpartitioning") == 1


def test_lines_joined_by_words_are_not_compared_by_letters(spark, monkeypatch):
    """A chain of lines, three words further each: only neighbours are similar in words, and no ends of it are compared by letters."""
    monkeypatch.setattr(linededup, "FEW", 0)
    compared, save = [], Scratch.save

    def saved(self, df, name, codec=None):
        out = save(self, df, name, codec)
        compared.extend([out.count()] if name == "letters" else [])
        return out

    monkeypatch.setattr(Scratch, "save", saved)
    common = [f"considerablylongword{k}" for k in range(11)]
    chain = [" ".join([*(f"{'new' if k < 3 * i else 'old'}{k * 7919}" for k in range(9)), *common]) for i in range(4)]
    long = [f"otherword{k}" for k in range(24)]
    wrong = [w.replace("w", "x", 1) if k % 4 == 0 else w for k, w in enumerate(long)]
    got = {r["row"].doc_id: r.n_removed for r in linededup.line_dedup(table(spark, list(enumerate([*chain, " ".join(long), " ".join(wrong)])))).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1}
    assert sum(compared) == 1


def test_last_pairs_are_new_and_links_joined_on_the_way_count(spark):
    """What was compared in small buckets, with the smallest of a large one or in a round of stars is not compared in the end; apart() leaves out what is joined."""
    asked = []
    keyed = spark.sql("SELECT 1L AS bk, id AS h FROM range(30) UNION ALL SELECT 2L, id FROM range(20, 30)")

    def prepare(items):
        def verify(pairs, apart):
            asked.append({(r.a, r.b) for r in pairs.collect()})
            left = Scratch(spark).save(apart(pairs.where("a % 5 = b % 5"), pairs.where("a % 5 + 1 = b % 5")), "left")
            assert left.where("ca = cb").isEmpty()
            return left.where("a % 5 = 0").select("a", "b")

        return verify, items

    label = {r.node: r.component for r in buckets.linked(keyed, prepare, Scratch(spark), steps=True).collect()}
    assert {label[h] for h in range(30) if h % 5 < 2} == {0} and {label[h] for h in range(30) if h % 5 > 1} == {2, 3, 4}
    assert len(asked) > 1 and not asked[-1] & set().union(*asked[:-1])
