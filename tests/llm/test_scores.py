"""Hard negatives and language-model scores against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import hardneg, ppm

VECTORS = "vec_id long, embedding array<float>, label int, id long, place string, rank int, anchor string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, "a") for r in rows], VECTORS)


def mined(rows, positives=5, negatives=3, scale=256):
    """The contract word for word, over rows (id, vector, label)."""
    own = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (a, x, label) in enumerate(own):
        if a % 50:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y)), i, n) for n, (i, y, _) in enumerate(own) if n != k))
        same = [(s, i) for s, i, n in scored if own[n][2] == label][:positives]
        for s, p in same:
            other = [(t, i) for t, i, n in scored if own[n][2] != label and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(other, 1)]
    return sorted(out)


def result(frame):
    return sorted(map(tuple, frame.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_hard_negatives(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0.05, 0.2) for _ in range(8)], rng.choice([0, 0, 0, 1, 2, -4])) for i in range(330)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    rows += [(400 + i, rows[100][1], 1) for i in range(30)]  # a group of copies, with ties
    rows += [rows[50], (50, rows[3][1], 2), (None, rows[4][1], 0), (500, None, 0), (550, [0.5, None], 0), (600, [float("nan")] * 8, 1), (650, [float("inf")] * 8, 1), (700, rows[9][1], None)]
    rows += [(750, [], 0), (800, [0.25] * 3, 0), (850, [0.0] * 8, 7)]
    want = mined(rows)
    assert len(want) > 40
    assert result(hardneg.hard_negatives(vectors(spark, rows), F.col("vec_id") % 50 == 0)) == want
    monkeypatch.setattr(hardneg, "ANCHORS", 2)
    monkeypatch.setattr(hardneg, "ROWS", 40)
    monkeypatch.setattr(hardneg, "_STRIP", 1)
    assert result(hardneg.hard_negatives(vectors(spark, rows), F.col("vec_id") % 50 == 0)) == want
    assert result(hardneg.hard_negatives(vectors(spark, []), F.col("vec_id") % 50 == 0)) == []


def test_scores_of_large_components(spark):
    for scale in (1.0, 2.0**30, 2.0**40):
        x, y = np.array([[3.0, -2.0], [0.0, 5.0]]) * scale, np.array([[1.0, 7.0]]) * scale
        assert hardneg.scores(x, y).tolist() == [[max(-(2**63), min(2**63 - 1, int(a) * int(c) + int(b) * int(d))) for c, d in y.tolist()] for a, b in x.tolist()]


def normal(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return words, b" ".join(words) + b"\n"


class Trie:
    """Prediction by partial matching with explicit sets of symbols."""

    def __init__(self, texts, order):
        self.order, self.seen = order, {}
        for t in texts:
            t = b"\n" * order + t
            for i in range(order, len(t)):
                for k in range(order + 1):
                    self.seen.setdefault(t[i - k : i], Counter())[t[i]] += 1

    def log10(self, text):
        text, out = b"\n" * self.order + text, 0.0
        for i in range(self.order, len(text)):
            excluded = set()
            for k in range(self.order, -1, -1):
                left = {s: c for s, c in self.seen.get(text[i - k : i], {}).items() if s not in excluded}
                total = sum(left.values())
                if text[i] in left:
                    out += math.log10((left[text[i]] - 0.5) / total)
                    break
                if left:
                    out += math.log10(len(left) / 2 / total)
                    excluded |= set(left)
            else:
                out += math.log10(1 / (256 - len(excluded)))
        return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "A\x01b\x0bC  d\n"), (64, " lead"), (64, " lead"), (None, "abc abc"), (65, "z\x00z q\x7f"), (66, " ".join(vocabulary * 30)), (67, "newword " * 5)]
    return rows


def learned(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


@pytest.mark.parametrize("order,chunk", [(1, 1 << 20), (3, 300), (5, 1 << 20), (6, 500)])
def test_scores(spark, texts, order, chunk):
    docs = spark.createDataFrame([(i, t, "c", "r", 3) for i, t in texts], "doc_id long, text string, chunk string, run string, n int")
    got = ppm.lm_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0, order=order, chunk=chunk).collect()
    train = [normal(t) for i, t in texts if learned(i)]
    trie, counts = Trie([b for _, b in train], order), Counter(w for words, _ in train for w in [*words, b"\n"])
    total, v = sum(counts.values()), len(counts)
    want = []
    for i, t in texts:
        words, coded = normal(t)
        tokens = [*words, b"\n"]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (v + 1))) for w in tokens)
        want.append((str(i), not learned(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, base, trie.log10(coded)))
    have = [(str(r.key), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    assert len(have) == len(want)
    for a, b in zip(sorted(have), sorted(want)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_scores_without_anything_to_learn(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert ppm.lm_scores(docs.limit(0), F.lit(True)).collect() == []
    got = ppm.lm_scores(docs, F.lit(None).cast("boolean")).collect()
    assert {r.train_tokens for r in got} == {0} and {r.n_known for r in got} == {0}
    sizes = Counter(-len(normal(t)[1]) * math.log10(256) for _, t in texts)
    assert sorted(r.score for r in got) == pytest.approx(sorted(sizes.elements()))


def test_adaptive_scores(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.key: r for r in ppm.adaptive_scores(docs, order=3).collect() if r.key is not None}
    for i, t in texts:
        coded = normal(t)[1]
        if i is not None:
            want, trie = 0.0, Trie([], 3)
            padded = b"\n" * 3 + coded
            for j in range(3, len(padded)):
                excluded = set()
                for k in range(3, -1, -1):
                    left = {s: c for s, c in trie.seen.get(padded[j - k : j], {}).items() if s not in excluded}
                    if padded[j] in left:
                        want += math.log10((left[padded[j]] - 0.5) / sum(left.values()))
                        break
                    if left:
                        want += math.log10(len(left) / 2 / sum(left.values()))
                        excluded |= set(left)
                else:
                    want -= math.log10(256 - len(excluded))
                for k in range(4):
                    trie.seen.setdefault(padded[j - k : j], Counter())[padded[j]] += 1
            assert got[i].n_bytes == len(coded) and got[i].score == pytest.approx(want)


def test_probabilities_add_up(spark):
    """The code lengths of all bytes after one context are a distribution."""
    from graphloom.plans.scratch import Scratch

    trie = Trie([normal(t)[1] for t in ("the cat sat", "the hat", "a cat")], 2)
    contexts = [b"he", b"at", b"zz", b"\n\n", b"xt"]
    runs = {int.from_bytes(c + bytes([s]), "little"): 0 for c in contexts for s in range(256)}
    for context, seen in trie.seen.items():
        if len(context) == 2:
            for s, c in seen.items():
                runs[int.from_bytes(context + bytes([s]), "little")] = c
    table = spark.createDataFrame(list(runs.items()), "run long, c long")
    got = {r.run: 10**r.value for r in ppm.code_lengths(table, 2, Scratch(spark)).collect()}
    for c in contexts:
        assert sum(got[int.from_bytes(c + bytes([s]), "little")] for s in range(256)) == pytest.approx(1)
