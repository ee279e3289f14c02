"""Toxicity by a subsequence string-kernel SVM with Nyström landmarks.

The kernel counts common subsequences of LENGTH characters that may have gaps, each occurrence weighted by DECAY to the
power of its span, so an insult with gaps or inserted characters still shares most of them; letters that are spelt out
one by one are joined first. An instance is a window of
WINDOW starting positions in a sentence. Landmarks are words that the training labels mark most; the SVM is linear in
the Nyström map of the kernel values at the landmarks. Sentences inherit the label of their document, and as most
sentences of a toxic document are harmless, training alternates between choosing the highest windows and fitting.

The decision value of a window is sum(beta[l] * K(window, l)); collecting the landmarks' subsequences into one table of
weights gives the same number with one lookup for each subsequence of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import text as T
from graphloom.plans.scratch import Scratch
from graphloom.plans.ship import ship

LENGTH, SPAN, WINDOW, DECAY = 4, 7, 16, 0.7
#: Bound of the training sample, in labelled rows of each class. Scores, counts and candidates cover all rows.
TRAIN_ROWS = 2500
LANDMARKS, CONTRAST, ROUNDS, TOP = 128, 32, 3, 3
THRESHOLD = 0.3
_CHUNK = 1 << 18
_PAD = WINDOW + SPAN

#: Five-bit symbols: 0 for a break, 1 to 26 for letters, 27 to 31 for bytes beyond ASCII.
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[0x61:0x7B] = SYMBOL[0x41:0x5B] = np.arange(1, 27)
SYMBOL[0x80:0xC0] = 27 + (np.arange(0x40) & 3)
SYMBOL[0xC0:] = 31
_PLACES = [(i, j, k) for k in range(LENGTH - 1, SPAN) for i in range(1, k - 1) for j in range(i + 1, k)]


def laid_out(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of documents data[at[i]:at[i+1]] with breaks after each, where each begins, and where sentences begin.

    A mark or blank between two letters that stand alone is left out, so that spelt-out words are words again.
    """
    raw = data[at[0] : at[-1]]
    letter = np.zeros(len(raw) + 2, bool)
    letter[1:-1] = SYMBOL[raw] > 0
    alone = np.zeros(len(raw) + 2, bool)
    alone[1:-1] = letter[1:-1] & ~letter[:-2] & ~letter[2:]
    stays = letter[1:-1] | ~(alone[:-2] & alone[2:])
    raw, at = raw[stays], np.concatenate([[0], np.cumsum(stays)])[at - at[0]]
    size = np.diff(at)
    start = at[:-1] + _PAD * np.arange(len(size))
    place = np.arange(len(raw)) + np.repeat(_PAD * np.arange(len(size)), size)
    sym = np.zeros(len(raw) + _PAD * len(size) + SPAN, np.int32)
    sym[place] = SYMBOL[raw]
    stop = (raw == 0x2E) | (raw == 0x21) | (raw == 0x3F)
    blank = (raw == 0x20) | (raw == 0x0A)
    ends = (raw[:-1] == 0x0A) | (stop[:-1] & blank[1:])
    return sym, start, np.union1d(start[size > 0], place[np.flatnonzero(ends) + 1] if len(raw) > 1 else [])


def codes(sym: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(span, code at each starting position) of every choice of gaps."""
    n = len(sym) - SPAN
    first, third = sym << 15, sym << 5
    second = [first[:n] | (sym[i : i + n] << 10) for i in range(SPAN - 2)]
    for i, j, k in _PLACES:
        yield k + 1, second[i] | third[j : j + n] | sym[k : k + n]


def decisions(sym: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The kernel expansion's value, without the bias, of the window that starts at each position."""
    n = len(sym) - SPAN
    total, found = np.zeros(n, np.float32), np.empty(n, np.float32)
    for span, code in codes(sym):
        np.take(table, code, out=found, mode="clip")
        found *= np.float32(DECAY**span)
        total += found
    summed = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])
    return summed[np.minimum(np.arange(n) + WINDOW, n)] - summed[:n]


def top_windows(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols, the windows' values, and of the TOP highest sentences of each document the document, start and value."""
    sym, start, begins = laid_out(data, at)
    value = decisions(sym, table)
    if not len(begins):
        return sym, value, np.zeros((3, 0)), begins, np.zeros(len(start), np.int64)
    begins = begins.astype(np.int64)
    best = np.maximum.reduceat(value, begins)
    doc = np.searchsorted(start, begins, "right") - 1
    order = np.lexsort((-best, doc))
    rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
    keep = order[rank < TOP]
    return sym, value, np.stack([doc[keep], keep, best[keep]]), begins, np.bincount(doc, minlength=len(start))


def features(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A row for each document: its TOP highest sentence values, 0 where it has fewer, and log(1 + sentences)."""
    _, _, top, _, count = top_windows(data, at, table)
    out = np.zeros((len(at) - 1, TOP + 1))
    doc = top[0].astype(np.int64)
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    out[doc, rank] = top[2]
    out[:, TOP] = np.log1p(count)
    return out


@dataclass
class Landmarks:
    """Landmark strings as vectors over the subsequences that any of them has."""

    code: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Landmarks:
        found: list[dict[int, float]] = []
        for word in words:
            raw = np.frombuffer(f" {word} ".encode(), np.uint8)
            sym = np.concatenate([SYMBOL[raw].astype(np.int32), np.zeros(SPAN, np.int32)])
            own: dict[int, float] = {}
            for span, code in codes(sym):
                for c in code[: max(0, len(raw) - span + 1)].tolist():
                    own[c] = own.get(c, 0.0) + DECAY**span
            norm = sum(v * v for v in own.values()) ** 0.5 or 1.0
            found.append({c: v / norm for c, v in own.items()})
        code = np.array(sorted(set().union(*found)), np.int64)
        rows = np.zeros((len(code), len(words)), np.float32)
        for k, own in enumerate(found):
            rows[np.searchsorted(code, np.array(list(own), np.int64)), k] = list(own.values())
        return cls(code, rows)

    def table(self, beta: np.ndarray) -> np.ndarray:
        """Weights of all subsequences for the expansion sum(beta[l] * K(., l))."""
        out = np.zeros(1 << (5 * LENGTH), np.float32)
        out[self.code] = self.rows @ beta.astype(np.float32)
        return out

    def kernel(self, windows: np.ndarray) -> np.ndarray:
        """K(window, landmark) for rows of WINDOW + SPAN symbols."""
        out = np.zeros((len(windows), self.rows.shape[1]))
        for k in range(0, len(windows), 256):
            part = windows[k : k + 256]
            flat = part.astype(np.int32).ravel()
            flat = np.concatenate([flat, np.zeros(SPAN, np.int32)])
            own = (np.arange(len(part))[:, None] * part.shape[1] + np.arange(WINDOW)).ravel()
            for span, code in codes(flat):
                place = np.minimum(np.searchsorted(self.code, code[own]), len(self.code) - 1)
                hit = np.flatnonzero(self.code[place] == code[own])
                np.add.at(out, k + hit // WINDOW, self.rows[place[hit]] * DECAY**span)
        return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps; y is -1 or 1. Returns weights and bias."""
    z = np.hstack([x, np.ones((len(x), 1))])
    keep = np.full(z.shape[1], ridge)
    keep[-1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        margin = 1 - y * (z @ w)
        act = margin > 0
        za = z[act] * weight[act, None]
        gradient = keep * w - 2 * za.T @ (y[act] * margin[act])
        step = np.linalg.solve(np.diag(keep) + 2 * za.T @ z[act], gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the intercept last; y is 0 or 1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(ridge * np.eye(len(w)) + (z.T * (p * (1 - p))) @ z, ridge * w + z.T @ (p - y))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """Subsequence weights, and the regression from a document's highest sentence values to a probability."""

    table: np.ndarray
    weights: np.ndarray

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = features(data, at, self.table)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _landmark_words(sample: DataFrame, prior: float, landmarks: int, contrast: int) -> list[str]:
    """Words of the sample that go with toxic documents most, and some that go with them least."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}]+"), F.lit(0)))
    seen = sample.select("toxic", F.explode(words).alias("word")).where(F.length("word").between(3, 32))
    counts = seen.groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("pos")).where("n >= 4")
    z = (F.col("pos") - F.col("n") * prior) / F.sqrt(F.col("n") * (prior * (1 - prior)))
    scored = counts.select("word", z.alias("z"))
    high = scored.orderBy(F.desc("z"), "word").limit(landmarks).collect()
    low = scored.orderBy("z", "word").limit(contrast).collect()
    return list(dict.fromkeys(r.word for r in [*high, *low]))


def _instances(sample: DataFrame, table: np.ndarray) -> list:
    """toxic, rank and symbols of the highest window of each of the TOP sentences of every sample row."""
    held = sample.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = T.buffers(batch.column(1))
            toxic = np.asarray(batch.column(0))
            for i, j in T.chunks(at, _CHUNK):
                sym, value, top, begins, _ = top_windows(data, at[i : j + 1], held.value)
                limit = np.append(begins, len(value))
                doc, windows, rank, last = top[0].astype(np.int64), [], [], (-1, 0)
                for d, k in zip(doc.tolist(), top[1].astype(np.int64).tolist()):
                    last = (d, last[1] + 1 if last[0] == d else 0)
                    p = int(limit[k] + np.argmax(value[limit[k] : limit[k + 1]]))
                    own = np.zeros(WINDOW + SPAN, np.uint8)
                    own[: len(sym[p : p + WINDOW + SPAN])] = sym[p : p + WINDOW + SPAN]
                    windows.append(own.tobytes())
                    rank.append(last[1])
                yield pa.RecordBatch.from_arrays([pa.array(toxic[i + doc], pa.int32()), pa.array(rank, pa.int32()), pa.array(windows, pa.binary())], names=["toxic", "rank", "win"])

    return sample.mapInArrow(run, "toxic int, rank int, win binary").collect()


def _document_features(sample: DataFrame, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    held = sample.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = T.buffers(batch.column(1))
            for i, j in T.chunks(at, _CHUNK):
                x = features(data, at[i : j + 1], held.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sample.mapInArrow(run, "toxic int, x array<double>").collect()
    return np.array([r.x for r in rows]), np.array([r.toxic for r in rows])


def train(sample: DataFrame, prior: float, landmarks: int = LANDMARKS, contrast: int = CONTRAST, rounds: int = ROUNDS) -> Model:
    """A model of the bounded sample (toxic, t); prior is the share of toxic rows among all labelled ones."""
    share = sample.agg(F.avg("toxic")).first()[0]
    words = _landmark_words(sample, share, landmarks, contrast)
    empty = Model(np.zeros(1 << (5 * LENGTH), np.float32), np.append(np.zeros(TOP + 1), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    if not words or not 0 < share < 1:
        return empty
    held = Landmarks.of(words)
    gram = (held.rows.T @ held.rows).astype(np.float64)
    value, vector = np.linalg.eigh(gram)
    whiten = vector[:, value > 1e-3] / np.sqrt(value[value > 1e-3])
    beta = np.where(np.arange(len(words)) < landmarks, 1.0, 0.0)
    for _ in range(rounds):
        rows = _instances(sample, held.table(beta))
        rows = [r for r in rows if not r.toxic or r.rank < TOP - 1]
        toxic = np.array([r.toxic for r in rows])
        if not 0 < toxic.sum() < len(toxic):
            return empty
        x = held.kernel(np.stack([np.frombuffer(r.win, np.uint8) for r in rows])) @ whiten
        weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (len(toxic) - toxic.sum())) * len(toxic)
        w, _ = fit_svm(x, np.where(toxic == 1, 1.0, -1.0), weight)
        beta = whiten @ w
    table = held.table(beta)
    x, y = _document_features(sample, table)
    weights = fit_logistic(x, y)
    weights[-1] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return Model(table, weights)


def _held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD
) -> DataFrame:
    """Per row: key, held_out (crc32 of the key as text leaves 2 modulo 4), score from 0 to 1, predicted.

    Trained on at most train_rows labelled rows of each class, chosen by a hash of the key among those that are not
    held out; labels are read nowhere else. Every whole text is scored. Null and empty texts have no sentence and get
    the score of a text without any; a null key is not held out and never trains; labels that are null, or keys that
    have several labels, count as they stand (null ones are left out). Without labels of both classes the score is
    the share of toxic rows. Repeated rows are scored alike; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    usable = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("toxic")).where(
        F.col("k").isNotNull() & F.col("toxic").isin(0, 1) & ~_held_out(F.col("k"))
    )
    counts = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    base = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    chosen = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("k", F.lit(5)), "k").limit(train_rows) for c in (0, 1)]
    sample = base.join(F.broadcast(chosen[0].union(chosen[1])), "k").where(F.col("t").isNotNull()).select("toxic", "t")
    sample = Scratch(spark).save(sample, "sample").repartition(spark.sparkContext.defaultParallelism)
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    if len(counts) == 2 and len(sample.take(1)):
        model = train(sample, prior)
    else:
        model = Model(np.zeros(1 << (5 * LENGTH), np.float32), np.append(np.zeros(TOP + 1), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = T.buffers(batch.column(1))
            for i, j in T.chunks(at, _CHUNK):
                score = held.value.score(data, at[i : j + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score)], names=["k", "score"])

    scored = base.mapInArrow(run, f"k {base.schema['k'].dataType.simpleString()}, score double")
    return scored.select(F.col("k").alias(key), _held_out(F.col("k")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_string_kernel_svm(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels)
