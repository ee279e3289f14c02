"""Token alignment against whole texts encoded by the libraries themselves and links found pair by pair."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from graphloom.llm import align

KINDS = ("byte_bpe_50k.json", "piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    parts = ["the", "Straße", "l'été", "it's", "can't", "x=1;", "漢字かな", "naïve", "😀😀", "10,000.5", "http://a.b/c?d", "foo\tbar", "\n\n", "  ", " ", "　a", "<s>", "<|endoftext|>", "<0x41>", "\x00\x01", "á", "Ärger", "−", "...", "''", "'s", "\r\n", "¿qué?", "ﬁ", "​", "x ", "é", "ÿ"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(120)]
    rows += [(200 + i, "".join(rng.choice([" ", "  ", "a", "é", " ", "1", ".", "\n", "'s"]) for _ in range(rng.randint(1, 30)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, " "), (503, "   "), (504, " lead"), (505, "trail "), (506, "a ▁ b"), (507, "▁"), (508, "same words"), (508, "same words"), (None, "same words"), (509, "word " * 3000), (510, "x" * 2000)]
    return rows


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(align.A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=align.B)
    letters = align._byte_letters()

    def one(text):
        return [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]

    def two(text):
        return [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]

    return one, two


def brute(texts):
    one, two = encoders()
    found, links = [], []
    for key, text in texts:
        x, y = (one(text), two(text)) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(t for _, t in x) != whole or b"".join(t for _, t in y) != whole:
            x, y = [], []
        spans = []
        for side in (x, y):
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        own = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, begin = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if begin <= s and e <= end) for side in spans))
            begin = end
        found.append((key, len(x), len(y), len(groups), ";".join(groups)))
        links.append(own)
    count = Counter(p for own in links for p in own)
    most = defaultdict(int)
    for (_, j), c in count.items():
        most[j] = max(most[j], c)
    rows = [(str(k), a, b, g, len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(w.encode()).hexdigest() if w else "", w) for (k, a, b, g, w), own in zip(found, links)]
    return rows, {(i, j, c, c == most[j]) for (i, j), c in count.items()}


@pytest.mark.parametrize("chunk", [1 << 20, 500])
def test_align(spark, texts, chunk):
    short = [(i, t) for i, t in texts if i != 509 or chunk > 500]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in short], "doc_id long, text string, chunk int, pair string")
    documents, pairs = align.align(docs, groups=True, chunk=chunk)
    want, want_pairs = brute(short)
    got = [(str(r.key), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in documents.collect()]
    assert sorted(got) == sorted(want)
    assert {tuple(r) for r in pairs.select("a_id", "b_id", "count", "best").collect()} == want_pairs
    assert sum(1 for r in want if r[1] == 0) >= 4


def test_align_other_vocabularies(spark, texts):
    docs = spark.createDataFrame(texts[:40], "doc_id long, text string")
    first, _ = align.align(docs)
    second, _ = align.align(docs, a=f"{align.FOLDER}/byte_bpe_50k.tiktoken")  # the same vocabulary in another form
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))
    with pytest.raises(ValueError):
        align.align(docs, a=f"{align.FOLDER}/word_bpe_49k.json")


def test_align_nothing(spark, texts):
    docs = spark.createDataFrame(texts[:1], "doc_id long, text string").limit(0)
    documents, pairs = align.align(docs)
    assert documents.collect() == [] and pairs.collect() == []
    documents, pairs = align.align(spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string"))
    assert sorted(tuple(r) for r in documents.collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)] and pairs.collect() == []
