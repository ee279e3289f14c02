import random

import corpus_pipeline
from graphloom.llm import catalog
from tests.llm.test_operators import changed, words


def test_queries_are_registered():
    assert sorted({int(q[2:].split("_")[0]) for q in catalog.QUERIES if q.startswith("op")}) == list(range(1, 11))
    assert "pipeline" in catalog.QUERIES and set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontamination", "packing"]


def test_pipeline(spark, tmp_path):
    rng = random.Random(4)
    line = lambda n=30: words(rng, n, 5000).capitalize() + "."
    first, passage, shared = [line() for _ in range(8)], line(26), line(40)
    rows = [
        (1, "\n".join(first)),
        (2, "\n".join([*[changed(rng, x[:-1], 0).upper() + "!" for x in first[:1]], *[line() for _ in range(6)]])),
        (3, "\n".join([*[line() for _ in range(3)], passage])),
        (4, "too short"),
        (5, "\n".join(["Home | Menu | Login", line(), shared])),
        (6, "\n".join([line(), shared, line()])),
        (7, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(sorted(r.doc_id for r in now.collect()))
    assert kept == [[1, 2, 3, 5, 6], [1, 2, 3, 5, 6], [1, 2, 3, 5, 6], [1, 2, 5, 6]]
    text = {r.doc_id: r for r in now.collect()}
    assert text[5].text == "\n".join(rows[4][1].split("\n")[1:]) and text[5].n_chars == len(text[5].text)
    assert shared not in text[6].text and first[0].upper()[:-1] not in text[2].text
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in packed) == [1, 2, 5, 6]
