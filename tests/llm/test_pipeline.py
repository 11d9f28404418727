"""The pipeline's stages against brute force, each on its own input."""

import collections

import corpus_pipeline
from tests.llm.test_llm import WORD, agreeing, linked, pareto, water

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    out = docs
    items = [r.text.lower().split() for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = out.collect()
        out = stage(spark, out, FOLDER).cache()
        after = {r.doc_id for r in out.collect()}
        if name != "sharding":
            assert out.columns == columns
        if name == "language":
            assert len(after) >= 0.98 * len(before)
        elif name == "near_duplicates":
            assert after == {d for d, x in linked([(r.doc_id, r.text) for r in before]).items() if x[2]}
        elif name == "decontamination":
            assert after == {r.doc_id for r in before if not any(agreeing(r.text.lower().split(), i) for i in items)} and len(after) < len(before)
        elif name == "mixing":
            sizes = collections.Counter()
            for r in before:
                sizes[r.source] += len(WORD.findall(r.text))
            copies, _ = pareto(before, water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}))
            assert collections.Counter(r.doc_id for r in out.collect()) == collections.Counter({d: c for (d, _), (c,) in copies.items() if c})
        else:
            assert out.count() == len(before)


def test_run_over_whole_tables(spark):
    """``run`` gives what its stages give one after another."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
    assert sorted(map(str, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(str, docs.collect()))


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, _id long"
    rows = [(1, None, None, None, None, 1, 1), (2, "", "en", "a", 0, 1, 1), (None, "the of and to a word here", "en", "a", 9, 1, 1), (3, "the of and to a word here", "en", "a", 9, 1, 1), (3, "the of and to a word here", "en", "a", 9, 1, 1)]
    out = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, FOLDER).cache()
        if name == "near_duplicates":
            assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "None"]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, FOLDER)
        assert empty.count() == 0


def test_rows_that_share_an_id(spark):
    """Different clean texts stay, near copies go whichever ids they have, and of equal rows one stays."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    near = text("b").replace("b59", "x")
    rows = [(1, text("a"), "en", "s", 1), (1, text("b"), "en", "s", 1), (1, text("c"), "en", "s", 1), (1, text("c"), "en", "s", 1), (2, near, "en", "s", 1), (3, text("d"), "en", "s", 1), (4, text("e"), "en", "s", 1), (4, text("d"), "en", "s", 1), (None, text("a"), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert out.columns == docs.columns
    want = [(1, text("a")), (1, text("b")), (1, text("c")), (3, text("d")), (4, text("e")), (None, text("a"))]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
