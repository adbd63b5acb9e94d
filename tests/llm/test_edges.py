"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra
columns with clashing names: every operator and stage gives its defined result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from retentio.llm import op1_licenses, op2_syncmers, op3_jaccard, op4_topk, op5_mixing, op6_urls, op7_language, op8_toxicity, op9_packing, op10_warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} thing{i % 13}" for i in range(30_000))
ROWS = [(1, "the quick brown fox jumps over the lazy dog again", "en", "a", 49), (2, None, "en", "a", None), (3, "", None, None, 0),
        (4, "   \n\t ", "fr", "b", 6), (None, "a text without any id at all in this row", "en", None, 40),
        (5, LONG, "en", "a", len(LONG)), (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 49),
        (6, "the quick brown fox jumps over the lazy dog again", None, "b", 49), (7, "12345 67890", "de", "c", 11),
        (8, "Licensed under the Apache License, Version 2.0.", "en", "c", 47), (9, "le chat noir et le chien blanc", "fr", "c", 30),
        (None, None, None, None, None), (1, "same id but another text", "en", "b", 24)]
EXTRA = ("score", "_score", "evidence", "lang_pred", "_size", "_row", "size", "node", "n", "text_hash", "component",
                                 "_target", "row_id", "piece", "_t", "_h", "a", "b", "_hash", "family", "anchors", "toxic", "host", "src")


def clash(df):
    return df.withColumns({c: F.lit("x") for c in EXTRA})


@pytest.fixture(scope="module")
def made(spark):
    return {"rows": spark.createDataFrame(ROWS, DOCS), "empty": spark.createDataFrame([], DOCS),
            "extra": spark.createDataFrame(ROWS, DOCS).transform(clash)}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (8, 0, 1), (8, 1, 0), (9, None, None), (None, 1, 1), (5, 1, 0), (77, 1, 1)],
                                 "doc_id long, quality int, toxic int")


def both(made, f):
    """Rows without and with the clashing columns are the same; the empty table gives none."""
    assert f(made["empty"]).collect() == []
    key = lambda r: repr(r)
    a, b = sorted(f(made["rows"]).collect(), key=key), sorted(f(made["extra"]).collect(), key=key)
    assert a == b
    return a


def test_licences(made):
    got = both(made, op1_licenses.op1_query)
    assert [(r.doc_id, r.paragraph, r.family, r.confirmed) for r in got] == [(8, 0, "Apache", True)]


def test_syncmers(made):
    got = both(made, op2_syncmers.op2_query)
    assert len(got) == len(ROWS)
    assert {(r.fingerprint, r.n_chars) for r in got if r.doc_id in (2, 3)} == {("", 0)}
    assert len({r.fingerprint for r in got if r.n_chars == 49}) == 1


def test_join(made):
    got = both(made, op3_jaccard.op3_query)
    comp = {(r.doc_id, r.n_shingles): r.component_id for r in got}
    assert len(got) == len(ROWS) and comp[(6, 7)] == 1 and comp[(1, 7)] == 1 and comp[(2, 0)] == 2 and comp[(None, 0)] is None


def test_top_k(spark):
    schema = "vec_id long, embedding array<float>, label int"
    one = [1.0, -1.0, 1.0, -1.0]
    rows = [(0, one, 1), (100, None, 1), (200, [], 1), (300, [None, 1.0, 1.0, 1.0], None), (None, one, 2), (1, one, 0), (1, one, 0), (2, one, 0),
            (3, [-1.0, 1.0, -1.0, 1.0], 0), (4, [1.0, -1.0], 0)]
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in op4_topk.op4_query(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 4, 1), (0, 4, 300, 3), (0, 5, 3, 4),
                   (300, 1, 3, 1), (300, 2, 0, 3), (300, 3, 1, 3), (300, 4, 2, 3), (300, 5, 4, 4)]
    assert [tuple(r) for r in op4_topk.op4_query(df.transform(clash)).orderBy("query_id", "rank").collect()] == got
    assert op4_topk.op4_query(spark.createDataFrame([], schema)).collect() == []


def test_mix(made, labels):
    got = both(made, lambda d: op5_mixing.op5_query(d, labels))
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)


def test_urls(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, None, None), (None, "http://X.example.org/es/a", ""), (2, "http://b.com", None), (2, "http://b.com", None),
            (3, "http://c.com/de/" + "x" * 100_000, "<p>"), (4, "://", None)]
    df = spark.createDataFrame(rows, schema)
    for d in (df, df.transform(clash)):
        got = sorted((r.page_id or 0, r.host, r.rule, r.verdict) for r in op6_urls.op6_query(spark, d).select("page_id", "host", "rule", "verdict").collect())
        assert got == sorted([(1, "", None, "allow"), (0, "x.example.org", "example.org/es/", "block"), (2, "b.com", None, "allow"),
                              (2, "b.com", None, "allow"), (3, "c.com", "com/de/", "block"), (4, "", None, "allow")], key=lambda x: (x[0], x[1]))
    assert op6_urls.op6_query(spark, spark.createDataFrame([], schema)).collect() == []


def test_language(made):
    got = both(made, op7_language.op7_query)
    assert len(got) == len(ROWS)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (2, 3, 4, 7))


def test_toxicity(made, labels):
    got = both(made, lambda d: op8_toxicity.op8_query(d, labels))
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in op8_toxicity.op8_query(made["rows"], labels.limit(0)).collect())


def test_packing(made):
    got = op9_packing.op9_query(made["rows"]).collect()
    assert op9_packing.op9_query(made["empty"]).collect() == []
    assert sorted((r.length for r in got if r.doc_id in (2, 3, 4))) == [1, 1, 1]
    assert sorted(r.length for r in op9_packing.op9_query(made["extra"]).collect()) == sorted(r.length for r in got)
    assert sum(r.length for r in got if r.doc_id == 5) > 4096 and all(r.length <= 4096 for r in got)


def test_warc(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, None, None), (None, "http://a/\r\nX: y", "<p>é</p>"), (2, "u", ""), (2, "u", ""), (3, "v", "<b>x</b>" * 50_000)]
    df = spark.createDataFrame(rows, schema)
    got = op10_warc.op10_query(df).collect()
    assert len(got) == 10 and len({r.record_id for r in got}) == 10 and not any("\nX: y" in r.headers for r in got)
    assert sorted(map(repr, op10_warc.op10_query(df.transform(clash)).collect())) == sorted(map(repr, got))
    assert op10_warc.op10_query(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, made, labels, tmp_dir, k):
    labels.write.parquet(f"{tmp_dir}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, made["empty"], tmp_dir).collect() == []
    for kind in ("rows", "extra"):
        out = stage(spark, made[kind], tmp_dir)
        rows = out.collect()
        if name != "pack":
            assert out.columns == made[kind].columns
        if name == "near_duplicates":
            kept = [(r.doc_id, r.text) for r in rows]
            assert len(kept) == len(set(kept)) + 0 and sum(t is None or not t.strip() for _, t in kept) == 4
            assert sum((t or "").startswith("the quick") for _, t in kept) == 1
        if name == "language":
            assert all(any(c.isalpha() for c in r.text) for r in rows)
        if name == "mix":
            assert {r.doc_id for r in rows} >= {2, 3}
