"""Class keys that different sets share; short clean texts in the pipeline's language stage; dropped tables."""

import os
import random

from pyspark.sql import functions as F

from conftest import SF01
from retentio.llm import common, op3_jaccard, op6_urls, stages


def _docs(spark):
    rnd = random.Random(6)
    texts = []
    for _ in range(25):
        base = [rnd.choice("abcdefgh") * rnd.randrange(1, 4) for _ in range(rnd.randrange(3, 60))]
        for _ in range(rnd.randrange(1, 5)):
            words = list(base)
            words[rnd.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    return spark.createDataFrame([*enumerate([*texts, *texts[:10], "", None])], "doc_id long, text string")


def test_sets_that_share_their_first_hash_stay_apart(spark):
    docs = _docs(spark)
    want = sorted(tuple(r) for r in op3_jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect())
    few = op3_jaccard.jaccard_components(docs, class_hash=lambda grams: F.pmod(F.xxhash64(grams), F.lit(5)))
    got = few.select("doc_id", "n_shingles", "component_id", "class_id").collect()
    assert sorted(tuple(r)[:3] for r in got) == want
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_class: dict = {}
    for r in got:
        if r.n_shingles:
            words = texts[r.doc_id].split()
            by_class.setdefault(r.class_id, set()).add(frozenset(tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))))
    assert all(len(s) == 1 for s in by_class.values())


def test_bands_price_the_exact_form_by_the_whole_chance():
    """Sets of the upper bands have hundreds of empty segments and more to spare: the exact form is the cheaper one."""
    bands = op3_jaccard.Bands(80, 40_000)
    assert [d for lo, d in zip(bands.lo, bands.deletes) if lo > 40] == [False] * sum(lo > 40 for lo in bands.lo)


def test_short_clean_texts_stay(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    short = ["le", "no", "data", "es ist", "de la", "la", "the"]
    extra = spark.createDataFrame([(10 ** 9 + i, t, None, "short", len(t or "")) for i, t in enumerate([*short, "", None, "12 !"])], docs.schema)
    kept = stages.drop_unknown_language(spark, docs.unionByName(extra), SF01).where("source = 'short'")
    assert sorted(r.text for r in kept.collect()) == sorted(short)


def test_used_tables_are_dropped(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    label = op6_urls.components(edges)
    assert {r.component for r in label.collect()} == {0}
    assert len(set(os.listdir(folder)) - before) == 1
