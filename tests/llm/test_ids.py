"""Ids beside a null one, sequence numbers, and the bulk tokenizer."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from retentio.llm import op9_packing, op10_warc

BIG = 2 ** 53 + 1


def test_packing_keeps_every_id(spark):
    rows = [(BIG, "a b"), (None, "c"), (BIG + 2, None), (-BIG, "d" * 50)]
    got = op9_packing.op9_query(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [-BIG, BIG, BIG + 2] and len(got) == 4


def test_warc_keeps_every_id(spark):
    rows = [(BIG, "http://a.org/", "<p>x</p>"), (None, "http://a.org/", "<p>x</p>"), (BIG - 1, "http://a.org/", "<p>x</p>")]
    got = op10_warc.op10_query(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert sorted({r.page_id for r in got if r.page_id is not None}) == [BIG - 1, BIG]
    assert len(got) == 6 and len({r.record_id for r in got}) == 6


def test_sequence_numbers_differ_as_the_names_do(spark):
    names = [f"{r}/{g}/{b}" for r in (0, 1, 1023) for g in (0, 1, 2 ** 29 - 1) for b in (0, 1, 2 ** 24 - 1)]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(op9_packing.sequence_number(F.col("n"))).collect()]
    assert len(set(got)) == len(names) and min(got) >= 0


def test_bulk_ids_equal_the_tokenizer():
    words = op9_packing.WordIds(op9_packing.default_tokenizer())
    rnd = random.Random(4)
    texts = ["", None, " ", "\n\n", "a,b.c don't IT'S ÉCOLE, été; ΣΑΣ İstanbul, 3,000.5% foo_bar's日本語、中文。 a≠b = ̸", "x<|endoftext|>y <|ENDOFTEXT|>",
             "we'll they'd I'M rock'n'roll 'tis (it) á, é. ǅ ẞ ﬁ"]
    texts += ["".join(rnd.choice("ab ,.'<>|\n\tÉéΣσςİıßA1  ́'s're've") for _ in range(rnd.randrange(60))) for _ in range(1500)]
    for part in (texts, [t for t in texts if t and "<|" not in t]):
        ids, at = words.of_rows(pa.array(part, pa.string()))
        for i, t in enumerate(part):
            assert ids[at[i]:at[i + 1]].tolist() == words.tok.encode(t or "", add_special_tokens=False).ids, t
