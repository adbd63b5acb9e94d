"""The cross parser: exact phrases of whole texts, small tables for large scripts, the learning sample."""

import numpy as np
import pytest

from retentio.llm import op7_language
from retentio.llm.op7_language import CrossParser, code_points, displaced, learn, suffix_automaton, together


def naive_phrases(codes, seen):
    s, seen, count, at = "".join(map(chr, codes)), "".join(map(chr, seen)), 0, 0
    while at < len(s):
        n = 0
        while at + n < len(s) and s[at:at + n + 1] in seen:
            n += 1
        at, count = at + max(1, n), count + 1
    return count


def test_phrases_of_whole_texts_are_exact():
    rng = np.random.default_rng(3)
    train = {x: rng.integers(97, 97 + n, 900).tolist() for x, n in (("a", 3), ("b", 6), ("c", 12))}
    model = CrossParser(train)
    texts = [rng.integers(97, 115, n).astype(np.uint32) for n in (0, 1, 2, 5, 7000)]
    texts += [np.array(train["b"][100:700], np.uint32), np.array([200, 200, 97, 200], np.uint32)]
    assert model.phrases(texts).tolist() == [[naive_phrases(t, train[x]) for t in texts] for x in model.langs]
    assert model.phrases([]).shape == (3, 0) and CrossParser({}).phrases(texts).shape == (0, len(texts))


def test_large_scripts_have_small_tables():
    rng = np.random.default_rng(4)
    han = {x: (0x4E00 + rng.zipf(1.2, 30_000) % 9000)[:16_000].tolist() for x in ("zh", "ja")}
    model = CrossParser(han | {"en": rng.integers(97, 123, 16_000).tolist()})
    assert model.width > 2000 and model.cells.nbytes + model.start.nbytes < 10_000_000
    part = np.array(han["ja"][5000:5400], np.uint32)
    assert model.phrases([part])[model.langs.index("ja"), 0] == 1


def test_displaced_rows_keep_every_cell():
    rows = suffix_automaton(np.random.default_rng(6).integers(0, 40, 500).tolist())
    place, cells = displaced(rows, 41)
    for r, to in enumerate(rows):
        got = cells[place[r]:place[r] + 41]
        assert {c: int(v & 0xFFFFFFFF) for c, v in enumerate(got) if to and v >> 32 == place[r]} == {c: place[v] for c, v in to.items()}
    some = place[[r for r, to in enumerate(rows) if to]]
    assert len(set(some.tolist())) == len(some) and 0 not in some


def test_learning_sample_is_bounded_and_ignores_partitions(spark):
    rows = [(i if i % 9 else None, f"text {i % 50} " + "ab"[i % 2] * (i % 5), "xy"[i % 3 == 0]) for i in range(400)] + [(7, "", "x"), (8, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = learn(docs.coalesce(1), rows=20), learn(docs.repartition(7), rows=20)
    assert one.langs == many.langs == ["x", "y"]
    assert np.array_equal(one.cells, many.cells) and np.array_equal(one.start, many.start)
    assert len(one.cells) < 20_000
    assert learn(docs.where("lang is null")).langs == []


@pytest.mark.parametrize("most", [1, 5, 100])
def test_batches_of_letters(most):
    texts = ["abc", None, "", "x" * 50, "de", "f"]
    parts = list(together(texts, most))
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= most for p in parts)
    assert op7_language.CrossParser({}).predict(texts)[0] == ["und"] * 6 and code_points("").size == 0
