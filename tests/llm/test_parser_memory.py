"""Memory of the cross parser."""

import tracemalloc

import numpy as np

from retentio.llm.op7_language import CrossParser, code_points


def test_predicting_holds_few_bytes_a_letter():
    rng = np.random.default_rng(5)
    train = {x: rng.integers(97, 97 + n, 900).tolist() for x, n in (("a", 8), ("b", 26))}
    model = CrossParser(train)
    texts = ["".join(map(chr, rng.integers(97, 123, 5000))) for _ in range(200)] + [None, "", "12", "x"]
    model.predict(texts[-5:])
    tracemalloc.start()
    langs, scores = model.predict(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * 1_000_000
    assert langs[-4:-1] == ["und"] * 3 and langs[0] == "b" and scores[-4:-1] == [0.0] * 3
    wide = CrossParser({"w": list(range(0x4E00, 0x4E00 + 300))})
    assert wide.coded(code_points("".join(map(chr, range(0x4E00, 0x4E00 + 301))))).tolist() == list(range(301))
