"""The top-k search over crowded blocks, small cells and unequal segments, against all distances."""

import numpy as np
import pandas as pd
import pytest

from retentio.llm import op4_topk


def brute(ids, bits, asks, k):
    out = set()
    for i in np.flatnonzero(asks(ids)):
        d = (bits != bits[i]).sum(1)
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out |= {(int(ids[i]), r + 1, int(ids[j]), int(d[j])) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize(("width", "k", "cell", "visits"), [(70, 3, 8, 2), (20, 7, 4096, 4096), (130, 5, 16, 3)])
def test_cells_of_crowded_blocks(spark, width, k, cell, visits):
    rng = np.random.default_rng(width)
    n = 300
    bits = rng.random((n, width)) < 0.5
    bits[:100] = bits[0]                      # a third: one half in common, so its blocks are crowded
    bits[:100, width // 2:] = rng.random((100, width - width // 2)) < 0.5
    bits[100:200] = bits[100]                 # a third: one code
    ids = rng.permutation(n) * 7
    rows = spark.createDataFrame([(int(i), [float(x) for x in np.where(b, 1.0, -1.0)]) for i, b in zip(ids, bits, strict=True)],
                                 "vec_id long, embedding array<float>")
    got = op4_topk.top_k(rows, lambda i: i % 5 == 0, k, cell=cell, visits=visits).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(ids, bits, lambda i: i % 5 == 0, k)


def test_a_pair_is_found_in_one_segment_at_one_radius():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 6, (40, 4))
    frame = pd.DataFrame({"code": codes.tolist(), "ids": [[i] for i in range(40)], "kth": 24})
    seen = [(tuple(map(int, r.code)), r.id) for seg in range(4) for radius in range(7)
            for r in op4_topk.search_cell(frame, frame, seg, radius, 40).itertuples()]
    assert len(seen) == len(set(seen)) == len({tuple(c) for c in codes.tolist()}) * 40


def test_segments_cover_every_bit_once():
    for width in (1, 5, 64, 70, 1000):
        for n in (0, 2, 500, 10**6, 10**12):
            cuts = op4_topk.segments(width, n)
            assert [b for lo, size in cuts for b in range(lo, lo + size)] == list(range(width))
            assert max(s for _, s in cuts) <= 62 and max(s for _, s in cuts) - min(s for _, s in cuts) <= 1
