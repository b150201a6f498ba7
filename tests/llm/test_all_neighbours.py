"""The forest against brute force: over borders of partitions, in a large dense group, and with a small reach."""

import numpy as np
import pytest

from loomwright.llm import neighbours


def data():
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((9, 16))
    # a third of the rows in one group of vectors that differ by less than single precision tells apart
    x = np.concatenate([rng.standard_normal((300, 16)), centre[rng.integers(1, 9, 100)] + 0.2 * rng.standard_normal((100, 16)), centre[:1] + 1e-4 * rng.standard_normal((200, 16))]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    return x, {(i, int(j), r + 1) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:5])}


@pytest.mark.parametrize("reach,width,places,least", [(9600, 600, 32_768, 1.0), (9600, 600, 1000, 1.0), (1600, 200, 700, 0.9)])
def test_forest_against_brute_force(spark, monkeypatch, reach, width, places, least):
    monkeypatch.setattr(neighbours, "WIDTH", width)
    monkeypatch.setattr(neighbours, "PLACES", places)
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    x, want = data()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "hit_id long, embedding array<float>")
    got = {(r["id"], r["other_id"], r["rank"]) for r in neighbours.nearest(df, reach=reach).collect()}
    assert len(got) == len(want) and len({p[:2] for p in got} & {p[:2] for p in want}) >= least * len(want)
    if least == 1.0:
        assert got == want


def test_counts_stop_the_ascent():
    tree, code = np.zeros(6, dtype=int), np.array([0b0001, 0b0010, 0b0011, 0b1000, 0b1001, 0b1111]) << (neighbours.BITS - 4)
    start, end = neighbours._runs(tree, code, 2)
    assert start.tolist() == [0, 0, 0, 3, 3, 5] and end.tolist() == [3, 3, 3, 5, 5, 6]
    assert neighbours._runs(np.array([0, 0, 0, 1, 1, 1]), code, 0)[1].tolist() == [3, 3, 3, 6, 6, 6]
