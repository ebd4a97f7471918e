"""Nearest neighbours against plain loops."""

import numpy as np
import pandas as pd
import pytest

from sparkloom.operators import inverted, vectors


def _nearest(ids, v, k, floor):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    out = []
    for a, x in zip(ids, u):
        near = sorted((-s, b) for s, b in zip(np.round(u @ x, 9), ids) if b != a and s >= floor)[:k]
        out += [(a, b, -s, r + 1) for r, (s, b) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize(("alike", "floor"), [(0.0, -2.0), (0.7, 0.2)])
def test_knn_over_blocks(spark, monkeypatch, alike, floor):
    monkeypatch.setattr(vectors, "COMPONENTS", 8 * 300)
    rng = np.random.default_rng(5)
    v = rng.standard_normal((900, 8))
    v[rng.random(900) < alike] = v[0]  # copies: ties go to the smaller id
    ids = rng.permutation(5000)[:900]
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)] + [(7000, None), (7001, [0.0] * 8), (7002, [float("nan")] * 8)], "id long, v array<double>")
    got = sorted((r.src, r.dst, r.cos, r.rank) for r in vectors.knn(df, 6, "id", "v", floor).collect())
    want = _nearest(ids.tolist(), v, 6, floor)
    assert [(a, b, r) for a, b, _, r in got] == [(a, b, r) for a, b, _, r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=2e-9)


def test_a_pair_of_blocks_serves_both():
    rng = np.random.default_rng(6)
    v = rng.standard_normal((200, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    block = lambda a, b: pd.DataFrame({"id": np.arange(a, b), "v": list(v[a:b])})
    found = vectors._block_top(3, -2.0)((0, 1), block(0, 90), block(90, 200))
    assert found.groupby("src").size().to_dict() == dict.fromkeys(range(200), 3)
    assert (found["src"] < 90).eq(found["dst"] >= 90).all()


def test_similar_pairs_are_not_shuffled(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((300, 8)).tolist()
    plans = []
    for ids in (range(300), [i % 299 for i in range(300)]):
        df = spark.createDataFrame(list(zip(ids, v)), "id long, v array<double>")
        got = inverted.similar_pairs(df, "id", "v", 0.3, lambda pairs: plans.append(pairs._jdf.queryExecution().optimizedPlan().toString()) or pairs).collect()
        assert len({(r.a, r.b, r.cos) for r in got}) == len(got)
    top = [p.split("FlatMapCoGroupsInPandas")[0] for p in plans]
    assert "Aggregate" not in top[0] and "Aggregate" in top[1]  # only repeated ids can give a pair twice
