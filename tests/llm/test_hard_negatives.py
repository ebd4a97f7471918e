"""Hard-negative mining against plain Python and SQL."""

import math
import random

import duckdb
import numpy as np
import pytest

from sparkloom.llm import hard_negatives as module
from sparkloom.llm import queries
from sparkloom.llm.hard_negatives import Approximations, cell_borders, hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, v string"


def _mined(rows, anchors, k=5):
    """By the definition, row by row, with whole numbers."""
    good = {(i, l, tuple(math.floor(256 * x) for x in e)) for i, e, l in rows if None not in (i, l) and e and all(x is not None and math.isfinite(x) for x in e)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for a in anchors:
        own = [x for x in good if x[0] == a]
        if not own:
            continue
        _, label, v = max(own, key=lambda x: x[1:])
        best = lambda found: sorted(set(found), key=lambda p: (-p[1], p[0]))[:k]
        for pid, ps in best((i, dot(v, w)) for i, l, w in good if l == label and i != a):
            inside = [(i, s) for i, l, w in good if l != label and 80 * ps <= 100 * (s := dot(v, w)) <= 100 * ps]
            out |= {(a, pid, n + 1, i, ps, s) for n, (i, s) in enumerate(best(inside))}
    return sorted(out)


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(12)
    rows = [(i, [r.choice((-1.0, -0.5, 0.0, 0.3, 1.0)) for _ in range(6)], r.choice((0, 0, 0, 1, 2))) for i in range(300)]
    rows += [(i, rows[3][1], i % 2) for i in range(300, 360)]  # ties
    rows += [(100, rows[100][1], rows[100][2])] * 3 + [(200, [0.9] * 6, 1), (7, [0.8] * 6, 0)]  # alike, and one id with two vectors
    rows += [(400, None, 1), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (600, [math.nan] + [0.0] * 5, 1), (700, [-math.inf] + [0.0] * 5, 0)]
    return rows + [(800, [0.1] * 6, None), (None, [0.1] * 6, 1), (900, [0.0] * 6, 1), (1000, [-1.0] * 6, 2), (1100, [], 1), (1200, [1.0] * 5, 1)]


@pytest.mark.parametrize("block,group", [(4096, 2048), (32, 3)])
def test_hard_negatives(spark, odd_rows, block, group, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "ANCHORS", group)
    df = spark.createDataFrame([(*x, "a", "b") for x in odd_rows], SCHEMA)
    got = hard_negatives(df, df.where("vec_id % 100 = 0")).collect()
    whole = [x for x in odd_rows if x[0] != 1200]  # a vector of another length
    assert sorted(map(tuple, got)) == _mined(whole, range(0, 1300, 100))
    assert hard_negatives(df.limit(0), df.limit(0)).count() == 0 == hard_negatives(df, df.limit(0)).count()


def test_large_components(spark):
    rows = [(0, [1e17, 1.0], 0), (1, [1e17, 1.0], 0), (2, [1e17, 0.5], 1), (3, [9e16, 0.5], 1), (4, [1e3, 0.5], 1), (100, [3e6, 3e6], 0), (101, [2.5e6, 3e6], 1)]
    df = spark.createDataFrame([(*x, "a", "b") for x in rows], SCHEMA)
    got = sorted(map(tuple, hard_negatives(df, df.where("vec_id = 100"), k=3).collect()))
    most = (1 << 63) - 1
    clip = lambda x: min(x, most)
    dot = lambda a, b: clip(sum(clip(math.floor(256 * x)) * clip(math.floor(256 * y)) for x, y in zip(a, b)))
    v = rows[5][1]
    for p in (0, 1):
        inside = sorted((-dot(v, e), i) for i, e, l in rows if l == 1 and 80 * dot(v, rows[p][1]) <= 100 * dot(v, e) <= 100 * dot(v, rows[p][1]))
        assert [x for x in got if x[1] == p] == [(100, p, n + 1, i, dot(v, rows[p][1]), -s) for n, (s, i) in enumerate(inside[:3])]


def test_bounds_hold_and_spare_most_rows():
    rng = np.random.default_rng(5)
    v = np.floor(256 * rng.standard_normal((3000, 32)) / 6).astype(np.int64)
    labels = rng.integers(0, 4, 3000)
    block = Approximations(np.arange(3000), labels, v, cell_borders(v[:500]))
    for i in range(0, 3000, 500):
        low, high = block.bounds(v[i], slice(None), np.float64)
        exact = block.vectors @ v[i]
        assert (low <= exact).all() and (exact <= high).all()
        _, tops, near = block.nearest(i, int(labels[i]), v[i], 5)
        _, far = block.in_windows(int(labels[i]), v[i], [(-(-80 * int(x) // 100), int(x)) for x in tops], 5)
        assert near < 250 and far < 1500


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLE["op12_hard_negatives"]).fetchall())
    assert want and sorted(map(tuple, queries.op12_hard_negatives(spark, sf).collect())) == want
