"""Communities, bridges, hierarchies, joins and matching against plain loops."""

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.maths import l2_normalise
from sparkloom.operators import bridges, communities, graph, hierarchy, inverted, matching, novelty

EDGES = "src long, dst long, weight double"


def _modularity(edges, label, resolution=1.0):
    m = sum(w for _, _, w in edges)
    deg, inside = defaultdict(float), 0.0
    for a, b, w in edges:
        deg[label[a]] += w
        deg[label[b]] += w
        inside += w * (label[a] == label[b])
    return inside / m - resolution * sum((x / 2 / m) ** 2 for x in deg.values())


def _louvain(edges, resolution=1.0):
    """Sequential local moving and aggregation, ties to the smaller name."""
    nodes = sorted({x for e in edges for x in e[:2]})
    of = {n: n for n in nodes}
    level = Counter()
    for a, b, w in edges:
        level[min(a, b), max(a, b)] += w
    m2 = 2 * sum(level.values())
    while True:
        near, k = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for (a, b), w in level.items():
            k[a] += w
            k[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        at = {n: n for n in k}
        total = dict(k)
        moved = changed = True
        changed = False
        while moved:
            moved = False
            for n in sorted(at):
                to = defaultdict(float)
                to[at[n]] += 0.0
                for o, w in near[n].items():
                    to[at[o]] += w
                total[at[n]] -= k[n]
                value = {c: round(w - resolution * k[n] * total[c] / m2, 9) for c, w in to.items()}
                best = min(value, key=lambda c: (-value[c], c))
                best = best if value[best] > value[at[n]] else at[n]
                moved |= best != at[n]
                changed |= best != at[n]
                at[n] = best
                total[best] += k[n]
        of = {n: at[c] for n, c in of.items()}
        if not changed:
            return of
        nxt = Counter()
        for (a, b), w in level.items():
            nxt[min(at[a], at[b]), max(at[a], at[b])] += w
        level = nxt


def _named(label):
    first = {}
    for n in sorted(label):
        first.setdefault(label[n], n)
    return {n: first[c] for n, c in label.items()}


def _planted(r, groups=8, size=12, inside=0.7, across=0.01):
    edges = []
    n = groups * size
    for a in range(n):
        for b in range(a + 1, n):
            if r.random() < (inside if a % groups == b % groups else across):
                edges.append((a, b, round(r.uniform(0.5, 1.0), 3)))
    return edges


@pytest.mark.parametrize("algorithm", ["leiden", "louvain"])
def test_communities_of_planted_graphs(spark, algorithm):
    r = random.Random(21)
    edges = _planted(r)
    cliques = [(100 * g + a, 100 * g + b, 1.0) for g in range(1, 7) for a in range(5) for b in range(a)] + [(100 * g, 100 * (g % 6 + 1) + 1, 0.1) for g in range(1, 7)]
    for some in (edges, cliques, [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (3, 4, 1.0), (3, 5, 1.0), (4, 5, 1.0), (2, 3, 0.01)]):
        found = communities.communities(spark.createDataFrame(some, EDGES), algorithm=algorithm)
        label = {x.node: x.community for x in found.members.collect()}
        assert label == _named(_louvain(some))
        assert all(b >= a - 1e-12 for a, b in zip(found.modularity, found.modularity[1:])) and abs(found.modularity[-1] - _modularity(some, label)) < 1e-9
        assert {x.community: x["size"] for x in found.members.collect()} == Counter(label.values())


def test_communities_of_a_random_graph(spark):
    """No planted groups: modularity near the sequential rule's, parts connected."""
    r = random.Random(5)
    edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), round(r.random() + 0.01, 3)) for a, b in ((r.randrange(150), r.randrange(150)) for _ in range(320)) if a != b}.values())
    best = _modularity(edges, _louvain(edges))
    for algorithm in ("leiden", "louvain"):
        found = communities.communities(spark.createDataFrame(edges, EDGES), spark.range(152).withColumnRenamed("id", "node"), algorithm=algorithm)
        label = {x.node: x.community for x in found.members.collect()}
        assert set(label) == set(range(152)) and label[151] == 151
        assert _modularity(edges, label) > best - 0.03
        assert all(b >= a - 1e-12 for a, b in zip(found.modularity, found.modularity[1:]))
        if algorithm == "leiden":
            again = {x.node: x.community for x in communities.communities(spark.createDataFrame(edges[::-1], EDGES).repartition(5), algorithm=algorithm).members.collect()}
            assert all(label[n] == c for n, c in again.items())
            for c in set(label.values()):
                own = [n for n in label if label[n] == c]
                near = defaultdict(set)
                for a, b, _ in edges:
                    if label[a] == label[b] == c:
                        near[a].add(b)
                        near[b].add(a)
                seen, todo = {own[0]}, [own[0]]
                while todo:
                    for x in near[todo.pop()] - seen:
                        seen.add(x)
                        todo.append(x)
                assert seen == set(own)


def test_communities_without_edges(spark):
    none = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0), (None, 2, 1.0)], EDGES)
    found = communities.communities(none, spark.range(3).withColumnRenamed("id", "node"))
    assert sorted((x.node, x.community, x["size"]) for x in found.members.collect()) == [(0, 0, 1), (1, 1, 1), (2, 2, 1)] and found.modularity == []
    double = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 4, 2.0)], EDGES)
    assert {(x.node, x.community) for x in communities.communities(double).members.collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}


def test_attached_in_order(spark):
    r = random.Random(8)
    n = 60
    near = {i: r.choice([j for j in range(n) if j != i]) for i in range(n)}
    linked = {50, 51, 52, 53}
    edges = [(50, 51, 0.9, 0.95), (52, 53, 0.8, 0.9)]
    has, want = set(linked), {(50, 51), (52, 53)}
    for i in range(n):
        if i not in has:
            want.add((min(i, near[i]), max(i, near[i])))
            has |= {i, near[i]}
    rows = [(i, j, -0.5, 1) for i, j in near.items()] + [(i, (j + 1) % n, -0.6, 2) for i, j in near.items()] + [(99, 1, float("nan"), 1)]
    got = communities.attached(spark.createDataFrame(edges, "src long, dst long, cos double, weight double"), spark.createDataFrame(rows, "src long, dst long, cos double, rank int")).collect()
    assert {(x.src, x.dst) for x in got} == want and len(got) == len(want)
    assert {round(x.weight, 9) for x in got if x.cos == -0.5} == {0.25}


def _betweenness(edges, nodes):
    near = defaultdict(set)
    for a, b, *_ in edges:
        near[a].add(b)
        near[b].add(a)
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        order, paths, dist = [], {s: 1}, {s: 0}
        todo = [s]
        while todo:
            v = todo.pop(0)
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    paths[w] = 0
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    return total


@pytest.mark.parametrize("rows", [1 << 24, 300])
def test_betweenness(spark, rows):
    r = random.Random(2)
    edges = [(r.randrange(40), r.randrange(40), 1.0) for _ in range(55)] + [(60, 61, 1.0), (3, 3, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
    edges = [e for e in edges if e[0] != e[1]] + [(3, 3, 1.0)]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | {70})
    want = _betweenness([e for e in edges if e[0] != e[1]], nodes)
    n = len(nodes)
    for normalised in (True, False):
        got = bridges.betweenness(spark.createDataFrame(edges, EDGES), spark.createDataFrame([(x,) for x in nodes], "node long"), normalised, rows).collect()
        assert len(got) == n
        assert all(abs(x.betweenness - want[x.node] / ((n - 1) * (n - 2) if normalised else 2)) < 1e-9 for x in got)
    assert bridges.betweenness(spark.createDataFrame([], EDGES)).count() == 0


def test_betweenness_in_groups_of_sources(spark, monkeypatch):
    """Tables don't grow in number with the layers, and both ways give the same; ids may be texts."""
    made = []

    def counted(df, name, keep=bridges.Saved):
        made.append(name)
        return keep(df, name)

    monkeypatch.setattr(bridges, "Saved", counted)
    monkeypatch.setattr(bridges, "STEPS", 500)
    monkeypatch.setattr(bridges, "STATES", 300)
    edges = [(i, i + 1, 1.0) for i in range(30)] + [(0, 7, 1.0), (4, 12, 1.0), (40, 41, 1.0), (41, 42, 1.0)]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | {70})
    want = _betweenness(edges, nodes)
    table, points = spark.createDataFrame(edges, EDGES), spark.createDataFrame([(x,) for x in nodes], "node long")
    got = {x.node: x.betweenness for x in bridges.betweenness(table, points, False).collect()}
    assert len(made) < 10
    assert got.keys() == want.keys() and all(abs(got[x] - want[x] / 2) < 1e-9 for x in want)
    joined = {x.node: x.betweenness for x in bridges.betweenness(table, points, False, along=0).collect()}
    assert all(abs(got[x] - joined[x]) < 1e-9 for x in want)
    named = table.selectExpr("CAST(src AS STRING) AS src", "CAST(dst AS STRING) AS dst", "weight")
    assert all(abs(x.betweenness - want[int(x.node)] / 2) < 1e-9 for x in bridges.betweenness(named, None, False).collect())


def test_links_sent_along_with_groups_are_bounded(spark, monkeypatch):
    """However many the sources or pairs, the links sent to their groups don't exceed a number in all, and no source is left out."""
    sent = []

    def counted(links, count, groups, along=bridges._along):
        sent.append(count * groups)
        return along(links, count, groups)

    monkeypatch.setattr(bridges, "_along", counted)
    monkeypatch.setattr(bridges, "STEPS", 10)
    monkeypatch.setattr(bridges, "COPIES", 400, raising=False)
    r = random.Random(8)
    edges = [(r.randrange(60), r.randrange(60), 1.0) for _ in range(40)] + [(100, 101 + i, 1.0) for i in range(12)]
    edges = [e for e in edges if e[0] != e[1]]
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    want = _betweenness(edges, nodes)
    table = spark.createDataFrame(edges, EDGES)
    got = {x.node: x.betweenness for x in bridges.betweenness(table, None, False).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x] / 2) < 1e-9 for x in want)
    pairs = spark.createDataFrame([(101 + i, 112 - i) for i in range(12)], "a long, b long")
    assert {tuple(x) for x in bridges.between(bridges._links(table), pairs).collect()} == {(101 + i, 112 - i, 100) for i in range(12)}
    assert len(sent) == 2 and max(sent) <= 400


def test_shares_of_sources_in_pieces(monkeypatch):
    """Layers are found from either side, sources of several components go together, links are looked at a few at a time."""
    monkeypatch.setattr(bridges, "PIECE", 7)
    r = random.Random(9)
    edges = {(min(a, b), max(a, b)) for a, b in ((r.randrange(80), r.randrange(80)) for _ in range(150)) if a != b}
    edges |= {(90 + i, 91 + i) for i in range(9)} | {(110, 111 + i) for i in range(20)} | {(140 + 3 * i, 141 + 3 * i) for i in range(6)}
    ids, src, dst = bridges._unpacked([np.array([a for a, _ in edges])], [np.array([b for _, b in edges])])
    want = _betweenness(edges, ids.tolist())
    for states in (1, 1 << 12):
        monkeypatch.setattr(bridges, "STATES", states)
        got = sum(bridges._shares(src, dst, len(ids), np.arange(g, len(ids), 3)) for g in range(3))
        assert all(abs(got[i] - want[v]) < 1e-9 for i, v in enumerate(ids.tolist()))


def test_bridges_make_no_table_a_layer_of_all_sources(spark, monkeypatch):
    made = []

    def counted(df, name, keep=bridges.Saved):
        made.append(name)
        return keep(df, name)

    monkeypatch.setattr(bridges, "Saved", counted)
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(13)], EDGES)
    members = spark.createDataFrame([(i, 0 if i < 5 else 1 if i < 9 else 2) for i in range(14)], "node long, community int")
    points = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(14)], "node long, vector array<double>")
    (got,) = bridges.bridges(edges, members, points).collect()
    assert (got.a, got.b, got.endpoint_a, got.endpoint_b, got.convergence, got.mediators) == (0, 2, 4, 9, 4, [6, 7, 5])
    assert made.count("shares") == 1


def test_nodes_between(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 4, 1.0), (4, 3, 1.0), (3, 5, 1.0), (6, 7, 1.0)], EDGES)
    pairs = spark.createDataFrame([(1, 5), (1, 6), (1, 2)], "a long, b long")
    got = bridges.between(bridges._links(edges), pairs).collect()
    assert sorted(map(tuple, got)) == [(1, 5, 2), (1, 5, 3), (1, 5, 4)]


def test_nodes_between_in_groups_of_pairs(spark, monkeypatch):
    """Tables don't grow in number with the layers, and both ways give the same as a plain loop; ids may be texts."""
    made = []

    def counted(df, name, keep=bridges.Saved):
        made.append(name)
        return keep(df, name)

    monkeypatch.setattr(bridges, "Saved", counted)
    monkeypatch.setattr(bridges, "STEPS", 100)
    r = random.Random(5)
    edges = [(i, i + 1, 1.0) for i in range(30)] + [(r.randrange(31), r.randrange(31), 1.0) for _ in range(5)] + [(40, 41, 1.0), (41, 42, 1.0)]
    near = defaultdict(set)
    for a, b, _ in edges:
        if a != b:
            near[a].add(b), near[b].add(a)

    def far(s):
        out, front = {s: 0}, [s]
        for v in front:
            for w in near[v] - out.keys():
                out[w] = out[v] + 1
                front.append(w)
        return out

    d = {v: far(v) for v in near}
    asked = [(0, 30), (0, 17), (3, 3), (5, 6), (8, 25), (29, 2), (40, 42), (42, 1), (77, 1), (2, 78)]
    want = {(a, b, v) for a, b in asked if b in d.get(a, {}) for v in d[a].keys() - {a, b} if d[a][v] + d[b][v] == d[a][b]}
    table, pairs = spark.createDataFrame(edges, EDGES), spark.createDataFrame(asked, "a long, b long")
    got = list(map(tuple, bridges.between(bridges._links(table), pairs).collect()))
    assert "layer" not in made and len(made) < 5
    assert set(got) == want and len(got) == len(want)
    assert set(map(tuple, bridges.between(bridges._links(table), pairs, along=0).collect())) == want
    named = bridges._links(table.selectExpr("CAST(src AS STRING) AS src", "CAST(dst AS STRING) AS dst"))
    texts = bridges.between(named, pairs.selectExpr("CAST(a AS STRING) AS a", "CAST(b AS STRING) AS b")).collect()
    assert {tuple(map(int, x)) for x in texts} == want
    assert bridges.between(bridges._links(table), pairs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [100, 7])
def test_pagerank_in_few_rounds(spark, monkeypatch, most):
    """A long chain needs over 80 plain rounds; no more than two tables a score of rounds."""
    made = []

    def counted(df, name, keep=graph.Saved):
        made.append(name)
        return keep(df, name)

    monkeypatch.setattr(graph, "Saved", counted)
    edges = [(i, i + 1, 1.0 + i % 3) for i in range(40)] + [(50, 51, 0.5)]
    w = defaultdict(lambda: defaultdict(float))
    for a, b, x in edges:
        w[a][b] += x
        w[b][a] += x
    nodes = sorted(w) + ([60, 61] if most == 100 else [])
    seeds = {0, 1, 50, 60} & set(nodes)
    table, points = spark.createDataFrame(edges, EDGES), spark.createDataFrame([(x,) for x in nodes], "node long")
    got = {x.node: x.score for x in graph.pagerank(table, spark.createDataFrame([(x,) for x in (0, 1, 50, 60)], "node long"), points, most=most).collect()}
    r = {n: (n in seeds) / len(seeds) for n in nodes}
    want = dict(r)
    for _ in range(400 if most == 100 else most):
        idle = sum(want[n] for n in nodes if n not in w)
        want = {n: (0.15 + 0.85 * idle) * r[n] + 0.85 * sum(want[m] * w[m][n] / sum(w[m].values()) for m in w[n]) if n in w else (0.15 + 0.85 * idle) * r[n] for n in nodes}
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-8 for n in nodes)
    assert made.count("graph-scores") <= 9


def test_lengths_are_formed_once_a_vector(spark):
    """Not once a component: then a vector of so many took minutes."""
    v = [float(i % 7 - 3) for i in range(12_000)]
    start = time.monotonic()
    got = spark.createDataFrame([(v,), ([0.0, 0.0],), ([math.inf, 1.0],), ([3.0, None],), (None,)], "v array<double>").select(l2_normalise(F.col("v")).alias("u")).collect()
    assert time.monotonic() - start < 60
    assert np.allclose(got[0].u, np.array(v) / np.linalg.norm(v))
    assert [x.u for x in got[1:]] == [[0.0, 0.0], [math.inf, 1.0], [3.0, None], None]


def _clouds(r, n=400, d=24):
    rng = np.random.default_rng(r)
    centres = rng.standard_normal((9, d)) * 1.3
    return np.round(centres[rng.integers(0, 9, n)] + rng.standard_normal((n, d)), 4)


def test_similar_pairs(spark, monkeypatch):
    x = _clouds(4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(401, x[3].tolist()), (5, x[5].tolist()), (402, None), (403, [0.0] * 24), (404, [math.nan] * 24), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    u = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and i < 402}
    for least in (0.55, 0.9, -1.0):
        want = {(a, b): c for a in u for b in u if a < b and (c := round(float(u[a] @ u[b]), 9)) >= least}
        for part in (2048, 16):
            if part == 16 and least < 0:
                continue
            monkeypatch.setattr(inverted, "PART", part)
            got = inverted.similar_pairs(df, "id", "v", least).collect()
            assert {(r.a, r.b) for r in got} == set(want) and len(got) == len(want)
            assert all(abs(r.cos - want[r.a, r.b]) < 2e-9 for r in got)
    assert inverted.similar_pairs(df.limit(0), "id", "v", 0.5).count() == 0


def test_transfer_pairs(spark):
    goals = spark.createDataFrame([(i, [1.0, 0.05 * i]) for i in range(8)], "id long, v array<double>")
    counts = spark.createDataFrame([(0, 9), (1, 5), (2, 4), (3, 4), (4, 1)], "id long, n long")
    got = {(r.donor, r.recipient): r.coverage for r in matching.transfer_pairs(goals, "id", "v", counts, least=0.9, most=0).collect()}
    n = {0: 9, 1: 5, 2: 4, 3: 4, 4: 1, 5: 0, 6: 0, 7: 0}
    assert got == {(a, b): n[b] / 5 for a in n for b in n if n[a] > n[b] and n[b] < 5}
    best = matching.transfer_pairs(goals, "id", "v", counts, least=0.9, most=3).collect()
    v = {i: np.array([1.0, 0.05 * i]) / np.hypot(1, 0.05 * i) for i in n}
    nearest = sorted((-round(float(v[a] @ v[b]), 9), a, b) for a, b in got)[:3]
    assert [(r.donor, r.recipient) for r in best] == [(a, b) for _, a, b in nearest]
    assert matching.transfer_pairs(goals, "id", "v", counts, least=0.9, least_gap=4, most=0).where("donor = 1").count() == 4


def test_nearest_within(spark, monkeypatch):
    x = _clouds(7, 600)
    rows = [(i, f"o{i % 3}", v.tolist()) for i, v in enumerate(x)] + [(900, None, x[0].tolist()), (901, "o1", None)]
    chunks = spark.createDataFrame(rows, "id long, owner string, v array<double>")
    probes = [(i, f"o{(i + 1) % 4}", (x[i] + 0.3).tolist()) for i in range(0, 600, 10)] + [(1000, "o1", None), (1001, "o1", x[10].tolist()), (1002, None, x[2].tolist())]
    asked = spark.createDataFrame(probes, "probe long, owner string, vector array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for part in (2048, 8):
        monkeypatch.setattr(inverted, "PART", part)
        got = {r.probe: r for r in inverted.nearest_within(asked, chunks, "id", "v", "owner").collect()}
        assert len(got) == len(probes)
        for p, owner, v in probes:
            own = [i for i in range(600) if owner == f"o{i % 3}"] if v else []
            if not own:
                assert (got[p].top_sim, got[p].nearest, got[p].share_read) == (0.0, None, 0.0)
                continue
            s = np.round(u[own] @ (np.array(v) / np.linalg.norm(v)), 9)
            best = min(zip(-s, own))
            assert got[p].nearest == best[1] and abs(got[p].top_sim + best[0]) < 2e-9
        read = [r.share_read for r in got.values() if r.nearest is not None]
        assert sum(read) / len(read) < 0.6
    new = {r.probe: r.novel for r in novelty.novelty_probe(asked, chunks, "id", "v", "owner").collect()}
    assert not new[1001] and not new[1000] and new[next(p for p, o, _ in probes if o == "o3")]
    assert inverted.nearest_within(asked, chunks.limit(0), "id", "v", "owner").where("nearest IS NULL").count() == len(probes)


def test_probes_meet_blocks_and_not_lists(spark, monkeypatch):
    """No table on the way has more rows than probes and vectors; blocks of 50 give what one block does."""
    sizes = []

    def counted(df, name, keep=inverted.Saved):
        table = keep(df, name)
        sizes.append(table.df.count())
        return table

    monkeypatch.setattr(inverted, "Saved", counted)
    x = _clouds(9, 400)
    chunks = spark.createDataFrame([(i, f"o{i % 2}", v.tolist()) for i, v in enumerate(x)] + [(400, "o0", x[8].tolist())], "id long, owner string, v array<double>")
    asked = spark.createDataFrame([(i, f"o{(i + 1) % 2}", v.tolist()) for i, v in enumerate(x)] + [(408, "o0", x[8].tolist())], "probe long, owner string, vector array<double>")
    found = []
    for rows in (2048, 50):
        monkeypatch.setattr(inverted, "PART", rows)
        monkeypatch.setattr(inverted, "BLOCKS", 16)
        found.append({r.probe: (r.top_sim, r.nearest) for r in inverted.nearest_within(asked, chunks, "id", "v", "owner").collect()})
    assert max(sizes) <= 401
    assert found[0] == found[1] and len(found[0]) == 401 and found[0][408] == (1.0, 8)


def test_cluster_novelty(spark):
    df = spark.createDataFrame([(1, 10, ["A b", "a-b", "x"]), (2, 5, ["a B", ""]), (3, None, []), (4, 1, None)], "c long, n long, k array<string>")
    got = {r.c: r.novelty for r in novelty.cluster_novelty(df, "c", "n", "k").collect()}
    assert got == {1: round((0 + 1 - (2 / 4 + 1 / 4) / 2) / 2, 4), 2: round((0.5 + 0.5) / 2, 4), 3: 0.75, 4: round((0.9 + 0.5) / 2, 4)}
    assert novelty.cluster_novelty(df.where("c = 1"), "c", "n", "k").first().novelty == 0.5


def _matched(rows, partners, most=None):
    """The rule, row after row; rows (id, order, keys), partners (id, order, keys)."""
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))[:most]
    partners = sorted(partners, key=lambda p: (p[1], p[0]))
    by = [{}, {}, {}]
    for p in partners:
        for i in range(3):
            if p[2][i] is not None:
                by[i].setdefault(p[2][i], p[0])
    free, used, out = [p[0] for p in partners], set(), {}
    for r in rows:
        if all(k is None for k in r[2]):
            continue
        got = next(((by[i][r[2][i]], i + 1) for i in range(3) if r[2][i] is not None and r[2][i] in by[i]), (None, 4))
        while got[0] is None and free:
            c = free.pop(0)
            if c not in used:
                got = (c, 4)
        if got[0] is not None and got[0] not in used:
            used.add(got[0])
            out[r[0]] = got
        else:
            out[r[0]] = (None, None)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_unique_matches(spark, seed):
    r = random.Random(seed)
    key = lambda n, none: tuple(None if r.random() < none else r.randrange(n) for _ in range(3))
    rows = [(i, r.randrange(20), key(30, 0.6)) for i in range(r.choice((5, 60, 120)))]
    partners = [(1000 + i, r.randrange(9), key(60, 0.7)) for i in range(r.choice((0, 30, 90)))]
    frame = lambda some: spark.createDataFrame([(i, o, *k) for i, o, k in some], "id long, o long, x long, y long, z long")
    for most in (None, 25):
        got = matching.unique_matches(frame(rows), frame(partners).withColumnRenamed("id", "p"), "id", "p", ["-o"], ["o"], ["x", "y", "z"], most)
        assert {x.id: (x.p, x.tier) for x in got.collect()} == _matched(rows, partners, most)


def test_hierarchy(spark):
    x = _clouds(9, 90, 8)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, [0.0] * 8), (None, [1.0] * 8), (7, x[7].tolist())]
    got = hierarchy.hierarchy(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v").collect()
    at = {(r.level, r.node): r for r in got}
    assert len(at) == len(got) and {n for level, n in at if level == 0} == set(range(90))
    under = Counter()
    for i in range(90):
        level, node = 0, i
        under[level, node] += 1
        while at[level, node].parent is not None:
            level, node = level + 1, at[level, node].parent
            under[level, node] += 1
    assert {k: r.n_leaves for k, r in at.items()} == under
    kids = Counter((level + 1, r.parent) for (level, _), r in at.items() if r.parent is not None)
    assert all(r.n_children == kids[k] >= 2 for k, r in at.items() if k[0]) and max(level for level, _ in at) >= 2
    assert max(level for level, _ in {(r.level, r.node) for r in hierarchy.hierarchy(spark.createDataFrame(rows[:30], "id long, v array<double>"), "id", "v", most_levels=1).collect()}) == 1
    assert hierarchy.hierarchy(spark.createDataFrame([], "id long, v array<double>"), "id", "v").count() == 0


def test_sized_components(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (7, 8, 1.0), (9, 10, 1.0), (10, 11, 1.0)], EDGES)
    got = [(r.node, r.component, r["size"]) for r in hierarchy.sized_components(edges, None, 3).collect()]
    assert got == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (9, 9, 3), (10, 9, 3), (11, 9, 3)]
    assert graph.components(edges, spark.createDataFrame([(20,)], "node long")).where("node = 20").first().component == 20
