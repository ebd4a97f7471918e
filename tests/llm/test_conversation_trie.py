"""The conversation trie against plain Python and SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import conversation_trie as module
from sparkloom.llm import queries
from sparkloom.llm.conversation_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos string, n_convs string"


def _turns(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            who, said = role or "", text or ""
            digest = hashlib.sha256(f"{len(who.encode())}:{who}{said}".encode()).digest()[:16]
            found[c].append(((turn is not None, turn or 0), digest, (who, said)))
    return {c: [x for *_, x in sorted(t)] for c, t in found.items()}


def _rebuilt(own):
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + t[h:]
    return out


def _nodes(convs):
    """By the definition, over all prefixes."""
    if not convs:
        return []
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(13)
    say = lambda: r.choice(["ja", "no", "", None, "日本語", "a b"])
    rows = []
    for c in [*range(0, 230), *range(500, 540), -5, -100, -101, 1 << 40]:
        n = r.choice((0, 1, 1, 2, 3, 5, 8))
        rows += [(c, r.choice((t, t, None)), r.choice(("user", "user", None)), say()) for t in range(n)]
    rows += [(700 + i, t, "user", f"same {t}") for i in range(60) for t in range(9)]  # copies
    rows += [(800 + i, t, "user", "hot" if t < 4 else f"{i % 7} {t}") for i in range(90) for t in range(4 + i % 5)]
    rows += [(950 + i, t, "user", f"long {t}" if t < 90 else f"{i} {t}") for i in range(4) for t in range(100 + i)]
    return rows + [(None, 0, "user", "nobody"), (7, 3, "user", "twice"), (7, 3, "user", "twice")]


@pytest.mark.parametrize("group,task,span", [(2000, 4000, 512), (30, 100, 3), (6, 50, 64)])
def test_trie(spark, odd_rows, group, task, span, monkeypatch):
    for name, value in (("GROUP", group), ("TASK", task), ("SPAN", span)):
        monkeypatch.setattr(module, name, value)
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in odd_rows], SCHEMA).repartition(3)
    own = _turns(odd_rows)
    conv = F.col("conv")
    if span != 3:
        got = conversation_trie(df, conv - conv % 100, F.crc32(conv.cast("string")) % 6, 5).collect()
        assert sorted(map(tuple, got), key=str) == _nodes(_rebuilt(own))
    if span != 512:
        assert sorted(map(tuple, conversation_trie(df).collect()), key=str) == _nodes(own)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert conversation_trie(df).count() == 0
    one = spark.createDataFrame([(-3, None, None, None, "a", "b", "c")], SCHEMA)
    assert sorted(map(tuple, conversation_trie(one).collect()), key=str) == _nodes(_turns([(-3, None, None, None)]))


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(con.execute(queries.ORACLE["op13_conversation_trie"]).fetchall(), key=str)
    names = [c[0] for c in con.description]
    got = queries.op13_conversation_trie(spark, sf).select(*names)
    assert sorted(map(tuple, got.collect()), key=str) == want
    own = _turns([tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    assert want == _nodes(_rebuilt(own))
