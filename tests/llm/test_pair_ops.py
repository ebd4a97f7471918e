"""Operators over pairs of texts or vectors, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from sparkloom.llm import queries
from sparkloom.llm.decontam import contamination
from sparkloom.llm.langid import fit, identify, page_evidence
from sparkloom.llm.near_dedup import near_duplicates
from sparkloom.llm.suffix_dedup import remove_repeats, without_repeats
from sparkloom.llm.topk import top_k

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def real_rows(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def _near(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def test_near_duplicates(spark, sf, docs, rows, empty):
    named = [(i, t) for i, t in rows if i is not None]
    got = near_duplicates(docs).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == _near(named)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    df, real = real_rows(spark, sf)
    assert sorted(map(tuple, near_duplicates(df).collect())) == _near(real)
    assert near_duplicates(empty).count() == 0
    twice = near_duplicates(docs.unionByName(docs.where("doc_id > 80"))).where("doc_id IS NOT NULL")
    assert sorted(set(map(tuple, twice.collect()))) == _near(named)


def test_near_duplicates_of_large_groups(spark):
    """Two groups that share most buckets but aren't linked to each other's ends."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(150):
        w = base + [word() for _ in range(r.choice((2, 8, 14, 19, 24)))]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(df).collect())) == _near(rows)


def _repeats(rows):
    seen, out = set(), []
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\1" * 100
            else:
                seen.add(s)
        rest = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2000, 3])
def test_remove_repeats(spark, sf, docs, rows, empty, hot, monkeypatch):
    from sparkloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = remove_repeats(docs).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == _repeats([x for x in rows if x[0] is not None])
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    if hot == 2000:
        df, real = real_rows(spark, sf)
        assert sorted(map(tuple, remove_repeats(df).collect())) == _repeats(real)
        assert remove_repeats(empty).count() == 0 and without_repeats(empty).count() == 0
        kept = {r.doc_id: r.text for r in without_repeats(docs).collect()}
        assert kept[70] is None and kept[71] == "" and kept[11] == "" and without_repeats(docs).columns == docs.columns


def test_remove_repeats_of_one_gram_in_many_contexts(spark, monkeypatch):
    """A line of 60 bytes in 3000 different places, a letter a million times, and rows that repeat an id."""
    from sparkloom.llm import suffix_dedup

    r = random.Random(8)
    say = lambda n: "".join(r.choices("abcdefgh ", k=n))
    line = say(60)
    tails = [say(45) for _ in range(40)]
    rows = [(i, f"{say(20)}{r.choice(tails)}{line}{r.choice(tails)}{say(30)}") for i in range(3000)]
    got = sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == _repeats(rows) and sum(x[2] > 0 for x in got) > 500
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    assert sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())) == got
    long = [(1, "x" * 1_000_000), (2, "y" * 99 + "x" * 150 + "z" * 100)]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in remove_repeats(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert got == {1: (999_999, 1), 2: (150, 1)}
    twice = rows[:50] + rows[:50] + [(7, say(300)), (8, rows[3][1])]
    got = remove_repeats(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert len(got) == len(twice)
    by = Counter((x.doc_id, x.kept_sha256) for x in got)
    assert all(by[i, next(h for d, h in by if d == i)] >= 2 for i in range(50) if i not in (7, 8))


def test_anchors_of_long_texts_in_pieces(spark, monkeypatch):
    from sparkloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "_RUN", 700)
    r = random.Random(5)
    say = lambda n: "".join(r.choices("abcde ", k=n))
    part = say(900)
    rows = [(1, say(1500) + part), (2, part + say(300) + part[:400]), (3, say(50)), (4, say(800) + part[100:850] + "é" * 60)]
    import numpy as np
    import pyarrow as pa

    from sparkloom.llm._bytes import text_bytes

    text, lo, hi, *_ = suffix_dedup.anchors(*text_bytes(pa.array([t for _, t in rows])))
    starts = sorted((int(t), int(s)) for t, a, b in zip(text, lo, hi) for s in range(a, b + 1))
    assert starts == [(k, s) for k, (_, t) in enumerate(rows) for s in range(len(t.encode()) - 99)]
    assert np.all(hi >= lo)


def _shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_contamination(spark, sf, docs, empty):
    df, real = real_rows(spark, sf)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, _shingles(r.text)) for r in bench.collect()]
    want = sorted((i, b, len(s), n) for i, t in real for d in [_shingles(t)] for b, s in items if s and 100 * (n := len(s & d)) >= 75 * len(s))
    assert want and sorted(map(tuple, contamination(df, bench).collect())) == want
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f g"), (3, "one"), (4, "changed a b c d e f")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contamination(docs, odd).collect()} == {(73, 3), (74, 3)}
    assert contamination(empty, bench).count() == 0 and contamination(df, odd.limit(0)).count() == 0


def test_language(spark, sf, docs, empty):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    even, odd = df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1")
    none = "CAST(NULL AS string)"
    rows = odd.selectExpr("doc_id", "lang AS truth", "text", "source AS host", f"{none} AS suffix", f"{none} AS declared")
    got = {r.doc_id: r for r in identify(rows, fit(even), ["doc_id"]).collect()}
    truth = {r.doc_id: r.truth for r in rows.collect()}
    kept = [i for i, r in got.items() if not r.rejected]
    assert len(got) == len(truth) and sum(got[i].lang == truth[i] for i in kept) >= 0.95 * len(kept) and len(kept) > 0.8 * len(got)
    odd_rows = docs.selectExpr("doc_id", "text", "source AS host", f"{none} AS suffix", f"{none} AS declared")
    found = {r.doc_id: r for r in identify(odd_rows, fit(even), ["doc_id"]).collect()}
    assert all(found[i].rejected and found[i].lang == "und" for i in (70, 71, 72))
    assert identify(odd_rows.limit(0), fit(empty), ["doc_id"]).count() == 0
    assert {r.lang for r in identify(odd_rows, fit(empty), ["doc_id"]).collect()} == {"und"}


def test_trigram_counts_against_a_plain_loop(spark, sf):
    """Counts of whole texts' trigrams by label, and a text's log-likelihoods from them."""
    import numpy as np
    import pyarrow as pa

    from sparkloom.llm import langid

    rows = [(i, r.text, r.lang) for i, r in enumerate(spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect())]
    rows += [(100, "ab ab  Ünï", "xx"), (101, "a", "xx"), (102, None, "xx"), (103, "abc", None), (104, "word " * 30_000 + "tail", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)

    def buckets(text):
        c = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
        c = [b if b >= 128 or 97 <= b <= 122 else 32 for b in c]
        return [(c[k] * 7919 + c[k + 1] * 263 + c[k + 2]) * 40503 % langid.BUCKETS for k in range(len(c) - 2) if c[k + 1] != 32]

    languages = sorted({lang for _, t, lang in rows if lang and t is not None})
    counts = np.zeros((langid.BUCKETS, len(languages)))
    for _, t, lang in rows:
        for b in buckets(t) if t is not None and lang else ():
            counts[b, languages.index(lang)] += 1
    model = fit(df)
    assert list(model.languages) == languages and np.allclose(model.table, langid.likelihoods(counts))
    texts = ["ab ab  Ünï", "", rows[3][1], "word tail"]
    got, n = model.score(pa.array(texts))
    for k, t in enumerate(texts):
        found = buckets(t)
        assert n[k] == len(found)
        if found:
            assert np.allclose(got[k], model.table[found].sum(axis=0) * min(len(found), langid.ENOUGH) / len(found))


def test_language_evidence(spark):
    """Declared language and host tip the scales where a text says little."""
    learn = spark.createDataFrame([(i, "the house and the garden" if i % 2 else "das haus und der garten", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    rows = [(i, "das haus und der garten", "h.de", "de", "de") for i in range(30)] + [(i, "the house and the garden", "h.com", "com", "en") for i in range(30, 60)]
    rows += [(100, "qxz", "h.de", "de", None), (101, "qxz", "h.com", "com", None), (102, "qxz", None, None, "de"), (103, "qxz", "new.de", "de", None), (104, "qxz", None, "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, suffix string, declared string")
    got = {r.doc_id: r.lang for r in identify(df, fit(learn), ["doc_id"]).collect()}
    assert [got[i] for i in range(100, 105)] == ["de", "en", "de", "de", "de"]
    page = spark.createDataFrame([(1, "https://u@A.example.DE:80/x", "<html lang='de-AT'><script>no</script>Hallo &amp; <b>Welt</b>"), (2, None, None)], "page_id long, url string, html string")
    got = page_evidence(page).orderBy("page_id").collect()
    assert (got[0].host, got[0].suffix, got[0].declared, got[0].text.split()) == ("a.example.de", "de", "de", ["Hallo", "Welt"])
    assert got[1].host is None and got[1].suffix is None and got[1].declared is None


def test_language_fusion_against_a_plain_loop(spark, sf):
    """Posteriors, host, suffix and declaration tables row by row in Python."""
    import numpy as np
    import pyarrow as pa

    from sparkloom.llm.langid import BACKGROUND

    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(df)
    r = random.Random(6)
    texts = [x.text for x in df.limit(60).collect()]
    rows = [(i, t if i % 7 else (None if i % 2 else "12 34"), r.choice(["a", "b", None]), r.choice(["de", "fr", None]), r.choice(["de", "en", None])) for i, t in enumerate(texts)]
    rows += rows[:5]  # repeated rows count as often as they stand
    frame = spark.createDataFrame(rows, "doc_id long, text string, host string, suffix string, declared string")
    got = sorted((x.doc_id, x.lang, round(x.probability, 6), x.rejected) for x in identify(frame, model, ["doc_id"]).collect())

    n = len(model.languages)
    ll, count = model.score(pa.array([x[1] or "" for x in rows]))
    soft = lambda v: (lambda e: e / e.sum())(np.exp(v - v.max()))
    post = [soft(np.append(v[:n], v[n] + math.log(BACKGROUND * n)))[:n] if c else np.zeros(n) for v, c in zip(ll, count)]
    total = sum(post)
    overall = (total + 1) / (total.sum() + n)
    add = lambda keep: sum((p for p, x in zip(post, rows) if keep(x)), np.zeros(n))
    near = lambda c, towards: (c + 8 * towards) / (c.sum() + 8)
    suffixes = {k: near(add(lambda x: x[3] == k), overall) for k in ("de", "fr")}
    above = {h: max((tuple(suffixes[x[3]]) for x, c in zip(rows, count) if x[2] == h and x[3] and c), default=tuple(overall)) for h in ("a", "b")}
    hosts = {h: near(add(lambda x: x[2] == h), np.array(above[h])) for h in ("a", "b")}
    said = add(lambda x: x[4] is not None)
    like = {k: (add(lambda x: x[4] == k) + 8 * add(lambda x: x[4] == k).sum() / said.sum()) / (said + 8) for k in ("de", "en")}
    want = []
    for x, v, c in zip(rows, ll, count):
        prior = hosts.get(x[2], suffixes.get(x[3], overall))
        d = like.get(x[4])
        p = soft(np.append(v[:n] + np.log(prior) + (np.log(d) if d is not None else 0), v[n] + math.log(BACKGROUND) + (math.log((d * overall).sum()) if d is not None else 0)))[:n]
        want.append((x[0], model.languages[int(p.argmax())], round(float(p.max()), 6), bool(p.max() < 0.5)) if c else (x[0], "und", 0.0, True))
    assert got == sorted(want)


def test_language_of_unlabelled_text_is_rejected(spark, sf):
    """Text in an unlabelled language and random letters; class size is no bonus."""
    df = spark.read.parquet(f"{sf}/documents.parquet")
    r = random.Random(4)
    rows = [(1, "我们今天在公园里散步然后回家吃晚饭天气很好大家都很高兴" * 8), (2, "Сегодня мы гуляли в парке, а потом вернулись домой и поужинали. " * 5)]
    rows += [(3 + k, " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(60))) for k in range(5)]
    texts = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'h' AS host", "CAST(NULL AS string) AS suffix", "CAST(NULL AS string) AS declared")
    got = {x.doc_id: x for x in identify(texts, fit(df), ["doc_id"]).collect()}
    assert all(x.rejected and x.probability < 0.5 for x in got.values()), got
    learn = [(i, ("alpha beta gamma delta " * (400 if i % 2 else 1)), "large" if i % 2 else "small") for i in range(20)]
    table = fit(spark.createDataFrame(learn, "doc_id long, text string, lang string")).table
    assert abs(table[table[:, 0].argmin(), 0] - table[table[:, 1].argmin(), 1]) < 1e-9


def _best(vectors, queries, k):
    v = {i: [math.floor(64 * x) for x in e] for i, e in vectors if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in queries:
        if q in v:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_top_k(spark, sf, monkeypatch):
    from sparkloom.llm import topk

    r = random.Random(2)
    vectors = [(i, [r.choice((-1.0, -0.5, 0.0, 0.3, 1.0)) for _ in range(6)]) for i in range(150)]
    vectors += [(i, vectors[4][1]) for i in range(150, 190)] + [(200, None), (220, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (240, [math.nan] + [0.0] * 5), (260, [math.inf] + [0.0] * 5), (None, [0.1] * 6)]
    df = spark.createDataFrame([(i, e, "x") for i, e in vectors], "vec_id long, embedding array<float>, score string")
    f32 = lambda x: x if x is None or not math.isfinite(x) else __import__("numpy").float32(x).item()
    want = _best([(i, e and [f32(x) for x in e]) for i, e in vectors], range(0, 300, 20), 20)
    for block, group in ((4096, 4096), (16, 4)):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "QUERIES", group)
        assert sorted(map(tuple, top_k(df, df.where("vec_id % 20 = 0")).collect())) == want
    assert top_k(df.limit(0), df.limit(0)).count() == 0


def test_threshold_stops_early():
    """Of skewed vectors few are scored, and the result is that of all."""
    import numpy as np

    from sparkloom.llm.topk import SortedLists

    rng = np.random.default_rng(3)
    whole = np.floor(64 * rng.standard_normal((4000, 4)) * (rng.pareto(1.0, size=(4000, 1)) + 0.01)).astype(np.int64)
    lists = SortedLists(np.arange(4000), whole)
    counts = []
    for i in range(0, 200, 20):
        ids, scores, scored = lists.top(whole[i], i, 20)
        all_scores = whole @ whole[i]
        want = sorted((-int(x), j) for j, x in enumerate(all_scores) if j != i)[:20]
        assert list(zip((-scores).tolist(), ids.tolist())) == want
        counts.append(scored)
    assert max(counts) < 4000 and sum(counts) < 2000 * len(counts)


def test_top_k_of_large_components_and_repeated_ids(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e15, 1.0]), (2, [2.0, 1.0]), (3, [0.5, 0.5]), (3, [4.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in sorted(top_k(df, df.where("vec_id = 0")).collect(), key=lambda r: r["rank"])]
    assert got == [(1, 64 * 64 * 10**15 + 4096), (3, 32768), (2, 12288), (3, 4096)]


def test_top_k_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = defaultdict(list)
    assert sorted(map(tuple, queries.op2_topk(spark, sf).collect())) == sorted(con.execute(queries.ORACLE["op2_topk"]).fetchall())
    assert not want
