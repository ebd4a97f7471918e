"""Operators on one text at a time, against plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import license_scan as licences
from sparkloom.llm import attention, lm_score
from sparkloom.llm.packing import best_pattern, cutting_stock, pack
from sparkloom.llm.sharding import place, shard
from sparkloom.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_token_counts(spark, docs, rows, empty, sf, library):
    def check(df, rows):
        got = sorted(map(tuple, token_counts(df, PATH).collect()), key=str)
        want = []
        for i, t in rows:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            want.append((i, len((t or "").encode()), n, n > 1024))
        assert got == sorted(want, key=str)

    check(docs, rows)
    real = spark.read.parquet(f"{sf}/documents.parquet")
    check(real, [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()])
    assert token_counts(empty, PATH).count() == 0


def test_long_text_is_cut_at_safe_boundaries(spark, library):
    from sparkloom.llm import _tokens

    text = "Some words, and  more   blanks\n\n  here's 12 numbers " * 200
    before, _tokens.SEGMENT = _tokens.SEGMENT, 50
    try:
        assert _tokens.PieceEncoder(PATH, True).encode(text) == len(library.encode(text, add_special_tokens=False).ids)
        ids = np.frombuffer(_tokens.PieceEncoder(PATH, False).encode(text), dtype="<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
    finally:
        _tokens.SEGMENT = before


def test_packing(docs, rows, empty, library):
    got = pack(docs.where("doc_id IS NOT NULL"), PATH).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows if i is not None}
    of, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    assert of.keys() == ids.keys()
    for i, pieces in of.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(seqs) <= math.ceil(total / 2048) + 2
    assert pack(empty, PATH).count() == 0
    assert pack(docs, PATH).where("doc_id IS NULL").count() == 2


def test_cutting_stock():
    widths = np.array([3, 5, 7, 64, 100])
    value, pattern = best_pattern(widths, np.array([0.1, 0.2, 0.4, 2.0, 3.0]), 128)
    assert (pattern * widths).sum() <= 128 and math.isclose((pattern * np.array([0.1, 0.2, 0.4, 2.0, 3.0])).sum(), value)
    rng = np.random.default_rng(3)
    for _ in range(5):
        demand = rng.integers(0, 50, size=5)
        plan = cutting_stock(widths, demand, 128)
        assert (sum(p * n for p, n in plan) == demand).all() if plan else not demand.any()
        assert all((p * widths).sum() <= 128 for p, _ in plan)
        assert sum(n for _, n in plan) <= math.ceil((demand * widths).sum() / 128) * 1.4 + 5


def test_cutting_stock_against_the_optimum():
    """Few pieces, all ways to fill bins."""
    from functools import lru_cache
    from itertools import product

    rng = np.random.default_rng(9)
    more = 0
    for _ in range(12):
        widths = np.sort(rng.choice(np.arange(2, 12), size=3, replace=False))
        demand = rng.integers(1, 6, size=3)
        fits = [p for p in product(*(range(int(d) + 1) for d in demand)) if any(p) and np.dot(p, widths) <= 16]

        @lru_cache(maxsize=None)
        def least(left):
            return 0 if not any(left) else 1 + min(least(tuple(a - b for a, b in zip(left, p))) for p in fits if all(b <= a for a, b in zip(left, p)))

        used, best = sum(n for _, n in cutting_stock(widths, demand, 16)), least(tuple(int(d) for d in demand))
        assert best <= used <= best + 1
        more += used - best
    assert more <= 3


def test_sharding(docs, rows, empty):
    got = shard(docs, PATH).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(0 <= s < 8 and sorted(x) == list(range(len(x))) for s, x in slots.items())
    assert shard(empty, PATH).count() == 0


def test_sharding_balances(spark, sf):
    df = spark.createDataFrame([(i, ("same text " if i % 3 == 0 else f"text {i} ") * (i % 40 + 1 if i % 3 else 20)) for i in range(3000)], "doc_id long, text string")
    got = shard(df, PATH).groupBy("shard").agg({"size": "sum", "*": "count"}).collect()
    sizes, counts = [r["sum(size)"] for r in got], [r["count(1)"] for r in got]
    assert len(got) == 8 and max(sizes) <= 1.02 * min(sizes) and max(counts) <= 1.1 * min(counts)
    assert len(set(place(np.full((80, 3), 1 / 80), 8))) == 8


def test_groups_stay_together(spark, sf, monkeypatch):
    """Each group that fits a shard lies in one; places are those of a plain loop."""
    from sparkloom.llm import sharding

    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for part in (4096, 20):  # all groups on the driver; in parts by tasks
        monkeypatch.setattr(sharding, "PART", part)
        of = defaultdict(set)
        for r in shard(df, PATH).collect():
            of[texts[r.doc_id]].add(r.shard)
        assert all(len(x) == 1 for x in of.values())
    loads = np.random.default_rng(1).random((60, 3)) / 60
    left, want = np.full((4, 3), 0.25), {}
    for i in sorted(range(60), key=lambda i: (-max(loads[i]), i)):
        dots = [sum(a * b for a, b in zip(left[s], loads[i])) for s in range(4)]
        want[i] = dots.index(max(dots))
        left[want[i]] -= loads[i]
    assert place(loads, 4).tolist() == [want[i] for i in range(60)]


def test_license_spans_are_verified(spark):
    say = lambda i, t: (i, f"Some text before. {t} And some after it.")
    rows = [
        say(1, "This is licensed under the GNU General Public License, either version 3 or later."),
        say(2, "not licensed under the gnu general public license version 2"),
        say(3, "SPDX-License-Identifier: Apache-2.0"),
        say(4, "GNU Affero General Public License, version 3"),
        say(5, "the gnu general public license is a text about which version 3 people talk"),
        say(6, "Redistribution and use in source and compiled binary forms, with or without modification, are permitted provided that the following conditions are met"),
        (7, None),
    ]
    got = {r.doc_id: r for r in licences.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 8)] == ["gpl-3", "gpl-2", "apache-2", "agpl-3", "", "bsd", ""]
    assert got[2].score == 1 and 0.8 < got[6].score < 1


def _scan(text: str):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER)) if w]
    places, labels = [], set()
    for phrase, label in licences.BASE:
        p = phrase.split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark, docs, rows, empty, sf):
    def check(df, rows):
        got = licences.license_scan(df).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *_scan(t or "")) for i, t in rows), key=str)
        for r in got:
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        return {r.doc_id: r for r in got}

    found = check(docs, rows)
    assert found[81].labels == "mit" and found[81].n_base == 0  # a passage with a word left out
    assert found[70].n_words == 0 and found[70].labels == "" and found[70].score == 0
    real = spark.read.parquet(f"{sf}/documents.parquet")
    check(real, [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()])
    assert licences.license_scan(empty).count() == 0


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER)) + [None]


def test_lm_scores(spark, sf, docs, rows, empty):
    def check(df, rows):
        got = lm_score.lm_scores(df, PATH).collect()
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        c = Counter(x for i, t in rows if not held(i) for x in _tokens(t or ""))
        n, v = sum(c.values()), len(c)
        want = defaultdict(list)
        for i, t in rows:
            own = _tokens(t or "")
            want[i].append((len(own), sum(c[x] > 0 for x in own), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own), 6)))
        seen = defaultdict(list)
        for r in got:
            seen[r.doc_id].append((r.n_tokens, r.n_known, round(r.base_score, 6)))
            assert r.train_tokens == n and r.held_out == held(r.doc_id) and math.isfinite(r.score) and r.score < 0
        assert {k: sorted(x) for k, x in seen.items()} == {k: sorted(x) for k, x in want.items()}
        return got

    check(docs, rows)
    real = spark.read.parquet(f"{sf}/documents.parquet")
    got = check(real, [(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()])
    # better than the shares of subword ids alone, by far
    ids = [(r.held_out, np.frombuffer(lm_score.encoder(PATH, False).encode((t or "").encode().lower().decode()), "<u4")) for r, (_, t) in zip(sorted(got, key=lambda r: r.doc_id), sorted((r.doc_id, r.text) for r in real.select("doc_id", "text").collect()))]
    c = sum(np.bincount(x, minlength=50257) for held, x in ids if not held)
    plain = sum(np.log10((c[x] + 0.5) / (c.sum() + 0.5 * len(c))).sum() for held, x in ids if held)
    assert sum(r.score for r in got if r.held_out) > 0.8 * plain
    assert lm_score.lm_scores(empty, PATH).count() == 0


def test_score_grows_with_the_ids_of_an_unseen_word(spark, library):
    """A long unbroken string costs as much as its ids, not one unseen word."""
    ids = iter(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 5 == 1)
    short, long = next(ids), next(ids)
    junk = "".join(np.random.default_rng(2).choice(list("abcdefghijklmnopqrstuvwxyz0123456789+/"), size=4000))
    rows = [(i, "some common words stand here and there again") for i in range(60)] + [(short, junk[:40]), (long, junk)]
    got = {r.doc_id: r for r in lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert math.isclose(got[short].base_score, got[long].base_score)
    n = len(library.encode(junk, add_special_tokens=False).ids)
    assert got[long].score < -0.5 * n and got[long].score < 20 * got[short].score


def _followers(texts):
    """As tasks count and sum them."""
    import pyarrow as pa

    table = np.arange(1 << 16) % attention.END
    batch = pa.RecordBatch.from_arrays([pa.array([t.astype("<u2").tobytes() for t in texts], pa.binary())], ["ids"])
    rows = list(lm_score._follower_rows(table)(iter([batch, batch])))
    counts = np.zeros((attention.INPUTS, attention.CLASSES), dtype=np.int64)
    for r in (r for b in lm_score._summed(iter([*rows, *rows])) for r in b.to_pylist()):
        assert not counts[r["x"]].any()
        counts[r["x"]] = np.frombuffer(r["c"], "<i8")
    return counts, attention.Followers(counts)


def _random_net(followers, seed=5):
    rng = np.random.default_rng(seed)
    return attention.Net({k: x.astype(np.float64) + rng.standard_normal(x.shape) * 0.2 for k, x in attention.start_params().items()}, followers)


def test_what_follows_is_counted():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 30, size=n) for n in (0, 1, 5, 60)]
    counts, _ = _followers(texts)
    want = Counter()
    for t in texts:
        line = [attention.START, *t.tolist(), attention.END]
        want.update({k: 4 * c for k, c in Counter(zip(line, line[1:])).items()})
    assert {(x, y): int(counts[x, y]) for x, y in zip(*np.nonzero(counts))} == want


def test_probabilities_sum_to_one_and_match_a_plain_loop():
    """Each token by a loop over the inputs in its sight; all classes after some texts."""
    rng = np.random.default_rng(5)
    texts = [np.append(rng.integers(0, 40, size=n), attention.END) for n in (3, 20, 70, 0, 200)]
    counts, followers = _followers([t[:-1] for t in texts])
    net = _random_net(followers)
    p, w = net.p, attention.WIDTH
    got = net.logs(*attention.blocks(texts))
    assert len(got) == sum(map(len, texts))
    assert np.allclose(got, net.logs(*attention.blocks(texts), tokens=32), rtol=1e-9)  # however it is cut
    shares = (counts.sum(axis=0) + 0.5) / (counts.sum(axis=0) + 0.5).sum()

    def chances(inputs):
        """Of all classes after a text's inputs so far."""
        i = len(inputs) - 1
        first = max(0, i // attention.BLOCK * attention.BLOCK - attention.BLOCK)
        rows = p["t"][inputs]
        a = np.array([rows[i, :w] @ rows[j, w : 2 * w] / math.sqrt(w) + p["near"][i - j] for j in range(first, i + 1)])
        a = np.exp(a - a.max())
        z = (a / a.sum()) @ rows[first : i + 1, 2 * w : 3 * w]
        h = np.maximum(rows[i, 3 * w :] + z @ p["z"], 0)
        mass = counts[inputs[-1]] + attention.SMOOTH * shares
        groups = mass.reshape(attention.GROUPS, -1)
        outer = np.exp(h @ p["o"] + p["ob"] + p["g"][0] * np.log(groups.sum(axis=1) / mass.sum()))
        inner = np.exp(np.stack([h @ p["m"][k] + p["mb"][k] + p["g"][1] * np.log(groups[k] / groups[k].sum()) for k in range(attention.GROUPS)]))
        return (outer[:, None] / outer.sum() * inner / inner.sum(axis=1, keepdims=True)).ravel()

    at = 0
    for t in texts:
        line = [attention.START, *t.tolist()]
        for k in range(len(t)):
            if k < 3 or k % 7 == 0 or k + 1 == len(t):
                all_ = chances(line[: k + 1])
                assert math.isclose(all_.sum(), 1, rel_tol=1e-9)
                assert math.isclose(got[at + k], math.log(all_[t[k]]), rel_tol=1e-4)
        at += len(t)
    # ids within their classes
    counts = np.zeros(50257)
    counts[:3000] = np.arange(3000)[::-1]
    table, within = lm_score.id_classes(counts)
    assert np.allclose(np.bincount(table, weights=np.exp(within)), 1) and table.max() < attention.END
    assert len(set(table[table < attention.END - lm_score.RARE])) == attention.END - lm_score.RARE


def test_blocks():
    rng = np.random.default_rng(1)
    texts = [np.append(rng.integers(0, 50, size=n), attention.END) for n in (0, 15, 16, 50)]
    x, y, goes_on = attention.blocks(texts)
    assert y[y >= 0].tolist() == np.concatenate(texts).tolist()  # each token once
    assert goes_on.tolist() == [False, False, False, True, False, True, True, True]
    assert (x == attention.START).sum() == 4 and x[:, 0].tolist()[:3] == [attention.START] * 3 and (y[x == attention.PAD] == -1).all()
    parts = list(attention.portions(x, y, goes_on, 32))
    assert np.concatenate([p[1][p[1] >= 0] for p in parts]).tolist() == y[y >= 0].tolist() and len(parts) == 4
    assert attention.blocks([])[0].shape == (0, attention.BLOCK)


def test_gradients_and_training():
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(0, 50, size=n), attention.END) for n in (0, 16, 17, 50)]
    _, followers = _followers([t[:-1] for t in texts])
    net, parts = _random_net(followers), attention.blocks(texts)
    loss, grad = net.gradients(*parts)
    for name, x in net.p.items():
        for _ in range(6):
            i = tuple(rng.integers(0, n) for n in x.shape)
            i = (int(rng.integers(0, 50)), *i[1:]) if name == "t" else (int(rng.integers(0, 2)), *i[1:]) if name in ("m", "mb") else i
            kept, ends = x[i], []
            for d in (1e-5, -1e-5):
                x[i] = kept + d
                ends.append(net.gradients(*parts)[0])
            x[i] = kept
            assert math.isclose((ends[0] - ends[1]) / 2e-5, grad[name][i], rel_tol=1e-3, abs_tol=1e-7), name
    # targets are left out of the counts while training, so the loss is above the score's
    assert loss > -net.logs(*parts).mean()
    # a rule that only a look further back can tell: the fifth last class comes again
    rule = []
    for _ in range(150):
        t = rng.integers(0, 12, size=5).tolist()
        while len(t) < 60:
            t.append(t[-5])
        rule.append(np.append(t, attention.END))
    _, followers = _followers([t[:-1] for t in rule])
    trainer = attention.Trainer(attention.start_params(), followers)
    before = -trainer.net.logs(*attention.blocks(rule[100:])).mean()
    for _ in range(25):
        trainer.fit(rule[:100], 1024)
    assert -trainer.net.logs(*attention.blocks(rule[100:])).mean() < 0.5 * before


def test_gradients_in_parts_and_logits_far_apart():
    """A step works on a few tokens at a time: its gradients are those of the
    whole. Logits whose exponentials no number holds give finite scores."""
    rng = np.random.default_rng(3)
    texts = [np.append(rng.integers(0, 50, size=n), attention.END) for n in (0, 16, 90, 300)]
    _, followers = _followers([t[:-1] for t in texts])
    net, parts = _random_net(followers), attention.blocks(texts)
    loss, grad = net.gradients(*parts, 1 << 20)
    for tokens in (16, 48):
        part_loss, part_grad = net.gradients(*parts, tokens)
        assert math.isclose(loss, part_loss, rel_tol=1e-9)
        assert set(grad) == set(attention.SHAPES) and all(np.allclose(grad[k], part_grad[k], rtol=1e-7, atol=1e-12) for k in grad)
    net.p["o"], net.p["m"], net.p["t"] = net.p["o"] * 300, net.p["m"] * 300, net.p["t"] * 20
    far = net.logs(*parts)
    short = attention.Net({k: x.astype(np.float32) for k, x in net.p.items()}, followers).logs(*parts)
    assert far.min() < -1000 and np.isfinite(far).all() and np.allclose(short, far, rtol=1e-3, atol=0.1)


def test_training_reaches_every_text_once(spark, monkeypatch):
    rows = [(i, np.full(i % 7 + 1, i % 500, dtype="<u2").tobytes()) for i in range(300)] + [(None, b""), (900, np.arange(9000, dtype="<u2").tobytes())]
    df = spark.createDataFrame(rows, "id long, ids binary").repartition(3)
    met = spark.sparkContext.accumulator(0)

    def counting(start, table, followers):
        def local(batches):
            for batch in batches:
                met.add(sum(len(x) // 2 + 1 for x in batch.column("ids").to_pylist()))
            return iter(())

        return local

    table = np.arange(1 << 16) % attention.END
    followers = lm_score.count_followers(df, table)
    tokens = sum(len(b) // 2 + 1 for _, b in rows)
    assert followers.counts.sum() == tokens
    shared = spark.sparkContext.broadcast(followers)
    params = lm_score.train(df, table, shared)
    start = attention.start_params()
    assert all(params[k].shape == start[k].shape and np.isfinite(params[k]).all() for k in start) and any((params[k] != start[k]).any() for k in start)
    monkeypatch.setattr(lm_score, "_local", counting)
    assert all((a == b).all() for a, b in zip(lm_score.train(df, table, shared).values(), start.values()))
    assert met.value == tokens


def test_repeated_rows_and_unseen_words(spark):
    """Rows that repeat an id count and are scored as often as they stand; a word met only in held-out texts."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    free = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1)
    rows = [(free, "one two"), (free, "one two"), (free, "three"), (held, "zzz zzz one zzz"), (held, "zzz zzz one zzz"), (None, "two")]
    got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    c = Counter("one two END one two END three END two END".split())
    base = lambda ws: sum(math.log10((c[w] + 0.5) / (10 + 0.5 * 5)) for w in ws)
    want = [(free, False, 3, 3, 10), (free, False, 3, 3, 10), (free, False, 2, 2, 10), (held, True, 5, 2, 10), (held, True, 5, 2, 10), (None, False, 2, 2, 10)]
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got), key=str) == sorted(want, key=str)
    assert {round(r.base_score, 9) for r in got if r.doc_id == held} == {round(base(["zzz"] * 3 + ["one", "END"]), 9)}
    assert len({round(r.score, 4) for r in got if r.doc_id == held}) == 1
