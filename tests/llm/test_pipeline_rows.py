"""The whole pipeline's rows against plain Python, stage after stage."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

import corpus_pipeline
from sparkloom.llm._tokens import encoder
from sparkloom.llm.langid import fit
from sparkloom.llm.queries import BYTE_BPE

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BACKGROUND, NEAR = 0.01, 8


def _languages(rows, model):
    """Keep rows whose best language has at least half: text, host (source) prior
    smoothed towards the prior of all rows, no suffix and no declaration."""
    n = len(model.languages)
    ll, count = model.score(pa.array([r["text"] or "" for r in rows]))
    soft = lambda v: (lambda e: e / e.sum())(np.exp(v - v.max()))
    post = [soft(np.append(v[:n], v[n] + math.log(BACKGROUND * n)))[:n] if c else np.zeros(n) for v, c in zip(ll, count)]
    overall = (sum(post) + 1) / (sum(post).sum() + n)
    host = defaultdict(lambda: np.zeros(n))
    for r, p in zip(rows, post):
        host[r["source"]] += p
    kept = []
    for r, v, c in zip(rows, ll, count):
        h = host[r["source"]]
        prior = (h + NEAR * overall) / (h.sum() + NEAR) if r["source"] is not None else overall
        p = soft(np.append(v[:n] + np.log(prior), v[n] + math.log(BACKGROUND)))[:n]
        if c and p.max() >= 0.5:
            kept.append(r)
    return kept


def _near(rows):
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(LOWER))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def _repeats(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(s)
        left = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore") if any(gone) else r["text"]
        if left and left.strip(" "):
            out.append({**r, "text": left, "n_chars": len(left)})
    return out


def _leaks(rows, items):
    shingles = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))(re.findall(r"[^\W_]+", (t or "").lower()))
    asked = [s for s in map(shingles, items) if s]
    return [r for r in rows if not any(100 * len(s & own) >= 75 * len(s) for own in [shingles(r["text"])] for s in asked)]


def test_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    counts = [len(rows)]
    for stage in (lambda x: _languages(x, fit(docs)), _near, _repeats, lambda x: _leaks(x, items)):
        rows = stage(rows)
        counts.append(len(rows))
    assert counts == sorted(counts, reverse=True) and counts[1] > counts[2] and counts[-1] > 50, counts
    of = encoder(BYTE_BPE, False)
    ids = {r["doc_id"]: np.frombuffer(of.encode(r["text"]), "<u4").tolist() + [1] for r in rows}
    got = defaultdict(list)
    sequences = defaultdict(int)
    for r in corpus_pipeline.run(spark, sf).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        got[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id] += r.length
    assert got.keys() == ids.keys()
    for i, pieces in got.items():
        assert sum(n for _, n in pieces) == len(ids[i]) and [s for s, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1].tolist()
    assert max(sequences.values()) <= 2048
