"""Rows that repeat an id, with the same text and with another, and very long texts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from sparkloom.llm.decontam import contamination
from sparkloom.llm.license_scan import license_scan
from sparkloom.llm.near_dedup import near_duplicates
from sparkloom.llm.packing import pack
from sparkloom.llm.queries import BYTE_BPE as PATH
from sparkloom.llm.sharding import shard
from sparkloom.llm.token_counts import token_counts

R = random.Random(31)


def say(n):
    return " ".join("".join(R.choices("abcdefgh", k=R.randint(2, 7))) for _ in range(n))


ONE, TWO, THREE, ITEM = say(60), say(60), say(60), say(30)
#: 1 twice alike; 2 with the texts of 3 and of 4; 5 with a benchmark item in the second of its texts.
ROWS = [(1, ONE), (1, ONE), (2, TWO), (2, THREE), (3, TWO), (4, THREE), (5, say(20)), (5, f"{say(10)} {ITEM} under the MIT license"), (6, say(40))]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def test_near_duplicates(df):
    got = near_duplicates(df).collect()
    assert len(got) in (len(ROWS), 6)  # a row each, or one a document
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by == {1: {(1, True)}, 2: {(2, True)}, 3: {(2, False)}, 4: {(2, False)}, 5: {(5, True)}, 6: {(6, True)}}


def test_contamination(spark, df):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, say(30)), (3, ITEM)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in contamination(df, bench).collect())
    assert got == {(5, 1): 1, (5, 3): 1}
    long = spark.createDataFrame([(9, f"{say(60_000)} {ITEM} {say(5)}"), (10, say(60_000))], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in contamination(long, bench.where("item_id = 3")).collect()] == [(9, 3)]


def test_licences(spark, df):
    got = Counter((r.doc_id, r.n_words, r.base_labels) for r in license_scan(df).collect())
    assert got == Counter((i, len(t.split()), "mit" if "MIT" in t else "") for i, t in ROWS)
    text = f"{say(60_000)} cc by nc {say(3)}"
    (r,) = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (60_006, 1, 60_000, 60_000, "cc-by-nc")


def test_token_counts(df):
    got = Counter((r.doc_id, r.n_bytes) for r in token_counts(df, PATH).collect())
    assert got == Counter((i, len(t.encode())) for i, t in ROWS)


def test_packing(df):
    got = pack(df, PATH).collect()
    assert Counter((r.doc_id, r.start) for r in got) == Counter((i, 0) for i, _ in ROWS)
    at = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048 and len(at) == math.ceil(sum(at.values()) / 2048)


def test_sharding(df):
    got = shard(df, PATH).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
