"""Importance resampling and radix ranks against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_operators import CLASH, LOWER, SCHEMA, odd_documents, prose

from spanline.llm import crc, radix
from spanline.llm.common import Shared
from spanline.llm.importance import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, percent, min_words, seed=42):
    def grams(text):
        ws = WORD.findall((text or "").translate(LOWER))
        out = [" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]
        return len(ws), [zlib.crc32(g.encode()) % 10000 for g in out]

    found = [(i, *grams(t)) for i, t in docs]
    s, t = Counter(b for *_, bs in found for b in bs), Counter(b for x in target for b in grams(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for i, n, bs in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        out.append((i, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = [(*r[0:1], *r[2:], k + 1) for k, r in enumerate(able[: len(able) * percent // 100])]
    left = Counter((r[0], *r[2:]) for r in out) - Counter(r[:-1] for r in rank)
    return sorted(map(str, [*rank, *[(*r, None) for r in left.elements()]]))


def run(docs, target, **options):
    out = resample(docs, target, ["doc_id", "kept"], **options)
    return sorted(str(tuple(r)) for r in out.select("doc.doc_id", "n_features", "weight", "score", "rank").collect())


def test_like_the_plain_version(spark):
    rng = random.Random(3)
    rows = odd_documents()
    rows += [(100 + k, prose(rng, rng.randrange(60)) + " Ünïcode 日本語 x1" * (k % 3), "en", "a", 1) for k in range(150)]
    rows += [(k, t, "en", "a", 1) for k, t in ((-5, prose(rng, 40)), (2**63 - 1, prose(rng, 30)), (-(2**63), prose(rng, 30)))]
    rows += [(500 + k, "w" * 300 + " " + "é" * 400 + " lorem" * 30, "en", "a", 1) for k in range(3)] + [rows[60]] * 40
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASH}).repartition(5)
    bench = [prose(rng, 50) for _ in range(10)] + [None, "", "Ünïcode 日本語", "lorem lorem"]
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    pairs = [(i, t) for i, t, *_ in rows]
    for percent, stretch in ((5, 1 << 18), (60, 16), (100, 7)):
        assert run(docs, target, percent=percent, stretch=stretch) == plain(pairs, bench, percent, 20)
    assert run(docs, target.limit(0), percent=30) == plain(pairs, [], 30, 20)
    assert run(docs.filter("doc_id < -9 and doc_id > -10"), target) == []
    nothing = docs.filter("doc_id in (0, 1, 2)")
    assert run(nothing, target) == plain([(i, t) for i, t in pairs if i in (0, 1, 2)], bench, 5, 20)


def test_long_text(spark):
    """One text of 20 MB among short ones."""
    rng = random.Random(4)
    rows = [(0, "Lorem ipsum dolor " * 1_100_000), (1, "z" * 2_000_000)] + [(k, prose(rng, 30)) for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit(1))
    target = spark.createDataFrame([("dolor lorem",)], "text string")
    assert run(docs, target, percent=50) == plain(rows, ["dolor lorem"], 50, 20)


def test_ranks(spark):
    """Keys without sign, half of the rows under one key, stretches of a few rows."""
    rng = random.Random(5)
    rows = [(k, rng.choice([7, 7, 7, -1, 2**62, rng.randrange(5000)]), rng.choice([0, -(2**63), 3, rng.randrange(99)])) for k in range(3000)]
    shared = Shared(spark, "ranks-test")
    df = shared.keep(spark.createDataFrame(rows, "row bigint, hi bigint, lo bigint").repartition(7), "rows")
    for stretch in (50, 1 << 18):
        got = {r["row"]: r["pos"] for r in radix.ranks(df, Shared(spark, "ranks-test"), stretch).collect()}
        assert sorted(got.values()) == list(range(3000))
        keys = sorted((got[k], hi & 2**64 - 1, lo & 2**64 - 1) for k, hi, lo in rows)
        assert [k[1:] for k in keys] == sorted(k[1:] for k in keys)
    assert radix.ranks(df.filter("row < 0"), shared).count() == 0
    assert radix.digits(0b1000000000000110) == [1, 15] and radix.digits(0) == []


def test_checksums():
    """Carrying registers over any number of zero bytes."""
    for n in (0, 1, 5, 255, 256, 257, 70_000, 20_000_000):
        assert crc.carry(np.array([zlib.crc32(b"ab")], np.uint32), np.array([n]))[0] ^ zlib.crc32(bytes(n)) == zlib.crc32(b"ab" + bytes(n))
