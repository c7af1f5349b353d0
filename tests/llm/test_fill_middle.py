"""Fill-in-the-middle against a plain version, on odd and on very long texts."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from test_operators import CLASH, SCHEMA, odd_documents

from spanline.llm.fill_middle import fill_middle, restore

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, seed=42, share=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= share:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["<P>", "a <M> b", "x<", "\U0001f600 \U0001f601\t\U0001f602  ", "$1 \\1 {2}", "a b c d", " \x1c x\x0b\x0c", "<S", "\n\n", "P> <", "\r\n a"]


@pytest.mark.parametrize("share", [50, 100, 0])
def test_like_the_plain_version(spark, share):
    rows = odd_documents()
    rows += [(1000 + k, ODD[k % len(ODD)], "en", "a", 1) for k in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in CLASH}).repartition(3)
    out = fill_middle(docs, docs.columns, share=share).withColumn("back", restore(F.col("output"), F.col("form")))
    got = out.select("doc.doc_id", "doc.text", "n", "form", "prefix_chars", "middle_chars", "output", "back", "doc.kept").collect()
    want = sorted((str((i, t, *plain(i, t, share=share))) for i, t, *_ in rows))
    assert sorted(str(tuple(r)[:7]) for r in got) == want
    assert all(r["back"] == (r["text"] or "") and r["kept"] == 1 for r in got)
    assert fill_middle(docs.filter("doc_id < 0"), ["doc_id"]).count() == 0


def test_long_texts(spark):
    """20 MB in two million units, and 20 MB without a blank."""
    rows = [(k, t) for k in range(2) for t in ("lorem\tipsu " * 1_900_000, "y" * 20_000_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = fill_middle(docs, ["doc_id"], share=100).withColumn("back", restore(F.col("output"), F.col("form")))
    got = out.select("doc.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2("back", 256))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        *facts, output = plain(i, t, share=100)
        want.append((i, *facts, sha(output), sha(t)))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
