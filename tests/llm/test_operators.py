"""Operators against plain Python versions, on small tables with every odd case in them."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASH = ["doc", "node", "row", "hub", "shard", "slot", "key", "begin", "_id", "_hash", "matches", "kept", "word", "id", "v"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    words = ["alpha", "beta", "Gamma", "delta", "éclair", "zeta", "eta", "theta", "iota", "kappa", "mu", "nu"]
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))


def odd_documents():
    rng = random.Random(7)
    base = [prose(rng, n) for n in (3, 5, 40, 60, 200, 3000)]
    texts = [None, "", " \t\n", "...", "a", "one two three", "One  two\nthree", *base, *base[2:4]]
    for k in range(12):
        words = base[3].split()
        for _ in range(k % 6):
            words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        texts.append(" ".join(words))
    texts += [f"{base[2]}\nThis is a shared line of text\n  this IS a shared line of text \nshort\n{k}" for k in range(3)]
    rows = [(k, t, ("en", "de", None)[k % 3], ("a", "b", None)[k % 3], 1) for k, t in enumerate(texts)]
    return [*rows, rows[9], rows[9], (None, base[3], "en", "a", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return odd_documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("doc_id < 0")


def tuples(df, *columns):
    key = lambda r: [(x is not None, x) for x in r]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_duplicates(docs, none, rows):
    from spanline.llm.near_dedup import drop_near_duplicates, near_duplicates

    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                common = len(sets[a] & sets[b])
                if common and 100 * common >= 75 * len(sets[a] | sets[b]) and group[b] < group[a]:
                    group[a], changed = group[b], True
    want = [(i, len(sets[i]), group[i], i == group[i]) for i, *_ in rows if i is not None]
    copy = next(i for i, t, *_ in rows if t == rows[-2][1])
    want += [(None, len(sets[copy]), group[copy], False), (None, 0, None, True)]
    got = tuples(near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(want, key=lambda r: [(x is not None, x) for x in r])
    assert near_duplicates(none).count() == 0
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert tuples(kept, "doc_id")[-1:] != [] and kept.count() == sum(w[3] or w[0] is None for w in want)


def test_repeated_rows_count_once(spark):
    """A third of all rows are one row; the others are near copies of it."""
    from spanline.llm.near_dedup import near_duplicates

    text = prose(random.Random(1), 80)
    rows = [(5, text)] * 400 + [(k, f"{text} tail{k}") for k in range(10, 30)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    assert {tuple(r) for r in got.select("component_id", "kept").distinct().collect()} == {(5, True), (5, False)}
    assert got.count() == len(rows) and got.filter("kept").count() == 400


def test_dense_group_stays_exact(spark):
    """Many texts at all distances from each other and from none in common."""
    from spanline.llm.near_dedup import near_duplicates

    rng = random.Random(3)
    base = [f"w{k}" for k in range(80)]
    texts = []
    for k in range(150):
        words = list(base if k % 3 else texts[rng.randrange(len(texts))].split() if texts else base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(80)] = f"x{rng.randrange(10_000)}"
        texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert tuples(got, "doc_id", "component_id") == [(k, root(k)) for k in range(len(texts))]


def test_sketches_merge_and_estimate():
    import numpy as np

    from spanline.llm import sketch
    from spanline.llm.bytewords import mix

    x = mix(np.arange(1000, dtype=np.uint64))
    one, two = sketch.registers(x[:800], np.array([0]), 160), sketch.registers(x[200:], np.array([0]), 160)
    assert (sketch.merge(one, two) == sketch.registers(x, np.array([0]), 160)).all()
    assert abs(sketch.jaccard(one, two, np.array([800.0]), np.array([800.0]))[0] - 0.6) < 0.12


def benchmark_rows(rows):
    long = rows[12][1].split()
    return [
        (1, " ".join(long[100:130])),
        (2, " ".join(long[5:17])),
        (3, "One, two? three"),
        (4, "zzz " * 20),
        (10, " ".join(long[100:130])),
        (5, None),
        (6, ""),
        (None, " ".join(long[:40])),
        (4, "a"),
    ]


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_decontamination(spark, docs, none, rows, block):
    from spanline.llm.decontaminate import decontaminate, find_matches, judged

    items = benchmark_rows(rows)
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc", F.lit(1))
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    want = []
    for i, text, *_ in rows:
        words, hit, held = find(text), set(), set()
        for item, t in items:
            other = find(t)
            k = min(13, len(other))
            windows = {tuple(other[j : j + k]) for j in range(len(other) - k + 1)} if other and item else set()
            for p in range(len(words) - k + 1):
                if tuple(words[p : p + k]) in windows:
                    hit |= set(range(p, p + k))
                    held.add(item)
        want.append((i, len(words), len(hit), sorted(held), bool(hit) and 20 * len(hit) >= len(words)))
    got = judged(find_matches(docs, bench, ["doc_id"], block_bytes=block)).select(
        "doc.doc_id", "n_words", "n_hit", F.array_sort("items").alias("items"), "contaminated"
    )
    key = lambda r: [(x is not None, x) for x in r]
    assert tuples(got, "*") == sorted(want, key=key)
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[4] for w in want)
    assert find_matches(none, bench).count() == 0
    assert decontaminate(docs, bench.filter("item_id < 0")).count() == len(rows)


def test_suffix_array_orders_and_finds():
    import numpy as np

    from spanline.llm.suffixes import Shard, suffix_array

    rng = np.random.default_rng(1)
    for vocabulary in (2, 5, 1000):
        ids = rng.integers(1, vocabulary + 1, 400)
        order = suffix_array(ids, 400)
        assert [tuple(ids[p:]) for p in order] == sorted(tuple(ids[p:]) for p in range(400))
        hashes = rng.integers(0, vocabulary, 300).astype(np.uint64)
        shard = Shard(hashes, np.array([0, 100, 100, 300]), 50)
        asked = shard.number(rng.integers(0, vocabulary + 1, 40).astype(np.uint64))
        t = np.arange(40)
        got = shard.longest(asked, t, 40 - t)
        texts = [shard.number(hashes[a:b]).tolist() for a, b in ((0, 100), (100, 300))]
        for k in t:
            best = 0
            while k + best < 40 and any(
                x[i : i + best + 1] == asked[k : k + best + 1].tolist() for x in texts for i in range(len(x) - best)
            ):
                best += 1
            assert got[k] == best


def test_line_dedup(docs, none, rows):
    from spanline.llm.line_dedup import drop_repeated_lines, keep_bitmaps, with_kept_text

    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders[key(line)].add(i)
    want = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or i <= min(holders.get(key(x), {i}))]
        want.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    got = with_kept_text(docs, keep_bitmaps(docs)).select("doc.doc_id", "n_lines", "n_dropped", "kept_text")
    assert tuples(got, "*") == sorted(want, key=lambda r: [(x is not None, x) for x in r])
    assert drop_repeated_lines(docs).columns == docs.columns
    assert drop_repeated_lines(none).count() == 0


def test_substring_dedup(docs, none, rows, spark):
    from spanline.llm.substring_dedup import remove_spans, repeated_spans

    rng = random.Random(5)
    passage = " ".join(f"Passage{k} word." if k % 9 == 0 else f"passage{k}" for k in range(55)) + "."
    texts = [f"{prose(rng, 30)}.\n{passage}\n{prose(rng, 20)}." for _ in range(3)] + [f"Start here. {passage} The end."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    spans = repeated_spans(df)
    found = tuples(spans, "doc_id", "first_doc_id", "n_words")
    assert [(d, f) for d, f, _ in found] == [(1, 0), (2, 0), (3, 0)] and all(n >= 55 for *_, n in found)
    kept = dict(tuples(remove_spans(df, spans), "doc_id", "text"))
    assert kept[0] == texts[0] and all("passage" not in kept[k] for k in (1, 2, 3))
    assert kept[3].startswith("Start here.") and kept[3].endswith("The end.")
    assert remove_spans(docs, repeated_spans(docs)).columns == docs.columns
    assert {r[0] for r in tuples(repeated_spans(docs), "doc_id")} <= {i for i, *_ in rows}
    assert repeated_spans(none).count() == 0


def test_substring_dedup_removes_every_long_passage(spark):
    """Passages inside sentences, without stops, beside a part that an earlier text holds, and repeated words."""
    from spanline.llm.substring_dedup import PASSAGE, remove_spans, repeated_spans

    rng = random.Random(8)
    new = lambda n: " ".join(f"Ä{rng.randrange(10**9)}" for _ in range(n))
    long, listed, most = new(90), new(60).replace(" ", " \n"), new(50)
    part = long.split()[20:60]
    texts = [
        f"{new(5)} {' '.join(part)} {new(30)}",
        f"Begin {new(4)} {long} {new(3)} end.",
        f"Another {new(70)} {long} {new(7)} stop. {listed}",
        f"{listed} {new(9)} {most} {new(1)}",
        f"{new(3)} {most} {new(40)} {' '.join(long.split()[:51])}",
        "same " * 148,
        f"{new(2)} {' '.join(long.split()[10:30])} {long.upper().replace(chr(196), 'Ä')} {new(300)}",
        new(20) + " " + "same " * 60,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    held, want = {}, {}
    for d, text in enumerate(texts):
        words = text.translate(LOWER).split()
        windows = [tuple(words[k : k + PASSAGE]) for k in range(len(words) - PASSAGE + 1)]
        gone = set()
        for k, w in enumerate(windows):
            e, at = held.setdefault(w, (d, k))
            if e < d or k >= at + PASSAGE:
                gone |= set(range(k, k + PASSAGE))
        want[d] = [w for k, w in enumerate(text.split()) if k not in gone]
    spans = repeated_spans(df)
    kept = {d: t.split() for d, t in tuples(remove_spans(df, spans), "doc_id", "text")}
    assert kept == want and len(kept[5]) == 51 and len(kept[1]) == 99
    assert sum(r["n_words"] for r in spans.collect()) == sum(len(t.split()) - len(want[d]) for d, t in enumerate(texts))


def test_mixing(docs, none, rows, spark):
    from spanline.llm.common import Shared
    from spanline.llm.mixing import mix_documents, mixture, weights

    sources = Shared(spark, "test").keep(
        spark.createDataFrame([("a", 9000), ("b", 500), (None, 400), ("d", 100)], "source string, tokens bigint"), "s"
    )
    import math

    for target, limit in ((0.9, 100.0), (0.5, 100.0), (0.99, 2.0)):
        table, budget = weights(sources, target, limit)
        w = {r["source"]: (r["weight"], r["tokens"]) for r in table.collect()}
        assert abs(sum(x for x, _ in w.values()) - 1) < 1e-9 and budget == 10_000
        entropy = -sum(x * math.log(x) for x, _ in w.values()) / math.log(4)
        times = max(x * budget / t for x, t in w.values())
        assert times <= limit + 1e-6 and (entropy >= target - 1e-6 or abs(times - limit) < 1e-3)
    drawn = mixture(docs, limit=2.0, cover=True)
    count = Counter(tuple(r) for r in drawn.select("doc_id", "source", "text_hash").collect())
    distinct = docs.select("doc_id", "source", F.xxhash64("text").alias("h")).distinct().count()
    assert len(count) == distinct and max(count.values()) <= 3
    assert drawn.groupBy("block").agg((F.count("*") - F.max("slot")).alias("x")).filter("x <> 1").count() == 0
    assert mix_documents(docs, cover=True).columns == docs.columns
    assert mixture(none).count() == 0


def test_sharding(docs, none, rows, spark):
    from spanline.llm.sharding import assign_shards

    out = assign_shards(docs, ["doc_id"], shards=4)
    got = out.select("doc.doc_id", "size", "text_crc32", "shard", "slot").collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(sizes.values()) - min(sizes[k] for k in range(4)) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sizes[k])) for k in range(4))
    text = {i: t for i, t, *_ in rows}
    assert all(r["size"] == 16 + len((text[r["doc_id"]] or "").encode()) for r in got if r["doc_id"] is not None)
    assert assign_shards(none, ["doc_id"]).count() == 0
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 300).alias("text"))
    per = assign_shards(many, ["doc_id"], shards=8).groupBy("text_crc32").agg(F.count_distinct("shard").alias("n"))
    assert per.filter("n > 1").count() <= 40
    one = many.withColumn("text", F.when(F.col("doc_id") < 600, F.lit("hot")).otherwise(F.col("text")))
    hot = assign_shards(one, ["doc_id"], shards=8).filter(F.col("text_crc32") == zlib.crc32(b"hot"))
    counts = sorted((r["count"] for r in hot.groupBy("shard").count().collect()), reverse=True)
    assert sum(counts) == 600 and len(counts) <= 6


def test_language(docs, none, rows, spark):
    from spanline.llm.language import Model, held_out, identify, keep_identified, train

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = train(table.filter(~held_out(F.col("doc_id"))))
    found = identify(table, model, ["doc_id", "lang"]).filter(held_out(F.col("doc.doc_id")))
    assert found.agg(F.avg((F.col("doc.lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    got = identify(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, *_ in rows}
    for r in got:
        t = text.get(r["doc"]["doc_id"])
        if r["doc"]["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not t or not any(c.isalpha() for c in t))
        assert 0 <= r["score"] <= 1
    en, de = (table.filter(f"lang = '{x}' and n_chars > 1500").orderBy("doc_id").first().text[:600] for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, f"{en}\n{de}"), (2, "Слово")], "doc_id bigint, text string")
    one, two = sorted(identify(mixed, model, ["doc_id"]).collect(), key=lambda r: r["doc"]["doc_id"])
    assert [s["lang"] for s in one["spans"]] == ["en", "de"] and abs(one["spans"][1]["begin"] - 600) < 40
    assert two["lang_pred"] in model.langs and two["score"] == 0
    assert {r["lang_pred"] for r in identify(docs, Model([]), ["doc_id"]).collect()} == {"und"}
    assert keep_identified(docs).columns == docs.columns
    assert keep_identified(none).count() == 0


def test_viterbi_against_plain_version():
    import numpy as np

    from spanline.llm.language import viterbi

    rng = np.random.default_rng(4)
    first = np.array([0, 3, 3, 4, 40])
    scores = -rng.exponential(3, (40, 3)).astype(np.float32)
    got = viterbi(scores, first, 2.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        best = {k: (0.0, []) for k in range(3)}
        for t in range(a, b):
            best = {
                k: max((v - 2.0 * (j != k and t > a) + scores[t, k], path + [k]) for j, (v, path) in best.items())
                for k in range(3)
            }
        total = max(v for v, _ in best.values())
        path = got[a:b]
        value = sum(scores[a + i, k] for i, k in enumerate(path)) - 2.0 * np.count_nonzero(np.diff(path))
        assert abs(value - total) < 1e-3


def test_top_k(spark):
    from spanline.llm.topk import top_k, whole_vectors

    rng = random.Random(2)
    data = [(k, [rng.gauss(0, 0.2) for _ in range(40)], k) for k in range(300)]
    data += [(k, data[0][1], k) for k in range(300, 320)] + [(400, None, 0), (401, [1.0, None], 0), (402, [float("nan")], 0)]
    data += [(403, [float("inf")], 0), (404, [], 0), (405, [0.5], 0), (None, [1.0], 0), (0, data[0][1], 0)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, score int")
    vectors = whole_vectors(df, "vec_id", "embedding", 1024.0)
    got = tuples(top_k(vectors.filter("id % 100 = 0"), vectors, 10), "query_id", "rank", "vec_id", "score")
    import math

    good = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in data if i is not None and v and all(
        x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {i: v for i, v in good if i % 100 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    assert top_k(vectors.filter("id < 0"), vectors.filter("id < 0"), 10).count() == 0
    huge = whole_vectors(spark.createDataFrame([(0, [3e6, 1.0]), (1, [2e6, 2.0]), (2, [2e6, 1.0])], "i bigint, e array<double>"), "i", "e", 1024.0)
    assert [r["vec_id"] for r in top_k(huge.filter("id = 0"), huge, 1).collect()] == [1]


def test_url_filter(spark):
    from spanline.llm.url_filter import allowed, judge

    captures = spark.createDataFrame(
        [
            (1, "http://user@A.Example.com:80/x/y?q", "2024-03-05"),
            (2, "https://example.com./z", "2024-02-01"),
            (3, "http://b.example.com/x", "2024-04-01"),
            (4, None, "2024-04-01"),
            (5, "no url", "2024-04-01"),
            (6, "http://a.example.com/x", None),
            (7, "http://a.example.com", "2024-01-31"),
            (7, "http://a.example.com", "2024-01-31"),
        ],
        "key bigint, url string, fetched string",
    )
    entries = spark.createDataFrame(
        [
            ("a.example.com/x", "2024-01-01", "add"),
            ("a.example.com", "2024-02-01", "add"),
            ("example.com", "2024-02-01", "add"),
            ("example.com", "2024-03-01", "remove"),
            ("example.com", "2024-03-01", "add"),
            ("b.example.com", "2024-04-01", "add"),
            ("b.example.com", "2024-04-02", "remove"),
            (None, "2024-01-01", "add"),
            ("a.example.com", None, "remove"),
            ("a.example.com", "2024-02-02", "other"),
        ],
        "key string, day string, action string",
    ).withColumn("day", F.col("day").cast("date"))
    got = judge(captures, entries).select("capture.key", "blocked", "rule", F.col("since").cast("string"))
    assert tuples(got, "*") == [
        (1, True, "a.example.com/x", "2024-01-01"),
        (2, True, "example.com", "2024-02-01"),
        (3, True, "b.example.com", "2024-04-01"),
        (4, False, None, None),
        (5, False, None, None),
        (6, False, None, None),
        (7, False, None, None),
        (7, False, None, None),
    ]
    assert allowed(captures, entries).count() == 5
    assert judge(captures, entries.filter("key = ''")).filter("blocked").count() == 0
    assert judge(captures.filter("key < 0"), entries).count() == 0


def test_quality(spark, docs, none, rows):
    from spanline.llm.quality import drop_low_quality, score

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = score(table, ["doc_id"]).select("doc.doc_id", "kept").join(labels, "doc_id")
    right = dict(judged.groupBy("quality").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("double"))).collect())
    assert right[1] > 0.98 and right[0] > 0.85
    got = score(docs, ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert drop_low_quality(docs).columns == docs.columns
    assert score(none, ["doc_id"]).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    df, before = spark.read.parquet(f"{SF}/documents.parquet"), None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = f"{tmp_path}/{k}"
        stage(spark, df, SF).write.parquet(out)
        before, df = df, spark.read.parquet(out)
        if k < 4:
            assert df.columns == columns, name
            assert df.join(before, columns, "left_anti").count() == 0
            assert stage(spark, before.filter("doc_id < 0"), SF).count() == 0
    kept = before.select("doc_id").distinct().count()
    dedup = spark.read.parquet(f"{tmp_path}/2").select("doc_id").distinct().count()
    assert kept == dedup and df.count() == before.count()
    n = [r["count"] for r in df.groupBy("shard").count().collect()]
    assert max(n) - min(n) <= 1


def test_nothing_else_imports_the_package():
    top = Path(__file__).resolve().parents[2] / "spanline"
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert "llm" not in p.read_text(), p
