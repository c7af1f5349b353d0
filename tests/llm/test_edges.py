"""Odd ids, very large numbers, very long texts, and plain versions of inner steps."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_operators import SCHEMA, odd_documents, prose, shingles

LONG = "lorem ipsum dolor\n" * 1_100_000  # 20 MB


# ---- exact top-k


def test_top_k_beyond_64_bits_and_in_small_blocks(spark):
    from spanline.llm.topk import top_k, whole_vectors

    top = 2**63 - 1
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 5.0]), (2, [1e300, 7.0]), (100, [2.0, 3.0]), (3, [0.5, -1.0])]
    v = whole_vectors(spark.createDataFrame(rows, "i bigint, e array<double>"), "i", "e", 1024.0)
    got = {(r[0], r[2]): r[3] for r in top_k(v.filter("id % 100 = 0"), v, 10).collect()}
    assert got[0, 2] == top and got[0, 1] == -top - 1 and got[0, 100] == top and got[100, 3] == 2048 * 512 - 3072 * 1024
    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) * (1 + k % 7) for _ in range(20)]) for k in range(900)]
    v = whole_vectors(spark.createDataFrame(rows, "i bigint, e array<double>").repartition(6), "i", "e", 1024.0)
    got = {tuple(r) for r in top_k(v.filter("id % 10 = 0"), v, 4, block_bytes=20 * 8 * 7).collect()}
    m = np.floor(np.array([x for _, x in rows]) * 1024).astype(np.int64)
    scores = m @ m.T
    want = set()
    for q in range(0, 900, 10):
        best = sorted((-int(scores[q, k]), k) for k in range(900) if k != q)[:4]
        want |= {(q, n + 1, k, -s) for n, (s, k) in enumerate(best)}
    assert got == want


def test_top_k_shuffles_no_vectors(spark):
    """What leaves the tasks: at most ``k`` rows a query and task, whatever the number of candidates."""
    from spanline.llm.topk import top_k

    many = spark.range(40_000).select("id", F.array(*[F.xxhash64("id", F.lit(k)) % 1000 for k in range(8)]).alias("v"))
    out = top_k(many.filter("id < 20"), many.repartition(5), 3)
    assert out.count() == 60
    files = [x for x in out.inputFiles() if "found-" in x]
    assert files and spark.read.parquet(*files).count() <= 20 * 3 * 8


# ---- decontamination


def test_ids_of_items_of_any_type(spark):
    from spanline.llm.decontaminate import find_matches, judged

    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None), (3, "eta " * 30)], "doc_id bigint, text string")
    bench = spark.createDataFrame([("gsm8k-1", "beta gamma"), ("b-2", "delta"), (None, "eta")], "item_id string, text string")
    got = judged(find_matches(docs, bench, ["doc_id"])).select("doc.doc_id", "n_hit", F.array_sort("items").alias("i")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 3, ["b-2", "gsm8k-1"]), (2, 0, []), (3, 0, [])]


# ---- language


def test_long_texts_go_through_viterbi_in_blocks():
    from spanline.llm import language

    rng = np.random.default_rng(8)
    # steps of 1/4: sums are exact, so both ways find the same labels
    for n, k in ((1, 3), (2, 2), (50, 4), (5000, 3)):
        scores = -(rng.integers(0, 40, (n, k)) / 4).astype(np.float32) * (rng.random((n, k)) < 0.7)
        value = lambda path: scores[np.arange(n), path].sum() - 2.25 * np.count_nonzero(np.diff(path))
        long = language.viterbi_long(scores, 2.25)
        alone = np.concatenate([[0], [n]])
        limit, language.LONG = language.LONG, n
        plain = language.viterbi(scores, alone, 2.25)
        language.LONG = limit
        assert abs(value(long) - value(plain)) < 1e-6 and (long == plain).mean() > 0.999
    first = np.array([0, 3, 3, 9003, 9010])
    scores = -rng.exponential(3, (9010, 3)).astype(np.float32)
    got = language.viterbi(scores, first, 2.0)
    assert (got[3:9003] == language.viterbi_long(scores[3:9003], 2.0)).all()
    begin = time.time()
    assert len(language.viterbi(-rng.exponential(3, (2_000_000, 4)).astype(np.float32), np.array([0, 2_000_000]), 8.0)) == 2_000_000
    assert time.time() - begin < 20


def test_scores_and_labels_against_plain_counts(spark):
    """Trigram scores of words, Viterbi over them and the share of letters, from counts in plain Python."""
    from spanline.llm.language import BUCKETS, PENALTY, identify, train

    english = ["the quick brown fox", "a lazy dog sleeps", "over the hills and far away"] * 3
    german = ["der schnelle braune fuchs", "ein fauler hund", "über die berge und weit weg"] * 3
    rows = [(k, t, "en") for k, t in enumerate(english)] + [(100 + k, t, "de") for k, t in enumerate(german)]
    # no bucket holds two of these few trigrams, so counts by trigram are counts by bucket
    distinct = {(t, lang) for _, t, lang in rows}
    grams: dict[str, Counter] = {"de": Counter(), "en": Counter()}

    def tri(word):
        padded = ["", *word, ""]
        return [tuple(padded[i : i + 3]) for i in range(len(word))]

    for _, t, lang in rows:
        grams[lang].update(g for w in t.split() for g in tri(w))
    assert len(distinct) == 6
    logs = lambda lang, w: sum(
        math.log((grams[lang][g] + 0.5) / (sum(grams[lang].values()) + 0.5 * BUCKETS)) for g in tri(w)
    )
    model = train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    tests = [(0, "the dog sleeps und der hund schnelle fuchs"), (1, "brown fox brown"), (2, "weit über berge")]
    got = identify(spark.createDataFrame(tests, "doc_id bigint, text string"), model, ["doc_id"]).collect()
    for r in got:
        words = dict(tests)[r["doc"]["doc_id"]].split()
        best = {"de": (0.0, []), "en": (0.0, [])}
        for n, w in enumerate(words):
            best = {
                b: max((v - PENALTY * (a != b and n > 0) + logs(b, w), [*path, b]) for a, (v, path) in best.items()) for b in best
            }
        path = max(best.values())[1]
        letters = Counter()
        for w, lang in zip(words, path, strict=True):
            letters[lang] += len(w)
        lang, most = letters.most_common(1)[0]
        assert r["lang_pred"] == lang and abs(r["score"] - most / sum(letters.values())) < 1e-9
        spans = [(s["begin"], s["end"], s["lang"]) for s in r["spans"]]
        at, want = 0, []
        for w, x in zip(words, path, strict=True):
            if want and want[-1][2] == x:
                want[-1] = (want[-1][0], at + len(w), x)
            else:
                want.append((at, at + len(w), x))
            at += len(w) + 1
        assert spans == want
        evidence = sum(logs(x, w) + len(w) * math.log(BUCKETS) for w, x in zip(words, path, strict=True))
        assert abs(r["evidence"] - evidence) < 1e-2


def test_stage_drops_random_letters_and_names_unnamed_texts(spark):
    from spanline.llm.language import keep_identified

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(9)
    mash = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxzäöü") for _ in range(rng.randrange(3, 12))) for _ in range(60))
    known = table.filter("length(text) > 300").orderBy("doc_id").limit(5).select("doc_id", "lang").collect()
    ids = [r["doc_id"] for r in known]
    rows = table.withColumn("lang", F.when(~F.col("doc_id").isin(ids), F.col("lang")))
    rows = rows.union(spark.createDataFrame([(-1, mash, "en", "a", 1), (-2, mash, None, "a", 1), (-3, "Слово за слово", None, "a", 1)], SCHEMA))
    got = {r["doc_id"]: r["lang"] for r in keep_identified(rows).select("doc_id", "lang").collect()}
    assert -1 not in got and -2 not in got and -3 in got and got[-3] is None
    assert len(got) == table.count() + 1
    assert all(got[r["doc_id"]] == r["lang"] for r in known)


def test_sample_is_bounded_for_repeated_rows_and_rows_without_id(spark):
    from spanline.llm import language

    rows = [(None, "hot text again", "en")] * 600 + [(k, f"word number {k} of many", "en") for k in range(900)]
    rows += [(k, f"wort nummer {k} von vielen", "de") for k in range(900)] + [(1, "palabra", "es")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    n = {r["lang"]: r["count"] for r in language.sampled(df, 100, 2).groupBy("lang").count().collect()}
    assert set(n) == {"de", "en"} and all(60 < x < 140 for x in n.values())
    assert language.train(df, per_language=100, max_languages=2).langs == ["de", "en"]


# ---- near-dedup as a stage


def test_one_row_of_each_group(spark):
    from spanline.llm.near_dedup import one_of_each_group

    rng = random.Random(11)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(5, a)] * 7 + [(9, a), (8, a + " more"), (None, a), (None, b), (None, b), (None, b + " x"), (7, c), (None, None), (None, None)]
    rows += [(11, ""), (12, "two words"), (12, "two words"), (13, "two words")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).withColumn("id", F.lit(1)).repartition(3)
    kept = one_of_each_group(df)
    assert kept.columns == df.columns
    got = kept.select("doc_id", "text").collect()
    assert sorted(r[0] for r in got if r[0] is not None) == [5, 7, 11, 12]
    nulls = [r[1] for r in got if r[0] is None]
    assert len(nulls) == 2 and None in nulls and any(t and t.startswith(b) for t in nulls)
    odd = spark.createDataFrame(odd_documents(), SCHEMA)
    left = [r["text"] for r in one_of_each_group(odd).select("text").collect()]
    sets = [shingles(t) for t in left]
    assert not any(100 * len(x & y) >= 75 * len(x | y) for n, x in enumerate(sets) for y in sets[:n] if x and y)
    assert one_of_each_group(df.filter("doc_id < 0")).count() == 0


# ---- sharding


def test_large_texts_fill_whole_shards(spark):
    from spanline.llm.sharding import assign_shards

    text = F.when(F.col("id") < 500, "one").when(F.col("id") < 850, "two").otherwise(F.concat(F.lit("t"), F.col("id") % 50))
    docs = spark.range(1003).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = assign_shards(docs, ["doc_id"], shards=10).select("doc.doc_id", "shard", "slot").collect()
    size = Counter(r["shard"] for r in got)
    assert sorted(size.values()) == [100] * 7 + [101] * 3
    of = {"one": Counter(r["shard"] for r in got if r["doc_id"] < 500), "two": Counter(r["shard"] for r in got if 500 <= r["doc_id"] < 850)}
    for name, n in (("one", 4), ("two", 3)):
        assert sum(of[name][k] == size[k] for k in size) >= n and len(of[name]) <= n + 2
    same = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert sorted(Counter(r["shard"] for r in assign_shards(same, ["doc_id"], shards=4).collect()).values()) == [10] * 4
    assert assign_shards(same.limit(3), ["doc_id"], shards=40).count() == 3


# ---- quality


def test_em_against_plain_sums():
    from spanline.llm.quality import BAD, GOOD, LABELLERS, expectation_maximisation

    rng = random.Random(12)
    pattern = np.array(sorted(rng.sample(range(3**LABELLERS), 60)))
    n = np.array([rng.randrange(1, 50) for _ in pattern])
    got, _ = expectation_maximisation(pattern, n, rounds=7)
    votes = [[p // 3**j % 3 for j in range(LABELLERS)] for p in pattern]
    post = [1 / (1 + math.exp(3 * v.count(BAD) - 0.5 * v.count(GOOD))) for v in votes]
    for _ in range(7):
        weight = [[(1 - p) * m for p, m in zip(post, n, strict=True)], [p * m for p, m in zip(post, n, strict=True)]]
        prior = [(sum(w) + 1) / (sum(map(sum, weight)) + 2) for w in weight]
        table = []
        for w in weight:
            rows = [[sum(x for x, v in zip(w, votes, strict=True) if v[j] == k) + 0.5 for k in range(3)] for j in range(LABELLERS)]
            table.append([[x / sum(r) for x in r] for r in rows])
        like = [[math.log(prior[c]) + sum(math.log(table[c][j][v[j]]) for j in range(LABELLERS)) for v in votes] for c in (0, 1)]
        post = [1 / (1 + math.exp(min(max(a - b, -50), 50))) for a, b in zip(*like, strict=True)]
    assert np.allclose(got[pattern], post, atol=1e-9)


def test_fit_against_plain_gradients(spark):
    from spanline.llm.quality import BUCKETS, fit

    rng = random.Random(13)
    rows = [(rng.random(), sorted(rng.sample(range(40), 5)), [rng.random() for _ in range(5)]) for _ in range(50)]
    df = spark.createDataFrame(rows, "good double, buckets array<int>, values array<double>").repartition(3)
    got = fit(df, steps=6)
    w, squares = [0.0] * 41, [1e-8] * 41
    for _ in range(6):
        g = [0.0] * 41
        for good, buckets, values in rows:
            z = w[40] + sum(w[b] * v for b, v in zip(buckets, values, strict=True))
            miss = 1 / (1 + math.exp(-z)) - good
            g[40] += miss / len(rows)
            for b, v in zip(buckets, values, strict=True):
                g[b] += miss * v / len(rows)
        squares = [s + x * x for s, x in zip(squares, g, strict=True)]
        w = [x - y / math.sqrt(s) for x, y, s in zip(w, g, squares, strict=True)]
    assert len(got) == BUCKETS + 1 and np.allclose([*got[:40], got[-1]], w, atol=1e-9)


# ---- a text of 20 MB


def test_long_text(spark):
    from spanline.llm.decontaminate import find_matches, judged
    from spanline.llm.language import identify, train
    from spanline.llm.near_dedup import near_duplicates

    rng = random.Random(14)
    rows = [(1, LONG, "en"), (2, LONG + "tail", "en")] + [(k, prose(rng, 40), "de") for k in range(3, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4).cache()
    near = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert near[2] == 1 and near[3] == 3
    bench = spark.createDataFrame([(1, "dolor lorem ipsum")], "item_id bigint, text string")
    hits = {r[0]: r[1] for r in judged(find_matches(docs, bench, ["doc_id"])).select("doc.doc_id", "n_hit").collect()}
    assert hits[1] == 3_299_997 and hits[3] == 0
    found = {r["doc"]["doc_id"]: r["lang_pred"] for r in identify(docs, train(docs), ["doc_id"]).select("doc", "lang_pred").collect()}
    assert found[1] == "en" and found[3] == "de"
