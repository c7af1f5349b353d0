"""Quality classifier from weak labels: overlapping heuristics, EM, a hashed linear scorer.

1. Labellers look at figures of a text and vote good, bad or nothing.  A text's votes are
   one of 3^labellers patterns.
2. Patterns are counted over all documents with words; EM over these counts (a table that does not
   grow) estimates, for good and bad texts, how often each labeller says what.  Each
   pattern gets a posterior.
3. A logistic scorer over hashed words and word endings learns the posteriors of a bounded
   sample of about ``sample`` distinct documents with words, by gradients summed over Spark tasks, and scores
   every document.  No hand label is read.

A document without words has score 0, is not kept, and takes no part in 2 and 3.  Repeated
rows are each scored; in the sample they count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.llm.bytewords import NOT_SPACE, Words, find_words, mix, text_chunks
from spanline.llm.common import Shared

BUCKETS = 1 << 15
SAMPLE = 20_000
STEPS = 30
GOOD, BAD, NONE = 2, 1, 0

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_PLAIN = np.zeros(256, bool)  # marks of ordinary prose
_PLAIN[[ord(c) for c in ".,;:'\"-()?"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!"]] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NONE))


def votes(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """(texts, labellers) votes."""
    n = words.counts
    count = np.maximum(n, 1)
    text = np.repeat(np.arange(len(n)), n)
    letters = np.maximum(_per_text(_LETTER[data], offsets), 1)
    marks = _per_text(~(_LETTER | _PLAIN | _DIGIT | ~NOT_SPACE)[data], offsets) / count
    upper = _per_text(_UPPER[data], offsets) / letters
    digits = _per_text(_DIGIT[data], offsets) / letters
    before, last = np.zeros(len(text), bool), np.zeros(len(text), bool)
    if len(text):
        before[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
        last = _STOP[data[words.end - 1]]
    again = np.bincount(text, before, minlength=len(n)) / count
    bare = ~np.add.reduceat(_LETTER[data] | _DIGIT[data], words.start).astype(bool) if len(text) else before
    lone = np.bincount(text, bare, minlength=len(n)) / count
    # equal words of a text side by side: sorted by hash, then by text, both stable
    order = np.lexsort((words.hash, text))
    other = np.ones(len(text), bool)
    other[1:] = (np.diff(words.hash[order]) != 0) | (np.diff(text) != 0)  # texts are in order as they are
    distinct = np.bincount(text, other, minlength=len(n)) / np.sqrt(count)
    length = _per_text(NOT_SPACE[data], offsets) / count
    stops = np.bincount(text, last, minlength=len(n)) / count
    some = n >= 5
    out = np.stack(
        [
            _vote(marks < 0.1, marks > 0.5),
            _vote(upper < 0.25, upper > 0.5),
            _vote(digits < 0.1, digits > 0.4),
            _vote(again < 0.05, (again > 0.2) & some),
            _vote(lone < 0.05, (lone > 0.2) & some),
            _vote((distinct > 2.0) | (n < 30), (distinct < 1.0) & (n >= 30)),
            _vote((length > 2.5) & (length < 12) | ~some, (length > 15) & some),
            _vote((stops > 0.03) & (stops < 0.4) | (n < 20), (stops > 0.6) & (n >= 20)),
        ],
        axis=1,
    )
    out[n == 0] = NONE
    return out


LABELLERS = 8
_PLACES = 3 ** np.arange(LABELLERS)


def patterns(votes_: np.ndarray) -> np.ndarray:
    return votes_ @ _PLACES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(3**LABELLERS, np.int64)
    for batch in batches:
        for _, data, offsets in text_chunks(batch.column("text")):
            n += np.bincount(patterns(votes(data, offsets, find_words(data, offsets, NOT_SPACE))), minlength=len(n))
    slots = np.flatnonzero(n)
    yield pa.RecordBatch.from_pydict({"pattern": slots, "n": n[slots]})


def expectation_maximisation(pattern: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of *good* for every pattern, and the tables ``[class, labeller, vote]`` behind it."""
    every = np.arange(3**LABELLERS)[:, None] // _PLACES % 3
    seen = every[pattern]
    good, bad = (seen == GOOD).sum(1), (seen == BAD).sum(1)
    # from the votes: one labeller that says bad outweighs the many that see nothing wrong
    post = 1.0 / (1.0 + np.exp(3.0 * bad - 0.5 * good))
    said = np.stack([seen == v for v in range(3)], axis=2)
    prior, table = np.array([0.5, 0.5]), np.zeros((2, LABELLERS, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - post) * n, post * n])
        prior = (weight.sum(1) + 1) / (weight.sum() + 2)
        table = np.einsum("cp,pjv->cjv", weight, said) + 0.5
        table /= table.sum(2, keepdims=True)
        logs = np.log(prior)[:, None] + np.einsum("cjv,pjv->cp", np.log(table), said)
        post = 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    said = np.stack([every == v for v in range(3)], axis=2)
    logs = np.log(prior)[:, None] + np.einsum("cjv,pjv->cp", np.log(np.maximum(table, 1e-12)), said)
    return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -50, 50))), table


def features(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value): hashed words and word endings, values of length 1 a text."""
    n = len(words.counts)
    text = np.repeat(np.arange(n), words.counts)
    if not len(text):
        return text, text, np.zeros(0)
    ends = np.zeros(len(text), np.uint64)
    for k in range(1, 4):
        at = words.end - k
        ends = (ends << np.uint64(8)) | np.where(at >= words.start, data[np.maximum(at, 0)], 0).astype(np.uint64)
    bucket = np.concatenate([words.hash, mix(ends + np.uint64(1 << 40))]) % np.uint64(BUCKETS)
    slot, times = np.unique(np.concatenate([text, text]) * BUCKETS + bucket.astype(np.int64), return_counts=True)
    text, value = slot // BUCKETS, np.sqrt(times.astype(np.float64))
    return text, slot % BUCKETS, value / np.sqrt(np.bincount(text, value**2, minlength=n))[text]


def _examples(posterior):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column("text")):
                words = find_words(data, offsets, NOT_SPACE)
                text, bucket, value = features(data, words)
                cuts = np.searchsorted(text, np.arange(len(offsets))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(posterior.value[patterns(votes(data, offsets, words))]),
                        pa.ListArray.from_arrays(cuts, pa.array(bucket.astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(value)),
                    ],
                    names=["good", "buckets", "values"],
                )

    return run


def _gradient(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, n = weights.value, np.zeros(BUCKETS + 1), 0
        for batch in batches:
            good, lists = batch.column("good").to_numpy(), batch.column("buckets")
            size = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(good)), size)
            bucket, value = lists.flatten().to_numpy(), batch.column("values").flatten().to_numpy()
            z = np.bincount(row, w[bucket] * value, minlength=len(good)) + w[-1]
            miss = 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))) - good
            total[:-1] += np.bincount(bucket, miss[row] * value, minlength=BUCKETS)
            total[-1] += miss.sum()
            n += len(good)
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()], "n": [n]})

    return run


def fit(examples: DataFrame, steps: int = STEPS) -> np.ndarray:
    """Weights of the scorer, by full gradients with steps scaled by their history."""
    context = examples.sparkSession.sparkContext
    w, squares = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    for _ in range(steps):
        # one row of BUCKETS + 1 sums a task, of a sample of bounded size
        shipped = context.broadcast(w)
        parts = examples.mapInArrow(_gradient(shipped), "sums binary, n bigint").collect()
        shipped.unpersist()
        n = sum(p["n"] for p in parts)
        if not n:
            break
        g = sum(np.frombuffer(p["sums"]) for p in parts) / n
        squares += g**2
        w = w - 1.0 * g / np.sqrt(squares)
    return w


def drawn(worded: DataFrame, sample: int) -> DataFrame:
    """``doc_id, text`` of about ``sample`` distinct rows, by a hash of both."""
    hashed = F.xxhash64("doc_id", "text")
    n = worded.agg(F.approx_count_distinct(hashed, 0.01)).first()[0]
    draw = F.pmod(hashed, F.lit(1 << 30)) / F.lit(float(1 << 30))
    return worded.select("doc_id", "text").filter(draw < sample / max(n, 1)).distinct()


def score(docs: DataFrame, keep: list[str], sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """A struct ``doc`` of the ``keep`` columns, ``posterior`` (of the votes), ``score``, ``kept``."""
    context = docs.sparkSession.sparkContext
    worded = docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    counts = worded.select("text").mapInArrow(_count, "pattern bigint, n bigint").groupBy("pattern").agg(
        F.sum("n").alias("n")
    )
    found = counts.collect()  # at most 3^LABELLERS rows
    pattern, n = (np.array([r[c] for r in found], np.int64) for c in ("pattern", "n"))
    posterior = context.broadcast(expectation_maximisation(pattern, n)[0])
    chosen = drawn(worded, sample).select("text")
    examples = Shared(docs.sparkSession, "quality").keep(
        chosen.mapInArrow(_examples(posterior), "good double, buckets array<int>, values array<double>"), "examples"
    )
    weights = context.broadcast(fit(examples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in text_chunks(batch.column("text")):
                words = find_words(data, offsets, NOT_SPACE)
                text, bucket, value = features(data, words)
                w = weights.value
                z = np.bincount(text, w[bucket] * value, minlength=len(offsets) - 1) + w[-1]
                good = np.where(words.counts > 0, 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(lo, len(good)),
                        pa.array(posterior.value[patterns(votes(data, offsets, words))]),
                        pa.array(good),
                        pa.array((good >= threshold) & (words.counts > 0)),
                    ],
                    names=["doc", "posterior", "score", "kept"],
                )

    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), "text")
    return rows.mapInArrow(
        run, f"doc {rows.schema['doc'].dataType.simpleString()}, posterior double, score double, kept boolean"
    )


def drop_low_quality(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold."""
    return score(docs, docs.columns, **options).filter("kept").select("doc.*")
