"""Language ID: scripts narrow the candidates, Viterbi labels the words of mixed texts.

A language is learned as smoothed frequencies of hashed letter trigrams (``BUCKETS`` of
them) and as the share of its letters in each script.  For a word, only languages that
write its script are candidates; its score for each is the sum of its trigrams' logs.
Over a text's words, Viterbi finds the best sequence of labels at ``PENALTY`` nats a
switch.  The text's language is the label with most letters, its score that label's part
of all letters.

Trained on a bounded sample: about ``per_language`` distinct documents of each of the
``max_languages`` languages with most labelled ones, picked by a hash of id and text.  The
model takes 128 KB a language, whatever the corpus.

Null texts and texts without letters are ``und`` with score 0, as is everything if there
is nothing to learn from.  Letters of a script that no learned language writes count as
unknown; a text of nothing else gets the language with most training text, score 0.
Repeated rows are each labelled; an empty table gives an empty result.  Ties go to the
language that comes first by name.  A text of any length is read whole: the words of long
ones go through Viterbi in blocks, by (max, +) matrices.

``evidence`` says how much likelier the words are in the languages they were given than
letters at random, in nats.  Letters at random are what the stage of the pipeline rejects.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanline.llm.bytewords import text_chunks

BUCKETS = 1 << 15
PENALTY = 8.0
PER_LANGUAGE = 20_000
MAX_LANGUAGES = 1000
#: Texts with more words are labelled block by block; words scored at a time.
LONG, BLOCK = 4096, 1 << 16
#: Evidence below which a text is letters at random: in all, and for each letter.
REJECT, REJECT_EACH = -30.0, -1.0
CHUNK = 2 << 20
PLANES = 0x20000
UND = "und"

# First and last code point of the main blocks of each script.
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F),
    ("lao", 0x0E80, 0x0EFF),
    ("myanmar", 0x1000, 0x109F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("hangul", 0x3130, 0x318F),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
OTHER = "other"
NAMES = [OTHER, *dict.fromkeys(name for name, _, _ in SCRIPTS)]


@cache
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point below ``PLANES``: kind (1 letter, 2 mark), script, lower case."""
    kind = np.zeros(PLANES, np.uint8)
    lower = np.arange(PLANES, dtype=np.uint32)
    for c in range(PLANES):
        of = unicodedata.category(chr(c))[0]
        if of == "L":
            kind[c] = 1
            if len(x := chr(c).lower()) == 1:
                lower[c] = ord(x)
        elif of == "M":
            kind[c] = 2
    script = np.zeros(PLANES, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
    return kind, script, lower


class _Letters:
    """Words of letters in a chunk of texts, with hashed trigrams and positions in characters."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kinds, scripts, lower = _characters()
        chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        low = np.minimum(chars, PLANES - 1)
        kind = np.where(chars < PLANES, kinds[low], 1)
        inside = np.concatenate([[False], kind > 0, [False]])
        begin = np.zeros(len(chars) + 1, bool)
        begin[at] = True
        first = inside[1:-1] & (~inside[:-2] | begin[:-1])
        last = inside[1:-1] & (~inside[2:] | begin[1:])
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        letters = np.concatenate([[0], np.cumsum(kind == 1)])
        self.letters = letters[self.end] - letters[self.start]
        self.script = scripts[low[self.start]]
        self.first = np.searchsorted(self.start, at)
        self.at = at
        text = np.where(chars < PLANES, lower[low], chars)
        before, behind = np.zeros_like(text), np.zeros_like(text)
        before[1:], behind[:-1] = text[:-1], text[1:]
        before[first], behind[last] = 0, 0
        mask = inside[1:-1]
        code = before[mask].astype(np.uint64) << np.uint64(42)
        code |= text[mask].astype(np.uint64) << np.uint64(21)
        code |= behind[mask]
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        self.trigram = (code >> np.uint64(49)).astype(np.int32)  # BUCKETS values
        self.edges = np.cumsum(self.end - self.start) - (self.end - self.start)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, slot, n``: trigrams per bucket, then letters per script."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lo, data, offsets in text_chunks(batch.column("text"), CHUNK):
            words = _Letters(data, offsets)
            of_text = langs[lo : lo + len(offsets) - 1]
            text = np.repeat(np.arange(len(of_text)), np.diff(words.first))
            size = words.end - words.start
            for lang in set(of_text):
                mine = (of_text == lang)[text]
                n = sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                n[:BUCKETS] += np.bincount(words.trigram[np.repeat(mine, size)], minlength=BUCKETS)
                n[BUCKETS:] += np.bincount(
                    words.script[mine], words.letters[mine], minlength=len(NAMES)
                ).astype(np.int64)
    for lang, n in sums.items():
        slots = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": [lang] * len(slots), "slot": slots, "n": n[slots]})


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    n = np.zeros(BUCKETS + len(NAMES), np.int64)
    n[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    packed = np.concatenate([np.log((n[:BUCKETS] + 0.5) / (n[:BUCKETS].sum() + 0.5 * BUCKETS)), n[BUCKETS:]])
    return pa.table({"lang": [key[0].as_py()], "packed": [packed.astype(np.float32).tobytes()]})


class Model:
    """Trigram scores and scripts of the learned languages."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        rows = sorted(rows)
        self.langs = [lang for lang, _ in rows]
        packed = np.array([np.frombuffer(p, np.float32) for _, p in rows]).reshape(len(rows), BUCKETS + len(NAMES))
        self.scores = np.ascontiguousarray(packed[:, :BUCKETS].T)
        letters = packed[:, BUCKETS:]
        self.writes = (letters >= 0.01 * np.maximum(letters.sum(1, keepdims=True), 1)).T
        self.writes[0] |= ~self.writes.any(1)[0]  # letters outside all blocks rule nothing out
        self.usual = int(letters.sum(1).argmax()) if rows else 0

    def word_scores(self, words: _Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, languages) scores, 0 at best; whether any language writes the word's script; the best one's nats."""
        n = len(words.start)
        scores, known, nats = np.empty((n, len(self.langs)), np.float32), np.empty(n, bool), np.empty(n)
        ends = np.append(words.edges[1:], len(words.trigram))
        for lo in range(0, n, BLOCK):
            part = slice(lo, lo + BLOCK)
            first, last = words.edges[lo], ends[part][-1]
            sums = np.add.reduceat(self.scores[words.trigram[first:last]], words.edges[part] - first, axis=0)
            may = self.writes[words.script[part]]
            known[part] = may.any(1)
            top = np.where(may, sums, -np.inf).max(1, keepdims=True, where=may | ~known[part, None], initial=-1e30)
            nats[part] = np.where(known[part], top[:, 0], 0.0)
            sums = np.where(may, np.maximum(sums - top, -50.0), -50.0)
            sums[~known[part]] = 0.0
            scores[part] = sums
        return scores, known, nats


def _before(v: np.ndarray, later: np.ndarray, penalty: float) -> np.ndarray:
    """The best label ahead of ``later``, for rows ``v`` of scores up to there."""
    top = v.argmax(-1)
    at = lambda k: np.take_along_axis(v, k[..., None], -1)[..., 0]
    return np.where(at(later) >= at(top) - penalty, later, top)


def viterbi_long(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of the words of one text, in steps that handle one word of each of many blocks.

    A block's (max, +) matrix says how well each label follows each label ahead of the
    block.  A chain of those matrices gives the scores ahead of every block, and from
    there on, all blocks are gone through at once.
    """
    n, k = scores.shape
    size = int(np.ceil(np.sqrt(n)))
    many = -(-n // size)
    s = np.zeros((many * size, k))
    s[:n] = scores  # words without scores at the end change no label
    s = s.reshape(many, size, k)
    step = np.where(np.eye(k, dtype=bool), 0.0, -penalty)[None] + s[:, 0, None, :]
    for t in range(1, size):
        step = np.maximum(step, step.max(2, keepdims=True) - penalty) + s[:, t, None, :]
    ahead = np.zeros((many, k))
    for b in range(1, many):
        ahead[b] = (ahead[b - 1][:, None] + step[b - 1]).max(0)
        ahead[b] -= ahead[b].max()
    best = np.empty((many, size, k))
    v = ahead
    for t in range(size):
        v = np.maximum(v, v.max(1, keepdims=True) - penalty) + s[:, t]
        v -= v.max(1, keepdims=True)
        best[:, t] = v
    # labels for each label that a block can end with, then the one that it does end with
    labels = np.empty((many, size, k), np.int32)
    labels[:, -1] = np.arange(k)
    for t in range(size - 2, -1, -1):
        labels[:, t] = _before(np.broadcast_to(best[:, t, None, :], (many, k, k)), labels[:, t + 1], penalty)
    out = np.empty((many, size), np.int64)
    end = int(best[-1, -1].argmax())
    for b in range(many - 1, -1, -1):
        out[b] = labels[b, :, end]
        if b:
            end = int(_before(best[b - 1, -1][None], out[b, :1], penalty)[0])
    return out.reshape(-1)[:n]


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of the words of many texts; one step handles the words at one place of all texts."""
    n = np.diff(first)
    if (n > LONG).any():
        label = np.empty(len(scores), np.int64)
        long = np.repeat(n > LONG, n)
        short = np.where(n > LONG, 0, n)
        label[~long] = viterbi(scores[~long], np.concatenate([[0], np.cumsum(short)]), penalty)
        for k in np.flatnonzero(n > LONG):
            label[first[k] : first[k + 1]] = viterbi_long(scores[first[k] : first[k + 1]], penalty)
        return label
    order = np.argsort(-n, kind="stable")
    start, n = first[:-1][order], n[order]
    longest = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(longest), "left")  # texts with more words than that
    best = scores.copy()
    for t in range(1, longest):
        at = start[: alive[t]] + t
        v = best[at - 1]
        top = v.max(1, keepdims=True)
        best[at] += np.maximum(v, top - penalty) - top
    label = np.empty(len(scores), np.int64)
    for t in range(longest - 1, -1, -1):
        at = start[: alive[t]] + t
        v = best[at]
        top = v.argmax(1)
        go_on = alive[t + 1] if t + 1 < longest else 0
        if go_on:
            later, rows = label[at[:go_on] + 1], np.arange(go_on)
            stay = v[rows, later] >= v[rows, top[:go_on]] - penalty
            top[:go_on] = np.where(stay, later, top[:go_on])
        label[at] = top
    return label


class _Labels:
    """Languages of the texts of a chunk."""

    def __init__(self, model: Model, data: np.ndarray, offsets: np.ndarray):
        n, k = len(offsets) - 1, len(model.langs)
        words = _Letters(data, offsets)
        text = np.repeat(np.arange(n), np.diff(words.first))
        letters = np.bincount(text, words.letters, minlength=n)
        self.some = letters > 0
        self.best, self.score, self.evidence = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
        self.known = np.zeros(n)
        self.words, self.text, self.label = words, text, np.zeros(len(text), np.int64)
        if k and len(text):
            scores, known, nats = model.word_scores(words)
            self.label = viterbi(scores, words.first, PENALTY)
            nats += np.where(known, scores[np.arange(len(text)), self.label] + (words.end - words.start) * np.log(BUCKETS), 0.0)
            self.evidence = np.bincount(text, nats, minlength=n)
            self.known = np.bincount(text, words.letters * known, minlength=n)
            per = np.bincount(text * k + self.label, words.letters * known, minlength=n * k).reshape(n, k)
            self.best = np.where(per.any(1), per.argmax(1), model.usual)
            self.score = per[np.arange(n), self.best] / np.maximum(letters, 1)
        self.some &= k > 0
        self.score[~self.some] = 0.0

    def names(self, langs: list[str]) -> list[str]:
        return [langs[b] if s else UND for b, s in zip(self.best, self.some, strict=True)]

    def spans(self, langs: list[str]) -> pa.ListArray:
        """Stretches of one language in each text, in characters from its begin."""
        w, n = self.words, len(self.best)
        new = np.ones(len(self.text), bool)
        new[1:] = (np.diff(self.text) != 0) | (np.diff(self.label) != 0)
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(new)]])[: len(head)] - 1
        text = self.text[head]
        spans = pa.StructArray.from_arrays(
            [
                pa.array(w.start[head] - w.at[text]),
                pa.array(w.end[tail] - w.at[text]),
                pa.array([langs[k] if langs else UND for k in self.label[head]], pa.string()),
            ],
            ["begin", "end", "lang"],
        )
        return pa.ListArray.from_arrays(np.searchsorted(text, np.arange(n + 1)).astype(np.int32), spans)


def sampled(labelled: DataFrame, per_language: int, max_languages: int) -> DataFrame:
    """``lang, text`` of about ``per_language`` distinct rows of each language at most."""
    rows = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    hashed = F.xxhash64("doc_id", "text")
    part = (
        rows.groupBy("lang")
        .agg(F.approx_count_distinct(hashed, 0.02).alias("_n"))
        .orderBy(F.col("_n").desc(), "lang")
        .limit(max_languages)
        .select(F.col("lang").alias("_lang"), (F.lit(float(per_language)) / F.col("_n")).alias("_part"))
    )
    draw = F.pmod(hashed, F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one short row a language, ``max_languages`` at most
    drawn = rows.join(F.broadcast(part), F.col("lang") == F.col("_lang")).filter(draw < F.col("_part"))
    return drawn.select("doc_id", "lang", "text").distinct().select("lang", "text")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Model:
    """A model of ``labelled (doc_id, text, lang)``, from about ``per_language`` distinct rows a language at most."""
    sample = sampled(labelled, per_language, max_languages)
    counts = sample.mapInArrow(_count, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(
        F.sum("n").alias("n")
    )
    packed = counts.groupBy("lang").applyInArrow(_pack, "lang string, packed binary")
    return Model([(r["lang"], bytes(r["packed"])) for r in packed.collect()])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: a quarter of them, by checksum of the id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """A struct ``doc`` of the ``keep`` columns, ``lang_pred``, ``score``, ``evidence``, and ``spans (begin, end, lang)``.

    ``known_letters`` counts the letters that the evidence is about, those of learned scripts.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    carry = ["doc"] + ["text"] * ("text" in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in text_chunks(batch.column("text"), CHUNK):
                langs = shipped.value.langs
                found = _Labels(shipped.value, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(lo, len(offsets) - 1) for c in carry],
                        pa.array(found.names(langs), pa.string()),
                        pa.array(found.score),
                        pa.array(found.evidence),
                        pa.array(found.known),
                        found.spans(langs),
                    ],
                    names=[*carry, "lang_pred", "score", "evidence", "known_letters", "spans"],
                )

    # the text crosses over once, beside the other columns
    others = F.struct(F.lit(0).alias("_"), *[docs[c] for c in keep if c != "text"])
    rows = docs.select(others.alias("doc"), "text")
    types = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry]
    spans = "array<struct<begin: bigint, end: bigint, lang: string>>"
    found = rows.mapInArrow(run, ", ".join([*types, "lang_pred string, score double, evidence double, known_letters double", f"spans {spans}"]))
    fields = [F.col("text") if c == "text" else F.col(f"doc.`{c}`") for c in keep]
    return found.select(F.struct(*fields).alias("doc"), "lang_pred", "score", "evidence", "known_letters", "spans")


def keep_identified(docs: DataFrame, least: float = REJECT, each: float = REJECT_EACH) -> DataFrame:
    """``docs`` without those in no language, and with the language found where ``lang`` is null.

    Texts without letters go, and those whose letters look drawn at random: evidence under
    ``least`` in all and under ``each`` for a letter of a learned script.  A mix of languages or
    a script that no learned language writes is no reason to drop a text; the latter keeps
    its null.  Everything stays as it is if there is nothing to learn from.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    if not model.langs:
        return docs
    found = identify(docs, model, docs.columns).filter(F.col("lang_pred") != UND)
    random = (F.col("evidence") < least) & (F.col("evidence") < each * F.col("known_letters"))
    named = F.coalesce("doc.lang", F.when(F.col("score") >= 0.5, F.col("lang_pred")))
    return found.filter(~random).select(
        *[named.alias(c) if c == "lang" else F.col(f"doc.`{c}`") for c in docs.columns]
    )
