"""Fill-in-the-middle: texts cut in three at drawn places and put together in another order.

A text is cut into units: a word with the whitespace ahead of it, or whitespace at the end.
``regexp_count`` gives their number ``n``; two draws from ``0 .. n`` are the ends of prefix
and middle.  A pattern made for each row, ``(unit{a}+)(unit{b-a}+)(rest)`` with possessive
counts, captures the three parts in one match, which the replacement writes in the order
of the row's form.  Possessive counts are walked through step by step, so a text of millions
of units needs no deeper stack than a short one.

Draws are hex digits of ``sha256("<seed>:<id>")``.  Forms: ``psm`` (prefix, suffix, middle),
``spm`` (suffix, prefix, middle), or ``plain``, the text as it is.  Texts that hold one of the
marks stay plain, so ``restore`` is exact.

Null texts count as empty, empty ones stay plain.  A null id draws as an empty one would.
Rows are independent of each other: repeated rows give repeated results, an empty table an
empty one; other columns come back in the struct ``doc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A word with the whitespace ahead of it, or the whitespace at the end.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"


def draws(id_: Column, seed: int) -> list[Column]:
    """The first four groups of 8 hex digits as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    psm = F.regexp_replace(output, f"(?s)\\A{PREFIX}(.*){SUFFIX}(.*){MIDDLE}(.*)\\z", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)\\A{SUFFIX}(.*){PREFIX}(.*){MIDDLE}(.*)\\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle(docs: DataFrame, keep: list[str], seed: int = 42, share: int = 50, spm: int = 80) -> DataFrame:
    """``doc`` (struct of the ``keep`` columns), ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    ``share`` percent of the texts are cut, ``spm`` percent of those in the form ``spm``.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    one, two, three, four = draws(docs["doc_id"], seed)
    rows = docs.select(
        F.struct(*[docs[c] for c in keep]).alias("doc"),
        text.alias("text"),
        F.regexp_count(text, F.lit(UNIT)).cast("bigint").alias("n"),
        one.alias("h1"),
        two.alias("h2"),
        (three % 100).alias("h3"),
        (four % 100).alias("h4"),
    )
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") >= share), "plain").when(F.col("h4") < spm, "spm")
    count = F.greatest(a, b) - F.least(a, b)
    pattern = F.format_string(f"(?s)\\A((?:{UNIT}){{%d}}+)((?:{UNIT}){{%d}}+)(.*)\\z", F.least(a, b), count)
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    cut = rows.withColumn("form", form.otherwise("psm")).withColumn("pattern", pattern)
    made = cut.select(
        "doc",
        "n",
        "form",
        F.when(F.col("form") == "plain", F.col("text"))
        .otherwise(F.regexp_replace(F.col("text"), F.col("pattern"), order))
        .alias("output"),
    )
    at = lambda mark: F.instr(F.col("output"), F.lit(mark)).cast("bigint")
    after = F.when(F.col("form") == "psm", at(SUFFIX)).when(F.col("form") == "spm", at(MIDDLE))
    width = len(PREFIX)
    middle = F.char_length("output").cast("bigint") - at(MIDDLE) + 1 - len(MIDDLE)
    return made.select(
        "doc",
        "n",
        "form",
        (after - at(PREFIX) - width).alias("prefix_chars"),
        F.when(F.col("form") != "plain", middle).alias("middle_chars"),
        "output",
    )
