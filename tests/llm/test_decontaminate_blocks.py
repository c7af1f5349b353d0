"""Blocks of the benchmark stay within their bound."""

from __future__ import annotations


def test_repeated_rows_do_not_fill_a_block(spark):
    from spanline.llm.decontaminate import dealt

    rows = [(1, "word " * 10)] * 500 + [(k, f"text {k} " * 5) for k in range(2, 300)] + [(300, "long " * 100)]
    items = spark.createDataFrame(rows, "item_id bigint, text string").repartition(3)
    got = dealt(items, 200).collect()
    assert sorted((r["item_id"], r["text"]) for r in got) == sorted(set(rows))
    size: dict[int, list[int]] = {}
    for r in got:
        size.setdefault(r["block"], []).append(len(r["text"]))
    assert all(sum(n) - max(n) <= 200 for n in size.values())
