"""Rows that repeat entirely and are read by one task."""

import random

from test_operators import brute_repeats

from quarry.llm import suffix_dedup


def test_repeated_rows_in_one_task(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    text = " ".join(word() for _ in range(60))
    t = {1: text, 2: "start " + text[50:250] + " end"}
    rows = [(1, t[1]), (1, t[1]), (2, t[2]), (2, t[2]), (1, t[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in suffix_dedup.remove_repeats(docs).collect()]
    want = brute_repeats(t, 100)
    assert sorted(got) == sorted((i, want[i]) for i, _ in rows)
    assert want[1][1] == 0 and want[2][1] >= 200
