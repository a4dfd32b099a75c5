"""Texts far beyond the sizes of batches and slabs, and columns whose names are also used inside."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_digest, brute_fingerprint, sha

from quarry.llm import fingerprint, line_dedup, mixing, neighbours, packing, simhash
from quarry.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def long(spark):
    """A text of 150,000 words and 1 MB, a copy with one word changed, the same line very often, and a short text."""
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    w = [rng.choice(vocabulary) for _ in range(150_000)]
    text = "\n".join(" ".join(w[i : i + 50]) for i in range(0, len(w), 50))
    rows = [(1, text), (2, text.replace(" ", "  ", 1) + " end"), (3, "the same line\n" * 30_000), (4, "short")]
    return spark.createDataFrame([(i, t, "en", "hot", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").cache()


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_fingerprints_of_long_texts(long):
    t = texts(long)
    got = {r.doc_id: r for r in fingerprint.with_next(long).collect()}
    half = len(t[1]) // 2
    assert got[1].n_chars == len(t[1]) and got[1].edited_sha256 == sha(t[1][: len(t[1]) - half] + t[2][:half])
    assert got[1].near_next > 0.9 > got[3].near_next  # the next of 1 is its near copy, the next of 3 is another text
    assert brute_digest(t[4].encode())[1] >= 0 and got[1].fingerprint != got[3].fingerprint


def test_words_and_lines_of_long_texts(long):
    t = texts(long)
    got = {r.doc_id: r.size for r in mixing.mix(long).collect()}
    assert got == {i: len(x.split()) for i, x in t.items()}
    out = line_dedup.apply_bitmaps(long.select("doc_id", "text"), line_dedup.keep_bitmaps(long.select("doc_id", "text"), min_docs=2))
    assert {r.doc_id: (r.n_lines, r.n_dropped, sha(r.kept_text)) for r in out.collect()} == brute_shared(t, 2)


def brute_shared(t, least):
    """Lines in ``least`` different documents go, however often they are in one."""
    lines = {i: x.split("\n") for i, x in t.items()}
    found = Counter(k for own in lines.values() for k in {s.strip(" \t\n\x0b\x0c\r").lower() for s in own})
    out = {}
    for i, own in lines.items():
        kept = [s for s in own if not s.strip() or found[s.strip().lower()] < least]
        out[i] = len(own), len(own) - len(kept), sha("\n".join(kept))
    return out


def test_simhash_of_long_texts(long):
    t = texts(long)
    got = {r.doc_id: r for r in simhash.near_duplicates(long.select("doc_id", "text")).collect()}
    for i in (1, 4):
        assert got[i].fp % 2**64 == brute_fingerprint(t[i])
    assert got[2].component_id == 1 and got[4].component_id == 4


def test_pieces_of_long_texts(long):
    path = tokenizer_path("word_bpe_49k.json")
    rows = [r for r in packing.pack(packing.pieces(long, path, capacity=2048), capacity=2048).collect() if r.doc_id == 1]
    rows.sort(key=lambda r: r.piece)
    assert len(rows) > 50 and [r.start for r in rows] == [2048 * i for i in range(len(rows))] and all(r.length == 2048 for r in rows[:-1])


def test_neighbours_with_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), 7, 8, 9, "v", 1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id long, rank int, id long, vector string, cid long, p int")
    plain = neighbours.nearest(df.select("vec_id", "embedding"), is_query=F.col("vec_id") % 20 == 0, k=3)
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(neighbours.nearest(df, is_query=F.col("vec_id") % 20 == 0, k=3)) == key(plain)
