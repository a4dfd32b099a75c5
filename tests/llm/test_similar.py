"""The pipeline's near-dedup against all pairs."""

import random
from collections import defaultdict

import numpy as np

import corpus_pipeline as P
from quarry.llm import similar


def brute_groups(t, percent=80):
    def own(x):
        w = x.lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {i: own(x) for i, x in t.items()}, {i: i for i in t}
    for i in sorted(t):
        for j in sorted(t):
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return root


def edited(rng, n_docs=60):
    """Texts of 30 to 200 words, and copies with edits in several places: similarities on both sides of 0.8."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    t = {}
    for i in range(0, n_docs, 4):
        base = [word() for _ in range(rng.randint(30, 200))]
        for k in range(4):
            w = list(base)
            for _ in range(k * len(base) // 100):
                w[rng.randrange(len(w))] = word()
            t[i + k] = " ".join(w)
    return t


def test_near_dedup_finds_copies(spark):
    """No pair is joined that isn't similar enough; of the joins that all pairs give, nearly all are made."""
    t = edited(random.Random(4), 240) | {1000: "", 1001: " \n", 1002: "Word", 1003: "word"}
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in t.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute_groups(t)
    assert 80 < len(set(want.values())) < 200
    got = defaultdict(set)
    for r in similar.similar_documents(docs).collect():
        got[r.root].add(r.doc_id)
    assert all(len({want[i] for i in g}) == 1 for g in got.values())
    assert len(got) - len(set(want.values())) <= 0.15 * (len(t) - len(set(want.values())))
    assert {1000, 1001} in got.values() and {1002, 1003} in got.values()
    kept = dict(P.STAGES)["near_dedup"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(g) for g in got.values())


def test_stars_join_what_single_pairs_join(spark, monkeypatch):
    t = edited(random.Random(9), 80)
    docs = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    roots = lambda: {r.doc_id: r.root for r in similar.similar_documents(docs).collect()}
    star, want = roots(), brute_groups(t)
    monkeypatch.setattr(similar, "STARS", False)
    plain = roots()
    # a star may compare pairs besides those that were found
    assert all(star[i] == star[j] for i in t for j in t if plain[i] == plain[j])
    assert all(want[i] == want[j] for i in t for j in t if star[i] == star[j])


def test_alike_is_exact():
    t = edited(random.Random(2), 60)
    sets = {i: similar.shingles(x, 5) for i, x in t.items()}
    for i in t:
        for j in t:
            shared = len(np.intersect1d(sets[i], sets[j]))
            assert similar.alike(sets[i], sets[j], 80) == (shared >= 0.8 * len(np.union1d(sets[i], sets[j])))


def test_near_dedup_tells_rows_apart(spark):
    rng = random.Random(1)
    a, b, c, d = (" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(100)) for _ in range(4))
    for one, two in ((a, b), (b, a)):  # whichever comes first by its hash
        rows = [(5, one), (5, two), (3, two + " end"), (None, c), (None, d), (None, c)]
        docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
        got = dict(P.STAGES)["near_dedup"](spark, docs, "").collect()
        assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, c), (0, d), (3, two + " end"), (5, one)])
