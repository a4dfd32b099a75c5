"""Each operator against a brute-force version on messy rows, and its defined results at the edges."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import fingerprint, html_text, line_dedup, lyndon, mixing, neighbours, packing, quality, simhash, suffix_dedup, toxicity
from quarry.llm.bpe import Encoder
from quarry.llm.components import connected
from quarry.llm.queries import tokenizer_path

SPACE = "[\x20\x09-\x0d]"


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


# 1 fingerprints
def test_fingerprint_edits(messy):
    t = texts(messy)
    ids = sorted(t)
    got = {r.doc_id: r for r in fingerprint.with_next(messy).collect()}
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        a, b, half = t[i], t[ids[(k + 1) % len(ids)]], len(t[i]) // 2
        assert (got[i].n_chars, got[i].edited_sha256) == (len(a), sha(a[: len(a) - half] + b[:half]))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    own = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(messy).collect()}
    assert own == {i: r.fingerprint for i, r in got.items()}
    assert len({own[i] for i in t if t[i] == t[13]}) == 1


def brute_digest(b):
    """Codes and length of a digest, from the definition."""
    counts, n = [0] * 1024, len(b)
    for i in range(n):
        x = (b[i] * 0x9E3779B1 + b[(i + 5) % n] * 0x85EBCA77 + b[(i + 11) % n] * 0xC2B2AE3D) % 2**32
        x = (x ^ x >> 15) * 0x2C1B3C6D % 2**32
        counts[(x ^ x >> 13) >> 22] += 1
    q = [sorted(counts)[k] for k in (255, 511, 767)]
    return [sum(c > x for x in q) for c in counts], round(8 * math.log1p(n))


def test_fingerprint_digest_and_likeness(messy):
    t = texts(messy)
    ids = sorted(t)
    digest = {i: brute_digest(t[i].encode()) for i in ids}
    got = {r.doc_id: r for r in fingerprint.with_next(messy).collect()}
    for k, i in enumerate(ids):
        a, b = t[i], t[ids[(k + 1) % len(ids)]]
        codes, n = digest[i]
        packed = bytes(codes[j] << 6 | codes[j + 1] << 4 | codes[j + 2] << 2 | codes[j + 3] for j in range(0, 1024, 4))
        assert got[i].fingerprint == f"{n:02x}{packed.hex()}"
        half = len(a) // 2
        for other, near in ((brute_digest((a[: len(a) - half] + b[:half]).encode()), got[i].near_edited), (digest[ids[(k + 1) % len(ids)]], got[i].near_next)):
            apart = sum(abs(x - y) for x, y in zip(codes, other[0])) + min(512, 8 * abs(n - other[1]))
            assert math.isclose(near, 1 - apart / (3 * 1024 + 512))


def test_fingerprint_edges(odd, nothing):
    assert fingerprint.with_next(nothing).count() == 0
    rows = fingerprint.with_next(odd).collect()
    assert len(rows) == 6 and {r.doc_id for r in rows} == {None, 1, 2}
    c, n = fingerprint.digests([b"", b"a", b"abc" * 500, b"abc" * 500])
    assert fingerprint.likeness(c[2:3], c[3:4], n[2:3], n[3:4])[0] == 1 and fingerprint.likeness(c[:1], c[2:3], n[:1], n[2:3])[0] < 1


# 2 mixing
def brute_mix(rows):
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r] for r in rows if r[2] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, free, left = {}, list(sources), float(sum(total.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if 3 * total[s] < weight[s] * level]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= target[s]
            free.remove(s)
    return size, total, target | {s: weight[s] * level for s in free}


def test_mix_targets_and_taken(messy):
    rows = [(r.doc_id, r.text, r.source) for r in messy.select("doc_id", "text", "source").collect()]
    size, total, target = brute_mix(rows)
    got = mixing.mix(messy).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id): r for r in got}
    for row in rows:
        g = by[row[0]]
        assert (g.size, g.source_size) == (size[row], total[row[2]])
        assert math.isclose(g.target, target[row[2]], rel_tol=1e-12, abs_tol=1e-9)
        assert g.taken == g.copies * g.size and 0 <= g.copies <= 3
    taken = Counter()
    for row in rows:
        taken[row[2]] += by[row[0]].taken
    longest = {s: max(size[r] for r in rows if r[2] == s) for s in total}
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in total)
    assert sum(taken.values()) <= sum(total.values())
    assert {(r.doc_id, r.copies) for r in mixing.mix(messy.repartition(7)).collect()} == {(r.doc_id, r.copies) for r in got}


def test_mix_edges(odd, nothing):
    assert mixing.mix(nothing).count() == 0
    rows = mixing.mix(odd).collect()
    assert len(rows) == 6 and all(r.taken == 0 for r in rows if r.size == 0)


# 3 line dedup
def brute_lines(t, least):
    key = lambda s: re.sub(f"^{SPACE}+|{SPACE}+$", "", s).translate({c: c + 32 for c in range(65, 91)})
    found = Counter(k for x in t.values() for k in {key(s) for s in x.split("\n")} if k)
    out = {}
    for i, x in t.items():
        lines = x.split("\n")
        kept = [s for s in lines if found[key(s)] < least or not key(s)]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


@pytest.mark.parametrize("least", [2, 10])
def test_lines(messy, least, monkeypatch):
    if least == 2:  # the ways for many keys, some of them hot, and many bitmaps
        monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 2)
        monkeypatch.setattr(line_dedup, "HOT_KEY", 20)
        monkeypatch.setattr(line_dedup, "BROADCAST_BITS", 0)
    out = line_dedup.apply_bitmaps(messy, line_dedup.keep_bitmaps(messy, min_docs=least)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, sha(r.kept_text)) for r in out} == brute_lines(texts(messy), least)


def test_lines_keep_first_and_edges(spark, messy, odd, nothing):
    t = texts(messy)
    out = {r.doc_id: r for r in line_dedup.apply_bitmaps(messy, line_dedup.keep_bitmaps(messy, keep_first=True)).collect()}
    assert "shared   boilerplate line of text" in out[4].kept_text.lower() and "boilerplate" not in out[8].kept_text.lower()
    assert sum(r.n_dropped for r in out.values()) == sum(v[1] for v in brute_lines(t, 10).values()) - 1
    assert line_dedup.apply_bitmaps(nothing, line_dedup.keep_bitmaps(nothing)).count() == 0
    assert line_dedup.apply_bitmaps(odd, line_dedup.keep_bitmaps(odd)).count() == 6
    clash = messy.withColumnsRenamed({"lang": "b_doc", "source": "b_hash", "size": "bits", "line": "opens", "pos": "words", "part": "row", "n_chars": "n_lines", "key": "n_dropped", "m": "kept.text"})
    rows = line_dedup.apply_bitmaps(clash, line_dedup.keep_bitmaps(clash))
    assert {r.doc_id: (r.n_lines, r.n_dropped, sha(r.kept_text)) for r in rows.collect()} == brute_lines(t, 10)
    assert rows.filter("doc_id = 100").select("b_doc", "b_hash", "bits", "opens", "words", "row", "`kept.text`").collect()[0] == ("en", "hot", 1, "x", 3, 4, 5)
    many = spark.createDataFrame([(i, "\n".join(f"{j}" if j % 3 else f"{i}-{j}" for j in range(200))) for i in range(12)], "doc_id long, text string")
    rows = line_dedup.apply_bitmaps(many, line_dedup.keep_bitmaps(many)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, sha(r.kept_text)) for r in rows} == brute_lines(texts(many), 10)


# 4 and 9 classifiers
def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] > -0.5)).astype(float)
    m = toxicity.boost(x[:400], y[:400]).margin(x[400:])
    assert ((m > 0) == (y[400:] == 1)).mean() > 0.93
    px, pp = toxicity.isotonic(m, y[400:])
    assert (np.diff(pp) >= 0).all() and (np.diff(px) >= 0).all()


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(5)
    m, y = rng.integers(0, 25, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    order = np.argsort(m, kind="stable")
    m, y = m[order], y[order]
    first, last = np.searchsorted(m, m, "left"), np.searchsorted(m, m, "right")
    mean = lambda a, b: y[a:b].mean()
    # the max-min formula, over whole ties
    starts = sorted(set(first))
    want = [max(min(mean(a, b) for b in sorted(set(last)) if b >= last[i]) for a in starts if a <= first[i]) for i in range(60)]
    px, pp = toxicity.isotonic(m, y)
    got = np.interp(m, px, pp)
    blocks = Counter(round(w, 9) for w in want)
    for i in range(60):
        n = blocks[round(want[i], 9)]
        assert abs(got[i] - (want[i] * n + 0.05) / (n + 0.1)) < 1e-9


def test_log_count_ratio_and_dual_solver():
    rows = [{0, 1}, {0, 2}, {0, 3}, {1, 2}, {2, 3}, {3}]
    y = np.array([1, 1, 1, -1, -1, -1])
    have = np.array([[sum(g in r for r, z in zip(rows, y) if z == side) for g in range(4)] for side in (1, -1)])
    want = [math.log((have[0][g] + 1) / 5) - math.log((have[1][g] + 1) / 5) for g in range(4)]
    ratio = quality.log_count_ratio(have[0], have[1], 3, 3)
    assert np.allclose(ratio, want)
    rng = np.random.default_rng(1)
    has = rng.random((30, 6)) < 0.5
    scale = rng.normal(size=6)
    x = has * scale
    z = np.where(x @ rng.normal(size=6) + 0.3 * rng.normal(size=30) > 0, 1, -1)
    cost = np.full(30, 0.7)
    w = quality.dual_coordinate_descent([np.flatnonzero(r) for r in has], scale, z, cost, rounds=3000)
    # the same by projected gradient on the dual
    q = (x * z[:, None]) @ (x * z[:, None]).T
    alpha = np.zeros(30)
    for _ in range(20_000):
        alpha = np.clip(alpha + (1 - q @ alpha) / np.linalg.norm(q, 2), 0, cost)
    assert np.allclose(w, (alpha * z) @ x, atol=5e-3)


def test_sample_counts_texts_once(spark):
    from quarry.llm.sample import labelled_sample, streamed

    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, None), (6, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0), (4, 1), (5, 1), (6, 0), (9, 1)], "doc_id long, toxic int")
    want = sorted((sha(t), t, y) for t, y in (("a", 0), ("b", 1), ("", 1)))
    for part in (docs, docs.repartition(3)):
        got = [(h, t, y) for t, y, h in streamed(labelled_sample(part, labels, "toxic", F.lit(True), 100))]
        assert got == want
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 2).count() <= 2


def brute_lexicons(rows):
    """Tokens that each half and the whole show to be toxic."""
    out = []
    for halves in ((0,), (1,), (0, 1)):
        mine = [(toxicity.tokens(t), y) for t, y in rows if int(sha(t)[:8], 16) % 2 in halves]
        n = Counter(y for _, y in mine)
        count = {y: Counter(w for s, z in mine if z == y for w in s) for y in (0, 1)}
        out.append({w for w, p in count[1].items() if p >= 5 and (p - math.sqrt(p)) / max(1, n[1]) > 10 * (count[0][w] + 1) / (n[0] + 1)})
    return out


def test_lexicons_and_order(spark):
    docs, labels = labelled(spark)
    from quarry.llm.sample import labelled_sample

    sample = labelled_sample(docs, labels, "toxic", F.lit(True), 1000)
    rows = [(r.text, r.label) for r in sample.collect()]
    got = toxicity.learn_lexicons(sample)
    for lexicon, want in zip(got, brute_lexicons(rows), strict=True):
        stems = {w[:-1] for w in want if w[-1] == "*"}
        assert lexicon.words == {w for w in want if w[-1] != "*"}
        assert lexicon.stems == {s for s in stems if not any(s != o and s.startswith(o) for o in stems)}
    one = {r.doc_id: r.score for r in toxicity.scores(docs, toxicity.train(docs, labels)).collect()}
    other = docs.repartition(5, "text")
    assert one == {r.doc_id: r.score for r in toxicity.scores(other, toxicity.train(other, labels)).collect()}


def labelled(spark, n=400):
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        body = " ".join(f"w{(i * 31 + j * 17) % 89}" for j in range(40 + i % 30))
        rows.append((i, body + (" you idiot ### ###" if bad else ""), int(bad), int(not bad)))
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t, *_ in rows], "doc_id long, text string, score double, label string")
    return docs, spark.createDataFrame([(i, q, t) for i, _, t, q in rows], "doc_id long, quality int, toxic int")


def test_classifiers_learn(spark):
    docs, labels = labelled(spark)
    q = {r.doc_id: r.score for r in quality.scores(docs, quality.train(docs, labels)).collect()}
    t = {r.doc_id: r.score for r in toxicity.scores(docs, toxicity.train(docs, labels)).collect()}
    for r in labels.collect():
        assert (q[r.doc_id] >= 0.3) == bool(r.quality) and (t[r.doc_id] >= 0.7) == bool(r.toxic)


def test_classifier_edges(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd.select("doc_id", "text")
    assert [r.score for r in quality.scores(docs, quality.train(docs, none)).collect()] == [0.5] * 6
    assert quality.scores(odd, quality.train(odd, none)).columns == toxicity.scores(odd, toxicity.train(odd, none)).columns == ["doc_id", "score"]
    long = spark.createDataFrame([(1, "you idiot! " * 60_000), (2, "")], "doc_id long, text string")
    known = labelled(spark)
    assert all(0 <= r.score <= 1 for m in (quality, toxicity) for r in m.scores(long, m.train(*known)).collect())
    assert [r.score for r in toxicity.scores(docs, toxicity.train(docs, none)).collect()] == [0.5] * 6
    one = spark.createDataFrame([(2, 1, 1), (None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.scores(docs, quality.train(docs, one, allowed=F.lit(True))).collect())
    empty = nothing.select("doc_id", "text")
    assert toxicity.scores(empty, toxicity.train(empty, none)).count() == 0


# 5 suffix-array dedup
def brute_repeats(t, length):
    seen, out = set(), {}
    for i in sorted(t):
        b = t[i].encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(b)))
        out[i] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(150):
        parts = [rng.integers(0, 1 + rng.integers(1, 4), rng.integers(1, 25)) for _ in range(rng.integers(1, 6))]
        edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        order = lyndon.suffix_arrays(np.concatenate(parts), edges)
        for i, p in enumerate(parts):
            assert (order[edges[i] : edges[i + 1]] - edges[i]).tolist() == sorted(range(len(p)), key=lambda j: p[j:].tolist())


@pytest.mark.parametrize("part", [1 << 13, 400])
def test_repeats(messy, part, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", part)  # 400: the pieces of most anchors are dealt into parts
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(messy).collect()}
    assert got == brute_repeats(texts(messy), 100)


def test_repeats_edges(odd, nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == 6
    same = [r for r in rows if r.doc_id == 1 and r.n_bytes == 216]
    assert len(same) == 2 and same[0] == same[1] and 0 < same[0].n_removed < 216


def test_long_text_in_parts(spark, monkeypatch):
    import random

    rng = random.Random(2)
    part = "".join(rng.choice("abcdefgh ") for _ in range(700))
    t = {0: part * 2 + "tail" + part[100:400], 1: "x" * 500 + part}
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    docs = spark.createDataFrame(list(t.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute_repeats(t, 100)


# 6 html
def test_main_text(spark):
    page = """<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class="cookie-banner">We use cookies on this site for all of you.</div>
    <article><h1>Head &amp; more</h1><p>First   para <b>bo</b>ld.<br>Next<script>var x="</p>"</script></p><div class="ad">Buy this very good thing now, it is cheap</div>
    <form>Name <input></form><p>Sh.</p></article><section id=comments><p>I liked to read this article very much, thanks to the writer.</p></section><footer>&copy; 2020 all of it</footer></body></html>"""
    assert html_text.main_text(page) == "Head & more First para bold. Next Sh."
    rows = spark.createDataFrame([(1, "u", page, "t"), (1, "u", page, "t"), (2, None, None, "t"), (None, "v", "", "t"), (3, "w", "<p>" + "word " * 60, "t")], "page_id long, url string, html string, text string")
    got = html_text.extract(rows).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in got) == [(0, 0), (1, 37), (1, 37), (2, 0), (3, 299)]
    assert html_text.extract(rows.limit(0)).count() == 0


# 7 simhash
def brute_fingerprint(text):
    w = [x for x in re.split(SPACE.encode() + b"+", re.sub(b"[A-Z]", lambda m: m[0].lower(), text.encode())) if x]
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fp, budget=4):
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fp[i] ^ fp[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("group", [4096, 3])
def test_near_duplicates(messy, group, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", group)  # 3: groups are cut into chunks
    fp = {i: brute_fingerprint(t) for i, t in texts(messy).items()}
    got = simhash.near_duplicates(messy).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == fp
    assert {r.doc_id: r.component_id for r in got} == components(fp)


def test_trie_join_finds_every_component(monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    v = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]]))
    half = len(v) // 2
    both = np.concatenate([v, v[:half], v[half:]])  # a run joined with itself, and two runs joined with each other
    n = len(v)
    roots = (np.array([0, n]), np.array([n, n + half]), np.array([0, n + half]), np.array([n, 2 * n]))
    for budget, leaf in ((0, 64), (2, 1), (4, 64), (4, 1), (10, 16)):
        monkeypatch.setattr(simhash, "LEAF", leaf)
        monkeypatch.setattr(simhash, "SLAB", 500)
        monkeypatch.setattr(simhash, "PAIRS", 300)
        x, y = simhash.trie_join(both, roots, budget)
        assert (np.bitwise_count(both[x] ^ both[y]) <= budget).all() and len(x) < 2 * n
        for lo, hi, pairs in ((0, n, None), (n, 2 * n, (n, n + half))):
            own = dict(enumerate(both[lo:hi].tolist(), lo))
            want = components(own, budget) if pairs is None else across(own, budget, pairs[1])
            root = {i: i for i in own}
            for a, b in ((a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True) if lo <= a < hi):
                a, b = sorted((root[a], root[b]))
                root = {k: a if r == b else r for k, r in root.items()}
            assert root == want


def across(fp, budget, middle):
    """Components of the pairs from both sides of ``middle`` only."""
    root = {i: i for i in fp}
    for i in fp:
        for j in fp:
            if i < middle <= j and (fp[i] ^ fp[j]).bit_count() <= budget:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return root


def test_near_duplicates_edges(odd, nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 6 and [r.component_id for r in rows if r.doc_id is None] == [None]
    x, y = "one two three four five six seven", "a b c d e f g h"
    rows = simhash.near_duplicates(odd.sparkSession.createDataFrame([(3, x), (5, x), (5, y), (None, y)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in rows) == [(0, 5), (3, 3), (5, 3), (5, 5)]


def test_the_budget_prunes_most_pairs(spark):
    """Of a real table's fingerprints in one trie, and of a million random ones in their groups."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    real = np.unique(np.array([r.fp for r in simhash.fingerprints(docs).select("fp").distinct().collect()], np.int64).view(np.uint64))
    some = np.random.default_rng(5).integers(0, 2**64, 10**6, dtype=np.uint64)
    blocks = simhash.block_keys(len(some), 4)[0]
    key = simhash.key_bits(some, blocks)
    assert blocks and (np.bincount(key.astype(np.int64)) > simhash.MEAN // 2).all()
    for values in (real, np.sort(some[key == key[0]])):
        seen = Counter()
        one = (np.array([0]), np.array([len(values)]))
        simhash.trie_join(values, (*one, *one), 4, seen)
        assert seen["pruned"] > 2 * seen["compared"], seen


def test_block_keys_hold_for_all_sizes():
    for classes, least, most in [(c, *s) for c in (10, 10**4, 10**6, 10**9) for s in ((None, None), (16, 256), (2, 2))]:
        keys = simhash.block_keys(classes, 4, least, most)
        flips = np.random.default_rng(0).integers(0, 64, (200, 4))
        for f in flips.tolist():
            assert any(all(not any(s <= b < s + w for b in f) for s, w in key) for key in keys)


def test_connected(spark):
    links = [(i, i + 1) for i in range(30)] + [(50, 40), (41, 50), (7, 7), (60, 61), (61, 60)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 50: 40, 60: 60, 61: 60}
    assert connected(spark.createDataFrame([], "src long, dst long")).count() == 0


# 8 packing
def plain_library(path):
    """The ids that the library gives, used as it comes."""
    library = Tokenizer.from_file(path)
    return lambda t: [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(t, add_special_tokens=False)]


def test_encoder_is_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    t = ["", "  ", "It's a <|endoftext|> test\x1cx  y ź naïve İstanbul", "x" * 70 + " " + "ab" * 300, "don't 123abc 你好 ÀÉß", "áè  x y"]
    t += ["a<|endoftext|>b", "<|startoftext|>", "<|ENDOFTEXT|> <|end", "<| endoftext |>", "x" * 60 + "<|endoftext|>" + "é" * 60, "Word\u00a0word\u2003x\u2028y", "\U0001f600 a\u0301 ﬁ"]
    assert Encoder(path).encode(t) == plain_library(path)(t)


def test_encoder_is_the_library_on_a_whole_table():
    import pyarrow.parquet as pq

    path = tokenizer_path("word_bpe_49k.json")
    t = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    assert Encoder(path).encode(t) == plain_library(path)(t)


def plain_best_fit(items, capacity):
    """Sequences of best fit by decreasing length, one item at a time."""
    room = []
    for x in sorted(items, reverse=True):
        fits = [r for r in room if r >= x]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else capacity) - x)
    return len(room)


def test_packing(messy, odd, nothing):
    path = tokenizer_path("word_bpe_49k.json")
    for docs in (messy, odd):
        encode = plain_library(path)
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = np.frombuffer(encode([r.text or ""])[0] + b"\0\0\0\0", "<u4")
            want += [(r.doc_id, k, lo, len(c), zlib.crc32(c.tobytes())) for k, lo in enumerate(range(0, len(ids), 256)) if len(c := ids[lo : lo + 256])]
        got = packing.pack(packing.pieces(docs, path, capacity=256), capacity=256).collect()
        order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=order) == sorted(want, key=order)
        rows = defaultdict(list)
        for r in got:
            rows[r.sequence_id].append((r.offset, r.length))
        for s in rows.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= 256
        assert len(rows) <= plain_best_fit([r.length for r in got], 256)
    assert packing.pack(packing.pieces(nothing, path)).count() == 0


def test_plan_keeps_every_piece():
    rng = np.random.default_rng(4)
    for _ in range(60):
        capacity = int(rng.integers(5, 40))
        h = Counter(rng.integers(1, capacity + 1, rng.integers(1, 60)).tolist())
        used = Counter()
        bins = 0
        for pattern, times in packing.plan(dict(h), capacity):
            assert sum(x * n for x, n in pattern) <= capacity and times > 0
            bins += times
            for x, n in pattern:
                used[x] += n * times
        assert used == h
        assert bins <= plain_best_fit(list(h.elements()), capacity) + 1


def test_reduction_takes_dominating_sets_only():
    left = {6: 1, 5: 1, 4: 2, 3: 1, 1: 1}
    fixed = packing.reduce_instance(left, 10)
    assert (((6, 1), (4, 1)), 1) in fixed and all(sum(x * n for x, n in p) <= 10 for p, _ in fixed)


# 10 neighbours
def test_nearest(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[700:720] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] + [1.0] * 14), (None, v[0].tolist()), (2004, [1.0])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    got = neighbours.nearest(df, is_query=F.col("vec_id") % 100 == 0, pivots=64, posts=4, reads=16).collect()
    x, hit = v.astype(np.float64), 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(d[m[1]] - m[2]) < 1e-12 for m in mine)
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hit += len({m[1] for m in mine} & set(np.lexsort((np.arange(1500), d))[:10].tolist()))
    assert hit >= 0.9 * 150 and {r.query_id for r in got} == set(range(0, 1500, 100))


def test_nearest_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [5.0, 5.0])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, is_query=F.col("vec_id") == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 1, 0.0), (0, 2, 2, 5.0)]
    assert neighbours.nearest(df.limit(0), is_query=F.lit(True)).count() == 0
