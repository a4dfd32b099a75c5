"""Source divergence, hard negatives and quality rules against their definitions, and their defined results at the edges."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import divergence, negatives, rules

# 11 source divergence
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "lang string, source string, text string, value long, rank int, part string, term string, n long, block int"


def spoken(rng, n):
    vocabulary = ["the", "The", "of", "été", "naïve", "Zürich", "x1y2", "a_b", "\U0001f600ok", "don't"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    return " ".join(vocabulary[min(int(rng.expovariate(0.07)), len(vocabulary) - 1)] for _ in range(n))


def brute_divergence(rows, least, top):
    docs = [((lang or ""), (source or ""), Counter(t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in d[2])
        kept = sorted((t for t in df if df[t] >= least), key=lambda t: t.encode())
        groups = {s: sum((d[2] for d in own if d[1] == s), Counter()) for s in {d[1] for d in own}}
        whole = sum(groups.values(), Counter())

        def p(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        ps, q = {s: p(c) for s, c in groups.items()}, p(whole)
        for s in groups:
            pairs = [(o, sum(abs(ps[s][t] - ps[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, ps[s][t] - q[t]) for t in kept if groups[s][t] > 0 and ps[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for r, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.add((lang, s, part, item, value, r + 1))
    return out


@pytest.mark.parametrize("block,strip,entries", [(2048, 256, 200_000), (7, 2, 40)])
def test_divergence(spark, monkeypatch, block, strip, entries):
    monkeypatch.setattr(divergence, "PIECE", 50 if block == 7 else 4_000_000)
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    rng = random.Random(3)
    rows = [(rng.choice(["en", "en", "en", "fr", None]), rng.choice(["hot", "hot", "b", "É", None, "z"]), spoken(rng, rng.randint(0, 60))) for _ in range(300)]
    rows += [("en", "quiet", None), ("en", "quiet", ""), ("xx", "one", "lonely words"), ("xx", "two", "... 12"), *rows[:20], ("fr", "b", "the " * 5000)]
    df = spark.createDataFrame([(*r, 1, 2, "p", "t", 3, 4) for r in rows], DOCS).repartition(5)
    got = {tuple(r) for r in divergence.divergence(df, least=12, top=6, block=block, strip=strip).select("lang", "source", "part", "item", "value", "rank").collect()}
    want = brute_divergence(rows, 12, 6)
    assert got == want and any(r[0] == "xx" and r[2] == "pair" and r[4] == 0 for r in got)


def test_divergence_edges(spark):
    df = spark.createDataFrame([], DOCS)
    assert divergence.divergence(df).count() == 0
    assert divergence.divergence(spark.createDataFrame([("en", "a", "x", 1, 2, "", "", 3, 4)], DOCS)).count() == 0  # one source: no pairs, no kept terms
    big = np.array([[9 * 10**15 - 5, 0]])
    assert divergence.probabilities(big, np.array([[9 * 10**15 - 5]]), 2).tolist() == [[1 + 10**9 * (9 * 10**15) // (9 * 10**15 + 5), 1 + 10**9 * 5 // (9 * 10**15 + 5)]]


# 12 hard negatives
VECTORS = "vec_id long, label long, embedding array<double>, id long, cid long, unit int, score long, rank int, windows int, vector string"


def brute_negatives(rows, anchors, positives=5, kept=3, scale=256):
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            z = [math.floor(scale * x) for x in v]
            if sum(x * x for x in z) <= 1 << 62:
                good[i] = min(good.get(i, (label, z)), (label, z))
    out = set()
    for a, (label, v) in good.items():
        if not anchors(a):
            continue
        score = {i: sum(x * y for x, y in zip(v, z, strict=True)) for i, (_, z) in good.items() if i != a and len(z) == len(v)}
        first = sorted((i for i in score if good[i][0] == label), key=lambda i: (-score[i], i))[:positives]
        for p in first:
            fits = [i for i in score if good[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            for r, i in enumerate(sorted(fits, key=lambda i: (-score[i], i))[:kept]):
                out.add((a, p, r + 1, i, score[p], score[i]))
    return out


def vector_rows():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 6)) * rng.exponential(1, size=(400, 1))
    v[50:120] = v[49]  # a large group of copies, in all labels
    v[120:130] = 0
    rows = [(i, int(rng.integers(0, 4)), v[i].tolist()) for i in range(400)]
    rows += [(i, 1, v[i].tolist()) for i in range(3)] + [(i, 2, v[i].tolist()) for i in range(60, 64)]  # repeated ids
    rows += [(None, 1, v[0].tolist()), (500, None, v[0].tolist()), (501, 1, None), (502, 1, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (503, 1, [float("nan")] * 6), (504, 1, [math.inf] * 6)]
    rows += [(505, 1, []), (510, 1, [1.0, 2.0]), (515, 1, [1.0, 1.0]), (520, 2, [1.5, 0.5]), (525, 3, [1e300] * 6), (530, 1, [3e6] * 6), (535, 1, [3e6, 2e6] * 3), (540, 2, [2e6] * 6)]
    return rows


@pytest.mark.parametrize("unit,bucket", [(1024, 256), (16, 4)])
def test_hard_negatives(spark, monkeypatch, unit, bucket):
    monkeypatch.setattr(negatives, "LEAST_UNIT", unit)
    monkeypatch.setattr(negatives, "MOST_UNIT", unit)
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, "x") for r in rows], VECTORS).repartition(4)
    got = [tuple(r) for r in negatives.hard_negatives(df, is_anchor=F.col("vec_id") % 5 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    want = brute_negatives(rows, lambda i: i % 5 == 0)
    assert len(got) == len(set(got)) and set(got) == want and any(r[4] == 0 for r in got) and any(r[0] == 530 for r in got)


def test_buckets_are_passed_over(spark, monkeypatch):
    """With norms that differ, few buckets are multiplied."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(4096, 8)) * rng.exponential(1, size=(4096, 1)) ** 2)
    norm = np.sqrt((x * x).sum(1))
    order = np.argsort(-norm)
    part = negatives._Rows.__new__(negatives._Rows)
    part.cid, part.label, part.norm, part.x = np.arange(4096), np.zeros(4096, np.int64), norm[order], x[order]
    unit = negatives._Unit([part])
    seen = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    asks = pa.RecordBatch.from_pydict({"cid": [9999], "label": [1], "norm": [norm[7]], "vector": [x[7].tolist()], "windows": [[{"window": 1, "lo": 0, "hi": 1 << 62, "kth": 0}]]}, schema=pa.schema([("cid", pa.int64()), ("label", pa.int64()), ("norm", pa.float64()), ("vector", pa.list_(pa.float64())), ("windows", pa.list_(pa.struct([(c, pa.int64()) for c in ("window", "lo", "hi", "kth")])))]))
    make = negatives._Rows.__init__

    def counted(self, b, size):
        make(self, b, size)
        self.x = self.x.view(Counted)

    monkeypatch.setattr(negatives._Rows, "__init__", counted)
    got = unit.answers(asks, 3, False).to_pylist()
    s = part.x @ x[7]
    want = sorted(((-int(v), int(c)) for v, c in zip(s, part.cid, strict=True)))[:3]
    assert [(-r["score"], r["f_cid"]) for r in got] == want and len(seen) <= len(unit.buckets) // 2


def test_hard_negatives_edges(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(none, is_anchor=F.col("vec_id") % 50 == 0).count() == 0
    alone = spark.createDataFrame([(50, 1, [1.0], 1, 2, 3, 4, 5, 6, "x"), (51, 2, [0.6], 1, 2, 3, 4, 5, 6, "x")], VECTORS)
    assert negatives.hard_negatives(alone, is_anchor=F.col("vec_id") % 50 == 0).count() == 0  # no positive


# 13 quality rules
TEXTS = "doc_id long, lang string, text string, quality int, good int, stratum string, rule string, severity long, w string, k int, n int, s string, q string"
SPACE = "[\x20\x09-\x0d]"


def brute_features(text):
    text = text or ""
    w = re.findall(SPACE.replace("[", "[^") + "+", text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(3)}
    lines = [x for x in text.split("\n") if re.sub(SPACE, "", x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered)


def brute_most(n, rate, error):
    k, c = -1, 0.0
    for i in range(n + 1):
        c += math.comb(n, i) * rate**i * (1 - rate) ** (n - i)
        if c > error:
            return k
        k = i
    return k


def rule_rows():
    """Good texts, and bad ones with symbols or long words; a few good ones have symbols, too."""
    rng = random.Random(9)
    word = lambda n=5: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for i in range(3600):
        good = int(rng.random() < 0.85)
        w = [word(rng.randint(3, 8)) for _ in range(rng.randint(40, 90))]
        if not good:
            w = [x + "##" for x in w] if i % 2 else [x * 3 for x in w]
        elif rng.random() < 0.01:
            w[3] += "#" * rng.randint(1, 3)
        rows.append((i, "en" if i % 3 else "fr", " ".join(w), good if i % 5 else None))
    return rows


def test_rule_features(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t\n ", "a", "a b", "a b c", "a b c a b c", "x " * 50, "one\n\none\n one\none two\nÉ é\nÉ é\n", "#*$%&|<> a#b", " wide space no break\x1c", " ".join(rng.choice("abc") for _ in range(400)), "w " * 60_000]
    texts += ["\n".join(" ".join(rng.choice(["to", "be", "or", "not", "x$", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(12)) for _ in range(60)]
    df = spark.createDataFrame([(i, "en", t) + (1, 1, "", "", 1, "", 1, 1, "", "") for i, t in enumerate(texts)], TEXTS)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in rules.features(df).collect()}
    assert got == {i: brute_features(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n,rate,error", [(0, 0.1, 0.05), (50, 0.1, 0.01), (500, 0.02, 0.001), (2000, 0.01, 0.3), (3000, 0.002, 0.002)])
def test_exact_binomial_bound(spark, n, rate, error):
    got = spark.range(1).select(rules.most_rejected(F.lit(n).cast("long"), rate, F.lit(error)).alias("k")).head().k
    assert got == brute_most(n, rate, error)


def test_rules_are_certified(spark):
    import hashlib

    rows = rule_rows()
    docs = spark.createDataFrame([(i, lang, t) + (0, 1, "", "", 1, "", 1, 1, "", "") for i, lang, t, _ in rows], TEXTS)
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows] + [(0, 7), (None, 1), (5000, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.judged(docs, labels, limit=0.1, error=0.1, gain=10).collect()}
    made = {}
    for i, lang, text, quality in rows:
        n, chars, symbols, lines, dup, repeats = brute_features(text)
        sev = (1000 * symbols // max(n, 1), 100 * chars // max(n, 1), 5000 - min(5000, 100 * chars // max(n, 1)), 1000 * dup // max(lines, 1), 1000 * repeats // max(n, 1))
        made[i] = lang, quality, n < 50 or 100 * repeats > 50 * n, [min(5000, s) for s in sev], hashlib.md5(str(i).encode()).hexdigest() >= "8"
    cuts = {}
    for lang in ("en", "fr"):
        own = [m for m in made.values() if m[0] == lang and m[1] is not None and not m[2]]
        most = brute_most(sum(m[4] and m[1] == 1 for m in own), 0.1 / 5, 0.1 / (2 * 5))
        for r in range(5):
            part = lambda good, held, cut: sum(m[1] == good and m[4] == held and m[3][r] >= cut for m in own)  # noqa: B023, E731
            fits = [((part(0, False, c) * part(1, False, 0) - 10 * part(1, False, c) * part(0, False, 0)), c) for c in {m[3][r] for m in own} if part(1, True, c) <= most]
            if fits and max(fits)[0] > 0:
                cuts[lang, r] = max(fits)[1]
    assert {lang for lang, _ in cuts} == {"en", "fr"} and any(r == 0 for _, r in cuts)
    for i, (lang, _, failed, sev, _) in made.items():
        hit = [rules.RULES[r] for r in range(5) if (lang, r) in cuts and sev[r] >= cuts[lang, r]]
        assert (got[i].base_failed, got[i].kept, got[i].rejected_by) == (failed, not failed and not hit, ["base"] if failed else hit)
    good = [i for i, m in made.items() if m[1] == 1 and not m[2]]
    assert sum(not got[i].kept for i in good) <= 0.1 * len(good) and sum(got[i].kept for i, m in made.items() if m[1] == 0 and not m[2]) < 10


def test_rules_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    none = spark.createDataFrame([], TEXTS)
    assert rules.judged(none, labels).count() == 0
    long_enough = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None, long_enough), (1, None, long_enough), (None, "en", long_enough), (2, "en", None), (3, "en", "# " * 100)]
    df = spark.createDataFrame([r + (0, 1, "", "", 1, "", 1, 1, "", "") for r in rows], TEXTS)
    got = sorted((r.doc_id or 0, r.base_failed, r.kept) for r in rules.judged(df, labels).collect())
    assert got == [(0, False, True), (1, False, True), (1, False, True), (2, True, False), (3, True, False)]  # without labels the base rule alone
