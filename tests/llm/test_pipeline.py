"""The pipeline, stage by stage, against brute force on what the stage before kept."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import SPACE, brute_mix
from test_similar import brute_groups

import corpus_pipeline as P


def keep_first(t, least=10):
    key = lambda s: re.sub(f"^{SPACE}+|{SPACE}+$", "", s).translate({c: c + 32 for c in range(65, 91)})
    found = Counter(k for x in t.values() for k in {key(s) for s in x.split("\n")} if k)
    seen, out = set(), {}
    for i in sorted(t):
        kept = []
        for s in t[i].split("\n"):
            k = key(s)
            if not k or found[k] < least or k not in seen:
                kept.append(s)
            seen.add(k)
        out[i] = "\n".join(kept)
    return out


@pytest.fixture(scope="module")
def folder(spark, messy, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    messy.write.parquet(f"{path}/documents.parquet")
    labels = messy.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    labels.limit(0).write.parquet(f"{path}/labels.parquet")  # no labels: every score is 0.5 and all documents stay
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    docs = P.keep_quality(spark, docs, folder)
    assert docs.columns == P.COLUMNS and docs.count() == len(text)

    docs = P.stored(P.drop_common_lines(spark, docs, folder), "t2")
    lines = {r.doc_id: r.text for r in docs.collect()}
    assert docs.columns == P.COLUMNS and lines == keep_first(text)
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    docs = P.stored(P.drop_near_copies(spark, docs, folder), "t3")
    near = brute_groups(lines)
    assert docs.columns == P.COLUMNS and sorted(r.doc_id for r in docs.collect()) == sorted(set(near.values()))

    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    size, total, target = brute_mix(rows)
    docs = P.stored(P.mix_sources(spark, docs, folder), "t4")
    times = Counter((r.doc_id, r.text, r.source) for r in docs.collect())
    assert docs.columns == P.COLUMNS and set(times) <= set(rows) and max(times.values()) <= 3
    taken = defaultdict(int)
    for row, n in times.items():
        taken[row[2]] += n * size[row]
    # a source is short by its longest document at most, and has its share of what others are short at most
    longest = {s: max(size[r] for r in rows if r[2] == s) for s in total}
    assert all(-longest[s] <= taken[s] - target[s] <= longest[s] + sum(longest.values()) for s in total)
    assert sum(taken.values()) <= sum(total.values())

    packed = P.pack_sequences(spark, docs, folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(k[0] for k in times.elements())
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= P.CAPACITY


def test_run_and_rejection(spark, folder, tmp_path):
    assert P.run(spark, folder).count() > 0
    rows = [(i, " ".join(f"w{(i * 7 + j * 13) % 97}" for j in range(30)) + (" ### $$$ ###" if i % 3 == 0 else ""), "en", "s", 1) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r.doc_id for r in P.keep_quality(spark, docs, str(tmp_path)).collect()) == [i for i in range(240) if i % 3]


def test_empty(spark, folder, nothing):
    docs = nothing
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_repeated_rows(spark, folder, odd):
    docs = odd
    for _, stage in P.STAGES[:3]:
        docs = P.stored(stage(spark, docs, folder), "odd")
    # the two texts of document 1 are no copies of each other, so both stay; the repeated rows are one
    assert sorted((r.doc_id or 0, r.text[:5]) for r in docs.collect()) == [(0, "no id"), (1, "one t"), (1, "other"), (2, "")]
    docs = P.stored(P.mix_sources(spark, docs, folder), "odd-mix")
    assert {(r.doc_id, r.text[:5]) for r in docs.collect()} <= {(None, "no id"), (1, "one t"), (1, "other")} and docs.count() > 0
    packed = P.pack_sequences(spark, docs, folder).collect()
    assert sum(r.piece == 0 for r in packed) == docs.count()
