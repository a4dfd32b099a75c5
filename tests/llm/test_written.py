"""What operators write for their shuffles."""

from __future__ import annotations

import random

from quarry.llm.suffix_dedup import remove_repeats


def written(spark) -> dict[int, tuple[int, int]]:
    """Records and bytes that each stage so far has written for a shuffle."""
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None).iterator()
    out = {}
    while stages.hasNext():
        x = stages.next()
        out[x.stageId()] = x.shuffleWriteRecords(), x.shuffleWriteBytes()
    return out


def test_texts_are_shuffled_once_for_fetching_and_cutting(spark, tmp_path):
    rng = random.Random(5)
    shared = "".join(rng.choices("abcdefghij ", k=400))
    texts = ["".join(rng.choices("klmnopqrstuvwxyz ", k=3000)) + shared[i % 7 :] + str(i) for i in range(301)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    before = set(written(spark))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    try:
        got = {r.doc_id: r for r in remove_repeats(spark.read.parquet(str(tmp_path / "d"))).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert got[0].n_removed == 0 and all(got[i].n_removed >= 400 - i % 7 for i in range(1, 301))
    moved = [n for stage, (n, size) in written(spark).items() if stage not in before and n == 301 and size > 301 * 1000]
    assert len(moved) == 1
