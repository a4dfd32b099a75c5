"""Trials that are looked at while their answers arrive: running means as keyed state, decisions to stop from all trials' means so far.

The state of a trial is how many answers it has and their sum; a restarted stream goes on from it. Each answer gives one row with its step and the mean
until then. Those rows are written in a folder for each batch, so that a batch that runs again replaces what it wrote, and decisions
are made of all of them by the rule for finished trials.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quarry.operators.evaluation import prune

#: Keyed state needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RunningMean(StatefulProcessor):
    """For each answer of a trial, in the order of arrival and within a batch of ``at``, its step and the mean until then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("so_far", "n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        batch = pd.concat(list(rows)).sort_values("at", kind="stable")
        steps, means = [], []
        for value in batch["value"]:
            n, total = n + 1, total + float(value)
            steps.append(n)
            means.append(round(total / n, 9))
        self.state.update((n, total))
        yield pd.DataFrame({"trial": key[0], "step": steps, "mean_so_far": means})

    def close(self) -> None:
        pass


def running_means(answers: DataFrame) -> DataFrame:
    """``trial, step, mean_so_far`` of a stream ``trial, at, value``. The session's state store must be ``STORE``."""
    kind = answers.schema["trial"].dataType.simpleString()
    rows = answers.select("trial", "at", F.coalesce(F.col("value"), F.lit(0.0)).alias("value"))
    return rows.groupBy("trial").transformWithStateInPandas(statefulProcessor=RunningMean(), outputStructType=f"trial {kind}, step long, mean_so_far double", outputMode="Append", timeMode="None")


def start(answers: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the running means of a stream of answers below ``out``, until all that is there is read."""
    answers.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return running_means(answers).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decisions(spark: SparkSession, out: str, **rule) -> DataFrame:
    """``trial, step, best_so_far, cut, pruned`` of all steps that were written until now; see :func:`quarry.operators.evaluation.prune`."""
    return prune(spark.read.parquet(out).select("trial", "step", "mean_so_far"), **rule)
