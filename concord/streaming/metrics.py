"""Incremental metrics (an extension): confusion counts are additive, so a stream of predictions keeps them up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import bundle


def confusion_stream(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Counts of (true_label, pred_label) of each group as stateful aggregation; update or complete mode."""
    return predictions.groupBy(*by, "true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))


def windowed_accuracy(predictions: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Accuracy by tumbling window; rows later than `late` are dropped and closed windows are emitted once (append)."""
    hit = (F.col("true_label") == F.col("pred_label")).cast("int")
    return predictions.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def start_confusion(predictions: DataFrame, by: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Each batch replaces the counts under path/batch=<n>; the largest n of a cell is current."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return confusion_stream(predictions, by).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_confusion(updates: DataFrame, by: list[str]) -> DataFrame:
    return updates.groupBy(*by, "true_label", "pred_label").agg(F.max_by("n", "batch").alias("n"))


def bundle_of(counts: DataFrame, by: list[str], k: int) -> DataFrame:
    """The usual metrics from current counts."""
    return bundle(counts, by, k, weight="n")
