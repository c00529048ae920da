"""Prediction over a Structured Streaming source with a fitted model.

Each micro-batch is a static DataFrame, so the batch plan of
``plans.model.predict`` (stream-static joins with the fitted tables,
per-sentence aggregations) applies unchanged inside ``foreachBatch``; the
sink is an idempotent Parquet append keyed by batch id, and the stream's
progress lives in a checkpoint under the shared checkpoint folder, so a
restarted query resumes without loss or duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import model


def start_prediction_stream(fitted: model.FittedModel, stream: DataFrame, keys: list[str],
                            out_path: str, checkpoint: str, available_now: bool = True):
    """Start the stream; returns the StreamingQuery. ``stream`` has the keys
    and the model's text column."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        pred = model.predict(fitted, batch, keys).withColumn("batch_id", F.lit(batch_id))
        # overwrite this batch's own partition: a replayed batch replaces
        # its earlier output instead of duplicating it
        (pred.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(out_path))

    w = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
