"""Freshness as a stream: new facts arrive, and snapshots that refer to what they supersede become stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridledger.operators.aggregates import joined


def latest_values(stream: DataFrame, key: str, at: str, value: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """For each window and key the value of the greatest time; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def mark_stale(stream: DataFrame, links: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes (batch, snapshot_id, reason) for every batch of superseded facts (fact_id, superseded_by).

    A batch's rows replace what an earlier try of the same batch wrote, so that each counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        reason = F.concat(F.lit("fact "), F.col("fact_id").cast("string"), F.lit(" superseded by "), F.col("superseded_by").cast("string"))
        rows = batch.join(links, "fact_id").groupBy("snapshot_id").agg(joined(reason, F.col("fact_id")).alias("reason"))
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
