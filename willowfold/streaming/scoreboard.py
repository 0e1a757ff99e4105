"""Live scoreboard: score, wickets and legal balls of each innings as deliveries arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DELIVERY = "match_id long, innings int, over_no int, ball_no int, total_runs int, is_out boolean, is_legal boolean"


def scoreboard(deliveries: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """A streaming DataFrame of totals; a replayed (match, innings, over, ball) counts once.

    watermark: the ingest time column and delay after which a replay is no longer expected, so that its key may be forgotten.
    Without one the keys of all balls are kept.
    """
    keys = ["match_id", "innings", "over_no", "ball_no"]
    if watermark:
        deliveries = deliveries.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys)
    else:
        deliveries = deliveries.dropDuplicates(keys)
    return deliveries.groupBy("match_id", "innings").agg(
        F.sum("total_runs").cast("long").alias("score"), F.count_if(F.col("is_out")).alias("wickets"), F.count_if(F.col("is_legal")).alias("balls"), F.count(F.lit(1)).alias("events")
    )


def run(spark: SparkSession, source: str, out: str, checkpoint: str, watermark: tuple[str, str] | None = None, files: int = 4, matches: DataFrame | None = None) -> StreamingQuery:
    """Follow the Parquet files of a folder; each micro-batch writes the totals that changed, with its number.

    watermark: as ``scoreboard``'s; the files then have that column, a timestamp.  matches: rows by match_id that are joined to the totals.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    schema = f"{DELIVERY}, {watermark[0]} timestamp" if watermark else DELIVERY
    stream = scoreboard(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source), watermark)
    if matches is not None:
        stream = stream.join(matches, "match_id", "left")
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, *more: str) -> DataFrame:
    """The totals as of the last batch, with more columns if asked for; a batch written again after a failure repeats the same rows."""
    rows = spark.read.parquet(out)
    last = F.max(F.struct("batch", "score", "wickets", "balls", *more)).alias("x")
    return rows.groupBy("match_id", "innings").agg(last).select("match_id", "innings", *[f"x.{c}" for c in ("score", "wickets", "balls", *more)])
