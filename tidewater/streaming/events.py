"""Streams: click-through by day from a log of events, and upserts of articles. Both leave tables; nothing is kept in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.logs import latest
from tidewater.storage import exists

#: Parts of a table of upserts, by a hash of the id; a micro-batch rewrites those that it touches.
BUCKETS = 64


def daily_counts(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """events(ts timestamp, kind): searches and clicks by day, for a stream or a table."""
    day = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day")) if events.isStreaming else events.groupBy(F.window("ts", "1 day"))
    return day.agg(F.count_if(F.col("kind") == "search").alias("searches"), F.count_if(F.col("kind") == "click").alias("clicks")).select(F.col("window.start").alias("day"), "searches", "clicks")


def run_once(counted: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Run a stream of counts by day over what is there. Every micro-batch writes the days that it changed; a day's last
    row counts. A micro-batch that is repeated after a failure writes the same folder again."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    counted.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return days(counted.sparkSession, target)


def days(spark: SparkSession, target: str) -> DataFrame:
    """day, searches, clicks as the stream has left them."""
    if not exists(spark, target):
        return spark.createDataFrame([], "day timestamp, searches long, clicks long")
    rows = spark.read.schema("day timestamp, searches long, clicks long, number long").parquet(f"{target}/batch=*")
    last = rows.groupBy("day").agg(F.max_by(F.struct("searches", "clicks"), "number").alias("last"))
    return last.select("day", "last.*")


def _state(spark: SparkSession, target: str, number: int) -> dict[int, int]:
    """Bucket -> micro-batch that wrote it last, after micro-batch number."""
    while number >= 0 and not exists(spark, f"{target}/state/{number}/_SUCCESS"):
        number -= 1
    return {r["bucket"]: r["number"] for r in spark.read.parquet(f"{target}/state/{number}").collect()} if number >= 0 else {}  # BUCKETS rows at most


def _read(spark: SparkSession, target: str, state: dict[int, int], schema) -> DataFrame:
    paths = [f"{target}/rows/{number}/bucket={bucket}" for bucket, number in state.items()]
    paths = [p for p in paths if exists(spark, p)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upserts(articles: DataFrame, target: str, checkpoint: str) -> None:
    """Each micro-batch: the last version of each id replaces what the target holds; unpublished ids go. Only the buckets
    that the micro-batch touches are written again; readers see a micro-batch once its state is complete."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, "article_id", "arrival").withColumn("bucket", F.pmod(F.xxhash64("article_id"), F.lit(BUCKETS)).cast("int"))
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # BUCKETS rows at most
        state = _state(spark, target, number - 1)
        old = _read(spark, target, {b: n for b, n in state.items() if b in touched}, batch.schema)
        old = old.join(new, "article_id", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("article_id"), F.lit(BUCKETS)).cast("int"))
        old.unionByName(new).filter("status = 'published'").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/rows/{number}")
        after = [*(state | dict.fromkeys(touched, number)).items()]
        spark.createDataFrame(after, "bucket int, number int").coalesce(1).write.mode("overwrite").parquet(f"{target}/state/{number}")

    articles.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upserted(spark: SparkSession, target: str, schema) -> DataFrame:
    """The rows of the last complete micro-batch."""
    number = 0
    while exists(spark, f"{target}/state/{number}/_SUCCESS"):
        number += 1
    return _read(spark, target, _state(spark, target, number - 1), schema)


def stream_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
