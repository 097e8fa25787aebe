"""From raw articles to clean ones, and the events that searches leave."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import clean_html, parse_published_at, strip, strip_or_null

REQUIRED = ("article_id", "title", "body", "url", "published_at")


def normalize_articles(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, rejected). Rejected rows lack a required field (null or empty) or have a date that can't be read;
    `missing` names what. In articles, markup is gone, blanks are null, tags are trimmed, status has its default, and
    the date is kept both as an instant and as it was written."""
    empty = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in REQUIRED]
    at = parse_published_at(F.col("published_at"))
    unread = F.when((F.coalesce("published_at", F.lit("")) != "") & at.isNull(), F.lit("published_at"))
    judged = raw.withColumn("missing", F.concat_ws(",", *empty, unread))
    tags = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), strip), lambda t: t != "")
    good = judged.filter("missing = ''").select(
        strip(F.col("article_id")).alias("article_id"), strip(F.col("title")).alias("title"), clean_html(F.col("body")).alias("body"), strip(F.col("url")).alias("url"), at.alias("published_at"),
        F.col("published_at").alias("published_at_iso"), *(strip_or_null(F.col(c)).alias(c) for c in ("author", "category", "source")), F.coalesce(strip_or_null(F.col("status")), F.lit("published")).alias("status"), tags.alias("tags"),
    )
    return good, judged.filter("missing <> ''")


def log_events(events: DataFrame, path: str) -> None:
    """Append events as JSON lines; those without a time get the present one."""
    stamped = events.withColumn("ts", F.coalesce("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")))
    stamped.write.mode("append").json(path)


def prometheus(snapshot: DataFrame, prefix: str = "tidewater") -> DataFrame:
    """One line `prefix_name value` for each column of a snapshot."""
    lines = F.array(*(F.concat(F.lit(f"{prefix}_{c} "), F.col(c).cast("string")) for c in snapshot.columns))
    return snapshot.select(F.explode(lines).alias("line"))


class EventBuffer:
    """Events wait on the driver and are appended together: `most` of them make a file, and so does flush()."""

    def __init__(self, spark, path: str, schema: str, most: int = 200):
        self.spark, self.path, self.schema, self.most, self.waiting = spark, path, schema, most, []

    def add(self, **event) -> None:
        self.waiting.append({"ts": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")} | event)
        if len(self.waiting) >= self.most:
            self.flush()

    def flush(self) -> None:
        waiting, self.waiting = self.waiting, []
        if waiting:
            columns = [c.split()[0] for c in self.schema.split(", ")]
            log_events(self.spark.createDataFrame([tuple(e.get(c) for c in columns) for e in waiting], self.schema), self.path)


class NoEvents:
    """Takes events and keeps none."""

    def add(self, **event) -> None:
        pass

    def flush(self) -> None:
        pass


#: (spark, path, schema) -> a log
EVENT_LOGS = {"none": lambda spark, path, schema: NoEvents(), "json": EventBuffer}
