"""Sources: articles from JSON, JSON lines, JDBC, relational tables and the document table; events from JSON lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.text import strip
from tidewater.storage import exists

ARTICLE = "article_id string, title string, body string, url string, published_at string, author string, category string, source string, status string, tags array<string>"
EVENT = "kind string, search_id string, query string, mode string, top_k int, result_ids array<string>, num_results int, zero_result boolean, variant string, article_id string, position int, dwell_ms int, ts string"
_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ARTICLE).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """Malformed and blank lines are skipped; a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


#: The columns of a content system that become an article; the joined ones are aggregated before (operators of this file).
CMS = "id long, title string, brief_title string, lead string, content string, slug string, source string, publish_date timestamp, created_at timestamp, updated_at timestamp, deleted_at timestamp, category string, author string, tags array<string>"


def cms_articles(rows: DataFrame, base_url: str = "") -> DataFrame:
    """Rows of a content system as raw articles: lead and content are the body, or else the title; the path follows from
    the slug or the id; a row is published when it says so, or when it was made, at +07:00."""
    filled = lambda c: F.when(strip(F.col(c)) != "", F.col(c))
    title = strip(F.coalesce(F.nullif("title", F.lit("")), "brief_title", F.lit("")))
    body = strip(F.concat_ws("\n\n", filled("lead"), filled("content")))
    at = F.date_format(F.coalesce("publish_date", "created_at"), "yyyy-MM-dd'T'HH:mm:ss'+07:00'")
    path = F.concat(F.lit(f"{base_url}/"), F.coalesce(F.nullif("slug", F.lit("")), F.concat(F.lit("article/"), F.col("id").cast("string"))))
    return rows.select(
        F.col("id").cast("string").alias("article_id"), title.alias("title"), F.when(body != "", body).otherwise(title).alias("body"), path.alias("url"), at.alias("published_at"), "author", "category", "source",
        F.lit("published").alias("status"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def cms_published(rows: DataFrame) -> DataFrame:
    return rows.filter("deleted_at is null and publish_date is not null")


def cms_since(rows: DataFrame, when: Column) -> DataFrame:
    """Published rows that were published or changed at that time or later."""
    return cms_published(rows).filter((F.col("publish_date") >= when) | (F.col("updated_at") >= when))


def cms_deleted(rows: DataFrame, when: Column) -> DataFrame:
    """article_id of the rows that were deleted or withdrawn at that time or later."""
    gone = F.col("deleted_at").isNotNull() | F.col("publish_date").isNull()
    return rows.filter((F.col("updated_at") >= when) & gone).select(F.col("id").cast("string").alias("article_id"))


def cms_by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows by ids(article_id); ids that are no whole number name none."""
    return cms_published(rows).join(ids.filter("article_id rlike '^[0-9]+$'").select(F.expr("try_cast(article_id as bigint)").alias("id")).distinct(), "id", "left_semi")


def jdbc_articles(spark: SparkSession, url: str, schema: str, table_name: str, low: int, high: int, parts: int) -> DataFrame:
    """A range-partitioned scan in place of keyset pages."""
    if not (_NAME.match(schema) and _NAME.match(table_name)):
        raise ValueError("schema and table must be plain identifiers")
    options = {"url": url, "dbtable": f"{schema}.{table_name}", "partitionColumn": "id", "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(**options).load().filter("deleted_at is null")


def spread(df: DataFrame) -> DataFrame:
    """Dealt over all cores where the scan has fewer splits than the cluster has cores (a small file is one split)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as articles: the first line is the title, the rest the body."""
    at = F.locate("\n", F.col("text"))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        F.col("doc_id").alias("article_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(at > 0, F.expr("substring(text, locate('\n', text) + 1)")).otherwise("").alias("body"),
        F.concat(F.lit("/doc/"), F.col("doc_id")).alias("url"),
        F.col("lang").alias("category"),
        "source",
        F.timestamp_add("HOUR", F.col("doc_id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("published_at"),
    )


def since(articles: DataFrame, when: Column) -> DataFrame:
    """Published at that time or later, or at a time that is not known."""
    return articles.filter(F.col("published_at").isNull() | (F.col("published_at") >= when))


def by_ids(articles: DataFrame, ids: DataFrame) -> DataFrame:
    return articles.join(ids, "article_id", "left_semi")


def batch_numbers(df: DataFrame, key: str, size: int, cell: int = 4096) -> DataFrame:
    """Batches of consecutive rows by key (a number): rows are numbered within cells of the key, over the cells before,
    and these over the cells of cells before, so that no window holds more than cell rows but the topmost, which holds one
    of every cell * cell values of the key."""
    celled = df.withColumn("cell", F.floor(F.col(key) / cell))
    ahead = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = celled.groupBy("cell").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("cell") / cell))
    blocks = cells.groupBy("block").agg(F.sum("n").alias("n")).select("block", ahead([], "block").alias("below"))
    cells = cells.withColumn("before", ahead(["block"], "cell")).join(blocks, "block").select("cell", (F.col("below") + F.col("before")).alias("base"))
    numbered = celled.withColumn("rn", F.row_number().over(Window.partitionBy("cell").orderBy(key))).join(cells, "cell")
    return numbered.withColumn("batch", F.floor((F.col("base") + F.col("rn") - 1) / size)).drop("cell", "rn", "base")
