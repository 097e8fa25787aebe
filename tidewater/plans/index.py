"""A searchable index as generations of tables; readers use the last complete one while the next is built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.entities import edges
from tidewater.operators.ingest import normalize_articles
from tidewater.operators.logs import latest
from tidewater.operators.retrieval import lengths, postings
from tidewater.operators.similarity import clusters, embeddings, signatures
from tidewater.storage import exists, stash

TABLES = ("articles", "rejected", "postings", "lengths", "signatures", "vectors", "clusters", "entities")


def current(spark: SparkSession, folder: str) -> int | None:
    """The newest generation whose last table is complete."""
    number = None
    while exists(spark, f"{folder}/{0 if number is None else number + 1}/entities/_SUCCESS"):
        number = 0 if number is None else number + 1
    return number


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    number = current(spark, folder)
    if number is None:
        raise FileNotFoundError(f"no complete generation in {folder}")
    return spark.read.parquet(f"{folder}/{number}/{name}")


def build(
    raw: DataFrame, folder: str, arrival: str | None = None, deleted: DataFrame | None = None, anew: bool = False, embedder: Callable[[DataFrame], DataFrame] = embeddings, strict: bool = False
) -> int:
    """Write the next generation: the articles of the last one, replaced by raw's by id (the last to arrive, if a column
    says so, else the one with the largest hash), without unpublished and deleted ones, and the tables that follow from
    them. Returns its number. With anew, nothing of the last generation stays; searches see the new one only when it is
    complete. strict: a row that is rejected is an error, and there is no new generation."""
    spark = raw.sparkSession
    before = current(spark, folder)
    number = 0 if before is None else before + 1
    path = f"{folder}/{number}"
    order = arrival or "row_hash"
    named = raw if arrival else raw.withColumn(order, F.xxhash64(*raw.columns))
    judged = normalize_articles(latest(named, "article_id", order).drop(order))
    articles, rejected = (stash(x, "normalized") for x in judged)
    if strict and (bad := rejected.limit(5).collect()):
        raise ValueError("; ".join(f"{r['article_id']}: {r['missing']}" for r in bad))
    rejected.select("article_id", "missing").write.mode("overwrite").parquet(f"{path}/rejected")
    renewed = articles.select("article_id")
    if before is not None and not anew:
        articles = spark.read.parquet(f"{folder}/{before}/articles").join(articles.select("article_id"), "article_id", "left_anti").unionByName(articles)
    if deleted is not None:
        articles = articles.join(deleted, "article_id", "left_anti")
    articles.filter("status = 'published'").write.mode("overwrite").parquet(f"{path}/articles")
    kept = spark.read.parquet(f"{path}/articles")
    text = F.concat_ws("\n", "title", "body").alias("text")
    # In order of tokens, so that a search reads the files and pages of its own tokens only.
    ordered = postings(kept).repartitionByRange("token", "article_id").sortWithinPartitions("token")
    tables = {"postings": ordered, "lengths": lengths(kept), "signatures": signatures(kept), "vectors": embedder(kept), "clusters": _clusters(kept, None if before is None or anew else spark.read.parquet(f"{folder}/{before}/clusters"), renewed), "entities": edges(kept.select("article_id", text))}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    return number


def _clusters(articles: DataFrame, before: DataFrame | None, renewed: DataFrame) -> DataFrame:
    """article_id, nth, label, cluster_id (an article_id). Articles arrive in order of publication, ties by id; those of the
    generation before that were not renewed keep their place and their cluster, even if its first article is gone."""
    texts = articles.select("article_id", "title", "body", "published_at")
    if before is None:
        before = articles.sparkSession.createDataFrame([], "article_id string, nth long, label long, cluster_id string")
    stay = before.join(renewed, "article_id", "left_anti").join(texts, "article_id")
    first = 1 + (before.agg(F.max("nth")).first()[0] or 0)
    fresh = texts.join(stay.select("article_id"), "article_id", "left_anti").orderBy("published_at", "article_id").withColumns({"nth": first + F.monotonically_increasing_id(), "label": F.lit(None).cast("long"), "cluster_id": F.lit(None).cast("string")})
    numbered = stash(stay.unionByName(fresh), "numbered")
    old = numbered.filter("label is not null")
    found = clusters(numbered.select(F.col("nth").alias("article_id"), "title", "body"), known=old.select(F.col("nth").alias("article_id"), F.col("label").alias("cluster_id")))
    names = old.select("label", "cluster_id").distinct().union(numbered.filter("label is null").select("nth", "article_id"))
    return numbered.select("nth", "article_id").join(found.select(F.col("article_id").alias("nth"), F.col("cluster_id").alias("label")), "nth").join(names, "label").select("article_id", "nth", "label", "cluster_id")
