"""Search and click logs: feedback metrics, latencies, alerts; relevance measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, LEAST_SEARCHES = 2000, 20


def feedback(log: DataFrame) -> DataFrame:
    """One row: searches, clicks, zero_result_rate, ctr (searches with a click by searches), avg_dwell_ms."""
    clicked = log.filter("kind = 'click'").select("search_id").distinct().withColumn("hit", F.lit(1))
    search = F.col("kind") == "search"
    n = F.count_if(search)
    flagged = log.join(clicked, "search_id", "left")
    return flagged.agg(
        n.alias("searches"),
        F.count_if(F.col("kind") == "click").alias("clicks"),
        F.coalesce(F.try_divide(F.count_if(search & F.col("zero_result")), n), F.lit(0.0)).alias("zero_result_rate"),
        F.coalesce(F.try_divide(F.count_distinct(F.when(search & F.col("hit").isNotNull(), F.col("search_id"))), n), F.lit(0.0)).alias("ctr"),
        F.avg(F.when(F.col("kind") == "click", F.col("dwell_ms"))).alias("avg_dwell_ms"),
    )


def clicks_by_position(log: DataFrame) -> DataFrame:
    return log.filter("kind = 'click'").groupBy("position").agg(F.count("*").alias("n"))


def percentile(values: Column, p: float) -> Column:
    """sorted[min(n - 1, floor(p * n))] of an array; 0 if it is empty."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.sort_array(values), F.least(n - 1, F.floor(F.lit(p) * n).cast("int")) + 1)).otherwise(0.0)


def metrics(log: DataFrame, order: str, window: int = WINDOW) -> DataFrame:
    """Latencies over the last window rows (that many at most are gathered), counts and rates over all."""
    last = log.orderBy(F.desc(order)).limit(window).agg(F.collect_list("latency").alias("l"))
    counts = log.agg(F.count("*").alias("searches"), F.coalesce(F.avg(F.col("failed").cast("double")), F.lit(0.0)).alias("error_rate"), F.coalesce(F.avg(F.col("zero_result").cast("double")), F.lit(0.0)).alias("zero_result_rate"))
    return counts.crossJoin(last).select("searches", F.round("error_rate", 6).alias("error_rate"), F.round("zero_result_rate", 6).alias("zero_result_rate"), *(F.round(percentile(F.col("l"), p), 2).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)))  # one row each


def alerts(snapshot: DataFrame, p95: float = 500, errors: float = 0.05, zeros: float = 0.3) -> DataFrame:
    """Names of limits that are passed, once there are LEAST_SEARCHES searches."""
    enough = F.col("searches") >= LEAST_SEARCHES
    names = [F.when(enough & (F.col(c) > limit), F.lit(c)) for c, limit in (("p95", p95), ("error_rate", errors), ("zero_result_rate", zeros))]
    return snapshot.select(F.concat_ws(",", *names).alias("alerts"))


def relevance(ranked: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """ranked(query_id, article_id, rank), wanted(query_id, article_id): recall, reciprocal rank and nDCG at k for each query."""
    return relevance_of_hits(ranked.join(wanted, ["query_id", "article_id"]), wanted.groupBy("query_id").agg(F.count("*").alias("n")), k)


def relevance_of_hits(hits: DataFrame, totals: DataFrame, k: int = 10) -> DataFrame:
    """relevance() from what was found of the wanted articles, hits(query_id, rank), and their number, totals(query_id, n)."""
    found = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    or_none = lambda x: F.coalesce(x, F.lit(0.0))
    measures = {"recall": or_none(F.col("found") / F.col("n")), "mrr": or_none(1 / F.col("first")), "ndcg": or_none(F.col("gain")) / ideal}
    return totals.join(found, "query_id", "left").select("query_id", *(F.round(x, 6).alias(name) for name, x in measures.items()))


def mean_relevance(measures: DataFrame) -> DataFrame:
    """One row: the means of relevance() over all queries; nulls without any."""
    return measures.agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")))


def latency_percentiles(took: DataFrame, by: str, value: str) -> DataFrame:
    """took(by, value) -> p50, p95 and mean of each group. The exact percentiles come from counts of equal values, so
    that no group is gathered: the value at sorted[min(n - 1, floor(p * n))]."""
    counts = took.groupBy(by, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    total = took.groupBy(by).agg(F.count("*").alias("total"), F.round(F.avg(value), 6).alias("mean"))
    placed = counts.withColumn("upto", F.sum("n").over(upto)).join(total, by)
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.lit(p) * F.col("total"))), F.col(value)))
    return placed.groupBy(by).agg(F.max("total").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("mean").alias("mean"))


def latest(rows: DataFrame, key: str, arrival: str) -> DataFrame:
    """The last version of each key."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(arrival)))).filter("nth = 1").drop("nth")
