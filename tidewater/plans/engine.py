"""The engine as one object: index, search, log, measure. What can be exchanged is named in registries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import entities, ingest, logs, retrieval, similarity, understanding
from tidewater.operators.cache import ResultCache
from tidewater.plans import index
from tidewater.sources import tables

#: articles(article_id, title, body) -> (article_id, embedding)
EMBEDDERS: dict[str, Callable[[DataFrame], DataFrame]] = {"hash": similarity.embeddings}
#: (ranked, queries, articles) -> ranked, with score and rank
RERANKERS: dict[str, Callable] = {"none": lambda ranked, queries, articles: retrieval.rerank_by_place(ranked)}
#: (spark, ...) -> raw articles
SOURCES: dict[str, Callable] = {"json": tables.json_articles, "jdbc": tables.jdbc_articles}


@dataclass(frozen=True)
class Settings:
    """What an engine is made with."""

    folder: str = "index"
    embedder: str = "hash"
    reranker: str = "none"
    events: str = "json"
    understanding: bool = False
    synonyms: str = ""
    cache_seconds: float = 60
    cache_size: int = 1000
    cache_fresh: bool = False

    @classmethod
    def read(cls, values: Mapping[str, str], prefix: str = "TIDEWATER_") -> Settings:
        """From texts such as the environment's; names are upper-case behind the prefix, others are left alone. A value that
        is not of its field's type is an error."""
        found = {}
        for field in fields(cls):
            if (value := values.get(prefix + field.name.upper())) is not None:
                kind = type(field.default)
                if kind is bool and value.lower() not in ("0", "1", "false", "true"):
                    raise ValueError(f"{field.name}: {value!r} is neither true nor false")
                found[field.name] = value.lower() in ("1", "true") if kind is bool else kind(value)
        return cls(**found)
_EVENTS = "kind string, search_id string, query string, mode string, top_k int, result_ids array<string>, num_results int, zero_result boolean, variant string, position int, article_id string, dwell_ms int, latency double, failed boolean, ts string"


def chosen(registry: dict, name: str):
    if name not in registry:
        raise ValueError(f"{name!r} is none of {sorted(registry)}")
    return registry[name]


@dataclass(frozen=True)
class Filters:
    """Equality without regard to case and outer blanks, and inclusive times; what is empty restricts nothing."""

    author: str | None = None
    category: str | None = None
    source: str | None = None
    since: str | None = None
    until: str | None = None

    def condition(self) -> Column | None:
        plain = lambda c: F.lower(T.strip(F.coalesce(c, F.lit(""))))
        parts = [plain(F.col(c)) == plain(F.lit(v)) for c in ("author", "category", "source") if (v := getattr(self, c))]
        parts += [F.col("published_at") >= T.parse_published_at(F.lit(self.since))] if self.since else []
        parts += [F.col("published_at") <= T.parse_published_at(F.lit(self.until))] if self.until else []
        return reduce(lambda a, b: a & b, parts) if parts else None


class SearchEngine:
    """Folder holds the generations of the index and the log of events. search() answers a whole frame of queries in one
    lazy plan; ask() answers one text through the cache and logs it."""

    def __init__(self, spark: SparkSession, folder: str, embedder: str = "hash", reranker: str = "none", cache: ResultCache | None = None, events: str = "json", understanding: bool = False, synonyms: dict | None = None, cache_fresh: bool = False):
        self.spark, self.folder, self.cache = spark, folder.rstrip("/"), cache or ResultCache()
        self.embedder, self.reranker, self.path = chosen(EMBEDDERS, embedder), chosen(RERANKERS, reranker), f"{self.folder}/events"
        self.log = chosen(ingest.EVENT_LOGS, events)(spark, self.path, _EVENTS)
        self.understanding, self.synonyms, self.cache_fresh = understanding, synonyms, cache_fresh

    @classmethod
    def of(cls, spark: SparkSession, settings: Settings) -> SearchEngine:
        synonyms = understanding.read_synonyms(settings.synonyms) if settings.synonyms else None
        return cls(spark, settings.folder, settings.embedder, settings.reranker, ResultCache(settings.cache_seconds, settings.cache_size), settings.events, settings.understanding, synonyms, settings.cache_fresh)

    def index(self, raw: DataFrame, arrival: str | None = None, strict: bool = False) -> int:
        return index.build(raw, self.folder, arrival, embedder=self.embedder, strict=strict)

    def sync(self, changed: DataFrame, deleted: DataFrame) -> int:
        """A generation with what changed (raw articles) and without deleted(article_id)."""
        return index.build(changed, self.folder, deleted=deleted, embedder=self.embedder)

    def job(self, raw: DataFrame, limit: int | None = None, shown: int = 5) -> dict:
        """Index raw articles, the first `limit` if that is given: generation, articles, rejected, a few rejected rows and
        articles a second."""
        began = time.perf_counter()
        number = self.index(raw if limit is None else raw.limit(limit))
        articles, rejected = self.table("articles").count(), self.table("rejected")
        return {"generation": number, "articles": articles, "rejected": rejected.count(), "shown": [r.asDict() for r in rejected.limit(shown).collect()], "per_second": articles / (time.perf_counter() - began)}

    def snapshot(self, path: str) -> None:
        """The articles of the current generation as JSON lines."""
        written = self.table("articles")
        written.withColumn("published_at", F.col("published_at_iso")).select(*(c.split()[0] for c in tables.ARTICLE.split(", "))).write.mode("overwrite").json(path)

    def restore(self, path: str) -> int:
        """A generation of the articles of a snapshot alone."""
        return self.reindex(self.spark.read.schema(tables.ARTICLE).json(path))

    def remove(self, ids: DataFrame) -> int:
        """A generation without the articles of ids(article_id), known or not."""
        nothing = self.spark.createDataFrame([], tables.ARTICLE)
        return index.build(nothing, self.folder, deleted=ids, embedder=self.embedder)

    def reindex(self, raw: DataFrame) -> int:
        return index.build(raw, self.folder, anew=True, embedder=self.embedder)

    def table(self, name: str) -> DataFrame:
        return index.read(self.spark, self.folder, name)

    def search(self, queries: DataFrame, mode: str = "hybrid", k: int = 10, filters: Filters | None = None, now: Column | None = None) -> DataFrame:
        """queries(query_id, text) -> query_id, rank, article_id, title, url, published_at (as written), snippet."""
        articles, condition = self.table("articles"), (filters or Filters()).condition()
        asked = queries.select(F.col("query_id").alias("article_id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"))
        vectors = self.embedder(asked).select(F.col("article_id").alias("query_id"), F.col("embedding").alias("vector"))
        allowed = None if condition is None else articles.filter(condition).select("article_id")
        stored = (self.table("postings"), self.table("lengths"))
        asked = queries.select("query_id", "text").join(vectors, "query_id")
        if self.understanding:
            asked = asked.join(self.understand(queries), "query_id", "left").withColumn("expanded", F.coalesce("expanded", "text"))
        found = retrieval.search(
            asked, articles, self.table("vectors"), self.table("clusters"), F.current_timestamp() if now is None else now,
            mode, k, allowed, index=stored, rerank=self.reranker,
        )
        written = articles.select("article_id", "published_at_iso")
        return found.join(written, "article_id").select("query_id", "rank", "article_id", "title", "url", F.col("published_at_iso").alias("published_at"), retrieval.snippet("body", "asked").alias("snippet"))

    def ask(self, text: str, mode: str = "hybrid", k: int = 10, filters: Filters | None = None, now: Column | None = None) -> tuple[str, list[dict]]:
        """(search_id, at most k <= 100 results of five fields). Empty texts and other values of k are errors."""
        if not (text or "").strip() or not 1 <= k <= 100:
            raise ValueError("a text and 1 to 100 results are needed")
        began, key = time.perf_counter(), (mode, k, text, filters)
        generation = index.current(self.spark, self.folder)
        asked = self.spark.createDataFrame([("q", text)], "query_id string, text string")
        fresh, variant = asked.select(T.fresh_intent(F.col("text")), T.variant(F.col("text"))).first()
        kept = self.cache_fresh or not fresh  # news that are asked for fresh are not answered from the cache
        found = self.cache.get(generation, *key) if kept else None
        if found is None:
            rows = self.search(asked, mode, k, filters, now).orderBy("rank").collect()
            found = [{c: r[c] for c in ("article_id", "title", "url", "published_at", "snippet")} for r in rows]
            if kept:
                self.cache.set(found, generation, *key)
        search_id, ids = uuid.uuid4().hex, [r["article_id"] for r in found]
        took = 1000 * (time.perf_counter() - began)
        self.log.add(kind="search", search_id=search_id, query=text, mode=mode, top_k=k, result_ids=ids, num_results=len(ids), zero_result=not ids, variant=variant, latency=took, failed=False)
        return search_id, found

    def click(self, search_id: str, article_id: str, position: int, dwell_ms: int | None = None) -> None:
        self.log.add(kind="click", search_id=search_id, article_id=article_id, position=int(position), dwell_ms=None if dwell_ms is None else int(dwell_ms))

    def events(self) -> DataFrame:
        self.log.flush()
        return tables.json_lines(self.spark, self.path, _EVENTS)

    def feedback(self) -> DataFrame:
        return logs.feedback(self.events())

    def metrics(self) -> DataFrame:
        return logs.metrics(self.events().filter("kind = 'search'"), "ts")

    def alerts(self) -> DataFrame:
        return logs.alerts(self.metrics())

    def entities_of(self, article_id: str) -> DataFrame:
        """Entities in order of appearance; an article that is not there is an error."""
        if not self.table("articles").filter(F.col("article_id") == article_id).limit(1).count():
            raise KeyError(article_id)
        return self.table("entities").filter(F.col("article_id") == article_id).orderBy("pos").select("name", "type")

    def top_entities(self, n: int = 20) -> DataFrame:
        return entities.top_entities(self.table("entities"), n)

    def understand(self, queries: DataFrame) -> DataFrame:
        """query_id, expanded: words that no article holds are corrected, then synonyms follow."""
        vocabulary = self.table("postings").groupBy("token").agg(F.sum("tf").alias("freq"))
        words = queries.select("query_id", F.posexplode(T.folded_tokens(F.col("text"))).alias("pos", "word"))
        right = words.join(understanding.correct(words.select("word"), vocabulary), "word")
        texts = right.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "corrected"))), lambda x: x["corrected"]), " ").alias("text"))
        return understanding.expand(texts, self.synonyms)

    def stats(self) -> dict[str, int | None]:
        return {"generation": index.current(self.spark, self.folder), "articles": self.table("articles").count(), "entities": self.table("entities").select("name_folded", "type").distinct().count()}


def register_functions(spark: SparkSession) -> None:
    """The text functions for SQL. All but tw_snippet are SQL functions that Catalyst inlines."""
    pattern, fold_from, fold_to = T.TOKEN.replace("\\", "\\\\"), T._FROM, T._TO
    space = T._SPACE.replace("\\", "\\\\")
    fold = f"CASE WHEN octet_length(x) = length(x) THEN x ELSE translate(x, '{fold_from}', '{fold_to}') END"
    for head, body in (
        ("tw_fold(x STRING) RETURNS STRING", fold),
        ("tw_normalize(x STRING) RETURNS STRING", f"trim(regexp_replace(lower(x), '{space}', ' '))"),
        ("tw_tokens(x STRING) RETURNS ARRAY<STRING>", f"regexp_extract_all(lower(x), '{pattern}', 0)"),
        ("tw_variant(x STRING) RETURNS STRING", "CASE WHEN conv(substr(md5(x), 32, 1), 16, 10) % 2 = 1 THEN 'B' ELSE 'A' END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("tw_snippet", retrieval.snippet)
