"""Queries over articles and vectors, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import retrieval as R
from tidewater.sources.tables import batch_numbers, corpus, since, table

def now():
    return F.lit("2024-03-01").cast("timestamp_ntz")



CORPUS = """corpus AS (SELECT doc_id AS article_id, split_part(text, chr(10), 1) AS title, CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body, '/doc/' || doc_id AS url, lang AS category, source, TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS published_at FROM documents)"""
TOKENS = r"regexp_extract_all(replace(replace(strip_accents(lower({})), 'đ', 'd'), 'Đ', 'D'), '[\p{{L}}\p{{N}}_]+')"
# Every row whose id is divisible by 20 asks: a document by its title, a vector by itself.
ASKED = "asked AS (SELECT 'q' || coalesce(article_id, vec_id) AS query_id, title AS text, vec_id AS vec FROM (SELECT article_id, title FROM corpus WHERE article_id % 20 = 0) FULL OUTER JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0) ON article_id = vec_id)"


def index_sql(weight: int = 3) -> str:
    return f"""WITH {CORPUS}, {ASKED},
post AS (SELECT article_id, token, sum(w) AS tf FROM (SELECT article_id, unnest({TOKENS.format("title")}) AS token, {weight} AS w FROM corpus UNION ALL SELECT article_id, unnest({TOKENS.format("body")}), 1 FROM corpus) GROUP BY ALL),
dl AS (SELECT article_id, {weight} * len({TOKENS.format("title")}) + len({TOKENS.format("body")}) AS dl FROM corpus),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS.format("text")}) AS token FROM asked) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM post WHERE token IN (SELECT token FROM q) GROUP BY token),
scores AS (SELECT query_id, article_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM post JOIN q USING (token) JOIN df USING (token) JOIN dl USING (article_id), stats GROUP BY ALL)"""


VECTORS = """vec AS (SELECT vec_id AS article_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
unit AS (SELECT article_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM vec),
sims AS (SELECT query_id, unit.article_id, unit.label, round(list_sum(list_transform(list_zip(unit.u, qv.u), lambda p: p[1] * p[2])), 9) AS score FROM unit, asked JOIN unit AS qv ON qv.article_id = asked.vec)"""
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id)"


def ranked_sql(source: str, k: int, where: str = "TRUE") -> str:
    return f"SELECT query_id, article_id::BIGINT AS article_id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, {RANK} AS rank FROM {source} WHERE {where}) WHERE rank <= {k}"


def questions(spark, sf_dir):
    """query_id, text, vector: every row whose id is divisible by 20, a document by its title, a vector by itself."""
    texts = corpus(spark, sf_dir).filter("article_id % 20 = 0").select("article_id", F.col("title").alias("text"))
    asked = texts.join(vectors(spark, sf_dir).filter("article_id % 20 = 0").withColumnRenamed("embedding", "vector"), "article_id", "full")
    return asked.select(F.concat(F.lit("q"), "article_id").alias("query_id"), "text", "vector")


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), "embedding")


def labels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), F.col("label").alias("cluster_id"))


def shown(df):
    return df.select("query_id", F.col("article_id").cast("long"), "rank", F.round("score", 6).alias("score"))


QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("text_normalize", r"SELECT doc_id, trim(regexp_replace(lower(text), '[\s\p{Z}\x1C-\x1F]+', ' ', 'g')) AS normalized FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query("text_fold", "SELECT doc_id, replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D') AS folded FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("text_tokenize", r"SELECT doc_id, len(t)::INT AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(?:p|div|br)\b[^>]*>', chr(10), 'g'), '(?s)</?[A-Za-z!][^>]*>', ' ', 'g')"""
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    _CLEAN = f"replace({_CLEAN}, '{_name}', '{_char}')"


@query("html_clean", rf"SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array({_CLEAN}, '[\n\r]+'), lambda l: trim(regexp_replace(l, '[\s\p{{Z}}]+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS cleaned FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_html(F.col("html")).alias("cleaned"))


@query("html_has_tag", r"SELECT page_id, regexp_matches(html, '<!--|</?[A-Za-z][^>]*>') AS has_tag FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.has_tag(F.col("html")).alias("has_tag"))


@query("article_validate", f"WITH {CORPUS} SELECT article_id, concat_ws(',', CASE WHEN coalesce(title, '') = '' THEN 'title' END, CASE WHEN coalesce(body, '') = '' THEN 'body' END, CASE WHEN coalesce(url, '') = '' THEN 'url' END) AS missing FROM corpus")
def _(spark, d):
    needed = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in ("title", "body", "url")]
    return corpus(spark, d).select("article_id", F.concat_ws(",", *needed).alias("missing"))


@query("scan_count", "SELECT count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) <> 0")
def _(spark, d):
    status = F.when(F.col("quality") == 0, "unpublished").otherwise("published")
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").filter(status == "published").agg(F.count("*").alias("n"))


@query("scan_since", f"WITH {CORPUS} SELECT article_id, published_at FROM corpus WHERE published_at >= TIMESTAMP '2024-01-15' OR published_at IS NULL")
def _(spark, d):
    return since(corpus(spark, d), F.lit("2024-01-15").cast("timestamp_ntz")).select("article_id", "published_at")


@query("scan_keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 500")
def _(spark, d):
    return table(spark, d, "orders").filter("o_orderkey > 100").orderBy("o_orderkey").limit(500).select("o_orderkey", "o_custkey")


@query("deleted_since", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus <> 'O'")
def _(spark, d):
    return table(spark, d, "orders").filter((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") != "O")).select("o_orderkey")


@query("batch_assign", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 500)::BIGINT AS batch FROM documents")
def _(spark, d):
    return batch_numbers(table(spark, d, "documents").select("doc_id"), "doc_id", 500).select("doc_id", F.col("batch").cast("long"))


@query("meta_filter", f"WITH {CORPUS} SELECT article_id FROM corpus WHERE lower(trim(category)) = 'de' AND lower(trim(source)) = 'src3'")
def _(spark, d):
    same = lambda c, v: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) == v.strip().lower()
    return corpus(spark, d).filter(same("category", " DE ") & same("source", "Src3")).select("article_id")


@query("date_range_filter", f"WITH {CORPUS} SELECT article_id FROM corpus WHERE published_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def _(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return corpus(spark, d).filter(F.col("published_at").between(at("2024-01-05"), at("2024-01-20"))).select("article_id")


@query("term_freq", index_sql() + " SELECT article_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, max(tf)::BIGINT AS max_tf FROM post GROUP BY article_id")
def _(spark, d):
    return R.postings(corpus(spark, d)).groupBy("article_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf"))


@query("doc_freq", index_sql() + " SELECT token, count(*) AS df, sum(tf)::BIGINT AS total FROM post GROUP BY token")
def _(spark, d):
    return R.postings(corpus(spark, d)).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


@query("corpus_stats", index_sql() + " SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def _(spark, d):
    return R.lengths(corpus(spark, d)).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))


@query("bm25_topk", index_sql() + ranked_sql("scores", 100))
def _(spark, d):
    return shown(R.bm25(questions(spark, d), corpus(spark, d)))


@query("bm25_filtered", index_sql() + ranked_sql("scores JOIN corpus USING (article_id)", 20, "category = 'en'"))
def _(spark, d):
    c = corpus(spark, d)
    return shown(R.bm25(questions(spark, d), c, 20, c.filter("category = 'en'").select("article_id")))


@query("bm25_title_weight", index_sql(5) + ranked_sql("scores", 20))
def _(spark, d):
    return shown(R.bm25(questions(spark, d), corpus(spark, d), 20, title_weight=5))


@query("vector_normalize", f"WITH {CORPUS}, {ASKED}, {VECTORS} SELECT article_id, array_to_string(list_transform(u, lambda x: round(x, 4)::DECIMAL(8, 4)), ',') AS unit FROM unit")
def _(spark, d):
    return vectors(spark, d).select("article_id", F.array_join(F.transform(R.unit(F.col("embedding")), lambda x: F.round(x, 4).cast("decimal(8,4)").cast("string")), ",").alias("unit"))


@query("cosine_topk", f"WITH {CORPUS}, {ASKED}, {VECTORS} " + ranked_sql("sims", 100))
def _(spark, d):
    return shown(R.cosine(questions(spark, d), vectors(spark, d)))


@query("cosine_filtered", f"WITH {CORPUS}, {ASKED}, {VECTORS} " + ranked_sql("sims", 20, "label < 5"))
def _(spark, d):
    return shown(R.cosine(questions(spark, d), vectors(spark, d), 20, labels(spark, d).filter("cluster_id < 5").select("article_id")))


_FUSED = f""", {VECTORS},
lex AS (SELECT * FROM (SELECT *, {RANK} AS rank FROM scores) WHERE rank <= 100), sem AS (SELECT * FROM (SELECT *, {RANK} AS rank FROM sims) WHERE rank <= 100),
fused AS (SELECT query_id, article_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, article_id, rank FROM lex UNION ALL SELECT query_id, article_id, rank FROM sem) GROUP BY ALL)"""
_DECAY = "(0.5 + 0.5 * pow(0.5::DOUBLE, greatest(0, date_diff('microsecond', published_at, TIMESTAMP '2024-03-01') / 86400e6::DOUBLE) / {}))"
_FRESH = r"regexp_matches(regexp_replace(replace(strip_accents(lower({})), 'đ', 'd'), '\bmoi\s+truong', ' ', 'g'), '\b(hom nay|moi nhat|moi|vua|vua xay ra|dang|truc tiep|nong|breaking|sang nay|chieu nay|toi nay|tuan nay|live)\b')"


@query("rrf_fuse", index_sql() + _FUSED + ranked_sql("fused", 200))
def _(spark, d):
    q, c, v = questions(spark, d), corpus(spark, d), vectors(spark, d)
    return shown(R.top(R.rrf(R.bm25(q, c), R.cosine(q, v)), 200))


@query("time_decay", f"WITH {CORPUS} SELECT article_id, round({_DECAY.format(30)}, 6) AS multiplier FROM corpus")
def _(spark, d):
    return corpus(spark, d).select("article_id", F.round(R.decay(F.col("published_at"), now()), 6).alias("multiplier"))


@query("noop_rerank", index_sql() + "SELECT query_id, article_id::BIGINT AS article_id, rank::INT AS rank, round(1.0::DOUBLE / rank, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) AS rank FROM scores) WHERE rank <= 50")
def _(spark, d):
    return shown(R.rerank_by_place(R.bm25(questions(spark, d), corpus(spark, d), R.RERANK_TOP)))


@query("collapse_clusters", f"WITH {CORPUS}, {ASKED}, {VECTORS}, r AS (SELECT *, {RANK} AS rank FROM sims), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS nth FROM r WHERE rank <= 100) SELECT query_id, article_id::BIGINT AS article_id, rank::INT AS rank, round(score, 6) AS score FROM c WHERE nth <= 1")
def _(spark, d):
    return shown(R.collapse(R.cosine(questions(spark, d), vectors(spark, d)), labels(spark, d)))


_FUNNEL = f""", dated AS (SELECT query_id, article_id, round(score * {_DECAY.format("half")}, 9) AS score FROM {{0}} JOIN corpus USING (article_id) JOIN (SELECT query_id, CASE WHEN {_FRESH.format("text")} THEN 2 ELSE 30 END AS half FROM asked WHERE len({TOKENS.format("text")}) > 0) USING (query_id)),
r AS (SELECT * FROM (SELECT *, {RANK} AS rank FROM dated) WHERE rank <= 50),
c AS (SELECT r.*, label, row_number() OVER (PARTITION BY query_id, coalesce('c' || label, 's' || r.article_id) ORDER BY rank) AS nth FROM r LEFT JOIN vec USING (article_id))
SELECT query_id, article_id::BIGINT AS article_id, title, url, published_at, place::INT AS rank, substr(body, 1, 200) || CASE WHEN length(body) > 200 THEN '...' ELSE '' END AS snippet
FROM (SELECT query_id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM c WHERE nth = 1) JOIN corpus USING (article_id) WHERE place <= 10"""


def _head(df):
    head = F.concat(F.substring("body", 1, R.SNIPPET), F.when(F.length("body") > R.SNIPPET, "...").otherwise(""))
    return df.select("query_id", "article_id", "title", "url", "published_at", "rank", head.alias("snippet"))


def _funnel(mode):
    def run(spark, d):
        return _head(R.search(questions(spark, d), corpus(spark, d), vectors(spark, d), labels(spark, d), now(), mode, diversify=False))

    return run


for _mode, _from in (("lexical", "lex"), ("semantic", "sem"), ("hybrid", "fused")):
    query(f"search_{_mode}_collapsed", index_sql() + _FUSED + _FUNNEL.replace("{0}", _from))(_funnel(_mode))


# Greedy MMR as a recursion over steps: the pool of a query, what is chosen, and each one's largest cosine with what is chosen.
_MMR = """, pool AS (SELECT query_id, article_id, rank, CASE WHEN max(score) OVER w - min(score) OVER w > 1e-12 THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1 END AS relevance
 FROM (SELECT query_id, article_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM {0}) WHERE rank <= 30 WINDOW w AS (PARTITION BY query_id)),
steps AS (
 SELECT query_id, article_id, rank, relevance, NULL::DOUBLE AS near, 0 AS step, row_number() OVER (PARTITION BY query_id ORDER BY 0.7 * relevance DESC, rank) = 1 AS chosen FROM pool
 UNION ALL
 SELECT query_id, article_id, rank, relevance, near, step, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * relevance - 0.3 * greatest(0, near), 12) DESC, rank) = 1 AS chosen FROM (
  SELECT s.query_id, s.article_id, s.rank, s.relevance, s.step + 1 AS step, greatest(coalesce(s.near, 0), coalesce(list_sum(list_transform(list_zip(a.u, b.u), lambda p: p[1] * p[2])), 0)) AS near
  FROM steps AS s JOIN steps AS c ON c.query_id = s.query_id AND c.chosen LEFT JOIN unit AS a ON a.article_id = s.article_id LEFT JOIN unit AS b ON b.article_id = c.article_id
  WHERE NOT s.chosen AND s.step < 9)),
mmr AS (SELECT query_id, article_id, (step + 1)::INT AS rank FROM steps WHERE chosen)"""


@query("mmr_select", f"WITH RECURSIVE {CORPUS}, {ASKED}, {VECTORS}, sem AS (SELECT *, {RANK} AS rank FROM sims)" + _MMR.replace("{0}", "(SELECT * FROM sem WHERE rank <= 100)") + " SELECT query_id, article_id::BIGINT AS article_id, rank FROM mmr")
def _(spark, d):
    v = vectors(spark, d)
    return R.mmr(R.cosine(questions(spark, d), v), v, 10).withColumn("article_id", F.col("article_id").cast("long"))


# The snippet from the words of a body and what stands between them, each with its place. {0}: rows of key, body, asked.
_SNIPPETS = rf"""shown AS (SELECT *, list_transform(regexp_extract_all(replace(replace(strip_accents(lower(asked)), 'đ', 'd'), 'Đ', 'D'), '[\p{{L}}\p{{N}}]+'), lambda w: w) AS wanted FROM {{0}}),
parts AS (SELECT key, i, part, list_contains(wanted, replace(replace(strip_accents(lower(part)), 'đ', 'd'), 'Đ', 'D')) AS hit, (sum(length(part)) OVER w)::BIGINT AS e FROM (SELECT key, wanted, unnest(ps) AS part, generate_subscripts(ps, 1) AS i FROM (SELECT key, wanted, regexp_extract_all(body, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS ps FROM shown)) WINDOW w AS (PARTITION BY key ORDER BY i)),
hits AS (SELECT key, e - length(part) AS s, e, row_number() OVER (PARTITION BY key ORDER BY i) AS nth FROM parts WHERE hit),
fit AS (SELECT h.key, h.s, h.nth, greatest(1, count(k.s)) AS n FROM hits AS h LEFT JOIN hits AS k ON k.key = h.key AND k.nth >= h.nth AND k.e <= h.s + {R.SNIPPET} GROUP BY ALL),
best AS (SELECT key, s, nth + n - 1 AS last FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, nth) AS o FROM fit) WHERE o = 1),
high AS (SELECT key, length(body) AS size, least(length(body), greatest(0, b.s - greatest(0, {R.SNIPPET} - (h.e - b.s)) // 2) + {R.SNIPPET}) AS hi FROM best AS b JOIN hits AS h USING (key) JOIN shown USING (key) WHERE h.nth = b.last),
span AS (SELECT key, size, hi, greatest(0, hi - {R.SNIPPET}) AS lo FROM high),
cut AS (SELECT key, string_agg(CASE WHEN hit AND e - length(part) >= lo AND e <= hi THEN '<b>' || part || '</b>' ELSE substr(part, (greatest(lo - (e - length(part)), 0) + 1)::INT, (least(e, hi) - greatest(e - length(part), lo))::INT) END, '' ORDER BY i) AS inside, any_value(lo) AS lo, any_value(hi) AS hi, any_value(size) AS size FROM parts JOIN span USING (key) WHERE e > lo AND e - length(part) < hi GROUP BY key),
snippets AS (SELECT key, coalesce(CASE WHEN lo > 0 THEN '...' ELSE '' END || inside || CASE WHEN hi < size THEN '...' ELSE '' END, substr(body, 1, {R.SNIPPET}) || CASE WHEN length(body) > {R.SNIPPET} THEN '...' ELSE '' END) AS snippet FROM shown LEFT JOIN cut USING (key))"""


def _search(mode):
    def run(spark, d):
        found = R.search(questions(spark, d), corpus(spark, d), vectors(spark, d), labels(spark, d), now(), mode)
        return found.select("query_id", F.col("article_id").cast("long").alias("article_id"), "title", "url", "published_at", "rank", R.snippet("body", "asked").alias("snippet"))

    return run


_SEARCH = _FUNNEL[: _FUNNEL.index("SELECT query_id, article_id::BIGINT")].rstrip() + _MMR.replace("{0}", "(SELECT query_id, article_id, 1.0::DOUBLE / rank AS score, rank FROM c WHERE nth = 1)") + ",\n" + _SNIPPETS.replace("{0}", "(SELECT query_id || ':' || article_id AS key, body, text AS asked FROM mmr JOIN corpus USING (article_id) JOIN asked USING (query_id))") + " SELECT query_id, article_id::BIGINT AS article_id, title, url, published_at, rank, snippet FROM mmr JOIN corpus USING (article_id) JOIN snippets ON key = query_id || ':' || article_id"
for _mode, _from in (("lexical", "lex"), ("semantic", "sem"), ("hybrid", "fused")):
    query(f"search_{_mode}", (index_sql() + _FUSED + _SEARCH.replace("{0}", _from)).replace("WITH ", "WITH RECURSIVE ", 1))(_search(_mode))


@query("snippet_head", "SELECT doc_id, substr(text, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END AS snippet FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.substring("text", 1, 200), F.when(F.length("text") > 200, "...").otherwise("")).alias("snippet"))


@query("snippet_highlight", f"WITH {CORPUS}, " + _SNIPPETS.replace("{0}", "(SELECT article_id AS key, body, 'the und que' AS asked FROM corpus)") + " SELECT key AS article_id, snippet FROM snippets")
def _(spark, d):
    return corpus(spark, d).select("article_id", R.snippet(F.col("body"), F.lit("the und que")).alias("snippet"))
