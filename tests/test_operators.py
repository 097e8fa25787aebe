"""Operators against hand-made values and brute force."""

import datetime
import json
import math
import shutil
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import entities, logs, retrieval, similarity, understanding
from tidewater.sources import tables
from tidewater.storage import dealt, stash
from tidewater.streaming import events


def one(spark, value, of):
    return spark.createDataFrame([(value,)], "x string").select(of(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("of", "value", "wanted"),
    [
        (T.normalize, "  Giá  Vàng \t Hôm\nNay  ", "giá vàng hôm nay"),
        (T.fold, "Đồng Tháp", "Dong Thap"),
        (T.tokens, "Giá vàng SJC, hôm nay tăng 2%!", ["giá", "vàng", "sjc", "hôm", "nay", "tăng", "2"]),
        (T.clean_html, "<p>A &lt;b&gt; &quot;C&quot; &nbsp; D</p>", 'A <b> "C" D'),
        (T.unescape, "&amp;lt; &eacute;&#8217;&#x2019; &#38;lt; &unknown; &#7; 5 &lt; 6 &apos;", "&lt; é’’ &lt; &unknown; &#7; 5 < 6 '"),
        (T.clean_html, "Giá 1 < 2 và 3 > 2 nhé.", "Giá 1 < 2 và 3 > 2 nhé."),
        (T.fresh_intent, "ô nhiễm môi trường", False),
        (T.fresh_intent, "tin mới về môi trường", True),
        (T.shingles, "a b", ["a b"]),
        (T.shingles, "!", []),
        (T.shingles, "a b c a b c", ["a b c", "b c a", "c a b"]),
        (T.strip_or_null, "  ", None),
        (T.strip_or_null, "\t\u00a0\n", None),
        (T.strip_or_null, "\tT x\n", "T x"),
        (T.fold, "Tha\u0301p D\u0323", "Thap D"),
        (T.tokens, "Tha\u0301p Mu\u031b\u0300i", ["tháp", "mừi"]),
        (T.normalize, "E\u0302\u0323", "ệ"),
        (T.compose, "e\u0302\u0323 a\u0301", "ệ á"),
        (T.tokens, None, None),
    ],
)
def test_text(spark, of, value, wanted):
    assert one(spark, value, of) == wanted


def test_rrf_and_decay(spark):
    rank = lambda ids: spark.createDataFrame([("q", a, k + 1) for k, a in enumerate(ids)], "query_id string, article_id string, rank int")
    got = {r["article_id"]: r["score"] for r in retrieval.rrf(rank("abc"), rank("bd"), k=10).collect()}
    assert got == {k: round(v, 9) for k, v in {"a": 1 / 11, "b": 1 / 12 + 1 / 11, "c": 1 / 13, "d": 1 / 12}.items()}
    now = datetime.datetime(2024, 3, 1)
    rows = spark.createDataFrame([(now - datetime.timedelta(days=30),), (now + datetime.timedelta(days=3),), (None,)], "p timestamp_ntz")
    assert [round(r[0], 9) for r in rows.select(retrieval.decay(F.col("p"), F.lit(now).cast("timestamp_ntz"), 30.0, 0.3)).collect()] == [0.65, 1.0, 1.0]


def test_mmr_is_greedy(spark):
    rng = np.random.default_rng(1)
    v = {k: rng.normal(size=4) for k in range(20)}
    ranked = spark.createDataFrame([("q", k, k + 1, float(1 / (k + 1))) for k in range(20)], "query_id string, article_id long, rank int, score double")
    frame = spark.createDataFrame([(k, [float(x) for x in v[k]]) for k in range(19)], "article_id long, embedding array<double>")
    got = [r["article_id"] for r in retrieval.mmr(ranked, frame, 6).orderBy("rank").collect()]
    rel = [(1 / (k + 1) - 1 / 20) / (1 - 1 / 20) for k in range(20)]
    cos = lambda a, b: 0.0 if 19 in (a, b) else float(v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b]))
    want = []
    while len(want) < 6:
        want.append(max((k for k in range(20) if k not in want), key=lambda k: (0.7 * rel[k] - 0.3 * max([0.0, *(cos(k, s) for s in want)]), -k)))
    assert got == want


def test_snippet():
    body = "x" * 300 + " giá vàng tăng " + "y" * 300
    assert retrieval.make_snippet("a" * 30, {"z"}, 20) == "a" * 20 + "..."
    assert "<b>giá</b> <b>vàng</b>" in retrieval.make_snippet(body, {"gia", "vang"})
    assert retrieval.make_snippet(None, {"z"}) == ""


def test_signature_equals_whole_numbers():
    words = [f"w{k}" for k in range(200)]
    a, b = similarity._coefficients()
    runs = {" ".join(words[k : k + 3]) for k in range(198)}
    want = [min((int(x) * zlib.crc32(r.encode()) + int(y)) % similarity.PRIME for r in runs) for x, y in zip(a, b, strict=True)]
    assert similarity.signature(words).tolist() == want
    assert set(similarity.signature([]).tolist()) == {similarity.PRIME}


def test_clusters_follow_arrival(spark):
    base = [f"tok{k}" for k in range(80)]
    texts = [" ".join(base), " ".join(base[:-2] + ["new", "end"]), "something else entirely here", " ".join(base), None]
    rows = spark.createDataFrame([(k, "", t) for k, t in enumerate(texts)], "article_id long, title string, body string")
    got = {r["article_id"]: r["cluster_id"] for r in similarity.clusters(rows).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}


def test_embedding_counts_grams():
    text = "năm mới ăn"
    want = np.zeros(256)
    for n in (2, 3, 4):
        for k in range(len(text) - n + 1):
            h = zlib.crc32(text[k : k + n].encode())
            want[h % 256] += -1 if h >> 31 else 1
    assert np.allclose(similarity.embed(text), want / np.linalg.norm(want))
    assert not similarity.embed("a").any() and not similarity.embed("  ").any()


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Theo Công ty Vàng Xanh, ông Nguyễn Văn An đến Hà Nội. NASA phóng.", [("Công ty Vàng Xanh", "ORG"), ("Nguyễn Văn An", "PER"), ("Hà Nội", "LOC"), ("NASA", "MISC")]),
        ("Phó Nguyễn Văn An nói", [("Nguyễn Văn An", "PER")]),
        ("mạng 5G Viettel mới", [("5G Viettel", "PER")]),
        ("Thủ đô Hà Nội đẹp", [("đô Hà Nội", "PER")]),
        ("Tại Huế mưa. gặp Bộ hôm qua", [("Huế", "LOC")]),
        ("xem Nguyễn   Văn", [("Nguyễn Văn", "PER")]),
        ("thấy Hanoi, rồi UBND", []),
        ("ở Nguye\u0302\u0303n Du", [("Nguyễn Du", "LOC")]),
        (None, []),
        ("  ", []),
    ],
)
def test_entities(text, wanted):
    assert entities.extract(text) == wanted


def test_labels_of_other_recognisers(spark):
    rows = spark.createDataFrame([("B-PER",), ("I-LOC",), ("ORG",), ("person",), ("B-EVT",), ("O",)], "x string")
    assert [r[0] for r in rows.select(entities.label_type(F.col("x"))).collect()] == ["PER", "LOC", "ORG", "PER", "MISC", "MISC"]


def test_links_of_clusters_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(12):
        base = [f"t{rng.integers(2000)}" for _ in range(120)]
        for n in (0, 0, 2, 4, 8):
            copy = list(base)
            for k in rng.integers(0, 120, n):
                copy[k] = f"n{rng.integers(2000)}"
            texts.append(" ".join(copy))
    signs = [similarity.signature(t.split()) for t in texts]
    bands = similarity.bands_for(0.7)
    assert bands == 16 and similarity.bands_for(0.5) > 16
    want = []
    for i, a in enumerate(signs):
        cut = lambda s: s.reshape(bands, -1)
        want.append(sum(j != i and (a == b).mean() >= 0.7 and bool((cut(a) == cut(b)).all(axis=1).any()) for j, b in enumerate(signs)))
    rows = spark.createDataFrame([(k, "", t) for k, t in enumerate(texts)], "article_id long, title string, body string").repartition(4)
    got = {r["article_id"]: r for r in similarity.clusters(rows).collect()}
    assert [got[k]["n_links"] for k in range(len(texts))] == want and max(want) > 2
    # Known articles keep their cluster; new ones join them.
    known = spark.createDataFrame([(1, 999)], "article_id long, cluster_id long")
    again = {r["article_id"]: r["cluster_id"] for r in similarity.clusters(rows.filter("article_id <> 0"), known=known).collect()}
    assert again[1] == 999 and again[2] in (999, 2)


def test_jaccard_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    texts = ["", "a b", "a b", None]
    for _ in range(20):
        base = [f"w{x}" for x in rng.integers(0, 900, 30)]
        texts += [" ".join([*base[:k], "other", *base[k + j :]]) for k, j in ((3, 1), (9, 1), (3, 1), (15, 4), (30, 0))]
    sets = [set(zip(w, w[1:], w[2:], strict=False)) if len(w := (t or "").split()) > 2 else {tuple(w)} if w else set() for t in texts]
    first = {}
    for k, s in enumerate(sets):
        first.setdefault(frozenset(s), k)
    want = {(a, b) for s, a in first.items() for u, b in first.items() if a < b and s and u and len(s & u) >= 0.3 * len(s | u)}
    rows = spark.createDataFrame(list(enumerate(texts)), "article_id long, text string")
    got = {(r["id_a"], r["id_b"]) for r in similarity.jaccard_pairs(rows, 0.3).collect()}
    assert got == want and len(want) > 5


def test_blocks_of_queries_equal_one_block(spark, monkeypatch):
    rng = np.random.default_rng(2)
    articles = spark.createDataFrame([(k, f"title {rng.integers(9)}", " ".join(f"w{x}" for x in rng.integers(0, 40, 30))) for k in range(80)], "article_id long, title string, body string")
    queries = spark.createDataFrame([(f"q{k}", " ".join(f"w{x}" for x in rng.integers(0, 60, 4)), [float(x) for x in rng.normal(size=5)]) for k in range(11)] + [("none", None, None)], "query_id string, text string, vector array<double>")
    vectors = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=5)]) for k in range(80)], "article_id long, embedding array<double>")
    every = [sorted(map(tuple, f(queries, x, 7).collect())) for f, x in ((retrieval.bm25, articles), (retrieval.cosine, vectors))]
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    assert every == [sorted(map(tuple, f(queries, x, 7).collect())) for f, x in ((retrieval.bm25, articles), (retrieval.cosine, vectors))]
    assert len(every[1]) == 77 and {r[0] for r in every[0]} <= {f"q{k}" for k in range(11)}
    posted, sizes = retrieval.postings(articles), retrieval.lengths(articles)
    assert every[0] == sorted(map(tuple, retrieval.bm25_indexed(queries, posted, sizes, 7).collect()))
    with pytest.raises(Exception, match="dimensions"):
        retrieval.cosine(queries, vectors.withColumn("embedding", F.slice("embedding", 1, 4)), 7).collect()


def _bm25(queries, articles, k):
    """By the formula: {query: [(article, score)]}."""
    bags = {a: Counter([*title.split() * 3, *body.split()]) for a, title, body in articles}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(t for b in bags.values() for t in b)
    idf = {t: math.log((len(bags) - n + 0.5) / (n + 0.5) + 1) for t, n in df.items()}
    found = {}
    for q, text in queries:
        of = {a: sum(idf[t] * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * sum(b.values()) / mean)) for t in text.split() if t in b) for a, b in bags.items()}
        found[q] = sorted(((a, round(s, 9)) for a, s in of.items() if s), key=lambda x: (-x[1], x[0]))[:k]
    return {q: rows for q, rows in found.items() if rows}


def test_many_questions_take_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(5)
    some = lambda n, m: " ".join(f"w{x}" for x in rng.zipf(1.3, n) if x < m)
    articles = [(f"a{k}", some(4, 90), some(40, 90)) for k in range(120)]
    articles += [(f"b{k}", "w1 w7", "w2 w3 w3 w50") for k in range(20)]  # copies: ties by id
    queries = [(f"q{k}", some(9, 120)) for k in range(700)]
    passes, stash = [], retrieval.stash
    monkeypatch.setattr(retrieval, "stash", lambda df, label: (passes.append(label), stash(df, label))[1])
    found = retrieval.bm25(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(articles, "article_id string, title string, body string"), 10).collect()
    assert passes == ["forward"]
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["article_id"], r["score"]))
    assert got == _bm25(queries, articles, 10)


def test_questions_of_the_same_words_are_scored_once(spark, monkeypatch):
    rng = np.random.default_rng(8)
    articles = [(k, f"w{k % 5}", " ".join(f"w{x}" for x in rng.integers(0, 30, 12))) for k in range(90)]
    queries = [(f"q{k}", ("w1 w2 w2", "w2 w1 w2", "w3 w9", "w3 w9 w9")[k % 4]) for k in range(60)] + [("none", "zzz"), ("empty", "")]
    passes, stash = [], retrieval.stash
    monkeypatch.setattr(retrieval, "stash", lambda df, label: (passes.append(label), stash(df, label))[1])
    monkeypatch.setattr(retrieval, "WORD_QUERIES", 16)
    found = retrieval.bm25(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(articles, "article_id long, title string, body string"), 6).collect()
    assert passes == ["forward"]
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["article_id"], r["score"]))
    assert got == _bm25(queries, articles, 6) and len(got) == 60


def test_many_vectors_take_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(150, 6)).round(2)
    vectors[7], vectors[20] = 0, vectors[21]
    queries = spark.createDataFrame([(f"q{k}", v.tolist()) for k, v in enumerate(vectors)] * 4, "query_id string, vector array<double>").withColumn("query_id", F.concat("query_id", F.lit("-"), F.monotonically_increasing_id()))
    passes, put = [], retrieval.stash
    monkeypatch.setattr(retrieval, "stash", lambda df, label: (passes.append(label), put(df, label))[1])
    rows = retrieval.cosine(queries, spark.createDataFrame(list(enumerate(vectors.tolist())), "article_id long, embedding array<double>"), 5).collect()
    assert passes == []
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(size > 0, size, 1)
    want = {}
    for k in np.flatnonzero(size):
        scores = np.round(unit @ unit[k], 9)
        want[f"q{k}"] = [(int(a), float(scores[a])) for a in np.lexsort((np.arange(150), -scores))[:5]]
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["article_id"], r["score"]))
    assert len(got) == 4 * 149 and all(x == want[q.split("-")[0]] for q, x in got.items())


def test_files_are_dealt_whole(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        made = stash(spark.range(0, 40000, numPartitions=1).selectExpr("id", "xxhash64(id) as x").unionByName(spark.range(40000, 46000, numPartitions=6).selectExpr("id", "xxhash64(id) as x")), "dealt")
        rows = lambda df: sorted(n for n in df.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect() if n)
        assert rows(dealt(made, 3)) == [3000, 3000, 40000]
        assert len(rows(dealt(made, 1))) <= 2 and sum(rows(dealt(made, 1))) == 46000
        assert sorted(r["id"] for r in dealt(made, 4).collect()) == list(range(46000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("dense", [0.0, 0.3, 2.0])
def test_chunks_of_postings_equal_one(monkeypatch, dense):
    rng = np.random.default_rng(6)
    tokens = [np.unique(rng.integers(0, 30, 8)) for _ in range(200)]
    counted = pa.table({"article_id": list(range(200, 0, -1)), "dl": [len(t) % 3 + 8 for t in tokens], "tokens": pa.array([t.tolist() for t in tokens], pa.list_(pa.int64())), "tfs": pa.array([(t % 3 + 1).tolist() for t in tokens], pa.list_(pa.int32()))})
    asked = [np.sort(rng.permutation(28)[:6]) for _ in range(70)]
    what = ([f"q{k}" for k in range(70)], np.arange(71) * 6, np.concatenate(asked), rng.integers(1, 3, 420).astype(float), np.arange(28), rng.random(28) + 0.1, 8.5, 5)
    one = pa.Table.from_batches(retrieval._best_by_words(iter(counted.to_batches()), *what)).to_pylist()
    monkeypatch.setattr(retrieval, "CHUNK", 90)
    monkeypatch.setattr(retrieval, "DENSE", dense)
    assert one == pa.Table.from_batches(retrieval._best_by_words(iter(counted.to_batches(max_chunksize=7)), *what)).to_pylist()
    assert len(one) == 350


def test_index_counts_the_folded_tokens(spark, monkeypatch):
    odd = [(1, "Đồng Tháp A_b 2%", "a\u0301o\u0323 vàng; vàng"), (2, "", "ΑΣ ΟΔΟΣ. İstanbul \U00010400x \u212a"), (3, "", None), (4, "x" * 90 + " tail", "\u0301 \u3000gold\u0000gold"), (5, "end", "end x"), (6, "٣٤ ⅷ ª", "中文 한국어 e\u0301")]
    odd += [(k, "w" * (k % 5), f"the {k} the\nx") for k in range(7, 40)]
    articles = spark.createDataFrame(odd, "article_id long, title string, body string")
    monkeypatch.setattr(retrieval, "PIECE", 64)
    found = {r["article_id"]: r for r in retrieval.forward_index(articles, 3).collect()}
    wanted = {}
    for r in retrieval.postings(articles, 3).collect():
        wanted.setdefault(r["article_id"], {})[r["token"]] = r["tf"]
    assert {a: sorted(r["tfs"]) for a, r in found.items() if r["tfs"]} == {a: sorted(w.values()) for a, w in wanted.items()}
    assert {a: r["dl"] for a, r in found.items()} == {a: sum(wanted.get(a, {}).values()) for a, _, _ in odd}
    # One hash for each token, wherever it is.
    names = {}
    for a, w in wanted.items():
        if len(set(w.values())) == len(w):
            for token, tf in w.items():
                names.setdefault(token, set()).add(found[a]["tokens"][found[a]["tfs"].index(tf)])
    assert all(len(x) == 1 for x in names.values()) and len(set().union(*names.values())) == len(names)
    assert len({t for r in found.values() for t in r["tokens"]}) == len({t for w in wanted.values() for t in w})


def test_tasks_hand_out_few_rows(spark, monkeypatch):
    articles = spark.createDataFrame([(k, f"w{k % 7}", "x " * (k % 5)) for k in range(400)], "article_id long, title string, body string").repartition(50)
    queries = spark.createDataFrame([(f"q{k}", f"x w{k % 7}") for k in range(200)], "query_id string, text string")
    monkeypatch.setattr(retrieval, "TOGETHER", 9)
    few = retrieval.bm25(queries, articles, 5)
    assert few.rdd.getNumPartitions() and "Window" not in few._jdf.queryExecution().toString()
    wide = {(r["query_id"], r["article_id"], r["score"], r["rank"]) for r in retrieval.bm25_indexed(queries, retrieval.postings(articles), retrieval.lengths(articles), 5).collect()}
    assert wide == set(map(tuple, few.select("query_id", "article_id", "score", "rank").collect()))


def test_snippets_equal_the_definition():
    rng = np.random.default_rng(3)
    for _ in range(200):
        body = "".join(str(rng.choice(["gold ", "Vàng, ", "x_y ", "lorem ", "ipsumdolor", ". "])) for _ in range(int(rng.integers(0, 60))))
        most = int(rng.integers(5, 80))
        found = [(m.start(), m.end()) for m in retrieval.re.finditer(r"\w+", body) if m.group() in ("gold", "Vàng")]
        got = retrieval.make_snippet(body, {"gold", "vang"}, most)
        assert got.replace("<b>", "").replace("</b>", "").strip(".") in body
        if found:
            fitting = [max(1, sum(e <= s + most for _, e in found[k:])) for k, (s, _) in enumerate(found)]
            k = fitting.index(max(fitting))
            start = max(0, found[k][0] - max(0, most - (found[k + fitting[k] - 1][1] - found[k][0])) // 2)
            end = min(len(body), start + most)
            inside = sum(s >= max(0, end - most) and e <= end for s, e in found)
            assert got.count("<b>") == inside


def test_content_system_rows(spark):
    at = lambda d: datetime.datetime(2026, 7, d)
    rows = [
        (1, "", " Short ", "lead", " ", "a-slug", "s", at(1), at(1), at(2), None, "c", "x", ["t"]),
        (2, "Only title", None, None, "", None, None, at(3), None, at(3), None, None, None, None),
        (3, "gone", None, "l", "c", "", None, at(1), at(1), at(5), at(5), None, None, None),
        (4, "withdrawn", None, "l", "c", "", None, None, at(1), at(6), None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, tables.CMS)
    got = {r["article_id"]: r for r in tables.cms_articles(tables.cms_published(frame)).collect()}
    assert set(got) == {"1", "2"} and (got["1"]["title"], got["1"]["body"], got["1"]["url"], got["1"]["tags"]) == ("Short", "lead", "/a-slug", ["t"])
    assert (got["2"]["body"], got["2"]["url"], got["2"]["published_at"], got["2"]["tags"]) == ("Only title", "/article/2", "2026-07-03T00:00:00+07:00", [])
    when = F.lit("2026-07-03").cast("timestamp")
    assert [r["id"] for r in tables.cms_since(frame, when).collect()] == [2]
    assert {r[0] for r in tables.cms_deleted(frame, when).collect()} == {"3", "4"}
    assert [r["id"] for r in tables.cms_by_ids(frame, spark.createDataFrame([("1",), ("3",), ("x",)], "article_id string")).collect()] == [1]


def test_daily_counts_over_several_runs(spark, tmp_path):
    schema = "ts timestamp, kind string"
    for k in range(2):
        spark.createDataFrame([(datetime.datetime(2026, 7, 1 + j, 5), ("search", "click")[(j + k) % 2]) for j in range(3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        counted = events.run_once(events.daily_counts(events.stream_table(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "check"))
        assert counted.count() == 3
    # The second run's first day is more than a day late.
    assert {r["day"].day: (r["searches"], r["clicks"]) for r in events.days(spark, str(tmp_path / "out")).collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 1)}


def test_spelling(spark):
    vocabulary = spark.createDataFrame([("lam", 3), ("phat", 5), ("kinh", 2), ("te", 9)], "token string, freq long")
    words = spark.createDataFrame([("phatt",), ("zzzzz",), ("lam",), ("kihn",)], "word string")
    assert {r[0]: r[1] for r in understanding.correct(words, vocabulary).collect()} == {"phatt": "phat", "zzzzz": "zzzzz", "lam": "lam", "kihn": "kinh"}
    # Long words, to both sides of the length up to which variants are made.
    rng = np.random.default_rng(5)
    tokens = ["".join(rng.choice(list("abcdefgh"), n)) for n in (39, 40, 41, 42, 43, 60, 200)]
    spoilt = {}
    for t in tokens:
        for kind in range(5):
            k = int(rng.integers(1, len(t) - 3))
            once = (t[:k] + t[k + 1 :], t[:k] + "z" + t[k:], t[:k] + "z" + t[k + 1 :], t[:k] + t[k + 1] + t[k] + t[k + 2 :], t[1:-1])[kind]
            spoilt[once] = t
    frame = spark.createDataFrame([(w,) for w in spoilt], "word string")
    assert {r[0]: r[1] for r in understanding.correct(frame, spark.createDataFrame([(t, 1) for t in tokens], "token string, freq long")).collect()} == {w: w if w in tokens else t for w, t in spoilt.items()}


def test_feedback_golden(spark):
    rows = [("search", "a", None, None, False), ("search", "b", None, None, True), ("click", "a", 1, 3000, None)]
    log = spark.createDataFrame(rows, "kind string, search_id string, position int, dwell_ms int, zero_result boolean")
    assert tuple(logs.feedback(log).first()) == (2, 1, 0.5, 0.5, 3000.0)
    assert tuple(logs.feedback(log.limit(0)).first()) == (0, 0, 0.0, 0.0, None)


def test_json_sources(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text(json.dumps({"kind": "search", "search_id": "a"}) + "\n\nnot json\n")
    assert tables.json_lines(spark, str(path)).count() == 1
    assert tables.json_lines(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "articles.json").write_text(json.dumps([{"article_id": "x", "tags": ["t"]}, {"article_id": "y"}]))
    assert tables.json_articles(spark, str(tmp_path / "articles.json")).count() == 2
    with pytest.raises(ValueError):
        tables.jdbc_articles(spark, "jdbc:x", "public; drop", "t", 0, 1, 1)


def test_upserts_keep_the_latest(spark, tmp_path):
    schema = "article_id string, arrival long, status string, title string"
    for k, rows in enumerate(([("a", 1, "published", "one"), ("b", 2, "published", "two")], [("a", 3, "published", "three"), ("b", 4, "draft", "gone")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events.upserts(events.stream_table(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "check"))
    assert [tuple(r) for r in events.upserted(spark, str(tmp_path / "out"), schema).collect()] == [("a", 3, "published", "three")]


def test_cache_forgets(spark):
    from tidewater.operators.cache import ResultCache

    now = [0.0]
    cache = ResultCache(ttl=10, size=2, clock=lambda: now[0])
    cache.set("x", 1, "q")
    assert cache.get(1, "q") == "x" and cache.get(2, "q") is None
    cache.set("y", 1, "r")
    cache.get(1, "q")
    cache.set("z", 1, "s")
    assert cache.get(1, "r") is None and cache.get(1, "q") == "x"
    now[0] = 10.0
    assert cache.get(1, "q") is None


def test_index_generations(spark, tmp_path):
    from tidewater.plans import index

    article = lambda i, body, n, status=None, at="2026-07-07T12:00:00": (i, f"Title {i}", body, f"/{i}", at, " ", None, None, status, [" t ", ""], n)
    schema = tables.ARTICLE + ", arrival long"
    folder = str(tmp_path / "index")
    assert index.current(spark, folder) is None
    first = [article("a", "<p>one</p>", 1), article("a", "<p>two &amp; more</p>", 2), article("b", "bee", 3), article("c", "", 4), article("d", "dee", 5, at="soon"), article("e", "eee", 6, "draft")]
    assert index.build(spark.createDataFrame(first, schema), folder, "arrival") == 0
    assert {r["article_id"]: r["body"] for r in index.read(spark, folder, "articles").collect()} == {"a": "two & more", "b": "bee"}
    assert {r["article_id"]: r["missing"] for r in index.read(spark, folder, "rejected").collect()} == {"c": "body", "d": "published_at"}
    row = index.read(spark, folder, "articles").filter("article_id = 'a'").first()
    assert row["author"] is None and row["tags"] == ["t"] and row["published_at"] == datetime.datetime(2026, 7, 7, 5)
    gone = spark.createDataFrame([("a",)], "article_id string")
    assert index.build(spark.createDataFrame([article("b", "new bee", 7)], schema), folder, "arrival", gone) == 1
    assert {r["article_id"]: r["body"] for r in index.read(spark, folder, "articles").collect()} == {"b": "new bee"}
    assert {r["token"] for r in index.read(spark, folder, "postings").collect()} == {"title", "b", "new", "bee"}


def test_engine(spark, tmp_path):
    from tidewater.plans import engine

    words = ["giá vàng tăng mạnh hôm qua", "đội tuyển thắng trận lớn", "giá xăng giảm nhẹ", "Công ty Vàng Xanh mở kho", "giá vàng tăng mạnh hôm qua"]
    rows = [(f"a{k}", f"Tin {k}", f"{w} ở Hà Nội", f"/{k}", f"2026-07-0{k + 1}T12:00:00+07:00", None, "kinh-te" if k % 2 == 0 else "khac", None, None, None) for k, w in enumerate(words)]
    raw = spark.createDataFrame(rows, tables.ARTICLE)
    made = engine.SearchEngine(spark, str(tmp_path / "index"))
    assert made.index(raw) == 0
    now = F.lit("2026-07-10 00:00:00").cast("timestamp")
    for mode in ("lexical", "semantic", "hybrid"):
        _, found = made.ask("giá vàng", mode, 3, now=now)
        assert found[0]["article_id"] in ("a0", "a4") and set(found[0]) == {"article_id", "title", "url", "published_at", "snippet"}
    assert "<b>giá</b>" in found[0]["snippet"] and found[0]["published_at"].endswith("+07:00")
    # Equal bodies under different titles are one cluster only if near enough; filters restrict what is found.
    only = {r["article_id"] for r in made.search(spark.createDataFrame([("q", "giá")], "query_id string, text string"), filters=engine.Filters(category=" KHAC "), now=now).collect()}
    assert only == {"a1", "a3"}
    indexed = retrieval.bm25_indexed(spark.createDataFrame([("q", "giá vàng hà")], "query_id string, text string"), made.table("postings"), made.table("lengths"))
    plain = retrieval.bm25(spark.createDataFrame([("q", "giá vàng hà")], "query_id string, text string"), made.table("articles"))
    assert sorted(map(tuple, indexed.collect())) == sorted(map(tuple, plain.collect()))
    search_id, none = made.ask("@@@ ###", now=now)
    assert none == []
    made.click(search_id, "a0", 1, 1200)
    assert tuple(made.feedback().first())[:2] == (4, 1) and made.metrics().first()["searches"] == 4
    assert made.alerts().first()[0] == ""
    assert ("Hà Nội", "LOC") in {tuple(r) for r in made.entities_of("a1").collect()}
    assert made.understand(spark.createDataFrame([("q", "vangg tang")], "query_id string, text string")).first()["expanded"] == "vang tang"
    assert made.events().filter("kind = 'search' and variant in ('A', 'B')").count() == 4
    with pytest.raises(KeyError):
        made.entities_of("no such article")
    # What is asked for fresh is answered anew each time; expanded questions find synonyms and correct words.
    kept = len(made.cache.entries)
    made.ask("tin moi", now=now)
    assert len(made.cache.entries) == kept
    wide = engine.SearchEngine(spark, str(tmp_path / "index"), events="none", understanding=True, synonyms={"kho": ["tang manh"]})
    found = lambda which, text: {r["article_id"] for r in which.ask(text, "lexical", now=now)[1]}
    assert found(made, "kho") == {"a3"} and found(wide, "kho") > {"a3"}
    assert found(made, "vangg") == set() and found(wide, "vangg")
    made.snapshot(str(tmp_path / "snap"))
    assert made.restore(str(tmp_path / "snap")) == 1 and made.stats()["articles"] == 5
    with pytest.raises(ValueError, match="body"):
        made.index(raw.limit(1).withColumn("body", F.lit("")), strict=True)
    shutil.rmtree(tmp_path / "index" / "2", ignore_errors=True)
    assert made.remove(spark.createDataFrame([("a0",), ("zz",)], "article_id string")) == 2 and made.stats()["articles"] == 4
    assert made.sync(raw.filter("article_id = 'a0'"), spark.createDataFrame([("a1",)], "article_id string")) == 3 and made.stats()["articles"] == 4
    done = made.job(raw.withColumn("title", F.when(F.col("article_id") != "a3", F.col("title"))), limit=5)
    assert done["rejected"] == 1 and done["shown"] == [{"article_id": "a3", "missing": "title"}] and done["per_second"] > 0
    assert made.reindex(raw.limit(2)) == 5 and made.stats()["articles"] == 2
    for bad in (lambda: made.ask(" "), lambda: made.ask("x", k=0), lambda: made.ask("x", "other"), lambda: engine.SearchEngine(spark, "x", reranker="other")):
        with pytest.raises(ValueError):
            bad()
    settings = engine.Settings.read({"TIDEWATER_FOLDER": str(tmp_path / "index"), "TIDEWATER_UNDERSTANDING": "true", "TIDEWATER_CACHE_SIZE": "5", "OTHER": "x"})
    assert (settings.understanding, settings.cache_size, settings.reranker) == (True, 5, "none") and engine.SearchEngine.of(spark, settings).understanding
    with pytest.raises(ValueError):
        engine.Settings.read({"TIDEWATER_CACHE_FRESH": "maybe"})
    engine.register_functions(spark)
    got = spark.sql("SELECT tw_fold('Đồng Tháp') AS f, tw_tokens('Giá 2%') AS t, tw_normalize('  A \t b ') AS n, tw_variant('q') AS v, tw_snippet('giá vàng', 'gia') AS s").first()
    assert (got["f"], got["t"], got["n"], got["s"]) == ("Dong Thap", ["giá", "2"], "a b", "<b>giá</b> vàng") and got["v"] in "AB"


def test_wanted_articles_are_counted_and_not_paired_with_every_query(spark, tmp_path, monkeypatch):
    from tidewater.plans import analytics, registry

    n, handed = 400, []
    texts = [f"title w{k % 7} x{k % 11}\nbody w{k % 5} y{k % 13}" for k in range(n)]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, 0, [1.0, 0.0])], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in filter(lambda x: hasattr(analytics.L, x), ("relevance", "relevance_of_hits")):

        def counted(a, b, k=10, plain=getattr(analytics.L, name)):
            handed.extend([a.count(), b.count()])
            return plain(a, b, k)

        monkeypatch.setattr(analytics.L, name, counted)
    got = {r["query_id"]: tuple(r)[1:] for r in analytics.QUERIES["eval_relevance"](spark, str(tmp_path)).collect()}
    assert len(got) == n // 20 and max(handed) <= 10 * n // 20
    ranked = {}
    for r in registry.QUERIES["bm25_topk"](spark, str(tmp_path)).filter("rank <= 10 and article_id % 3 > 0").collect():
        ranked.setdefault(r["query_id"], []).append(r["rank"])
    total, ideal = sum(k % 3 > 0 for k in range(n)), sum(1 / math.log2(i + 1) for i in range(1, 11))
    assert got == {q: (round(len(x) / total, 6), round(1 / min(x), 6), round(sum(1 / math.log2(i + 1) for i in x) / ideal, 6)) for q in got for x in [ranked[q]]}


def test_snippets_fold_only_words_that_are_not_ascii():
    asked = []

    def plain(word):
        asked.append(word)
        return retrieval._plain(word)

    assert retrieval.make_snippet("One TWO, three_4 two.", {"two"}, plain=plain) == "One <b>TWO</b>, three_4 <b>two</b>." and not asked
    assert retrieval.make_snippet("Một HAI ba: Đá hai", {"hai", "da"}, plain=plain) == "Một <b>HAI</b> ba: <b>Đá</b> <b>hai</b>" and asked == ["Một", "Đá"]
