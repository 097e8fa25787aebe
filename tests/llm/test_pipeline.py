"""The pipeline on a small folder of tables, stage by stage."""

import pytest

import corpus_pipeline
from tidewater.llm import near_text


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    text = lambda k: " ".join(f"word{(k * 37 + j * j) % 211} and the" for j in range(60))
    bench = " ".join(f"item{j}" for j in range(20))
    rows = [(k, text(k), "en", f"src{k % 3}", len(text(k))) for k in range(40)]
    rows += [(50, text(3), "en", "src1", 1), (51, "123 456", "en", "src1", 7), (52, None, None, None, None), (53, text(99) + " " + bench, "en", "src2", 1), (54, bench, "en", "src0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        seen[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
    ids = {name: {r["doc_id"] for r in got} for name, got in seen.items()}
    assert set(range(40)) <= ids["language"] and not ids["language"] & {51, 52}
    assert 3 in ids["near_duplicates"] and 50 not in ids["near_duplicates"] and len(ids["near_duplicates"]) == 42
    assert 54 not in ids["decontamination"] and 53 in ids["decontamination"]
    assert not any("item5" in r["text"] for r in seen["decontamination"])
    assert all(r["n_chars"] == len(r["text"]) for r in seen["decontamination"] if r["doc_id"] == 53)
    assert ids["sharding"] == ids["mixing"] and len(seen["sharding"]) == len(seen["mixing"])
    assert (near_text.SHINGLE, near_text.RADIUS) == (5, 2)


def test_run(spark, folder):
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) for _ in range(2))
    assert first and first == again


def test_shards_hold_the_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("text is not null")
    got = corpus_pipeline.shard(spark, docs, folder)
    assert set(docs.columns) < set(got.columns)
    assert sorted(map(tuple, got.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert len({(r["shard"], r["slot"]) for r in got.collect()}) == docs.count()


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    """Ids that repeat with other texts or are missing, null columns, columns named like those that the stages make."""
    text = lambda k: " ".join(f"word{(k * 37 + j * j) % 211} and the" for j in range(60))
    rows = [(k, text(k), "en", f"src{k % 3}", 5) for k in range(20)] + [(3, text(103), "en", None, None), (None, text(104), "en", "src1", 7), (None, text(105), None, "src1", 7), (3, text(3), "en", "src1", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as h1", "2 as copies", "3 as key", "4 as mask", "5 as nth", "6 as h")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    for name, docs in (("odd", frame), ("none", frame.limit(0))):
        path = str(tmp_path / name)
        docs.write.parquet(f"{path}/documents.parquet")
        bench.write.parquet(f"{path}/benchmark.parquet")
        got = corpus_pipeline.run(spark, path)
        assert set(frame.columns) < set(got.columns)
        found = {(r["doc_id"], r["text"]) for r in got.collect()}
        assert found <= {(r[0], r[1]) for r in rows} and (name == "none") == (not found)
    # Near duplicates and the mix lose no row that is a text of its own.
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, frame, path).collect()}
    assert kept == {(r[0], r[1]) for r in rows}


def test_sources_keep_their_targets(spark, folder):
    from tidewater.llm import mixing

    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("text is not null")
    size = lambda d: {r["source"]: r["n"] for r in d.selectExpr("source", "size(split(trim(text), ' +')) as n").groupBy("source").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    before, after = size(docs), size(corpus_pipeline.mix_sources(spark, docs, folder))
    order = sorted(before)
    want = mixing.targets([before[s] for s in order], [mixing.WEIGHTS[k % 3] for k in range(len(order))])
    longest = docs.selectExpr("max(size(split(trim(text), ' +'))) as n").first()["n"]
    assert all(abs(after.get(s, 0) - w) <= longest for s, w in zip(order, want, strict=True))
