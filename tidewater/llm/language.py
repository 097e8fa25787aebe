"""Language identification by nearest centroid.

A text is a vector of hashed byte 1- to 3-grams of its lower-cased words, weighted sqrt(tf) * idf and normalised.
Document frequencies are counted over all training documents. Each language gets several centroids, fitted by
spherical k-means on a bounded sample of its training documents (SAMPLE for each language, by the order of a hash of
their ids and texts). A text gets the language of the centroid with the largest cosine; it is rejected if it has no
letter or if that cosine is below the language's limit, a share of the lowest cosines seen in training (less for short
texts). The limit lies between the cosines of own texts and those of languages that were not learned.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; without any training
document everything is `und`; rows without lang are not learned from but predicted; repeated rows are learned from once
and predicted alike; rows without an id are treated like others; of centroids with equal cosines the first by language
and values wins; texts of any length are read whole, at about 10 bytes of memory a byte; an empty table gives an empty
result; extra columns are ignored by the query and kept by known_language().
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.patterns import first_of_each, id_remainder, new_name
from tidewater.storage import stash

DIMS, CENTROIDS, ROUNDS = 8192, 3, 12
#: Training documents of a language; languages that are compared in one pass (more take more passes).
SAMPLE, BLOCK_LANGUAGES = 400, 200
FOLDS = 5
#: A language's limit is this share of the 1st percentile of the cosines of its own training documents.
REJECT_SHARE = 0.75
#: Texts with fewer n-grams than this have lower cosines by nature; their limit falls with the root of the number.
SHORT_GRAMS = 400
UNKNOWN = "und"

# ASCII letters and all bytes of non-ASCII characters stay, anything else parts words.
_LETTER_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Model(NamedTuple):
    languages: list[str]
    centroids: np.ndarray  # (n, DIMS), unit length
    limits: np.ndarray
    idf: np.ndarray

    def blocks(self) -> list[Model]:
        """Parts of BLOCK_LANGUAGES languages, one at least."""
        first = [k for k, x in enumerate(self.languages) if not k or x != self.languages[k - 1]]
        cuts = [*first[::BLOCK_LANGUAGES], len(self.languages)] if first else [0, 0]
        return [Model(self.languages[a:b], self.centroids[a:b], self.limits[a:b], self.idf) for a, b in zip(cuts, cuts[1:], strict=False)]


def predict(model: tuple, text: str | None) -> tuple[str, float, bool]:
    """Language, cosine, whether it is rejected."""
    languages, centroids, limits, idf = model
    if not languages or not has_letter(text):
        return UNKNOWN, 0.0, True
    at, tf = grams(text)
    v = np.sqrt(tf) * idf[at]
    cosines = centroids[:, at] @ v / max(np.linalg.norm(v), 1e-12)
    best = int(np.argmax(cosines))
    score = float(min(1.0, max(0.0, cosines[best])))
    return languages[best], score, score < limits[best] * min(1.0, float(tf.sum() / SHORT_GRAMS) ** 0.5)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions that occur in the text, and how often."""
    flat = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTER_BYTES).split())
    b = np.frombuffer(b"  " + flat + b" ", np.uint8).astype(np.uint32)
    one, two = b[2:], b[1:-1] * np.uint32(257) + b[2:]
    three = b[:-2] * np.uint32(66049) + two
    hashed = [((x + np.uint32(k << 24)) * np.uint32(2654435761)) >> np.uint32(19) for k, x in enumerate((one, two, three))]
    counts = np.bincount(np.concatenate(hashed), minlength=DIMS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


def _document_frequencies(batches):
    df, n = np.zeros(DIMS + 1, np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            df[grams(text.as_py())[0]] += 1
            n += 1
    df[DIMS] = n
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["dim", "n"])


def fit(training: DataFrame) -> Model:
    """training(doc_id, text, lang), nulls in text and lang left out."""
    known = training.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    counted = known.select("text").mapInArrow(_document_frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    df = np.zeros(DIMS + 1)
    for dim, n in counted.collect():  # DIMS + 1 rows at most
        df[dim] = n
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1

    def vectors(batches):
        for batch in batches:
            out = []
            for text in batch.column("text"):
                at, tf = grams(text.as_py())
                v = np.zeros(DIMS, np.float32)
                v[at] = np.sqrt(tf) * idf[at]
                out.append((v / max(np.linalg.norm(v), 1e-12)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array(out, pa.binary())], names=["lang", "h", "vector"])

    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("vector", "ascending")])
        x = np.stack([np.frombuffer(v, np.float32) for v in table.column("vector").to_pylist()])
        # From texts spread by how near they are to the mean.
        near = np.argsort(x @ x.mean(axis=0), kind="stable")
        k = min(CENTROIDS, len(x))
        c = x[near[((np.arange(k) + 0.5) * len(x) / k).astype(int)]]
        for _ in range(ROUNDS):
            label = np.argmax(x @ c.T, axis=1)
            c = np.stack([x[label == k].mean(axis=0) if (label == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        limit = REJECT_SHARE * float(np.quantile((x @ c.T).max(axis=1), 0.01))
        return pa.table({"lang": [table.column("lang")[0].as_py()] * len(c), "limit": [limit] * len(c), "centroid": pa.array([v.astype(np.float32).tobytes() for v in c], pa.binary())})

    hashed = known.withColumn("h", F.xxhash64("doc_id", "text"))
    chosen = stash(first_of_each(hashed.select("lang", "h"), "lang", SAMPLE), "language-sample")
    sample = hashed.join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    fitted = sample.select("lang", "h", "text").mapInArrow(vectors, "lang string, h long, vector binary")
    rows = fitted.groupBy("lang").applyInArrow(cluster, "lang string, limit double, centroid binary").collect()  # CENTROIDS rows for each language
    rows.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    matrix = np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows]) if rows else np.zeros((0, DIMS), np.float32)
    return Model([r["lang"] for r in rows], matrix, np.array([r["limit"] for r in rows]), idf)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(id_remainder("doc_id", FOLDS) != 0)


def _judged(docs: DataFrame, block: Model, columns: list[str]) -> DataFrame:
    """The columns with lang_pred, score, rejected by one block of the model."""
    # Executors get plain values, which need none of this package's classes.
    sent = docs.sparkSession.sparkContext.broadcast(tuple(block))

    def of(batches):
        for batch in batches:
            found = [predict(sent.value, x.as_py()) for x in batch.column("text")]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([bool(f[2]) for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *more], names=[*columns, "lang_pred", "score", "rejected"])

    head = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, *(c for c in ("text",) if c not in columns)).mapInArrow(of, f"{head}, lang_pred string, score double, rejected boolean")


def _best_of_blocks(docs: DataFrame, blocks: list[Model]) -> DataFrame:
    """h, found (lang_pred, score, rejected) for each different (doc_id, text), over all blocks, one pass for each."""
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    each = [stash(_judged(hashed, b, ["h"]).withColumn("block", F.lit(k)), "language-block") for k, b in enumerate(blocks)]
    every = each[0]
    for more in each[1:]:
        every = every.union(more)
    best = F.max_by(F.struct("lang_pred", "score", "rejected"), F.struct("score", -F.col("block")))
    return every.groupBy("h").agg(best.alias("found"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    blocks = model.blocks()
    if len(blocks) == 1:
        return _judged(docs, model, ["doc_id"])
    best = _best_of_blocks(docs, blocks)
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).join(best, "h").select("doc_id", "found.*")


def known_language(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected."""
    blocks = model.blocks()
    if len(blocks) > 1:
        name = new_name(docs, "h")
        good = _best_of_blocks(docs, blocks).filter("not found.rejected").select(F.col("h").alias(name))
        return docs.withColumn(name, F.xxhash64("doc_id", "text")).join(good, name, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array([not predict(sent.value, x.as_py())[2] for x in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit(training_rows(docs)))
    return found.select("doc_id", (id_remainder("doc_id", FOLDS) == 0).alias("held_out"), "lang_pred", "score", "rejected")
