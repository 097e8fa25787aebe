"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's features are its different words and their prefixes of PREFIXES letters; a
logistic model gives its score, and the document's score is the noisy-or of its sentences: 1 - prod(1 - p). The
weights are trained from document labels alone, on a bounded sample (SAMPLE documents for each label, by the order
of a hash of their ids, as far as their texts together stay within SAMPLE_BYTES); the same weights then point at the
offending sentences.

Defined results: null and wordless texts have no sentence and score 0; without any training document every score is
0; a document with several label rows counts as its largest label; null labels, and labels of rows without an id, are
ignored; of rows that share an id one is learned from; repeated rows score alike; of sentences that score alike the first
is the worst; texts of any length are scored whole, sentence by sentence; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.patterns import first_of_each, id_remainder
from tidewater.storage import stash

#: What one model is fitted on: documents of each label, and bytes of text of each label (no one text more than a 16th).
SAMPLE, SAMPLE_BYTES = 2500, 8 << 20
FOLDS, HELD_OUT = 3, 1
PREFIXES = (4, 5)
SLOTS = 1 << 20
#: A feature is used if it stands in so many documents of the sample.
LEAST_DOCUMENTS = 3
EPOCHS, RATE, DECAY, START = 150, 0.15, 2e-4, -4.0
THRESHOLD, OFFENDING = 0.7, 0.5
_CACHE = 500_000

# Sentence ends become newlines; letters, digits and all bytes of non-ASCII characters stay; anything else parts words.
_BYTES = bytes(10 if b in b"\n.!?" else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def sentences(text: str | None) -> list[list[bytes]]:
    """The words of each sentence; sentences without a word are left out."""
    flat = text.lower().encode("utf-8", "surrogatepass").translate(_BYTES) if text else b""
    return [words for line in flat.split(b"\n") if (words := line.split())]


def features(word: bytes) -> list[int]:
    """Slots of the word and its prefixes (by characters)."""
    letters = word.decode("utf-8", "ignore")
    return [zlib.crc32(word) % SLOTS, *(zlib.crc32(b"%d:" % n + letters[:n].encode()) % SLOTS for n in PREFIXES if len(letters) >= n)]


class Model:
    """Weights by slot. Executors get `state`, plain values, and make a model of their own from it."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    @property
    def state(self) -> tuple[dict[int, float], float]:
        return self.weights, self.bias

    def word(self, word: bytes) -> float:
        if (w := self.known.get(word)) is None:
            if len(self.known) >= _CACHE:
                self.known.clear()
            w = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def scores(self, text: str | None) -> np.ndarray:
        """A score for each sentence."""
        if not self.weights:
            return np.zeros(0)
        known, word = self.known.get, self.word
        z = [sum((w if (w := known(x)) is not None else word(x)) for x in sorted(set(words))) for words in sentences(text)]
        return 1 / (1 + np.exp(-np.clip(np.array(z) + self.bias, -40, 40)))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


def _bags(batches):
    """Each document's label, features and number of features of each sentence."""
    for batch in batches:
        ids, counts = [], []
        for text in batch.column("text"):
            bag = [sorted(f for w in set(words) for f in features(w)) for words in sentences(text.as_py())]
            ids.append([f for s in bag for f in s])
            counts.append([len(s) for s in bag])
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("toxic"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["h", "toxic", "features", "counts"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic): trained on a bounded sample of the labelled documents."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    hashed = known.filter("toxic in (0, 1)").withColumn("h", F.xxhash64("doc_id", F.lit("toxic")))
    chosen = stash(first_of_each(hashed.select("toxic", "h", "doc_id"), "toxic", SAMPLE), "toxicity-sample")
    # 2 * SAMPLE ids at most; rows that repeat an id are put together before they are shuffled.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = found.filter(F.octet_length("text") <= SAMPLE_BYTES // 16).groupBy("toxic", "h").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    sample = stash(sample, "toxicity-texts").withColumn("upto", upto).filter(F.col("upto") <= SAMPLE_BYTES)
    table = sample.select("h", "toxic", "text").mapInArrow(_bags, "h long, toxic int, features array<int>, counts array<int>").toArrow()
    table = table.filter(pa.compute.greater(pa.compute.list_value_length(table["counts"]), 0)).sort_by([("h", "ascending"), ("toxic", "ascending")])
    if len(set(table["toxic"].to_pylist())) < 2:
        return Model({}, START)
    y = table["toxic"].to_numpy().astype(bool)
    flat = table["features"].combine_chunks().flatten().to_numpy()
    per_sentence = table["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
    n_sentences = pa.compute.list_value_length(table["counts"]).to_numpy().astype(np.int64)
    del table
    sentence_doc = np.repeat(np.arange(len(y)), n_sentences)
    sentence = np.repeat(np.arange(len(per_sentence)), per_sentence)
    pairs = np.unique(sentence_doc[sentence] * SLOTS + flat)
    used = np.flatnonzero(np.bincount(pairs % SLOTS, minlength=SLOTS) >= LEAST_DOCUMENTS)
    del pairs
    column = np.full(SLOTS, -1, np.int32)
    column[used] = np.arange(len(used))
    keep = column[flat] >= 0
    sentence, feature = sentence[keep], column[flat][keep]
    return _train(y, sentence_doc, sentence, feature, used)


def _train(y, sentence_doc, sentence, feature, used) -> Model:
    """Adam on the noisy-or likelihood; labels weigh alike."""
    w, bias = np.zeros(len(used) + 1), len(used)
    w[bias] = START
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    for t in range(1, EPOCHS + 1):
        z = np.bincount(sentence, w[feature], minlength=len(sentence_doc)) + w[bias]
        total = np.bincount(sentence_doc, np.logaddexp(0, z), minlength=len(y))  # -log(1 - score)
        slope = weight * np.where(y, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0)
        d = slope[sentence_doc] / (1 + np.exp(-np.clip(z, -40, 40)))
        g = np.append(np.bincount(feature, d[sentence], minlength=len(used)), d.sum())
        g[:bias] += DECAY * w[:bias]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model({int(s): float(x) for s, x in zip(used, w[:bias], strict=True) if abs(x) > 1e-3}, float(w[bias]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, worst_sentence (0-based, null if there is none), n_offending."""
    sent = docs.sparkSession.sparkContext.broadcast(model.state)

    def of(batches):
        model = Model(*sent.value)
        for batch in batches:
            found = [model.scores(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([noisy_or(p) for p in found], pa.float64()),
                    pa.array([int(np.argmax(p)) if len(p) else None for p in found], pa.int64()),
                    pa.array([int((p >= OFFENDING).sum()) for p in found], pa.int64()),
                ],
                names=["doc_id", "score", "worst_sentence", "n_offending"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, score double, worst_sentence long, n_offending long")


def offending_sentences(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, sentence (0-based), score, words (lower-cased, space-joined) of each sentence that scores OFFENDING or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model.state)

    def of(batches):
        model = Model(*sent.value)
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column("text").to_pylist()):
                p = model.scores(text)
                bag = sentences(text) if (p >= OFFENDING).any() else []
                rows += [(k, int(s), float(p[s]), b" ".join(bag[s]).decode("utf-8", "replace")) for s in np.flatnonzero(p >= OFFENDING)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.string())],
                names=["doc_id", "sentence", "score", "words"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, sentence long, score double, words string")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(id_remainder("doc_id", FOLDS) != HELD_OUT)
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_sentence", "n_offending")
