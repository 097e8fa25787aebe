"""SimHash near duplicates by meet-in-the-middle ball hashing, radius 3.

Every distinct fingerprint emits all variants within half the radius, variants are shuffled, and fingerprints that
meet on a variant are linked. As the radius is odd, one side has to go a bit further: fingerprints with an even
number of ones also emit variants with two flipped bits, those in the same half of the fingerprint only, since of
three differing bits two are always in one half. (Distance 1 or 3 changes the parity; at distance 2 both sides flip
one bit.) So an even fingerprint emits 1 + 64 + 992 variants and an odd one 64, whatever the size of the corpus.

All that meet on a variant are within the radius of any of them that flipped at most one bit, so a star around such
a one stands for all their pairs: a group of any size costs no more than its variants. Copies have one fingerprint
and are put together before. Variants travel packed, 10 bytes each, in one blob for each bucket and batch.

Defined results: null and wordless texts have fingerprint zero and are linked like any other; repeated rows fall into
one component; component ids are the smallest doc_id (nulls last); an empty table gives an empty result; extra
columns are ignored. near_text.py applies the same method to texts that are similar rather than nearly equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.storage import stash

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Variants that a bucket holds on average (a bucket is read by one task), fingerprints that a task expands, and those
#: it expands at once. Tasks and buckets follow the number of fingerprints, so each blob is of about the same size.
BUCKET_ROWS, TASK_FINGERPRINTS, EXPAND = 1_000_000, 8192, 512
_CHUNK = 1 << 15


def _masks() -> np.ndarray:
    one = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    i, j = np.triu_indices(32, 1)
    low = one[i] | one[j]
    return np.concatenate([np.zeros(1, np.uint64), one, low, low << np.uint64(32)])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    pieces = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in pieces), np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        part = hashes[k : k + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long: the 64 bits of the fingerprint)."""

    def of(batches):
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(of, f"doc_id {kind}, fp long")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """distinct(fp) -> links(a, b) between fingerprints within the radius; a spanning set, not all pairs."""
    n, per_fp = distinct.count(), 561  # variants on average
    buckets, tasks = max(1, -(-n * per_fp // BUCKET_ROWS)), max(1, -(-n // TASK_FINGERPRINTS))

    def emit(batches):
        masks = _masks()
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            odd = (np.bitwise_count(every) & 1).astype(bool)
            for fps, first, upto in ((every[~odd], 0, len(masks)), (every[odd], 1, 65)):
                step = EXPAND * 16 if upto == 65 else EXPAND
                for k in range(0, len(fps), step):
                    variant = (fps[k : k + step, None] ^ masks[None, first:upto]).ravel()
                    flip = np.tile(np.arange(first, upto, dtype=np.uint16), len(fps[k : k + step]))
                    bucket = ((variant * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
                    order = np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable")
                    variant, flip, bucket = variant[order], flip[order], bucket[order]
                    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                    ends = [*starts[1:].tolist(), len(bucket)]
                    cut = list(zip(starts.tolist(), ends, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket[starts]), pa.array([variant[a:b].tobytes() for a, b in cut]), pa.array([flip[a:b].tobytes() for a, b in cut])],
                        names=["bucket", "variants", "flips"],
                    )

    def meet(batches):
        # One bucket in all its batches.
        masks, variants, flips = _masks(), [], []
        for batch in batches:
            variants += [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("variants")]
            flips += [np.frombuffer(x.as_py(), np.uint16) for x in batch.column("flips")]
        variant, flip = np.concatenate(variants), np.concatenate(flips)
        order = np.argsort(variant)
        same = variant[order][1:] == variant[order][:-1]
        met = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        variant, flip = variant[met], flip[met]
        order = np.lexsort((flip, variant))
        variant, flip = variant[order], flip[order]
        fps = variant ^ masks[flip]
        head = np.maximum.accumulate(np.where(np.concatenate([[True], variant[1:] != variant[:-1]])[: len(variant)], np.arange(len(variant)), 0))
        near = (flip[head] <= 64) & (np.bitwise_count(fps ^ fps[head]) <= RADIUS) & (fps != fps[head])
        pair = np.unique(np.stack([fps[head][near], fps[near]], axis=1), axis=0) if near.any() else np.zeros((0, 2), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy().view(np.int64)), pa.array(pair[:, 1].copy().view(np.int64))], names=["a", "b"])

    def group(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(meet(table.to_batches())))

    blobs = distinct.select("fp").repartition(tasks).mapInArrow(emit, "bucket long, variants binary, flips binary")
    return blobs.groupBy("bucket").applyInArrow(group, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id."""
    each = stash(fingerprints(docs), "fingerprints")
    distinct = stash(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints-distinct")
    roots = stash(components(fingerprint_links(distinct)), "fingerprint-roots")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return each.join(stash(classes, "fingerprint-classes"), "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
