"""Removal of repeated 200-byte strings by distributed prefix doubling.

Ranks of positions at growing lengths are what prefix doubling sorts; here the rank of a position at a length is a
64-bit fingerprint made from the two fingerprints of half that length (1, 2, 4, 8, 16, 32, 50, 100, 200 bytes), so
levels are computed inside each text and Spark groups (rank, position) pairs only where that can decide something:

1. At 50 bytes: only anchors, positions whose fingerprint is the smallest of the 151 in some 200-byte string. The
   same string has the same anchors wherever it stands, so no repeat is lost. Anchors with a unique rank are done.
2. At up to 350 bytes: the strings of 200 bytes around an anchor together. If an anchor's surroundings occur twice,
   all of them do, and the anchor is done.
3. At 200 bytes: of what is left, one for each different surroundings, every position is ranked by itself.

A group of any size costs one row for each task or slice, or is spread by its members' own joins; texts travel
compressed, and only to where their rows are asked for.

Defined results: null text counts as empty; texts under LENGTH bytes keep everything; of strings that occur twice
all copies go, the first included; repeated rows repeat each other, as do rows without an id; a text of any length is
ranked whole, piece by piece; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.patterns import whole_text
from tidewater.storage import release, stash

LENGTH, GRAM = 200, 50
REACH = LENGTH - GRAM
#: Bytes of text that are ranked at once; those that one slice of level 3 holds; those whose ranks meet in a bucket.
_PIECE, _SLICE, BUCKET_BYTES = 1 << 21, 1 << 20, 8 << 20
#: A rank at GRAM bytes is hot if it is more than one in so many of those that repeat (so fewer than HOT are).
HOT = 20_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = b >> np.uint64(31)
    x += b * _B
    x ^= a * _A
    x ^= x >> np.uint64(30)
    x *= _C
    x ^= x >> np.uint64(29)
    return x


def ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the strings of GRAM and of LENGTH bytes from each position."""
    x = (data.astype(np.uint64) + np.uint64(1)) * _A
    gram = None
    for step in (1, 2, 4, 8, 16, 18, 50, 100):
        if step == 50:
            gram = x
        x = _pair(x[:-step], x[step:]) if len(x) > step else x[:0]
    return gram, x


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x, have = of(x[:-have], x[have:]), 2 * have
    return of(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(gram: np.ndarray) -> np.ndarray:
    """Positions whose rank is the smallest in some run of REACH + 1 positions."""
    least = _sliding(gram, REACH + 1, np.minimum)
    padded = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    return np.flatnonzero(_sliding(padded, REACH + 1, np.maximum) == gram)


def _pieces(n: int):
    """(first, last, from, to): positions first..last are decided by the bytes from..to."""
    for first in range(0, n, _PIECE):
        last = min(n, first + _PIECE)
        yield first, last, max(0, first - LENGTH), min(n, last + 2 * LENGTH)


def anchor_rows(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank at GRAM bytes, rank of the surroundings, and place (position << 16 | bytes left << 8 | bytes right)."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    n = len(data)
    for first, last, a, b in _pieces(n) if n >= LENGTH else ():
        gram, whole = ranks(np.frombuffer(data, np.uint8, b - a, a))
        p = anchors(gram) + a
        p = p[(p >= first) & (p < last)]
        left, right = np.minimum(REACH, p), np.minimum(REACH, n - GRAM - p)
        around = _pair(whole[p - left - a], whole[p + right - REACH - a]) + (left * 256 + right).astype(np.uint64) * _B
        out.append((gram[p - a], around, (p << 16) | (left << 8) | right))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _grams_only(batches):
    for batch in batches:
        grams = [anchor_rows(_data(x.as_py()))[0] for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64) if grams else [], pa.int64())], names=["g"])


def _anchors(batches):
    for batch in batches:
        found = [anchor_rows(_data(x.as_py())) for x in batch.column("text")]
        rid = np.repeat(batch.column("rid").to_numpy(zero_copy_only=False), [len(f[0]) for f in found])
        g, c, at = (np.concatenate([f[k] for f in found]) for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(rid), pa.array(at)], names=["g", "c", "rid", "at"])


def _packed(batches):
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = pa.array([press.compress(_data(x.as_py())) for x in batch.column("text")], pa.binary())
        names = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), texts], names=[*names, "packed"])


def _unpacked(blob: bytes) -> bytes:
    return zstandard.decompress(blob) if blob else b""


def _positions(requests: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions asked for, and whether each is known to repeat. A request: place << 1 | known."""
    r = np.array(requests, np.int64)
    known, left, right, p = r & 1, (r >> 9) & 255, (r >> 1) & 255, r >> 17
    marks = np.zeros((2, n + 1), np.int64)
    for k in (0, 1):
        some = known == k
        np.add.at(marks[k], (p - left)[some], 1)
        np.add.at(marks[k], (p + right - REACH + 1)[some], -1)
    asked, sure = np.cumsum(marks, axis=1)[:, :n] > 0
    at = np.flatnonzero(asked | sure)
    return at, sure[at]


def _runs(ids: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Positions ordered by text: the texts' ids, how many positions each has, and the steps between positions."""
    docs, counts = np.unique(doc, return_counts=True)
    steps = np.diff(at.astype(np.int32), prepend=np.int32(0))
    return ids[docs].tobytes(), counts.astype(np.uint32).tobytes(), zstandard.compress(steps.tobytes(), 1)


def _read_runs(rids: bytes, counts: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.frombuffer(rids, np.int64), np.frombuffer(counts, np.uint32))
    return owner, np.cumsum(np.frombuffer(zstandard.decompress(at), np.int32), dtype=np.int64).astype(np.uint32)


def _fine(buckets: int, hot):
    """Level 3, sending: the ranks at LENGTH of the positions asked for, packed by bucket; each rank once a slice. The
    bucket follows from the smallest rank at GRAM within the string, which equal strings and most neighbours share; where
    that is one of the hot ones (a line that is everywhere, say), from the rank at LENGTH itself."""

    def pack(rids, ranks_, least, places, sure):
        doc = np.repeat(np.arange(len(rids), dtype=np.uint32), [len(x) for x in places])
        rank, p, sure = np.concatenate(ranks_), np.concatenate(places).astype(np.uint32), np.concatenate(sure)
        distinct, head, which, times = np.unique(rank, return_index=True, return_inverse=True, return_counts=True)
        any_sure = np.zeros(len(distinct), bool)
        np.logical_or.at(any_sure, which, sure)
        repeats = (times > 1) | any_sure
        done = np.flatnonzero(repeats[which] & ~sure)
        near, spread = np.concatenate(least)[head], hot.value
        at = np.minimum(np.searchsorted(spread, near), max(0, len(spread) - 1))
        near = np.where(spread[at] == near, distinct, near) if len(spread) else near
        bucket = (((near * _A) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        owner, place = doc[head], p[head]
        order = np.lexsort((place, owner, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = {k: [] for k in ("bucket", "rids", "counts", "ranks", "at", "repeats", "done_rids", "done_counts", "done_at")}
        ids = np.array(rids, np.int64)
        home = int(ids[0] % buckets)  # of what this slice has decided itself
        for k in range(buckets):
            e, d = order[cuts[k] : cuts[k + 1]], done if k == home else done[:0]
            if len(e) or len(d):
                row = (k, *_runs(ids, owner[e], place[e]), distinct[e].tobytes(), np.packbits(repeats[e]).tobytes(), *_runs(ids, doc[d], p[d]))
                for column, v in zip(("bucket", "rids", "counts", "at", "ranks", "repeats", "done_rids", "done_counts", "done_at"), row, strict=True):
                    out[column].append(v)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == "bucket" else pa.binary()) for k, v in out.items()], names=list(out))

    def send(batches):
        held, size = ([], [], [], [], []), 0
        for batch in batches:
            for rid, blob, asked in zip(batch.column("rid").to_pylist(), batch.column("packed"), batch.column("asked").to_pylist(), strict=True):
                data = _unpacked(blob.as_py())
                at, sure = _positions(asked, len(data))
                rank, least = np.zeros((2, len(at)), np.uint64)
                for first, last, a, b in _pieces(len(data)):
                    if (some := (at >= first) & (at < last)).any():
                        gram, whole = ranks(np.frombuffer(data, np.uint8, b - a, a))
                        rank[some], least[some] = whole[at[some] - a], _sliding(gram, REACH + 1, np.minimum)[at[some] - a]
                for store, x in zip(held, (rid, rank, least, at, sure), strict=True):
                    store.append(x)
                size += len(at)
                if size >= _SLICE:
                    yield pack(*held)
                    held, size = ([], [], [], [], []), 0
        if size:
            yield pack(*held)

    return send


def _meet(table: pa.Table) -> pa.Table:
    """Level 3, one bucket: the positions that repeat, one row for each text."""
    rows = table.to_pylist()
    owner, at = (np.concatenate(x) for x in zip(*(_read_runs(r["rids"], r["counts"], r["at"]) for r in rows), strict=True))
    done_owner, done_at = (np.concatenate(x) for x in zip(*(_read_runs(r["done_rids"], r["done_counts"], r["done_at"]) for r in rows), strict=True))
    rank = np.concatenate([np.frombuffer(r["ranks"], np.uint64) for r in rows])
    repeats = np.concatenate([np.unpackbits(np.frombuffer(r["repeats"], np.uint8), count=len(r["ranks"]) // 8) for r in rows]).astype(bool)
    _, which, times = np.unique(rank, return_inverse=True, return_counts=True)
    here = repeats | (times[which] > 1)
    owner, at = np.concatenate([owner[here], done_owner]), np.concatenate([at[here], done_at])
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    ends = [*cuts[1:].tolist(), len(owner)]
    return pa.table({"rid": pa.array(owner[cuts]), "at": pa.array([at[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=False)], pa.binary())})


def _cut(batches):
    """Each text without the strings found: lengths, runs, hash of what is left."""
    for batch in batches:
        out = []
        for blob, around, fine in zip(batch.column("packed").to_pylist(), batch.column("around").to_pylist(), batch.column("fine").to_pylist(), strict=True):
            data = _unpacked(blob)
            marks = np.zeros(len(data) + 1, np.int64)
            if around:
                r = np.array(around, np.int64)
                np.add.at(marks, (r >> 16) - ((r >> 8) & 255), 1)
                np.add.at(marks, (r >> 16) + GRAM + (r & 255), -1)
            for x in fine or ():
                p = np.frombuffer(x, np.uint32).astype(np.int64)
                np.add.at(marks, p, 1)
                np.add.at(marks, p + LENGTH, -1)
            gone = np.cumsum(marks)[:-1] > 0
            spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left)."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    long_ = rows.filter(F.octet_length("text") >= LENGTH).select("rid", "text")
    # Level 1.
    # Written first, so that the join below is of two plain shuffles, which Spark can split where a rank is hot.
    twice = long_.select("text").mapInArrow(_grams_only, "g long").groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    twice = stash(twice, "grams")
    total = twice.agg(F.sum("n")).first()[0] or 0
    hot = np.sort(twice.filter(F.col("n") * HOT > total).select("g").toArrow().column("g").to_numpy().view(np.uint64))  # HOT rows at most
    hot = docs.sparkSession.sparkContext.broadcast(hot)
    left = stash(long_.mapInArrow(_anchors, "g long, c long, rid long, at long").join(twice.select("g"), "g"), "anchors")
    release(docs.sparkSession, twice)
    # Level 2.
    around = stash(left.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("one")), "surroundings")
    release(docs.sparkSession)
    whole = left.join(around.filter("n > 1").select("g", "c"), ["g", "c"]).groupBy("rid").agg(F.collect_list("at").alias("around"))
    mixed = stash(around.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g"), "mixed-surroundings")
    known = F.when(F.col("n") > 1, 1).otherwise(0)
    asked = around.join(mixed, "g").select("one.rid", F.shiftleft("one.at", 1).bitwiseOR(known).alias("at")).groupBy("rid").agg(F.collect_list("at").alias("asked"))
    whole, asked = stash(whole, "repeats-around"), stash(asked, "asked")
    release(docs.sparkSession, left, around, mixed)
    # Level 3.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = long_.mapInArrow(_packed, "rid long, packed binary").join(asked, "rid").mapInArrow(_fine(buckets, hot), "bucket long, rids binary, counts binary, ranks binary, at binary, repeats binary, done_rids binary, done_counts binary, done_at binary")
    fine = sent.groupBy("bucket").applyInArrow(_meet, "rid long, at binary").groupBy("rid").agg(F.collect_list("at").alias("fine"))
    found = stash(whole.join(fine, "rid", "full"), "repeats")
    release(docs.sparkSession, whole, asked)
    packed = rows.select("doc_id", "rid", "text").mapInArrow(_packed, f"doc_id {kind}, rid long, packed binary")
    return packed.join(found, "rid", "left").mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
