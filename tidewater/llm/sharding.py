"""Sharding by minimax contiguous partition.

Atomic groups (here: equal texts) stand in the order of their md5 key. The smallest shard capacity for which a
greedy sweep needs no more than the wanted number of shards is found by binary search, and the cuts are made for
that capacity. Only a histogram of group sizes reaches the driver: a segment of the key order counts first by its
three leading hex digits, and the few segments in which a cut can fall are split by two more digits until the
answer is exact. Memory on the driver depends on the number of shards, not on the number of groups.

Defined results: null text counts as the empty text (size 1, crc32 0); equal texts, however many, stay in one shard
(so a shard with a huge group is as large as that group); an empty table gives an empty result; repeated rows each
get a slot of their own; extra columns are ignored; with fewer groups than shards some shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.patterns import whole_text
from tidewater.storage import stash

N_SHARDS = 16
FIRST_DIGITS, MORE_DIGITS, KEY_DIGITS = 3, 2, 32
#: Rows are numbered in cells of (two key digits, salt), so that a group of any size is spread over SALTS cells.
SALTS = 256


class _Segments:
    """Consecutive runs of the key order: bytes, number of groups, first key; greedy sweeps over them."""

    def __init__(self, rows: list[tuple[str, int, int, int, str]]):
        self.rows = sorted(rows)
        self.ends = list(accumulate(r[1] for r in self.rows))
        self.starts = [0, *self.ends[:-1]] if self.rows else []
        self.total = self.ends[-1] if self.rows else 0
        self.largest = max((r[3] for r in self.rows), default=0)

    def whole(self, capacity: int, shards: int) -> list[int] | None:
        """Cut positions (in segments) of a greedy sweep that keeps segments whole; None if it needs more shards."""
        cuts, at = [0], 0
        for _ in range(shards):
            if at == len(self.rows):
                break
            reach = bisect_right(self.ends, self.starts[at] + capacity)
            if reach == at:
                return None
            at = reach
            cuts.append(at)
        return cuts if at == len(self.rows) else None

    def reach(self, capacity: int, shards: int, upper: bool) -> list[int]:
        """Byte positions that each cut of a sweep can't pass (upper) or surely reaches (not upper)."""
        out, at = [], 0
        for _ in range(shards):
            to = at + capacity
            if to >= self.total:
                out.append(self.total)
                at = self.total
                continue
            k = bisect_right(self.ends, to)
            if not upper or self.rows[k][2] == 1:
                to = max(at, self.starts[k])
            at = to
            out.append(at)
        return out

    def smallest(self, feasible, low: int) -> int:
        high = max(low, self.total)
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if feasible(middle) else (middle + 1, high)
        return low


def _histogram(groups: DataFrame, digits: int, within: list[str] | None) -> list[tuple[str, int, int, int, str]]:
    if within is not None:
        groups = groups.filter(F.substring("key", 1, digits - MORE_DIGITS).isin(within))
    rows = groups.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("bytes").alias("largest"), F.min("key").alias("first")
    )
    return [tuple(r) for r in rows.collect()]


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[str]]:
    """groups(key: 32 hex digits, bytes > 0) in key order: the smallest capacity, and the first keys of shards 1, 2, ..."""
    seg = _Segments(_histogram(groups, FIRST_DIGITS, None))
    if not seg.rows:
        return 0, []
    while True:
        least = max(-(-seg.total // n_shards), seg.largest)
        low = seg.smallest(lambda c: seg.reach(c, n_shards, True)[-1] >= seg.total, least)
        high = seg.smallest(lambda c: seg.whole(c, n_shards) is not None, least)
        open_ = [r[0] for r in seg.rows if r[2] > 1 and r[1] * 8 > low]
        if not open_ and low < high:
            spans = zip(seg.reach(low, n_shards, False), seg.reach(high, n_shards, True), strict=True)
            hit = {k for a, b in spans for k in range(bisect_right(seg.ends, a), min(bisect_left(seg.starts, b) + 1, len(seg.rows)))}
            open_ = [seg.rows[k][0] for k in sorted(hit) if seg.rows[k][2] > 1]
        if not open_:
            break
        split: dict[int, list[str]] = {}
        for prefix in open_:
            split.setdefault(len(prefix), []).append(prefix)
        rows = [r for r in seg.rows if r[0] not in set(open_)]
        for digits, prefixes in split.items():
            rows += _histogram(groups, min(KEY_DIGITS, digits + MORE_DIGITS), prefixes)
        seg = _Segments(rows)
    return high, _level(seg, high, n_shards)


def _level(seg: _Segments, capacity: int, n_shards: int) -> list[str]:
    """Cuts of equal count as near as may be to equal shares, none above the capacity."""
    back, at = [len(seg.rows)], len(seg.rows)
    for _ in range(n_shards):  # least position of each cut from which the rest still fits
        at = bisect_left(seg.starts, seg.ends[at - 1] - capacity) if at else 0
        back.append(at)
    back = back[::-1]
    cuts, at = [], 0
    for j in range(1, n_shards):
        here = seg.starts[at] if at < len(seg.rows) else seg.total
        want = here + (seg.total - here) / (n_shards - j + 1)
        k = bisect_left(seg.ends, want)
        if k < len(seg.rows) and (k < at or seg.ends[k] - want <= want - seg.starts[k]):
            k += 1
        k = min(max(k, back[j], at), bisect_right(seg.ends, here + capacity))
        if k < len(seg.rows):
            cuts.append(seg.rows[k][4])
        at = k
    return cuts


def _placed(rows: DataFrame, n_shards: int) -> DataFrame:
    """rows(..., doc_id, size, key) with shard and slot."""
    groups = stash(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    _, cuts = minimax_cuts(groups, n_shards)
    shard = sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    cell = ["shard", "digits", "salt"]
    rows = rows.withColumns({"shard": shard.cast("int"), "digits": F.substring("key", 1, 2), "salt": F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(SALTS))})
    before = Window.partitionBy("shard").orderBy("digits", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(cell).agg(F.count("*").alias("n")).select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = rows.withColumn("rn", F.row_number().over(Window.partitionBy(cell).orderBy("key", "doc_id", "size")))
    return numbered.join(cells, cell).withColumn("slot", F.col("base") + F.col("rn") - 1).drop("digits", "salt", "rn", "base")


def _thin(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, key, shard, slot: equal texts together, bytes of the largest shard as few as can be."""
    return _placed(stash(_thin(docs), "shard-rows"), n_shards)


def placed_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The documents, all their columns and texts, with size, text_crc32, shard and slot."""
    text = whole_text()
    thin = ((F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("key"))
    whole = F.struct(*(c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot"))).alias("document")
    return _placed(docs.select("doc_id", *thin, whole), n_shards).select("document.*", "size", "text_crc32", "shard", "slot")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
