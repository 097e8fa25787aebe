"""Mixing sources to target weights.

The words of a source, its documents in the order of a hash of their ids, are packed into blocks of BLOCK words.
Each output shard draws its source counts from a multinomial over what is still wanted of each source. The slots of
a source are numbered through all shards; slot i takes block p(i mod blocks), where p is a pseudorandom permutation
of that source's block indices (a Feistel network with cycle walking), so a second pass begins only when every block
was taken once. Slots meet blocks, and blocks meet documents, by equi-joins on (source, block). The last slot of a
source is cut so that its words end on the target. mixed_blocks() forms the blocks themselves; mixed_documents() takes
whole documents as often as the blocks take their words, with the parts rounded so that each source keeps its target.

Sources are put, in their order, into GROUPS groups at most (one source each if there are no more), and the draws
are of groups; what a group takes next follows from a pseudorandom permutation of the slots of all its sources. So the
driver holds a row for each group and a driver's row for no single document, however many sources there are.

Defined results: null text has no words, takes nothing and has a row; a null source is a source of its own and comes
last; a source without words has target 0; repeated rows are mixed as rows of their own; rows without an id or with the
id of others likewise; a very long text is laid over many blocks; equal places are ordered by hash; an empty table gives
an empty result; extra columns, whatever their names, are ignored by the query and kept by mixed_documents().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.patterns import WORD, new_name, whole_text
from tidewater.storage import stash

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MAX_REPEAT = 1.5, 2.0
BLOCK = 2048
BUCKETS = 4096
#: Draws are of so many groups of sources and into so many shards at most; slots that one row is expanded to.
GROUPS, MAX_OUT_SHARDS, SLOTS_PER_SHARD, SLOT_ROWS = 1024, 1024, 4096, 1 << 16
#: Steps by which the parts of documents are ordered where whole documents are taken.
LEVELS = 1024
SEED = 20_011
_ROUNDS = 4


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MAX_REPEAT) -> list[float]:
    """Water filling in memory: shares by weight, none above most times its size, the excess shared again."""
    total, scale, full = share * sum(sizes), -1.0, set()
    while True:
        rest = [s for s in range(len(sizes)) if s not in full]
        scale = (total - sum(most * sizes[s] for s in full)) / sum(weights[s] for s in rest) if rest else scale
        now = {s for s in range(len(sizes)) if weights[s] * scale > most * sizes[s]}
        if now == full:
            return [most * n if s in full else weights[s] * scale for s, n in enumerate(sizes)]
        full = now


def _round_keys(source: int) -> list[int]:
    return [(SEED * 0x9E3779B1 + source * 0x85EBCA6B + r * 0xC2B2AE35) & 0xFFFFFFFF for r in range(_ROUNDS)]


def _mix(half: np.ndarray, key: int, mask: int) -> np.ndarray:
    x = (half ^ np.uint64(key)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return (x >> np.uint64(31)) & np.uint64(mask)


def permuted(index: np.ndarray, n: int, source: int, inverse: bool = False) -> np.ndarray:
    """The source's pseudorandom permutation of 0..n-1, applied to an array of indices."""
    half = np.uint64(max(1, math.ceil(math.log2(max(2, n)) / 2)))
    mask, keys = (1 << int(half)) - 1, _round_keys(source)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & np.uint64(mask)
        for key in reversed(keys) if inverse else keys:
            a, b = (b ^ _mix(a, key, mask), a) if inverse else (b, a ^ _mix(b, key, mask))
        return (a << half) | b

    out = once(index.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def slot_count(size: int, want: int, source: int) -> tuple[int, int]:
    """Slots that a source fills for want words, and the words of the last slot if it is cut (else 0)."""
    blocks = -(-size // BLOCK)
    if not want or not blocks:
        return 0, 0
    passes, rest = divmod(want, size)
    last = int(permuted(np.array([blocks - 1]), blocks, source, inverse=True)[0])
    short = size - (blocks - 1) * BLOCK
    if rest <= last * BLOCK:
        full, cut = divmod(rest, BLOCK)
    elif rest < last * BLOCK + short:
        full, cut = last, rest - last * BLOCK
    else:
        full, cut = divmod(rest - last * BLOCK - short, BLOCK)
        full += last + 1
    return passes * blocks + full + (cut > 0), cut


def draws(slots: np.ndarray) -> np.ndarray:
    """(shards, groups): a multinomial draw for each output shard over what each group has left."""
    left = np.array(slots, dtype=np.int64)
    per_shard = max(SLOTS_PER_SHARD, -(-int(left.sum()) // MAX_OUT_SHARDS))
    rng, out = np.random.default_rng(SEED), []
    while total := int(left.sum()):
        n = min(per_shard, total)
        count = np.minimum(rng.multinomial(n, left / total), left)
        for s in np.argsort(count - left, kind="stable"):  # what a drained group could not give
            if not (short := n - int(count.sum())):
                break
            count[s] += min(short, int(left[s] - count[s]))
        out.append(count)
        left = left - count
    return np.array(out, dtype=np.int64).reshape(-1, len(slots))


def _numbered(sources: DataFrame) -> DataFrame:
    """sources(source, ...) with s, their places by code point, null last."""
    ranged = stash(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.withColumn("place", place).join(F.broadcast(parts), "part").withColumn("s", F.col("base") + F.col("place") - 1).drop("part", "place", "base")


def source_plan(sized: DataFrame) -> DataFrame:
    """sized(source, size) -> source, s, source_size, target, blocks, slots, cut: water filling by sums over all sources,
    again until no more sources are full."""
    found = stash(_numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-numbered")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("s") % len(WEIGHTS) + 1).cast("int"))
    most, scale, n_full = MAX_REPEAT * F.col("source_size"), -1.0, -1
    total = SHARE * (found.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = weight * scale > most
        taken, rest, n = found.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, weight)), F.count_if(full)).first()
        if n == n_full:
            break
        scale, n_full = (total - (taken or 0)) / rest if rest else scale, n
    target = F.when(weight * scale > most, most).otherwise(weight * scale)

    def planned(batches):
        for batch in batches:
            size, target, s = (batch.column(c).to_pylist() for c in ("source_size", "target", "s"))
            counts = [slot_count(n, round(t), k) for n, t, k in zip(size, target, s, strict=True)]
            more = [pa.array([-(-n // BLOCK) for n in size], pa.int64()), *(pa.array([c[j] for c in counts], pa.int64()) for j in (0, 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "blocks", "slots", "cut"])

    rows = found.select("source", "s", "source_size", target.cast("double").alias("target"))
    return stash(rows.mapInArrow(planned, "source string, s long, source_size long, target double, blocks long, slots long, cut long"), "mix-plan")


def drawn_slots(plan: DataFrame) -> DataFrame:
    """out_shard, s, source, slot, block, cut (words of a block that is cut): the mix, slot by slot."""
    spark = plan.sparkSession
    n = plan.agg(F.max("s")).first()[0]
    groups = min(GROUPS, 0 if n is None else n + 1)
    grouped = plan.filter("slots > 0").withColumn("g", F.floor(F.col("s") * groups / (0 if n is None else n + 1)).cast("int"))
    ahead = Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    grouped = stash(grouped.withColumn("first", F.coalesce(F.sum("slots").over(ahead), F.lit(0))), "mix-groups")
    held, members = np.zeros(max(1, groups), np.int64), np.zeros(max(1, groups), np.int64)
    for g, slots, count in grouped.groupBy("g").agg(F.sum("slots"), F.count("*")).collect():  # GROUPS rows at most
        held[g], members[g] = slots, count
    sent = spark.sparkContext.broadcast((np.cumsum(draws(held), axis=0), held, members))  # GROUPS * MAX_OUT_SHARDS numbers at most

    def place(batches):
        upto, held, members = sent.value
        for batch in batches:
            s, slot, blocks, g, first = (batch.column(c).to_numpy() for c in ("s", "slot", "blocks", "g", "first"))
            block, turn = np.empty_like(slot), slot.copy()
            for k in np.unique(s):
                at = s == k
                block[at] = permuted(slot[at] % blocks[at][0], int(blocks[at][0]), int(k))
            # A group of several sources is taken in a pseudorandom order of all their slots.
            for k in np.unique(g[members[g] > 1]):
                at = g == k
                turn[at] = permuted(first[at] + slot[at], int(held[k]), int(k), inverse=True)
            shard = np.empty(len(s), np.int32)
            for k in np.unique(g):
                at = g == k
                shard[at] = np.searchsorted(upto[:, k], turn[at], "right")
            yield pa.RecordBatch.from_arrays([pa.array(shard), *(batch.column(c) for c in ("s", "source", "slot")), pa.array(block), batch.column("cut")], names=["out_shard", "s", "source", "slot", "block", "cut"])

    runs = grouped.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOT_ROWS))))
    runs = runs.repartition(F.col("s"), F.col("run"))
    rows = runs.withColumn("slot", F.explode(F.sequence(F.col("run") * SLOT_ROWS, F.least("slots", (F.col("run") + 1) * SLOT_ROWS) - 1)))
    last = F.when((F.col("slot") == F.col("slots") - 1) & (F.col("cut") > 0), F.col("cut"))
    return rows.select("s", "source", "slot", "blocks", "g", "first", last.alias("cut")).mapInArrow(place, "out_shard int, s long, source string, slot long, block long, cut long")


def row_hashes(columns: list[str]) -> tuple[Column, Column]:
    """128 bits of a row."""
    named = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*named), F.xxhash64(F.lit("row"), *named)


def _laid(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, plan). rows: one for each document: doc_id, h1, h2, source, size, s, source_size, target, and the words of
    its source that are its own: start to end."""
    h1, h2 = row_hashes(columns)
    sized = stash(docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"), h1.alias("h1"), h2.alias("h2")), "mix-rows")
    plan = source_plan(sized)
    # Catalyst sends the plan to all tasks only if it is small.
    rows = sized.join(plan.select(F.col("source").alias("named"), "s", "source_size", "target"), F.col("source").eqNullSafe(F.col("named"))).withColumn("bucket", F.pmod("h1", F.lit(BUCKETS)))
    cell = ["s", "bucket"]
    ahead = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(cell).agg(F.sum("size").alias("words")).select(*cell, F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    order = Window.partitionBy(cell).orderBy("h1", "h2", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    laid = rows.withColumns({"upto": F.sum("size").over(order), "ordinal": F.row_number().over(order)}).join(cells, cell)
    ends = {"start": F.col("base") + F.col("upto") - F.col("size"), "end": F.col("base") + F.col("upto")}
    return laid.withColumns(ends).drop("named", "base", "upto"), plan


def mix(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "text")) -> tuple[DataFrame, DataFrame]:
    """(rows, slots). rows: one for each document: doc_id, source, size, source_size, target, taken, h1, h2 (a hash of
    the columns), s (its source's number); slots: out_shard, s, source, slot, block, cut."""
    laid, plan = _laid(docs, list(columns))
    slots = drawn_slots(plan)
    times = slots.groupBy("s", "block").agg(F.count_if(F.col("cut").isNull()).alias("full"), F.coalesce(F.max("cut"), F.lit(0)).alias("part"))
    block_size = F.lit(BLOCK).cast("long")
    touched = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_size), F.floor(F.greatest("start", F.col("end") - 1) / block_size))))
    low = F.greatest(F.col("start"), F.col("block") * block_size)
    within = lambda upto: F.greatest(F.lit(0), F.least(F.col("end"), F.col("block") * block_size + upto) - low)
    took = touched.join(times, ["s", "block"], "left").withColumn("words", F.coalesce("full", F.lit(0)) * within(block_size) + within(F.coalesce("part", F.lit(0))))
    each = took.groupBy("s", "bucket", "ordinal").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target", "h1", "h2")), F.sum("words").alias("taken")
    )
    return each.select("doc_id", "source", "size", "source_size", "target", "taken", "h1", "h2", "s"), slots


def mixed_blocks(docs: DataFrame) -> DataFrame:
    """out_shard, source, slot, block, text: the mix as blocks of BLOCK words, space-joined (the last of a source is
    shorter, and the last slot of a source is cut)."""
    laid, plan = _laid(docs, ["doc_id", "source", "text"])
    h1, h2 = row_hashes(["doc_id", "source", "text"])
    texts = docs.select(h1.alias("h1"), h2.alias("h2"), "text").dropDuplicates(["h1", "h2"])

    def split(batches):
        for batch in batches:
            out = []
            for s, start, text in zip(*(batch.column(c).to_pylist() for c in ("s", "start", "text")), strict=True):
                words, at = text.encode("utf-8", "surrogatepass").split(), 0
                while at < len(words):
                    block = (start + at) // BLOCK
                    upto = min(len(words), (block + 1) * BLOCK - start)
                    out.append((s, block, start + at, b" ".join(words[at:upto]).decode("utf-8", "surrogatepass")))
                    at = upto
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["s", "block", "at", "words"])

    pieces = laid.filter("size > 0").select("h1", "h2", "s", "start").join(texts, ["h1", "h2"]).select("s", "start", "text").mapInArrow(split, "s long, block long, at long, words string")
    blocks = pieces.groupBy("s", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda p: p["words"]), " ").alias("text"))
    found = drawn_slots(plan).join(blocks, ["s", "block"])
    return found.select("out_shard", "source", "slot", "block", F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("cut").cast("int")), " ")).alias("text"))


def copies(rows: DataFrame) -> DataFrame:
    """rows as of mix() -> h1, h2, n (equal rows), copies (of all of them together). Whole copies come first; of what is
    left of each row, those with the largest parts are taken once more, until their source has its words."""
    each = rows.filter("size > 0").groupBy("h1", "h2").agg(F.first("s").alias("s"), F.first("size").alias("size"), F.sum("taken").alias("taken"), F.count("*").alias("n"))
    each = each.withColumn("whole", F.floor(F.col("taken") / F.col("size"))).withColumn("part", F.col("taken") - F.col("whole") * F.col("size"))
    each = stash(each.withColumn("level", F.floor((1 - F.col("part") / F.col("size")) * LEVELS) * 64 + F.pmod("h1", F.lit(64))), "mix-copies")
    some = each.filter("part > 0")
    cell = ["s", "level"]
    ahead = Window.partitionBy("s").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy("s")
    cells = some.groupBy(cell).agg(F.sum("size").alias("words"), F.sum("part").alias("parts"))
    cells = cells.select(*cell, F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"), F.sum("parts").over(all_of).alias("wanted"))
    upto = F.sum("size").over(Window.partitionBy(cell).orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, 0))
    chosen = some.withColumn("upto", upto).join(cells, cell).filter(F.col("base") + F.col("upto") - F.col("size") / 2 <= F.col("wanted")).select("h1", "h2", F.lit(1).alias("more"))
    out = each.join(chosen, ["h1", "h2"], "left")
    return out.select("h1", "h2", "n", (F.col("whole") + F.coalesce("more", F.lit(0))).alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it; the words of each source come within one document of its target.
    Wordless ones are never taken. Equal rows are taken alike, but for what can't be divided among them."""
    rows, _ = mix(docs, tuple(docs.columns))
    a, b, times, n, nth = (new_name(docs, x) for x in ("h1", "h2", "copies", "n", "nth"))
    wanted = stash(copies(rows).filter("copies > 0").select(F.col("h1").alias(a), F.col("h2").alias(b), F.col("copies").alias(times), F.col("n").alias(n)), "mix-wanted")
    h1, h2 = row_hashes(docs.columns)
    keyed = docs.withColumn(a, h1).withColumn(b, h2)
    repeated = lambda found, count: found.withColumn(nth, F.explode(F.sequence(F.lit(1), count.cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
    each, over = F.floor(F.col(times) / F.col(n)), F.col(times) % F.col(n)
    out = repeated(keyed.join(wanted.filter(each > 0), [a, b]), each)
    if wanted.filter(over > 0).limit(1).count():
        out = out.union(repeated(keyed.join(wanted.filter(over > 0), [a, b]).dropDuplicates([a, b]), over))
    return out


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken")
