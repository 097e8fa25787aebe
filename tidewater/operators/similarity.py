"""Near-duplicate clusters by MinHash signatures in bands, in order of arrival; and hashing embeddings."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import fold, folded_tokens, shingles
from tidewater.storage import stash

# Signature length, shingle size, threshold, modulus and seed.
PERMUTATIONS, SHINGLE, THRESHOLD = 128, 3, 0.7
PRIME, SEED = (1 << 61) - 1, 12345
DIMENSIONS, GRAMS = 256, (2, 3, 4)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(SEED)
    pairs = [(rng.randrange(1, PRIME), rng.randrange(0, PRIME)) for _ in range(PERMUTATIONS)]
    return tuple(np.array(x, np.uint64) for x in zip(*pairs, strict=True))


def _modulo(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def signature(tokens: list[str]) -> np.ndarray:
    """min over shingles of (a * crc32 + b) mod 2**61 - 1, exactly, with a split into 32-bit halves."""
    runs = {" ".join(tokens[k : k + SHINGLE]) for k in range(max(1, len(tokens) - SHINGLE + 1))} if tokens else set()
    out = np.full(PERMUTATIONS, PRIME, np.uint64)
    a, b = _coefficients()
    high, low = a >> np.uint64(32), a & np.uint64(0xFFFFFFFF)
    hashes = np.array([zlib.crc32(r.encode()) for r in runs], np.uint64)
    for k in range(0, len(hashes), 2048):
        h = hashes[k : k + 2048, None]
        top = _modulo(high * h)  # below 2**61; times 2**32 mod the prime: its bits wrap at 61
        top = _modulo(((top & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (top >> np.uint64(29)))
        out = np.minimum(out, _modulo(_modulo(top + _modulo(low * h)) + b).min(axis=0))
    return out


def signatures(articles: DataFrame) -> DataFrame:
    """article_id, signature (128 longs as bytes)."""

    def of(batches):
        for batch in batches:
            rows = [signature(t).tobytes() for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("article_id"), pa.array(rows, pa.binary())], names=["article_id", "signature"])

    text = F.concat_ws("\n", "title", "body")
    return articles.select("article_id", folded_tokens(text).alias("t")).mapInArrow(of, f"article_id {articles.schema['article_id'].dataType.simpleString()}, signature binary")


def bands_for(threshold: float = THRESHOLD, permutations: int = PERMUTATIONS) -> int:
    """The number of bands whose curve is steepest nearest to the threshold, at (1 / bands) ** (bands / permutations)."""
    whole = [b for b in range(1, permutations + 1) if permutations % b == 0]
    return min(whole, key=lambda b: abs(b ** (-b / permutations) - threshold))


def band_keys(classes: DataFrame, bands: int) -> DataFrame:
    """classes(signature, ...) with a row for each band: band, key."""
    width = 8 * PERMUTATIONS // bands
    each = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(k.alias("band"), F.substring("signature", F.lit(1) + k * width, F.lit(width)).alias("key")))).alias("b")
    return classes.select(*classes.columns, each).select(*classes.columns, "b.*")


def similar_classes(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """classes(leader, signature, n) -> leader, parent, sim, links: for each bucket of a band and each class in it, the
    earlier class most like it and the articles of all classes that it links to. A pair is counted in the first band
    that it shares, so the sum of links over the buckets is that of different articles."""
    bands = bands_for(threshold)
    buckets = band_keys(classes.select("leader", "signature", "n"), bands)

    def best(t: pa.Table) -> pa.Table:
        t = t.sort_by("leader")
        ids, n, band = t.column("leader").to_numpy(), t.column("n").to_numpy(), t.column("band")[0].as_py()
        sig = np.stack([np.frombuffer(s, np.uint64) for s in t.column("signature").to_pylist()])
        cut = sig.reshape(len(sig), bands, -1)
        parents, sims, links = np.full(len(ids), -1, np.int64), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for k in range(1, len(ids)):
            same = (sig[:k] == sig[k]).mean(axis=1)
            at = int(np.argmax(same))
            parents[k], sims[k] = ids[at], same[at]
            linked = np.flatnonzero(same >= threshold)
            linked = linked[np.argmax((cut[linked] == cut[k]).all(axis=2), axis=1) == band]
            links[k] += n[linked].sum()
            links[linked] += n[k]
        near = sims >= threshold
        some = near | (links > 0)
        return pa.table({"leader": ids[some], "parent": pa.array(parents[some], mask=~near[some]), "sim": pa.array(sims[some], mask=~near[some]), "links": links[some]})

    crowded = buckets.groupBy("band", "key").agg(F.count("*").alias("m")).filter("m > 1").select("band", "key")
    return buckets.join(crowded, ["band", "key"]).groupBy("band", "key").applyInArrow(best, "leader long, parent long, sim double, links long")


def clusters(articles: DataFrame, threshold: float = THRESHOLD, known: DataFrame | None = None) -> DataFrame:
    """article_id, cluster_id, parent_id, n_links: in order of ids each article joins the cluster of the earlier article
    most like it (the smallest id at ties) if that shares a band and reaches the threshold; else it opens its own.
    n_links: all other articles that share a band and reach it. Articles in known(article_id, cluster_id) keep the cluster
    they have, whatever else came or went.

    Equal signatures are one class, led by their smallest id. A bucket of classes gives one row for each member, its
    best earlier one, so no pairs are made; chains of parents are followed by doubling."""
    signed = stash(signatures(articles), "signatures")
    leaders = stash(signed.groupBy("signature").agg(F.min("article_id").alias("leader"), F.count("*").alias("n")), "signature-classes")
    found = similar_classes(leaders, threshold)
    parent = found.groupBy("leader").agg(F.max_by("parent", F.when(F.col("parent").isNotNull(), F.struct("sim", -F.col("parent")))).alias("parent"), F.sum("links").alias("links"))
    rows = leaders.join(parent, "leader", "left").select("leader", "parent", F.coalesce("links", F.lit(0)).alias("links"))
    none = articles.sparkSession.createDataFrame([], "article_id long, cluster_id long")
    kept = (none if known is None else known).select(F.col("article_id").alias("leader"), F.col("cluster_id").alias("kept"))
    rows = rows.join(kept, "leader", "left")
    # root: where the chain of parents has come to; label: the cluster, once it is known.
    own = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("parent").isNull(), F.col("leader"))
    forest = stash(rows.select("leader", F.coalesce("parent", "leader").alias("root"), F.coalesce("parent", "leader").alias("parent"), "links", own.alias("label")), "forest")
    while True:
        up = forest.select(F.col("leader").alias("root"), F.col("root").alias("above"), F.col("label").alias("above_label"))
        forest = stash(forest.join(up, "root").select("leader", F.col("above").alias("root"), "parent", "links", F.coalesce("label", "above_label").alias("label")), "forest")
        if forest.filter("label is null").limit(1).count() == 0:
            break
    classes = leaders.join(forest, "leader").select("signature", "leader", "label", "parent", "links", "n")
    parent_id = F.when(F.col("article_id") == F.col("leader"), F.col("parent")).otherwise(F.col("leader"))
    out = signed.join(classes, "signature").select("article_id", F.col("label").alias("cluster_id"), parent_id.alias("parent_id"), (F.col("links") + F.col("n") - 1).alias("n_links"))
    if known is None:
        return out
    mine = known.select("article_id", F.col("cluster_id").alias("kept"))
    return out.join(mine, "article_id", "left").select("article_id", F.coalesce("kept", "cluster_id").alias("cluster_id"), "parent_id", "n_links")


def jaccard_pairs(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """texts(article_id, text) -> id_a, id_b, jaccard: pairs of different sets of shingles whose exact similarity reaches the
    threshold, each set named by its smallest article. A set is joined by its prefix only, its rarest shingles, so many
    that two sets as similar as that share one of them; sets without a shingle have no partner."""
    sets = texts.select("article_id", F.array_sort(shingles(F.col("text"), SHINGLE)).alias("g")).filter(F.size("g") > 0)
    classes = stash(sets.groupBy(F.md5(F.array_join("g", "\n")).alias("k")).agg(F.min("article_id").alias("id"), F.first("g").alias("g")).drop("k"), "shingle-sets")
    each = classes.select("id", F.size("g").alias("n"), F.explode("g").alias("h"))
    rare = each.groupBy("h").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "h")  # the shingles of one text
    prefix = stash(each.join(rare, "h").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1).filter("df > 1").select("id", "n", "h"), "shingle-prefixes")
    a, b = (prefix.select(F.col("id").alias(f"id_{x}"), F.col("n").alias(f"n_{x}"), "h") for x in "ab")
    near = a.join(b, "h").filter((F.col("id_a") < F.col("id_b")) & (F.col("n_a") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n_a"))).select("id_a", "id_b").distinct()
    g_a, g_b = (classes.select(F.col("id").alias(f"id_{x}"), F.col("g").alias(f"g_{x}")) for x in "ab")
    both = F.size(F.array_intersect("g_a", "g_b"))
    found = near.join(g_a, "id_a").join(g_b, "id_b").withColumn("both", both).withColumn("either", F.size("g_a") + F.size("g_b") - F.col("both"))
    return found.filter(F.col("both") >= threshold * F.col("either")).select("id_a", "id_b", F.round(F.col("both") / F.col("either"), 6).alias("jaccard"))


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    return x


def embed(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed hashed character n-grams, spaces included, of length one; a text of one character or none is zero.
    All n-grams of a text are hashed together, byte by byte."""
    data = np.frombuffer(re.sub(r"\s+", " ", text or "").strip().encode("utf-8", "surrogatepass"), np.uint8)
    starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    table, out = _crc_table(), np.zeros(dimensions)
    for n in GRAMS:
        if len(starts) <= n:
            continue
        begin, size = starts[:-n], starts[n:] - starts[:-n]
        crc = np.full(len(begin), 0xFFFFFFFF, np.uint32)
        for step in range(int(size.max())):
            on = np.flatnonzero(size > step) if step >= n else slice(None)
            crc[on] = table[(crc[on] ^ data[begin[on] + step]) & 0xFF] ^ (crc[on] >> np.uint32(8))
        crc ^= np.uint32(0xFFFFFFFF)
        out += np.bincount(crc % dimensions, np.where(crc >> np.uint32(31), -1.0, 1.0), minlength=dimensions)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def embeddings(articles: DataFrame) -> DataFrame:
    def of(batches):
        for batch in batches:
            rows = [embed(x.as_py()).astype(np.float32) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("article_id"), pa.array(rows, pa.list_(pa.float32()))], names=["article_id", "embedding"])

    text = fold(F.lower(F.concat_ws("\n", "title", "body")))
    return articles.select("article_id", text.alias("text")).mapInArrow(of, f"article_id {articles.schema['article_id'].dataType.simpleString()}, embedding array<float>")
