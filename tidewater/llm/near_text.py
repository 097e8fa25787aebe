"""Near-duplicate texts (Jaccard similarity of five-word shingles of 0.8 or more) by SimHash and ball hashing.

Texts as similar as that differ in about 15 % of their SimHash bits, too many for one 64-bit fingerprint: a ball wide
enough would have millions of variants. So each text gets a long SimHash of TABLES pieces of 32 bits, and each piece is
ball-hashed on its own: it emits its variants within half the radius (itself and its 32 single flips), variants are
shuffled, and texts that meet on one have pieces within RADIUS bits. A text and a copy of similarity 0.8 meet in at least
one of 42 pieces with probability 0.995 (0.85: 0.9998). What meets is compared on 32 further bits at once (CHECK), then
on all bits (LIMIT, as of similarity 0.71), and what is left by its shingles themselves: only a Jaccard similarity of
LEAST or more links. Pieces are worked off in PASSES passes, so that only some of the variants are on disk at a time.

Nothing that meets is dropped, and no group makes pairs with its square. Of the texts that share a piece, the one with the
smallest check stands for all whose check is near to its own, and only it (and those not near to it) emit variants. Up to
FEW entries of a variant are paired with each other; more are a crowd, of which only pairs that connect it are handed out.
Crowds, and texts that others stand for, form families; all texts of a family that are not connected yet are compared with
each other on all bits, in blocks that a task holds; those that differ from another in LIMIT bits or fewer are sent with their
words to the task of the block, which verifies every such pair that nearer ones have not connected and hands out only links
that connect. So two texts are missed only if they meet in no piece.

Copies with equal signatures are put together before, so a group of exact copies of any size is one text. A bucket is
read in batches; of a crowd only one entry stays in memory.

Defined results: texts of fewer than five words are one shingle; null and wordless texts are alike; repeated rows are
one text; rows that share an id and differ in text are rows of their own; rows without an id can't be told apart and all
stay; very long texts are compared whole; extra columns, whatever their names, are kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.components import components, forest
from tidewater.llm.patterns import new_name
from tidewater.storage import release, stash

SHINGLE, SEED = 5, 42
#: Least Jaccard similarity, in fifths.
LEAST_FIFTHS = 4
#: Pieces of 32 bits: those that are ball-hashed (so many in each pass), and all (the next is the check).
TABLES, PASSES, PIECES = 42, 3, 44
#: Bits that may differ: of 32 in a piece that is ball-hashed, of 32 in the check, of all 1408.
RADIUS, CHECK, LIMIT = 2, 11, 262
#: Entries that a bucket holds on average, keys that a task expands, those it expands at once.
BUCKET_ROWS, TASK_KEYS, EXPAND = 1_000_000, 160_000, 8192
#: Entries of a variant that are paired with each other; more are a crowd. Texts of a family in a part, and bytes of their packed words.
FEW, BLOCK, BLOCK_BYTES = 3, 4096, 1 << 25
_ROWS = 1 << 14
_MASKS = np.concatenate([np.zeros(1, np.uint32), np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))])
_STEPS = np.arange(1, PIECES // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _spread(h: np.ndarray) -> np.ndarray:
    """PIECES / 2 independent hashes of each hash, by the splitmix64 finaliser."""
    z = h[:, None] + _STEPS[None, :]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _ones(rows: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of words. Full adders turn three rows of a weight into one of it and one of
    twice the weight, so that few rows are left to be unpacked."""
    total, weight = np.zeros(rows.shape[1] * 64, np.int64), 1
    while len(rows):
        carries = []
        while (third := len(rows) // 3) > 0:
            a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            rows = np.concatenate([half ^ c, rows[3 * third :]])
        total += weight * np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        rows, weight = np.concatenate(carries) if carries else rows[:0], 2 * weight
    return total


def shingles(words: list[bytes]) -> set[bytes]:
    return set(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))) if len(words) >= SHINGLE else {b" ".join(words)}


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return 5 * both >= LEAST_FIFTHS * (len(a) + len(b) - both)


def signature(text: str | None) -> bytes:
    """A bit is 1 if it is set in over half the hashes of the distinct shingles."""
    words = words_of(text)
    if not words:
        return bytes(PIECES * 4)
    pieces = shingles(words)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in pieces), np.uint64, len(pieces))
    ones = sum(_ones(_spread(hashes[k : k + _ROWS])) for k in range(0, len(hashes), _ROWS))
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def row_key() -> Column:
    """128 bits of a row's id and text."""
    return F.unhex(F.md5(F.concat(F.col("doc_id").cast("string"), F.when(F.col("text").isNull(), "\n0").otherwise("\n1"), F.coalesce("text", F.lit("")))))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key (binary: the row's id and text), sig (binary)."""

    def of(batches):
        for batch in batches:
            sigs = pa.array([signature(x.as_py()) for x in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), sigs], names=["doc_id", "key", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key().alias("key"), "text").mapInArrow(of, f"doc_id {kind}, key binary, sig binary")


def _pieces(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, PIECES)


def _key(piece: np.ndarray, check: np.ndarray) -> np.ndarray:
    """A piece in the high half, the check in the low half."""
    return ((piece.astype(np.uint64) << np.uint64(32)) | check).view(np.int64)


def _met(where: np.ndarray, key: np.ndarray, old: np.ndarray, crowd: np.ndarray):
    """Entries sorted by where; old: compared before, crowd: stands for a crowd. Returns pairs, as indices, and whether
    they are of a crowd; which entries stay, and which of these stand for crowds. In a group of FEW or less all that are near
    are paired; in a crowd the first stands for all."""
    check = key.astype(np.uint32)
    starts = np.concatenate([[True], where[1:] != where[:-1]])
    group = np.cumsum(starts) - 1
    many = (np.bincount(group) > FEW) | (np.bincount(group, crowd) > 0)
    many = many[group]
    others = np.flatnonzero(many & ~starts)
    pairs = [(np.flatnonzero(starts)[group[others]], others)]
    few = np.flatnonzero(~many)
    for step in range(1, FEW):
        i, j = few[:-step], few[step:]
        near = (group[i] == group[j]) & ~(old[i] & old[j])
        i, j = i[near], j[near]
        near = np.bitwise_count(check[i] ^ check[j]) <= CHECK
        pairs.append((i[near], j[near]))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return i, j, np.arange(len(i)) < len(others), ~many | starts, many & starts


def _variants(key: np.ndarray) -> np.ndarray:
    """The piece's variants, row by row: itself and its 32 single flips."""
    return (key.astype(np.uint64) >> np.uint64(32)).astype(np.uint32)[:, None] ^ _MASKS


def _emit(each: int):
    """(piece, key) -> blobs of variants by bucket, each buckets for a piece."""

    def emit(batches):
        for batch in batches:
            pieces, keys = batch.column("piece").to_numpy().astype(np.uint8), batch.column("key").to_numpy().view(np.uint64)
            for k in range(0, len(keys), EXPAND):
                key = keys[k : k + EXPAND]
                variant = _variants(key)
                piece = np.broadcast_to(pieces[k : k + EXPAND, None], variant.shape).ravel()
                flip = np.broadcast_to(np.arange(len(_MASKS), dtype=np.uint8), variant.shape).ravel()
                check = np.broadcast_to(key.astype(np.uint32)[:, None], variant.shape).ravel()
                variant = variant.ravel()
                bucket = ((_where(variant, piece) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % each + each * piece.astype(np.int64)
                order = np.argsort(bucket.astype(np.uint16) if each * TABLES <= 65536 else bucket, kind="stable")
                bucket = bucket[order]
                columns = [x[order] for x in (variant, piece, flip, check)]
                starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                cut = list(zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[starts]), *(pa.array([x[a:b].tobytes() for a, b in cut], pa.binary()) for x in columns)],
                    names=["bucket", "variants", "pieces", "flips", "checks"],
                )

    return emit


_BLOBS = "bucket long, variants binary, pieces binary, flips binary, checks binary"


def _where(variant: np.ndarray, piece: np.ndarray) -> np.ndarray:
    return (variant.astype(np.uint64) << np.uint64(6)) | piece


def _entries(blobs) -> tuple[np.ndarray, np.ndarray]:
    """Variant with piece, and key, of the entries of some blobs."""
    variant, piece, flip, check = (np.concatenate([np.frombuffer(b[k], t) for b in blobs]) for k, t in enumerate((np.uint32, np.uint8, np.uint8, np.uint32)))
    return _where(variant, piece), ((variant ^ _MASKS[flip]).astype(np.uint64) << np.uint64(32)) | check


def near_keys(keys: DataFrame) -> DataFrame:
    """keys(piece int, key long), each once -> (piece, a, b, crowd): pairs of keys of a piece that met and passed the check, each
    once; and of those that are in crowds pairs that connect each crowd, checked or not."""
    n = keys.count()
    each, tasks = max(1, -(-n * len(_MASKS) // (BUCKET_ROWS * -(-TABLES // PASSES)))), max(1, -(-n // TASK_KEYS))

    def meet(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, keys, crowd = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)  # so far

        def step(more):
            nonlocal where, keys, crowd
            new_where, new_keys = _entries(more)
            w, k = np.concatenate([where, new_where]), np.concatenate([keys, new_keys])
            old, crowd = np.arange(len(w)) < len(where), np.concatenate([crowd, np.zeros(len(new_where), bool)])
            order = np.lexsort((k, ~old, ~crowd, w))
            w, k, old, crowd = w[order], k[order], old[order], crowd[order]
            i, j, many, stay, stands = _met(w, k, old, crowd)
            where, keys, crowd = w[stay], k[stay], stands[stay]
            # Two of few share two variants, or all if their bases are equal; one of these reports the pair.
            base_a, base_b = k[i] >> np.uint64(32), k[j] >> np.uint64(32)
            low = (base_a ^ base_b) & (~(base_a ^ base_b) + np.uint64(1))
            once = ~many & (np.minimum(base_a ^ low, base_b ^ low) == w[i] >> np.uint64(6))
            a, b = forest(k[i[many]], k[j[many]])
            both = [pa.array(np.concatenate(x).view(np.int64)) for x in ((k[i[once]], a), (k[j[once]], b))]
            piece = np.full(len(both[0]), int(w[0] & np.uint64(63)), np.int32)  # a bucket is of one piece
            return pa.RecordBatch.from_arrays([pa.array(piece), *both, pa.array(np.arange(len(piece)) >= once.sum())], names=["piece", "a", "b", "crowd"])

        more, rows = [], 0
        for batch in batches:
            for blob in zip(*(batch.column(x).to_pylist() for x in ("variants", "pieces", "flips", "checks")), strict=True):
                more.append(blob)
                rows += len(blob[1])
                if rows >= BUCKET_ROWS:
                    yield step(more)
                    more, rows = [], 0
        if more:
            yield step(more)

    # Spark tells functions on iterators by their annotations, which must be types and not text.
    meet.__annotations__ = {"batches": Iterator[pa.RecordBatch], "key": tuple[pa.Scalar, ...], "return": Iterator[pa.RecordBatch]}
    blobs = keys.select("piece", "key").repartition(tasks).mapInArrow(_emit(each), _BLOBS)
    return blobs.groupBy("bucket").applyInArrow(meet, "piece int, a long, b long, crowd boolean")


def _keyed(texts: DataFrame, low: int, high: int) -> DataFrame:
    """texts(id, sig) -> id, piece, key of the pieces low to high - 1."""

    def spread(batches):
        for batch in batches:
            p = _pieces(batch.column("sig"))
            keys = _key(p[:, low:high], p[:, TABLES : TABLES + 1])
            rows = np.repeat(np.arange(len(keys)), high - low)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows)), pa.array(np.tile(np.arange(low, high, dtype=np.int32), len(keys))), pa.array(keys.ravel())],
                names=["id", "piece", "key"],
            )

    return texts.select("id", "sig").mapInArrow(spread, "id binary, piece int, key long")


def _passes() -> list[tuple[int, int]]:
    each = -(-TABLES // PASSES)
    return [(low, min(TABLES, low + each)) for low in range(0, TABLES, each)]


def met_texts(classes: DataFrame, low: int, high: int) -> DataFrame:
    """classes(id, sig) -> (a, b, direct, kin) of the pieces low to high - 1. direct: the pair has met, unverified; kin: all that
    such pairs connect have to be compared with each other."""
    base, check = F.shiftrightunsigned("key", 32).alias("base"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("check")
    keyed = stash(_keyed(classes, low, high).select("id", "piece", "key", base, check), "near-pieces")
    # Written, so that the join below is of plain shuffles, which Spark can split where a piece is hot.
    heads = stash(keyed.groupBy("piece", "base").agg(F.min(F.struct("check", "id")).alias("head"), (F.count("*") > 1).alias("several")), "near-heads")
    off = F.bit_count(F.col("check").bitwiseXOR(F.col("head.check"))) > CHECK
    classed = stash(keyed.join(heads, ["piece", "base"]).select("piece", "key", "id", F.col("head.id").alias("head"), off.alias("off"), "several"), "near-classes")
    release(classes.sparkSession, keyed, heads)
    far = classed.filter("off").groupBy("piece", "key").agg(F.min("id").alias("id"), F.lit(True).alias("several"))
    leaders = stash(classed.filter("id = head").select("piece", "key", "id", "several").union(far), "near-leaders")
    met = stash(near_keys(leaders.select("piece", "key")), "near-keys")
    a, b = (leaders.select("piece", F.col("key").alias(x), F.col("id").alias(f"id_{x}"), F.col("several").alias(f"several_{x}")) for x in "ab")
    kin = F.col("crowd") | F.col("several_a") | F.col("several_b")  # who stands for several speaks for them too
    pairs = met.join(a, ["piece", "a"]).join(b, ["piece", "b"]).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), (~F.col("crowd")).alias("direct"), kin.alias("kin"))
    members = classed.select(F.col("head").alias("a"), F.col("id").alias("b"), (~F.col("off")).alias("direct"), F.lit(True).alias("kin"))
    same = classed.filter("off").select("piece", "key", F.col("id").alias("b")).join(leaders.select("piece", "key", F.col("id").alias("a")), ["piece", "key"]).select("a", "b", F.lit(True).alias("direct"), F.lit(True).alias("kin"))
    behind = stash(pairs.union(members).union(same).filter("a <> b"), "near-behind")
    release(classes.sparkSession, classed, leaders, met)
    return behind


def kin_in_blocks(families: DataFrame, classes: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """families(node, root) -> (root, i, j, part, id, joined, sig): the texts of families that roots(node, root) leaves apart, in blocks of
    two parts, so that any two of a family share a block. A part is of BLOCK texts and BLOCK_BYTES of texts(id, words, size), about."""
    joined = roots.select("node", F.col("root").alias("joined"))
    members = families.join(joined, "node", "left").select("root", F.col("node").alias("id"), F.coalesce("joined", "node").alias("joined"))
    members = members.join(texts.select("id", "size"), "id")
    sized = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("joined").alias("least"), F.max("joined").alias("most")).filter("least <> most")
    parts = sized.select("root", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES)).alias("parts"))
    sliced = members.drop("size").join(parts, "root").join(classes.select("id", "sig"), "id").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return sliced.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "joined", "sig")


_BLOCKS = "root binary, i long, j long, part long, id binary, joined binary, sig binary"


def _near_in_block(key, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block in order of id: the component of each text, and the pairs, as indices, that are not connected and differ in at most LIMIT
    bits, with the number."""
    i, j = key[1].as_py(), key[2].as_py()
    part = table.column("part").to_numpy()
    sigs, group = _pieces(table.column("sig")).view(np.uint64), np.unique(np.array(table.column("joined").to_pylist(), object), return_inverse=True)[1]
    rows, columns = np.flatnonzero(part == i), np.flatnonzero(part == j)
    found = [np.zeros((3, 0), np.int32)]
    for r in rows:
        others = columns[columns > r] if i == j else columns
        others = others[group[others] != group[r]]
        differ = np.bitwise_count(sigs[others] ^ sigs[r]).sum(axis=1, dtype=np.int32)
        near = differ <= LIMIT
        found.append(np.stack([np.full(near.sum(), r), others[near], differ[near]]).astype(np.int32))
    return group, *np.concatenate(found, axis=1)


def near_in_blocks(blocks: DataFrame) -> DataFrame:
    """The rows of kin_in_blocks() that differ from another of their block in at most LIMIT bits and are not connected with it."""

    def compare(key, table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        return table.take(pa.array(np.unique(np.concatenate(_near_in_block(key, table)[1:3]))))

    compare.__annotations__ = {"key": tuple[pa.Scalar, ...], "table": pa.Table, "return": pa.Table}
    return blocks.groupBy("root", "i", "j").applyInArrow(compare, _BLOCKS)


def similar_in_blocks(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): pairs of near_in_blocks() of similar texts that connect all such pairs of their block, one for each text at most. The
    nearest are verified first, and none that others connect. Pairs never leave their block: only texts move."""

    def verify(key, table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        group, a, b, differ = _near_in_block(key, table)
        words, root = table.column("words"), list(range(len(table)))
        hashes: list[np.ndarray | None] = [None] * len(table)

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def of(x):
            return shingles(zstandard.decompress(words[x].as_py()).split())

        def hashed(x):
            if hashes[x] is None:
                hashes[x] = np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in of(x)), np.uint64))
            return hashes[x]

        out = []
        order = np.lexsort((b, a, differ))
        for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
            if (g := top(group[x])) == (h := top(group[y])):
                continue
            # Hashes sort out most of the pairs; what they leave is verified by the shingles themselves.
            u, v = hashed(x), hashed(y)
            if 5 * min(len(u), len(v)) < LEAST_FIFTHS * max(len(u), len(v)):
                continue
            both = np.count_nonzero(u[np.minimum(np.searchsorted(u, v), len(u) - 1)] == v)
            if 5 * both >= LEAST_FIFTHS * (len(u) + len(v) - both) and similar(of(x), of(y)):
                root[max(g, h)] = min(g, h)
                out.append((x, y))
        ids = table.column("id")
        return pa.table({c: ids.take(pa.array([p[k] for p in out], pa.int64())) for k, c in enumerate("ab")})

    verify.__annotations__ = {"key": tuple[pa.Scalar, ...], "table": pa.Table, "return": pa.Table}
    return blocks.join(texts.select("id", "words"), "id").groupBy("root", "i", "j").applyInArrow(verify, "a binary, b binary")


def near_by_bits(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(a, b) whose signatures differ in at most LIMIT bits, with the number."""

    def differences(batches):
        for batch in batches:
            differ = np.bitwise_count(_pieces(batch.column("sig_a")) ^ _pieces(batch.column("sig_b"))).sum(axis=1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(differ)], names=["a", "b", "differ"]).filter(pa.array(differ <= LIMIT))

    sig_a, sig_b = (classes.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    return pairs.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(differences, "a binary, b binary, differ int")


def _pressed(batches):
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        blobs = [press.compress(b" ".join(words_of(x.as_py()))) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(blobs, pa.binary())], names=["key", "words"])


def similar_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b) whose shingles have a Jaccard similarity of LEAST_FIFTHS fifths or more; texts(id, words: compressed)."""

    def verified(batches):
        @functools.lru_cache(64)
        def of(blob: bytes) -> set[bytes]:
            return shingles(zstandard.decompress(blob).split())

        for batch in batches:
            a, b = batch.column("words_a").to_pylist(), batch.column("words_b").to_pylist()
            # Only small texts are kept at hand.
            read = lambda x: of(x) if len(x) < 20_000 else of.__wrapped__(x)
            yield batch.select(["a", "b"]).filter(pa.array([similar(read(x), read(y)) for x, y in zip(a, b, strict=True)], pa.bool_()))

    words_a, words_b = (texts.select(F.col("id").alias(x), F.col("words").alias(f"words_{x}")) for x in "ab")
    return pairs.join(words_b, "b").join(words_a, "a").select("a", "b", "words_a", "words_b").mapInArrow(verified, "a binary, b binary")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs(a, b, ...) that are not connected yet."""
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(pairs.columns)


def near_roots(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """classes(id, key, sig) -> (node, root): the components of the texts that are like another."""
    behind = functools.reduce(DataFrame.union, [met_texts(classes, *each) for each in _passes()])
    # Pairs of families are compared below; of each of their texts one is tried at once, that met in most pieces.
    met = behind.filter("direct").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("times"), F.bool_or("kin").alias("kin"))
    met = stash(met, "near-met")
    likely = met.filter("kin").groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a"))
    pairs = stash(met.filter("not kin").select("a", "b").union(likely.select("a", "b")), "near-pairs")
    ids = behind.select(F.col("a").alias("id")).union(behind.select("b")).distinct()
    wanted = stash(ids.join(classes.select("id", "key"), "id"), "near-wanted")
    pressed = docs.select(row_key().alias("key"), "text").mapInArrow(_pressed, "key binary, words binary")
    texts = stash(wanted.join(pressed, "key").groupBy("id").agg(F.first("words").alias("words")).withColumn("size", F.length("words")), "near-texts")
    near = stash(near_by_bits(pairs, classes), "near-bits")
    # Each text with the one nearest to it, then what this has not connected.
    first = near.groupBy("b").agg(F.min_by("a", F.struct("differ", "a")).alias("a")).select("a", "b")
    links = stash(similar_pairs(first, texts), "near-links")
    roots = components(links)
    links, roots = _joined(links, roots, similar_pairs(_apart(near.select("a", "b"), roots), texts))
    # What others spoke for, or was in a crowd, is compared whole, as far as it is apart.
    families = stash(components(behind.filter("kin").select("a", "b")), "near-families")
    blocks = stash(near_in_blocks(kin_in_blocks(families, classes, texts, roots)), "near-kin")
    return _joined(links, roots, similar_in_blocks(blocks, texts))[1]


def _joined(links: DataFrame, roots: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links and their components, with more links."""
    more = stash(more, "near-links")
    if not more.limit(1).count():
        return links, roots
    links = links.union(more)
    return links, components(links)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, one of each group that links join: the one with the smallest doc_id (of rows that share an id, the
    one with the smallest hash; of repeated rows, one)."""
    named = docs.filter("doc_id is not null")
    each = signatures(named)
    classes = stash(each.groupBy("sig").agg(F.min(F.struct("doc_id", "key")).alias("first")).select(F.unhex(F.md5("sig")).alias("id"), "first.doc_id", "first.key", "sig"), "near-classes")
    roots = stash(near_roots(named, classes), "near-roots")
    rooted = classes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    stays = rooted.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.key")
    name = new_name(docs, "key")
    kept = named.withColumn(name, row_key()).join(stays.withColumnRenamed("key", name), name, "left_semi").dropDuplicates([name])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).union(docs.filter("doc_id is null"))
