"""Language-model scoring by context-tree weighting, beside a unigram base.

Bytes (A-Z lowered, one end mark behind each text) are decomposed into eight binary decisions; every decision has a
tree of contexts, the bytes before it, up to DEPTH. Each context keeps a Krichevsky-Trofimov estimate, and every
inner context weighs its own estimate against those of its longer contexts by how well each coded the training
bytes, so a prediction mixes the estimates of all depths. Every context counts, however rare. The different codes (a
context of DEPTH bytes and the byte behind it) of all texts are a distributed table with their training counts. Codes whose
contexts end with the same two bytes share all longer contexts, so buckets of such pairs are weighed and mixed apart from
each other; only the two shortest depths (256 contexts) are put together on the driver. Only decisions that occur are
held, not 256 for each context.

The model stays a distributed table too. Texts are cut into slices; each slice asks, bucket by bucket, for its different
codes once, gets their log probabilities back in the same order, and sums them up for its texts. So what is shuffled
grows with the texts alone, not with the model, and a code that is everywhere costs one entry a slice.

The base's token counts are a distributed table. Frequent tokens (fewer than HOT, by their share) are sent to all tasks;
of the others every slice sends its documents' counts, packed by bucket, to where they are counted, and gets back sums.

Defined results: null text counts as empty: one token (the end); without training rows the counts are 0 and the model
is uniform over bytes; repeated rows and rows without an id are scored like others; a text of any length is scored whole,
in slices; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.patterns import id_remainder, whole_text
from tidewater.storage import release, stash

DEPTH = 5
#: Codes that are mixed in one bucket, on average; bytes of a slice; bytes of text whose codes are asked for in one bucket;
BUCKET_CODES, SLICE_BYTES, ASK_BYTES = 100_000, 2 << 20, 8 << 20
#: slices that one task puts together again.
TASK_SLICES = 4
#: Different codes or tokens that a task holds before it hands out their counts.
HELD = 1_500_000
FOLDS, HELD_OUT = 7, 2
#: Bytes of text whose rarer tokens one bucket counts, on average; a token is frequent if it is more than one in HOT.
BUCKET_BYTES, HOT = 16 << 20, 50_000
_PIECE = 2 << 20
_END_BYTE, _END_TOKEN = b"\xff", xxhash.xxh64_intdigest(b"\n")


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


# ---- context-tree weighting ----


def context_codes(data: bytes, before: bytes = b"", end: bool = True) -> np.ndarray:
    """For each byte, and the end mark: the DEPTH bytes before it and itself, in one number. before: what stands ahead
    of a part of a text; zeros stand before a text."""
    b = np.frombuffer((b"\0" * DEPTH + before)[-DEPTH:] + data + _END_BYTE * end, np.uint8)
    n = len(data) + end
    codes = b[:n].astype(np.uint64)
    for k in range(1, DEPTH + 1):
        codes <<= np.uint64(8)
        codes |= b[k : k + n]
    return codes


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """The first of each value of a sorted array, which is not empty. Sorting is faster than numpy.unique(), which hashes."""
    return np.concatenate([[True], ordered[1:] != ordered[:-1]])


def _count(batches):
    """(code, n) over all texts of a task: n counts in training texts; the codes of others are there with 0."""
    codes, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    waiting, size = {True: [], False: []}, 0

    def merged():
        new = {train: np.unique(np.concatenate(x), return_counts=True) for train, x in waiting.items() if x}
        both, n = np.concatenate([codes, *(x for x, _ in new.values())]), np.concatenate([counts, *(n * train for train, (_, n) in new.items())])
        order = np.argsort(both, kind="stable")  # runs that are sorted already
        first = _firsts(both[order])
        return both[order[first]], np.add.reduceat(n[order], np.flatnonzero(first))

    def out():
        for k in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[k : k + 100_000].astype(np.int64)), pa.array(counts[k : k + 100_000])], names=["code", "n"])

    for batch in batches:
        for text, train in zip(batch.column("text"), batch.column("train").to_pylist(), strict=True):
            data = _bytes(text.as_py())
            for k in range(0, len(data) + 1, _PIECE):
                more = context_codes(data[k : k + _PIECE], data[max(0, k - DEPTH) : k], k + _PIECE > len(data))
                waiting[bool(train)].append(more)
                size += len(more)
                if size >= _PIECE:
                    codes, counts = merged()
                    waiting, size = {True: [], False: []}, 0
                    if len(codes) >= HELD:
                        yield from out()
                        codes, counts = codes[:0], counts[:0]
    if size:
        codes, counts = merged()
    yield from out()


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5: Stirling's series at x + 8."""
    z, product = x + 8, np.ones_like(x)
    for k in range(8):
        product *= x + k
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


#: log gamma of n + 0.5 and of n + 1 for small whole n, which most counts are.
_GAMMA = {x: _lgamma(np.arange(4096) + x) for x in (0.5, 1.0)}


def _log_gamma(n: np.ndarray, more: float) -> np.ndarray:
    """log gamma of n + more for whole numbers n."""
    table = _GAMMA[more]
    out, large = table[np.minimum(n, len(table) - 1).astype(np.int64)], n >= len(table)
    if large.any():
        out[large] = _lgamma(n[large] + more)
    return out


def _decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(m, 256) byte counts -> (m, 256) zeros and ones at each decision; decision v has its bits as v's lower bits."""
    zeros, ones = np.zeros_like(counts), np.zeros_like(counts)
    for level in range(8):
        halves = counts.reshape(len(counts), 1 << level, 2, 128 >> level).sum(axis=3)
        zeros[:, 1 << level : 2 << level], ones[:, 1 << level : 2 << level] = halves[:, :, 0], halves[:, :, 1]
    return zeros, ones


def _estimate(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """KT: log probability of the counts, and the next one's probability of being 1, at each decision."""
    return _kt(*_decisions(counts))


def _kt(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    log_pe = _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5) - _log_gamma(zeros + ones, 1.0) - np.log(np.pi)
    return log_pe, (ones + 0.5) / (zeros + ones + 1)


def _weigh(log_pe: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability, and the weight of a context's own estimate."""
    log_pw = np.log(0.5) + np.logaddexp(log_pe, below)
    return log_pw, np.exp(np.log(0.5) + log_pe - log_pw)


class _Level:
    """One of the eight decisions of every code of a bucket: the decisions that occur in contexts of 2 to DEPTH bytes,
    with their estimates and their weights. A decision is a code with the byte's known bits in place of the byte."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, level: int):
        byte = codes & 255
        self.bit = (byte >> (7 - level)) & 1
        name, up = np.unique((codes & ~255) | (1 << level) | (byte >> (8 - level)), return_inverse=True)
        ones = np.bincount(up, n * self.bit, minlength=len(name))
        zeros = np.bincount(up, n, minlength=len(name)) - ones
        # From the longest contexts to those of two bytes; up: from each entry of the depth before to its parent here.
        self.ups, self.kt, self.weight, below = [], [], [], None
        for depth in range(DEPTH, 1, -1):
            if depth < DEPTH:
                name, up = np.unique(name & ((1 << (8 * depth + 8)) - 1), return_inverse=True)
                zeros, ones, below = (np.bincount(up, x, minlength=len(name)) for x in (zeros, ones, below))
            log_pe, kt = _kt(zeros, ones)
            below, weight = _weigh(log_pe, below) if depth < DEPTH else (log_pe, np.ones_like(kt))
            for store, x in ((self.ups, up), (self.kt, kt), (self.weight, weight)):
                store.append(x)
        #: Last byte and decision of the contexts of two bytes, and their weighted log probabilities.
        self.last, self.decision, self.log_pw = (name >> 8) & 255, name & 255, below

    def log_probability(self, done: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log10 of the mixed probability of each code's bit; done, left: as of the contexts of one byte."""
        done, left = done[self.last, self.decision], left[self.last, self.decision]
        for up, kt, weight in zip(reversed(self.ups), reversed(self.kt), reversed(self.weight), strict=True):
            done, left = (done + left * weight * kt)[up], (left * (1 - weight))[up]
        return np.log10(np.maximum(np.where(self.bit == 1, done, 1 - done), 1e-300))


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    codes, n = table.column("code").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order].astype(np.float64)


def _weighed(table: pa.Table) -> pa.Table:
    """One bucket: the weighted log probabilities of its contexts of two bytes, summed by last byte and decision."""
    codes, n = _sorted(table)
    below = np.zeros(65536)
    for level in range(8):
        found = _Level(codes, n, level)
        below += np.bincount((found.last << 8) | found.decision, found.log_pw, minlength=65536)
    at = np.flatnonzero(below)
    return pa.table({"at": at, "x": below[at]})


def fit_tree(rows: DataFrame) -> DataFrame:
    """rows(text, train) -> code, log_p: log10 of the mixed probability of each code that occurs in any row."""
    counted = stash(rows.select("text", "train").mapInArrow(_count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "contexts")
    buckets = max(1, -(-counted.count() // BUCKET_CODES))
    pair = F.shiftright("code", 8).bitwiseAND(F.lit(0xFFFF))
    bucketed = counted.withColumn("bucket", F.pmod(F.xxhash64(pair), F.lit(buckets)))

    # Depths 0 and 1, at most 65,536 rows each.
    counts1, below1 = np.zeros(65536), np.zeros(65536)
    for at, n in counted.groupBy(F.col("code").bitwiseAND(F.lit(0xFFFF)).alias("at")).agg(F.sum("n")).collect():
        counts1[at] = n
    # Sums in a fixed order, so that scores are the same in every run.
    in_order = F.aggregate(F.array_sort(F.collect_list("x")), F.lit(0.0), lambda a, x: a + x)
    for at, x in bucketed.filter("n > 0").groupBy("bucket").applyInArrow(_weighed, "at long, x double").groupBy("at").agg(in_order).collect():
        below1[at] = x
    counts1 = counts1.reshape(256, 256)
    log_pe1, kt1 = _estimate(counts1)
    log_pw1, weight1 = _weigh(log_pe1, below1.reshape(256, 256))
    log_pe0, kt0 = _estimate(counts1.sum(axis=0, keepdims=True))
    _, weight0 = _weigh(log_pe0, log_pw1.sum(axis=0, keepdims=True))
    done, left = weight0 * kt0 + (1 - weight0) * weight1 * kt1, (1 - weight0) * (1 - weight1)
    sent = rows.sparkSession.sparkContext.broadcast((done, left))

    def mixed(table: pa.Table) -> pa.Table:
        codes, n = _sorted(table)
        return pa.table({"code": codes, "log_p": sum(_Level(codes, n, level).log_probability(*sent.value) for level in range(8)).astype(np.float32)})

    model = stash(bucketed.groupBy("bucket").applyInArrow(mixed, "code long, log_p float"), "model")
    release(rows.sparkSession, counted)
    return model


def _slices_of(batches):
    """Texts in slices of SLICE_BYTES: which texts (rid, the number of the part, its length), and their bytes. A long
    text is cut; each part brings the DEPTH bytes before it along."""
    press, number = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
    rids, parts, sizes, held, size = [], [], [], [], 0

    def made():
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), *(pa.array([np.array(x, t).tobytes()], pa.binary()) for x, t in ((rids, np.int64), (parts, np.int32), (sizes, np.int64))), pa.array([press.compress(b"".join(held))], pa.binary())],
            names=["slice", "rids", "parts", "sizes", "data"],
        )

    for batch in batches:
        for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text"), strict=True):
            data = b"\0" * DEPTH + _bytes(text.as_py()) + _END_BYTE
            for part, k in enumerate(range(DEPTH, len(data), SLICE_BYTES)):
                piece = data[k - DEPTH : k + SLICE_BYTES]
                if size and size + len(piece) > SLICE_BYTES:
                    yield made()
                    number += 1
                    rids, parts, sizes, held, size = [], [], [], [], 0
                for store, x in ((rids, rid), (parts, part), (sizes, len(piece)), (held, piece)):
                    store.append(x)
                size += len(piece)
    if size:
        yield made()


def _codes_of(sizes: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a slice, text after text, and where each text's begin."""
    b, sizes = np.frombuffer(zstandard.decompress(data), np.uint8), np.frombuffer(sizes, np.int64)
    codes = b[: len(b) - DEPTH].astype(np.uint64)
    for k in range(1, DEPTH + 1):
        codes <<= np.uint64(8)
        codes |= b[k : len(b) - DEPTH + k]
    ends = np.cumsum(sizes)
    # Codes that reach over the border of two texts are none.
    real = np.ones(len(b), bool)
    for j in range(1, DEPTH + 1):
        real[ends - j] = False
    starts = np.concatenate([[0], np.cumsum(sizes - DEPTH)[:-1]])
    return codes[real[: len(codes)]], starts


def _places(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a slice in order, and the text of each. Of 65,536 texts or fewer a text's number fits behind its code."""
    text = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(starts, append=len(codes)))
    if len(starts) > 65536:
        place = np.argsort(codes, kind="stable")
        return codes[place], text[place].astype(np.int64)
    both = np.sort((codes << np.uint64(16)) | text)  # several times as fast as argsort()
    return both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)


def _bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray, buckets: int) -> np.ndarray:
    return np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable")


def _asked(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, by bucket and then by value, and where each bucket's begin."""
    ordered = np.sort(codes)
    distinct = ordered[_firsts(ordered)]
    bucket = _bucket_of(distinct, buckets)
    order = _by_bucket(bucket, buckets)
    return distinct[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _answer(model: pa.Table, asked: pa.Table) -> pa.Table:
    """One bucket: the log probabilities of the codes that each slice asks for."""
    codes, log_p = model.column("code").to_numpy().view(np.uint64), model.column("log_p").to_numpy()
    order = np.argsort(codes)
    codes, log_p = codes[order], log_p[order]
    found = [log_p[np.searchsorted(codes, np.cumsum(np.frombuffer(zstandard.decompress(c), np.uint64)))].tobytes() for c in asked.column("codes").to_pylist()]
    return pa.table({"slice": asked.column("slice"), "bucket": asked.column("bucket"), "log_p": pa.array(found, pa.binary())})


def text_scores(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows(rid, text), model(code, log_p) -> rid, score (log10 of the probability of the text and its end), one for each rid."""
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    buckets = max(1, -(-size // ASK_BYTES))
    slices = stash(rows.select("rid", "text").mapInArrow(_slices_of, "slice long, rids binary, parts binary, sizes binary, data binary"), "slices")

    def ask(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for number, sizes, data in zip(*(batch.column(c).to_pylist() for c in ("slice", "sizes", "data")), strict=True):
                codes, cuts = _asked(_codes_of(sizes, data)[0], buckets)
                some = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
                blobs = [press.compress(np.diff(codes[cuts[k] : cuts[k + 1]], prepend=np.uint64(0)).tobytes()) for k in some]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([number] * len(some), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "slice", "codes"])

    def bucketed(batches):
        for batch in batches:
            bucket = _bucket_of(batch.column("code").to_numpy().view(np.uint64), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column("code"), batch.column("log_p")], names=["bucket", "code", "log_p"])

    def total(batches):
        for batch in batches:
            for rids, parts, sizes, data, answers in zip(*(batch.column(c).to_pylist() for c in ("rids", "parts", "sizes", "data", "answers")), strict=True):
                codes, starts = _codes_of(sizes, data)
                codes, text = _places(codes, starts)
                first = _firsts(codes)
                distinct = codes[first]
                log_p = np.empty(len(distinct))
                log_p[_by_bucket(_bucket_of(distinct, buckets), buckets)] = np.frombuffer(b"".join(a["log_p"] for a in sorted(answers, key=lambda a: a["bucket"])), np.float32)
                scores = np.bincount(text, np.repeat(log_p, np.diff(np.flatnonzero(first), append=len(codes))), len(starts))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(rids, np.int64)), pa.array(np.frombuffer(parts, np.int32)), pa.array(scores)], names=["rid", "part", "score"])

    requests = slices.select("slice", "sizes", "data").mapInArrow(ask, "bucket long, slice long, codes binary")
    parts_of_model = model.mapInArrow(bucketed, "bucket long, code long, log_p float")
    answers = parts_of_model.groupBy("bucket").cogroup(requests.groupBy("bucket")).applyInArrow(_answer, "slice long, bucket long, log_p binary")
    tasks = max(1, -(-slices.count() // TASK_SLICES))
    gathered = answers.repartition(tasks, "slice").groupBy("slice").agg(F.collect_list(F.struct("bucket", "log_p")).alias("answers"))  # a row for each bucket
    each = slices.repartition(tasks, "slice").join(gathered, "slice").select("rids", "parts", "sizes", "data", "answers").mapInArrow(total, "rid long, part int, score double")
    # Rows of equal rid have equal texts and so equal parts.
    whole = F.aggregate(F.array_sort(F.collect_set(F.struct("part", "score"))), F.lit(0.0), lambda a, x: a + x["score"])
    out = stash(each.groupBy("rid").agg(whole.alias("score")), "text-scores")
    release(rows.sparkSession, slices)
    return out


# ---- unigram base ----


def _slices(batch: pa.RecordBatch):
    """The batch in runs of rows of about _PIECE bytes of text."""
    ends = np.cumsum(pa.compute.binary_length(batch.column("text").cast(pa.large_binary())).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PIECE, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _name(batch: pa.RecordBatch) -> tuple[int, bytes]:
    """The name of a slice, a hash of its rows, and the rows."""
    rids = batch.column("rid").to_numpy(zero_copy_only=False).tobytes()
    return xxhash.xxh64_intdigest(rids) - (1 << 63), rids


def _token_counts(batches):
    """(token, n) over the training texts of a task, ends included."""
    found, ends = Counter(), 0

    def out():
        keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in found), np.uint64, len(found)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(found.values(), np.int64, len(found)))], names=["token", "n"])

    for batch in batches:
        for text in batch.column("text"):
            found.update(_bytes(text.as_py()).split())
            ends += 1
            if len(found) >= HELD // 4:
                yield out()
                found.clear()
    yield out()
    yield pa.RecordBatch.from_arrays([pa.array(np.array([_END_TOKEN], np.uint64).view(np.int64)), pa.array([ends], pa.int64())], names=["token", "n"])


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, how often, and in which row of the batch, for the different tokens of each row."""
    hashes, times, sizes = [], [], []
    for text in batch.column("text"):
        words = Counter(_bytes(text.as_py()).split())
        sizes.append(len(words) + 1)
        # Hashing a word is faster than finding its hash in a large dictionary.
        hashes += [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), np.array([_END_TOKEN], np.uint64)]
        times += [np.fromiter(words.values(), np.int64, len(words)), np.ones(1, np.int64)]
    return np.concatenate(hashes), np.concatenate(times), np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)


def _at(token: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token stands in a sorted array, and whether it does."""
    at = np.minimum(np.searchsorted(known, token), max(0, len(known) - 1))
    return at, known[at] == token if len(known) else np.zeros(len(token), bool)


_REPLY = "slice long, rids binary, which binary, log_counts binary, n_known binary, n_tokens binary"


def _frequent(sent):
    """Each slice's sums over its frequent tokens."""

    def reply(batch):
        token, n, doc = _tokens(batch)
        known, counts = sent.value
        at, mine = _at(token, known)
        size, c = batch.num_rows, counts[at[mine]]
        name, rids = _name(batch)
        sums = (np.bincount(doc[mine], n[mine] * np.log10(c + 1), minlength=size), np.bincount(doc[mine], n[mine] * (c > 0), minlength=size).astype(np.int32), np.bincount(doc, n, minlength=size).astype(np.int32))
        row = (rids, np.arange(size, dtype=np.uint32).tobytes(), *(x.tobytes() for x in sums))
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=["slice", "rids", "which", "log_counts", "n_known", "n_tokens"])

    return lambda batches: (reply(piece) for batch in batches for piece in _slices(batch))


def _send(sent, buckets: int):
    """The rarer tokens of each slice, packed by bucket."""

    def packed(batch):
        token, n, doc = _tokens(batch)
        rare = ~_at(token, sent.value[0])[1]
        token, n, doc = token[rare], n[rare].astype(np.uint32), doc[rare]
        train = batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
        bucket = (token % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable")
        token, n, doc, bucket = token[order], n[order], doc[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        name, _ = _name(batch)
        columns = {k: [] for k in ("bucket", "slice", "which", "train", "tokens", "docs", "times")}
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=False):
            which, local = np.unique(doc[a:b], return_inverse=True)
            row = (int(bucket[a]), name, which.tobytes(), train[which].tobytes(), token[a:b].tobytes(), local.astype(np.uint32).tobytes(), n[a:b].tobytes())
            for column, x in zip(columns, row, strict=True):
                columns[column].append(x)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("bucket", "slice") else pa.binary()) for k, v in columns.items()], names=list(columns))

    return lambda batches: (packed(piece) for batch in batches for piece in _slices(batch))


def _tally(table: pa.Table) -> pa.Table:
    """One bucket: for each blob its documents' sums over their tokens."""
    rows = table.to_pylist()
    sizes = [len(r["train"]) for r in rows]
    ahead = np.concatenate([[0], np.cumsum(sizes)])
    read = lambda column, kind: np.concatenate([np.frombuffer(r[column], kind) for r in rows])
    token, n, train = read("tokens", np.uint64), read("times", np.uint32), read("train", np.uint8)
    doc = np.concatenate([np.frombuffer(r["docs"], np.uint32) + np.int64(a) for r, a in zip(rows, ahead, strict=False)])
    distinct, which = np.unique(token, return_inverse=True)
    c = np.bincount(which, n * train[doc].astype(np.float64), minlength=len(distinct))
    mine, end = c[which], int(ahead[-1])
    log_counts = np.bincount(doc, n * np.log10(mine + 1), minlength=end)
    n_known = np.bincount(doc, n * (mine > 0), minlength=end).astype(np.int32)
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ahead, ahead[1:], strict=False)], pa.binary())
    none = pa.nulls(len(rows), pa.binary())
    return pa.table({"slice": pa.array([r["slice"] for r in rows], pa.int64()), "rids": none, "which": pa.array([r["which"] for r in rows], pa.binary()), "log_counts": cut(log_counts), "n_known": cut(n_known), "n_tokens": none})


def _gather(table: pa.Table) -> pa.Table:
    """One slice in all its buckets: each row's sums. Slices with the same rows, in the same order, share a name: each
    sends the same, so what comes is divided by their number."""
    rows = table.to_pylist()
    heads = [r for r in rows if r["rids"] is not None]
    rids = np.frombuffer(heads[0]["rids"], np.int64)
    log_counts, n_known = np.zeros(len(rids)), np.zeros(len(rids), np.int64)
    for r in rows:
        which = np.frombuffer(r["which"], np.uint32)
        log_counts[which] += np.frombuffer(r["log_counts"], np.float64)
        n_known[which] += np.frombuffer(r["n_known"], np.int32)
    return pa.table({"rid": rids, "log_counts": log_counts / len(heads), "n_known": n_known // len(heads), "n_tokens": np.frombuffer(heads[0]["n_tokens"], np.int32).astype(np.int64)})


def token_sums(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """rows(rid, text, train) -> (rid, log_counts, n_known, n_tokens), one for each rid; V and N."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    counted = stash(rows.filter("train").select("text").mapInArrow(_token_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n > 0"), "tokens")
    types, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = counted.filter((F.col("n") * HOT > total) | (F.col("token") == int(np.array(_END_TOKEN, np.uint64).view(np.int64)))).toArrow()  # HOT rows at most
    token, n = hot.column("token").to_numpy().view(np.uint64), hot.column("n").to_numpy().astype(np.float64)
    if _END_TOKEN not in token:  # nothing to learn from
        token, n = np.append(token, np.uint64(_END_TOKEN)), np.append(n, 0.0)
    order = np.argsort(token)
    sent = rows.sparkSession.sparkContext.broadcast((token[order], n[order]))
    replies = rows.mapInArrow(_send(sent, buckets), "bucket long, slice long, which binary, train binary, tokens binary, docs binary, times binary").groupBy("bucket").applyInArrow(_tally, _REPLY)
    every = rows.select("rid", "text").mapInArrow(_frequent(sent), _REPLY).union(replies)
    gathered = every.groupBy("slice").applyInArrow(_gather, "rid long, log_counts double, n_known long, n_tokens long")
    # Rows of equal rid have equal texts.
    sums = gathered.groupBy("rid").agg(*(F.min(c).alias(c) for c in ("log_counts", "n_known", "n_tokens")))
    return stash(sums, "token-sums"), types, total


# ---- both ----


def score(docs: DataFrame, train) -> DataFrame:
    """doc_id, train, n_bytes, n_tokens, n_known, train_tokens, base_score, score; train: the condition to learn from a row."""
    rows = docs.select("doc_id", whole_text().alias("text"), train.alias("train"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    model = fit_tree(rows)
    scores = text_scores(rows, model)
    release(docs.sparkSession, model)
    sums, types, tokens = token_sums(rows.select("rid", "text", "train"))
    each = rows.select("doc_id", "rid", "train", F.octet_length("text").cast("long").alias("n_bytes")).join(scores, "rid").join(sums, "rid")
    base = F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(tokens + types + 1)))
    return each.select("doc_id", "train", "n_bytes", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", FOLDS) == HELD_OUT
    found = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out)
    bits = -F.col("score") / F.lit(float(np.log10(2))) / (F.col("n_bytes") + 1)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))
