"""Ranked retrieval for whole frames of queries: BM25, cosine, rank fusion, decay, collapsing, MMR, snippets."""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewater.functions.text import FOLDED, TOKEN, folded_tokens, fresh_intent, tokens
from tidewater.storage import dealt, stash

K1, B, TITLE_WEIGHT = 1.5, 0.75, 3
CANDIDATES, RRF_K, RERANK_TOP, POOL, LAMBDA = 100, 60, 50, 30, 0.7
HALF_LIFE, FRESH_HALF_LIFE, FLOOR = 30.0, 2.0, 0.5
SNIPPET = 200
#: Vectors that are asked for in one matrix product, and in one pass; questions, and their tokens, that are in one pass.
QUERY_BLOCK, VECTOR_QUERIES, WORD_QUERIES, WORD_TOKENS = 256, 8192, 32768, 1 << 21
#: Postings that a task holds; questions that it scores at once, and those that share a matrix; part of the pairs of these
#: questions and the articles from which a token is a row of the matrix; cells that it has at most.
CHUNK, ABREAST, ALIKE, DENSE, CELLS = 1 << 22, 64, 256, 0.01, 1 << 23
#: Tokens by which questions are sorted, and directions in which these are looked at.
FREQUENT, DIRECTIONS = 128, 3
#: Bytes of text that are tokenised at once.
PIECE = 1 << 19
#: Chunks that a task works off one after another; queries whose best articles are put together at once.
TASK_CHUNKS, TOGETHER = 4, 64


def _words(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", folded_tokens(F.col("title")).alias("in_title"), folded_tokens(F.col("body")).alias("in_body"))


def _length(title_weight: int) -> Column:
    return title_weight * F.size("in_title") + F.size("in_body")


def _occurrences(words: DataFrame, title_weight: int, *more: str) -> DataFrame:
    """A row for each token of each article, with its weight; every text is tokenised once."""
    weighed = lambda c, w: F.transform(c, lambda t: F.struct(t.alias("token"), F.lit(w).alias("w")))
    both = F.concat(weighed("in_title", title_weight), weighed("in_body", 1))
    return words.select("article_id", *more, F.explode(both).alias("o")).select("article_id", *more, "o.token", "o.w")


def postings(articles: DataFrame, title_weight: int = TITLE_WEIGHT) -> DataFrame:
    """article_id, token, tf: title tokens count title_weight times."""
    return _occurrences(_words(articles), title_weight).groupBy("article_id", "token").agg(F.sum("w").alias("tf"))


def lengths(articles: DataFrame, title_weight: int = TITLE_WEIGHT) -> DataFrame:
    return _words(articles).select("article_id", _length(title_weight).alias("dl"))


def top(ranked: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best of each query, ties by id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "article_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@functools.cache
def _letters(jvm) -> np.ndarray:
    """For each code point of a lowered text what folded_tokens() makes of it: a letter, 0 where it goes (a mark), a space
    where it parts words; by the JVM's own classes. Planes 4 to 13 are not assigned, 15 and 16 are for private use."""
    every = "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000))))
    points = lambda x: np.frombuffer(x.encode("utf-32-le"), np.uint32)
    without = lambda x: points(jvm.java.util.regex.Pattern.compile(x).matcher(every).replaceAll(""))
    table = np.full(0x110000, ord(" "), np.uint32)
    of_token, marks = without(f"[^{TOKEN[1:-2]}]"), without(r"\P{M}")
    table[of_token], table[marks] = of_token, 0
    table[points(FOLDED[0])] = table[points(FOLDED[1])]
    return table


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _plain_ids(ids: pa.Array) -> np.ndarray:
    return ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else np.array(ids.to_pylist())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an odd number, and of its inverse, by 2 ** 64."""
    odd = 0x9E3779B97F4A7C15
    return tuple(np.cumprod(np.full(n, x, np.uint64)) for x in (odd, pow(odd, -1, 1 << 64)))


def _hashed(texts: pa.Array, value: np.ndarray, powers: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of the lowered texts, and the text of each. value: for each code point a number, 0 where it
    goes and 1 where it parts words. A hash is the sum of the letters' numbers, each times a power that counts its place:
    a difference of running sums over all texts, brought to the same power. powers: _powers(), made anew if too few."""
    flat, ends = b"".join(texts.to_pylist()), np.cumsum(pc.binary_length(texts).to_numpy())
    x = np.frombuffer(flat, np.uint8)
    if not flat.isascii():
        ends = np.concatenate([[0], np.cumsum((x & 0xC0) != 0x80)])[ends]
        x = np.frombuffer(flat.decode().encode("utf-32-le"), np.uint32)
    x = value[x]
    if not (stays := x > 0).all():
        ends, x = np.concatenate([[0], np.cumsum(stays)])[ends], x[stays]
    inside = x > 1
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = ends[ends < len(x)]  # where a text begins, so does a token
    begins[heads] = inside[heads]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    power, inverse = powers if powers and len(powers[0]) >= len(x) else _powers(len(x))
    x *= power[: len(x)]
    sums = np.cumsum(x)
    return (sums[last] - sums[first] + x[first]) * inverse[first], np.searchsorted(ends, first, "right")


def _counted(titles: pa.Array, bodies: pa.Array, value: np.ndarray, title_weight: int, powers: tuple | None = None) -> tuple[np.ndarray, ...]:
    """Lengths of the articles, and for each its different tokens with their weighed counts: those of article k are at
    ends[k] to ends[k + 1]."""
    (title, of_title), (body, of_body) = (_hashed(x, value, powers) for x in (titles, bodies))
    n_title, n_body = (np.bincount(x, minlength=len(titles)) for x in (of_title, of_body))
    bounds = np.concatenate([[0], np.cumsum(n_title + n_body)])
    every = np.empty(bounds[-1], np.uint64)  # the last bit: in the title
    every[np.arange(len(title)) + np.concatenate([[0], np.cumsum(n_body)])[of_title]] = title | np.uint64(1)
    every[np.arange(len(body)) + np.cumsum(n_title)[of_body]] = body & ~np.uint64(1)
    for a, b in itertools.pairwise(bounds.tolist()):
        every[a:b].sort()
    token, weight = (every >> np.uint64(1)).view(np.int64), np.where(every & np.uint64(1), title_weight, 1)
    once = np.concatenate([[True], token[1:] != token[:-1]])[: len(token)]
    once[bounds[:-1][n_title + n_body > 0]] = True
    at = np.flatnonzero(once)
    tfs = np.add.reduceat(weight, at) if len(at) else weight
    return title_weight * n_title + n_body, np.concatenate([[0], np.cumsum(once)])[bounds], token[at], tfs


def forward_index(articles: DataFrame, title_weight: int = TITLE_WEIGHT, packed: bool = False) -> DataFrame:
    """article_id, dl, tokens (hashes of 63 bits), tfs: the tokens of folded_tokens(), counted where the text is. packed:
    the numbers of both lists as bytes, which Spark passes on as a whole; _unpacked() makes lists of them."""
    sent = articles.sparkSession.sparkContext.broadcast(_letters(articles.sparkSession.sparkContext._jvm))  # 4.5 MB

    def counted(batches):
        letters = sent.value
        value = np.where(letters == ord(" "), np.uint64(1), np.where(letters == 0, np.uint64(0), _mixed(letters) | np.uint64(2)))
        powers = _powers(2 * PIECE)
        for batch in batches:
            title, body = (batch.column(c).fill_null(b"") for c in ("title", "body"))
            size = np.cumsum(pc.binary_length(title).to_numpy().astype(np.int64) + pc.binary_length(body).to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(size // PIECE)) + 1).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                dl, ends, tokens, tfs = _counted(title.slice(a, b - a), body.slice(a, b - a), value, title_weight, powers)
                lists = [_bytes_of(ends, x) if packed else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (tokens, tfs.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column("article_id").slice(a, b - a), pa.array(dl, pa.int64()), *lists], names=["article_id", "dl", "tokens", "tfs"])

    kind = articles.schema["article_id"].dataType.simpleString()
    lowered = lambda c: F.lower(c).cast("binary").alias(c)
    lists = "tokens binary, tfs binary" if packed else "tokens array<long>, tfs array<int>"
    return articles.select("article_id", lowered("title"), lowered("body")).mapInArrow(counted, f"article_id {kind}, dl long, {lists}")


def _bytes_of(ends: np.ndarray, x: np.ndarray) -> pa.Array:
    """A value of bytes for each of the lists of numbers that are at ends[k] to ends[k + 1]."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _lists_of(packed: pa.Array, kind: type) -> pa.ListArray:
    """The lists of numbers that _bytes_of() packed."""
    _, ends, flat = packed.buffers()
    ends = np.frombuffer(ends, np.int32)[packed.offset : packed.offset + len(packed) + 1] if len(packed) else np.zeros(1, np.int32)
    x = np.frombuffer(flat if flat is not None else b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]) // x.itemsize, pa.int32()), pa.array(x))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"tokens": np.int64, "tfs": np.int32}
    for batch in batches:
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([_lists_of(batch.column(c), kinds[c]) if c in kinds else batch.column(c) for c in names], names=names)


def _blocks(rows: DataFrame) -> Iterator[list]:
    """The rows in blocks of VECTOR_QUERIES; one partition at a time comes to the driver."""
    every = rows.toLocalIterator()
    while block := list(itertools.islice(every, VECTOR_QUERIES)):
        yield block


def _each_block(blocks, run, schema: str, spark) -> DataFrame:
    """The union of run(block) over all blocks; every result but a single one is written, so that no block waits in memory."""
    found = [run(block) for block in itertools.islice(blocks, 1)]
    for block in blocks:
        found = [stash(found[0], "ranked")] if len(found) == 1 and not hasattr(found[0], "stash_path") else found
        found.append(stash(run(block), "ranked"))
    return functools.reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def _best(scores: np.ndarray, ids: np.ndarray, k: int, least: float) -> list[np.ndarray]:
    """For each column the rows of the k best scores above least, ties by id."""
    out = []
    for c in scores.T:
        some = np.flatnonzero(c > least)
        if len(some) > k:
            some = some[c[some] >= np.partition(c[some], len(some) - k)[len(some) - k]]
        out.append(some[np.lexsort((ids[some], -c[some]))][:k])
    return out


def _ranked_batch(names: list, scores: np.ndarray, batch: pa.RecordBatch, k: int, least: float) -> pa.RecordBatch:
    scores = np.round(scores, 9)
    rows = _best(scores, _plain_ids(batch.column("article_id")), k, least)
    at, which = np.concatenate(rows), np.repeat(np.arange(len(names)), [len(r) for r in rows])
    return pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(which)), batch.column("article_id").take(pa.array(at)), pa.array(scores[at, which])], names=["query_id", "article_id", "score"])


def _word_blocks(words: DataFrame) -> Iterator[list[tuple]]:
    """Queries as (query_ids, tokens, how often) in order of tokens, those of the same words as one, in blocks of
    WORD_QUERIES (four times as many ids) and WORD_TOKENS at most (but one)."""
    block, held, ids = {}, 0, 0
    for q in words.toLocalIterator():
        tokens, qtf = np.array(q["tokens"], np.int64), np.array(q["qtfs"], np.int64)
        order = np.argsort(tokens)
        tokens, qtf = tokens[order], qtf[order]
        same = tokens.tobytes(), qtf.tobytes()
        if block and (ids >= 4 * WORD_QUERIES or same not in block and (len(block) >= WORD_QUERIES or held + len(tokens) > WORD_TOKENS)):
            yield list(block.values())
            block, held, ids = {}, 0, 0
        if same not in block:
            block[same] = [], tokens, qtf.astype(np.float64)
            held += len(tokens)
        block[same][0].append(q["query_id"])
        ids += 1
    if block:
        yield list(block.values())


def _neighbours(tokens: list[np.ndarray]) -> np.ndarray:
    """An order of the queries in which those with the same frequent tokens are near each other, shorter ones first: by
    the side on which they lie in the directions in which they differ most."""
    every, sizes = np.concatenate(tokens), np.array([len(t) for t in tokens])
    known, place, asked = np.unique(every, return_inverse=True, return_counts=True)
    column = np.full(len(known), -1)
    column[np.argsort(-asked, kind="stable")[:FREQUENT]] = np.arange(min(FREQUENT, len(known)))
    at, query = column[place], np.repeat(np.arange(len(tokens)), sizes)
    x = np.zeros((len(tokens), FREQUENT))
    x[query[at >= 0], at[at >= 0]] = 1
    x /= np.maximum(1, np.linalg.norm(x, axis=1, keepdims=True))
    x -= x.mean(axis=0)
    sides = x @ np.linalg.eigh(x.T @ x)[1][:, -DIRECTIONS:] > 0
    return np.lexsort((sizes, *sides.T))


def _found_in(index: DataFrame, known: np.ndarray) -> np.ndarray:
    """For each of the known tokens, which are sorted, the number of articles that have it."""
    sent = index.sparkSession.sparkContext.broadcast(known)

    def counted(batches):
        n, value_set = np.zeros(len(sent.value), np.int64), pa.array(sent.value)
        for batch in _unpacked(batches):
            n += np.bincount(pc.index_in(batch.column("tokens").flatten(), value_set=value_set).drop_null().to_numpy(), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["place", "n"])

    found = index.select("tokens").mapInArrow(counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(known), np.int64)
    out[found["place"].to_numpy()] = found["n"].to_numpy()
    return out


def _inverted(batches: Iterator[pa.RecordBatch], known: np.ndarray, idf: np.ndarray, mean: float) -> Iterator[tuple]:
    """Counted articles, some CHUNK postings at a time, as ids and for each known token the articles and what it adds to
    their scores: those of token t are at bounds[t] to bounds[t + 1]."""
    value_set = pa.array(known)

    def turned(parts):
        ids, token, doc, gain = (np.concatenate(x) for x in zip(*parts, strict=True))
        # Stable sorts of 16 bits are radix sorts; articles are in order already.
        order = np.argsort((token & 0xFFFF).astype(np.uint16), kind="stable")
        for shift in range(16, max(1, len(known)).bit_length(), 16):
            order = order[np.argsort(((token >> shift) & 0xFFFF).astype(np.uint16)[order], kind="stable")]
        return ids, np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(known)))]), doc[order], gain[order]

    parts, docs, held = [], 0, 0
    for batch in batches:
        tokens = batch.column("tokens")
        doc = np.repeat(np.arange(batch.num_rows), tokens.value_lengths().to_numpy())
        place = pc.index_in(tokens.flatten(), value_set=value_set)
        hit = place.is_valid().to_numpy(zero_copy_only=False)
        token, doc = place.drop_null().to_numpy().astype(np.int64), doc[hit]
        tf = batch.column("tfs").flatten().to_numpy()[hit].astype(np.float64)
        gain = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * batch.column("dl").to_numpy() / mean))[doc]) * idf[token]
        parts.append((_plain_ids(batch.column("article_id")), token, doc + docs, gain))
        docs, held = docs + batch.num_rows, held + len(token)
        if held >= CHUNK or docs >= CHUNK >> 5:
            yield turned(parts)
            parts, docs, held = [], 0, 0
    if held:
        yield turned(parts)


def _best_by_words(batches: Iterator[pa.RecordBatch], names: list, starts: np.ndarray, at: np.ndarray, qtf: np.ndarray, known: np.ndarray, idf: np.ndarray, mean: float, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of the articles for each query, ties by id. Tokens of the query q are at[starts[q] : starts[q + 1]]. Of
    ALIKE queries, the tokens that make a DENSE part of the pairs are added as a matrix product, the others posting by posting."""
    found = [(np.zeros(0), None)] * len(names)
    for ids, bounds, docs, gains in _inverted(batches, known, idf, mean):
        n, size = len(ids), np.diff(bounds)
        row = np.full(len(known), -1)
        for low in range(0, len(names), ABREAST):
            some = range(low, min(low + ABREAST, len(names)))
            if low % ALIKE == 0:
                near = min(low + ALIKE, len(names))
                often, asked = np.unique(at[starts[low] : starts[near]], return_counts=True)
                pairs = asked * size[often]
                first = np.argsort(-pairs, kind="stable")[: max(1, CELLS // n)]
                often = often[first][(pairs[first] > 0) & (pairs[first] >= DENSE * (near - low) * n)]
                row[:] = -1
                row[often] = np.arange(len(often))
                dense = np.zeros((len(often), n))
                for r, t in enumerate(often.tolist()):
                    dense[r, docs[bounds[t] : bounds[t + 1]]] = gains[bounds[t] : bounds[t + 1]]
            t, which = at[starts[low] : starts[some[-1] + 1]], np.repeat(np.arange(len(some)), np.diff(starts[low : some[-1] + 2]))
            asks = np.zeros((len(some), len(often)))
            asks[which[row[t] >= 0], row[t][row[t] >= 0]] = qtf[starts[low] : starts[some[-1] + 1]][row[t] >= 0]
            scores = asks @ dense
            for total, q in zip(scores, some, strict=True):
                t, times = at[starts[q] : starts[q + 1]], qtf[starts[q] : starts[q + 1]]
                rare = (row[t] < 0) & (size[t] > 0)
                if rare.any():
                    t, times = t[rare], times[rare]
                    cuts = list(zip(bounds[t].tolist(), bounds[t + 1].tolist(), strict=True))
                    add = np.concatenate([gains[a:b] for a, b in cuts])
                    if (times != 1).any():
                        add *= np.repeat(times, size[t])
                    total += np.bincount(np.concatenate([docs[a:b] for a, b in cuts]), add, minlength=n)
                best, which = found[q]
                # Scores are rounded only once there are few; the margin is wider than the rounding. At first, the
                # k-th best of every eighth article is a lower bound of that of all.
                part = total[::8] if n > 16 * k else total
                least = best[-1] if len(best) == k else np.partition(part, len(part) - k)[len(part) - k] if len(part) > k else 0.0
                rows = np.flatnonzero(total >= least - 1e-9) if least > 1e-9 else np.flatnonzero(total)
                if not len(rows):
                    continue
                new, who = total[rows], ids[rows]
                if len(new) > k:
                    near = new >= np.partition(new, len(new) - k)[len(new) - k] - 1e-9
                    new, who = new[near], who[near]
                new = np.round(new, 9)
                if len(best):
                    new, who = np.concatenate([best, new]), np.concatenate([which, who])
                order = np.lexsort((who, -new))[:k]
                found[q] = new[order], who[order]
    for low in range(0, len(names), WORD_QUERIES // 16):
        part = [(q, *found[q]) for q in range(low, min(low + WORD_QUERIES // 16, len(names))) if len(found[q][0])]
        if part:
            score, which = (np.concatenate(x) for x in list(zip(*part, strict=True))[1:])
            query = pa.array(names).take(pa.array(np.repeat([q for q, _, _ in part], [len(x) for _, x, _ in part])))
            out = pa.RecordBatch.from_arrays([query, pa.array(which.tolist() if which.dtype == object else which), pa.array(score)], names=["query_id", "article_id", "score"])
            yield out.filter(pa.array(score > 0))


def bm25(queries: DataFrame, articles: DataFrame, k: int = CANDIDATES, allowed: DataFrame | None = None, title_weight: int = TITLE_WEIGHT) -> DataFrame:
    """query_id, article_id, score, rank. Document frequencies and lengths are those of all articles; allowed
    (article_id) restricts what is scored. Queries are worked off in blocks of WORD_QUERIES, one pass over the counted
    articles for each; a task turns its articles into postings, CHUNK of them at a time, adds up those that a query asks
    for and keeps the k best, so no pair of query and article is shuffled."""
    spark = articles.sparkSession
    index = stash(forward_index(articles, title_weight, packed=True), "forward")
    words = forward_index(queries.select(F.col("query_id").alias("article_id"), F.col("text").alias("title"), F.lit("").alias("body")), 1)
    asked = words.select(F.col("article_id").alias("query_id"), F.explode(F.arrays_zip("tokens", "tfs")).alias("w")).groupBy("query_id", F.col("w.tokens").alias("token")).agg(F.sum("w.tfs").alias("qtf"))
    asked = asked.groupBy("query_id").agg(F.collect_list(F.struct("token", "qtf")).alias("w")).select("query_id", F.col("w.token").alias("tokens"), F.col("w.qtf").alias("qtfs"))
    n, mean, postings = index.agg(F.count("*"), F.avg("dl"), F.sum(F.octet_length("tfs") / 4)).first()
    # Every task hands out its k best of each query, so there are no more tasks than keep all cores at work.
    cores = spark.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-int(postings or 0) // (TASK_CHUNKS * CHUNK * cores)))
    rows = dealt(index, tasks)
    rows = rows.filter("article_id is not null") if allowed is None else rows.join(allowed, "article_id", "left_semi").coalesce(tasks + 1)
    rows = rows.select("article_id", "dl", "tokens", "tfs")
    of_query, of_article = (x.schema[c].dataType.simpleString() for x, c in ((queries, "query_id"), (articles, "article_id")))
    kind = f"query_id {of_query}, article_id {of_article}, score double, rank int"

    def run(block):
        names, tokens, qtf = zip(*(block[i] for i in _neighbours([tokens for _, tokens, _ in block])), strict=True)
        known, at = np.unique(np.concatenate(tokens), return_inverse=True)
        df = _found_in(index, known)
        starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        each = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        sent = spark.sparkContext.broadcast((list(itertools.chain(*names)), each, starts, at, np.concatenate(qtf), known, np.log((n - df + 0.5) / (df + 0.5) + 1), mean or 1.0, k))  # WORD_TOKENS tokens

        def packed(batches):
            for found in _best_by_words(_unpacked(batches), list(range(len(sent.value[1]) - 1)), *sent.value[2:]):
                query = found.column("query_id").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(query // TOGETHER)) + 1).tolist(), len(query)]
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), x) for x in found.columns]
                yield pa.RecordBatch.from_arrays([pa.array(query[cuts[:-1]] // TOGETHER), *lists], names=["part", "query", "article_id", "score"])

        def merged(t: pa.Table) -> pa.Table:
            query, score = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("query", "score"))
            ids = t.column("article_id").combine_chunks().flatten()
            order = np.lexsort((_plain_ids(ids), -score, query))
            firsts = np.flatnonzero(np.diff(query[order], prepend=-1))
            rank = np.arange(len(order)) - np.repeat(firsts, np.diff(firsts, append=len(order)))
            order, rank = order[rank < k], rank[rank < k]
            # A row for each query of these words.
            of, each = query[order], sent.value[1]
            copies = np.diff(each)[of]
            name = np.repeat(each[of] - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())
            order, rank = np.repeat(order, copies), np.repeat(rank, copies)
            return pa.table({"query_id": pa.array(sent.value[0]).take(pa.array(name)), "article_id": ids.take(pa.array(order)), "score": score[order], "rank": pa.array(rank + 1, pa.int32())})

        return rows.mapInArrow(packed, f"part long, query array<long>, article_id array<{of_article}>, score array<double>").groupBy("part").applyInArrow(merged, kind)

    return _each_block(_word_blocks(asked), run, kind, spark)


def bm25_indexed(queries: DataFrame, posted: DataFrame, sizes: DataFrame, k: int = CANDIDATES, allowed: DataFrame | None = None) -> DataFrame:
    """bm25() from stored postings(article_id, token, tf) and lengths(article_id, dl): no text is read. Postings that
    are written in order of tokens are pruned to the files that can hold those asked for."""
    asked = _asked(queries)
    found = posted.join(asked.select("token").distinct(), "token", "left_semi").join(sizes, "article_id")
    return _scored(asked, found, sizes, k, allowed)


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(folded_tokens(F.col("text"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def _scored(asked: DataFrame, found: DataFrame, sizes: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
    """found(article_id, token, tf, dl) -> the k best of each query."""
    stats = sizes.agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg("dl"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
    df = found.groupBy("token").agg(F.count("*").alias("df"))
    scored = found.join(asked.join(df, "token").crossJoin(stats), "token")  # stats: one row
    if allowed is not None:
        scored = scored.join(allowed, "article_id", "left_semi")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return top(scored.groupBy("query_id", "article_id").agg(F.round(F.sum(gain), 9).alias("score")).filter("score > 0"), k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, allowed: DataFrame | None = None) -> DataFrame:
    """queries(query_id, vector), vectors(article_id, embedding): each query against all vectors, as matrix products of
    QUERY_BLOCK queries, one pass over the vectors for VECTOR_QUERIES; a task keeps the k best of its batches. A zero or
    missing query vector finds nothing, a zero vector scores 0; vectors of another length than the queries' are an error."""
    spark = vectors.sparkSession
    rows = vectors.filter("embedding is not null")
    rows = rows if allowed is None else rows.join(allowed, "article_id", "left_semi")
    asked = queries.select("query_id", "vector").filter("vector is not null")
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, article_id {vectors.schema['article_id'].dataType.simpleString()}, score double"

    def run(block):
        matrix = np.array([q["vector"] for q in block], np.float64)
        sizes = np.linalg.norm(matrix, axis=1)
        names = [q["query_id"] for q, size in zip(block, sizes, strict=True) if size]
        sent = spark.sparkContext.broadcast((names, matrix[sizes > 0] / sizes[sizes > 0, None]))  # VECTOR_QUERIES queries

        def score(batches):
            names, asked = sent.value
            for batch in batches:
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                if len(flat) != batch.num_rows * asked.shape[1]:
                    raise ValueError(f"vectors are not all of {asked.shape[1]} dimensions, as the queries are")
                v = flat.reshape(batch.num_rows, -1)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v /= np.where(size > 0, size, 1.0)
                for low in range(0, len(names) if batch.num_rows else 0, QUERY_BLOCK):
                    some = slice(low, low + QUERY_BLOCK)
                    yield _ranked_batch(names[some], (asked[some] @ v.T).T, batch, k, -np.inf)

        return rows.select("article_id", "embedding").mapInArrow(score, kind)

    return top(_each_block(_blocks(asked), run, kind, spark), k)


def rrf(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, article_id, score: sum of 1 / (k + rank) over the rankings that hold the article."""
    part = lambda r, name: r.select("query_id", "article_id", (1 / (k + F.col("rank"))).alias(name))
    every = part(rankings[0], "score")
    for r in rankings[1:]:
        both = F.coalesce("score", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))
        every = every.join(part(r, "more"), ["query_id", "article_id"], "full").select("query_id", "article_id", both.alias("score"))
    return every.withColumn("score", F.round("score", 9))


def decay(published: Column, now: Column, half_life: Column | float = HALF_LIFE, floor: float = FLOOR) -> Column:
    """floor + (1 - floor) * 0.5 ** (age / half_life); a future date has age 0, no date or half-life no decay."""
    half = half_life if isinstance(half_life, Column) else F.lit(half_life)
    days = F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", published, now) / F.lit(86_400e6))
    return F.when(published.isNull() | (half <= 0), 1.0).otherwise(floor + (1 - floor) * F.pow(F.lit(0.5), days / half))


def rerank_by_place(ranked: DataFrame) -> DataFrame:
    """Order kept, score 1 / rank."""
    return ranked.withColumn("score", 1 / F.col("rank"))


def collapse(ranked: DataFrame, clusters: DataFrame, most: int = 1) -> DataFrame:
    """The first of each cluster by rank; articles without a cluster stand for themselves."""
    kept = ranked.join(clusters, "article_id", "left")
    own = F.coalesce(F.col("cluster_id").cast("string"), F.concat(F.lit("solo:"), F.col("article_id")))
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", own).orderBy("rank"))).filter(F.col("nth") <= most).drop("nth")


def mmr(ranked: DataFrame, vectors: DataFrame, k: int, pool: int = POOL, weight: float = LAMBDA) -> DataFrame:
    """query_id, article_id, rank: greedy maximal marginal relevance over the first pool rows of each query (so a
    group has pool rows at most). Relevance is the score between 0 and 1; a missing vector is like nothing."""
    first = Window.partitionBy("query_id").orderBy("rank")
    pooled = ranked.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= pool).join(vectors, "article_id", "left")

    def choose(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        score = t.column("score").to_numpy()
        spread = score.max() - score.min()
        relevance = (score - score.min()) / spread if spread > 1e-12 else np.ones(len(score))
        vector = [np.array(v, np.float64) if v is not None else None for v in t.column("embedding").to_pylist()]
        vector = [v / n if v is not None and (n := np.linalg.norm(v)) > 0 else None for v in vector]
        near, left, chosen = np.zeros(len(score)), list(range(len(score))), []
        while left and len(chosen) < k:
            best = max(left, key=lambda i: (weight * relevance[i] - (1 - weight) * near[i], -i))
            left.remove(best)
            chosen.append(best)
            for i in left:
                if vector[i] is not None and vector[best] is not None:
                    near[i] = max(near[i], float(vector[i] @ vector[best]))
        at = pa.array(chosen, pa.int64())
        return pa.table({"query_id": t.column("query_id").take(at), "article_id": t.column("article_id").take(at), "rank": pa.array(range(1, len(chosen) + 1), pa.int32())})

    kind = ranked.schema["article_id"].dataType.simpleString()
    return pooled.select("query_id", "article_id", F.col("nth").alias("rank"), F.col("score").cast("double"), "embedding").groupBy("query_id").applyInArrow(choose, f"query_id string, article_id {kind}, rank int")


_WORDS = re.compile(r"(\w+)")


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower().replace("đ", "d")) if not unicodedata.combining(c))


def make_snippet(body: str | None, words: set[str], most: int = SNIPPET, plain: Callable[[str], str] = _plain) -> str:
    """The part of the body with most matches in a row, in the middle of `most` characters; matches in <b>, dots where
    it is cut. Without a match, the head."""
    body = unicodedata.normalize("NFC", body or "")
    # What is no word, and words, by turns.
    parts = _WORDS.split(body.lower() if body.isascii() else body)
    folded = parts[1::2] if body.isascii() else (w.lower() if w.isascii() else plain(w) for w in parts[1::2])
    hits = [2 * k + 1 for k, w in enumerate(folded) if w in words]
    if not hits:
        return body[:most] + "..." * (len(body) > most)
    upto = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    begins, ends = upto[np.array(hits) - 1], upto[hits]
    spans = np.stack([begins, ends], axis=1)
    # Ends grow, so those that fit behind a match are a run.
    fitting = np.maximum(1, np.searchsorted(ends, begins + most, "right") - np.arange(len(spans)))
    best = int(np.argmax(fitting))
    wide = int(ends[best + fitting[best] - 1] - begins[best])
    low = max(0, int(begins[best]) - max(0, most - wide) // 2)
    high = min(len(body), low + most)
    low = max(0, high - most)
    edges = [low, *spans[(begins >= low) & (ends <= high)].ravel().tolist(), high]
    pieces = (f"<b>{body[a:b]}</b>" if k % 2 else body[a:b] for k, (a, b) in enumerate(itertools.pairwise(edges)))
    return "..." * (low > 0) + "".join(pieces) + "..." * (high < len(body))


@F.pandas_udf(StringType())
def snippet(body, query):
    plain = functools.lru_cache(1 << 16)(_plain)
    return body.combine(query, lambda b, q: make_snippet(b, {plain(w) for w in re.findall(r"[^\W_]+", q or "")}, plain=plain))


def search(
    queries: DataFrame, articles: DataFrame, vectors: DataFrame, clusters: DataFrame, now: Column, mode: str = "hybrid", k: int = 10, allowed: DataFrame | None = None, diversify: bool = True,
    index: tuple[DataFrame, DataFrame] | None = None, rerank=None,
) -> DataFrame:
    """queries(query_id, text, vector, and maybe expanded: the words to look for) -> the five fields of each result with its rank: retrieval, fusion, decay (faster
    where fresh news is asked for), the first RERANK_TOP re-ranked by place, one of each cluster, MMR, snippet.

    A query without a token finds nothing, in any mode. index gives stored postings and lengths in place of the texts;
    rerank(ranked, queries, articles) -> ranked takes the place of re-ranking by place."""
    if mode not in ("lexical", "semantic", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    queries = queries.filter(F.size(tokens(F.col("text"))) > 0)
    branches = []
    if mode != "semantic":
        words = queries.select("query_id", F.col("expanded").alias("text")) if "expanded" in queries.columns else queries
        branches.append(bm25_indexed(words, *index, CANDIDATES, allowed) if index else bm25(words, articles, CANDIDATES, allowed))
    if mode != "lexical":
        branches.append(cosine(queries, vectors, CANDIDATES, allowed))
    fused = rrf(*branches) if mode == "hybrid" else branches[0]
    half = F.when(fresh_intent(F.col("text")), FRESH_HALF_LIFE).otherwise(HALF_LIFE)
    dated = fused.select("query_id", "article_id", "score").join(articles.select("article_id", "published_at"), "article_id").join(queries.select("query_id", half.alias("half")), "query_id")
    ranked = top(dated.withColumn("score", F.round(F.col("score") * decay(F.col("published_at"), now, F.col("half")), 9)), RERANK_TOP).drop("published_at", "half")
    ranked = collapse(rerank(ranked, queries, articles) if rerank else rerank_by_place(ranked), clusters)
    final = mmr(ranked, vectors, k) if diversify else ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= k)
    texts = articles.select("article_id", "title", "url", "published_at", "body")
    return final.select("query_id", "article_id", "rank").join(texts, "article_id").join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
