"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of the benchmark items form one suffix automaton (each item inserted from the root). Documents
are streamed through it word by word: the state reached and the length carried along give the longest match that
ends at each word. Where that length reaches WINDOW, the last WINDOW words are an occurrence of an item's window;
an item of fewer words is found at its own state among the suffix links. Hit spans and the items they belong to
follow from that; spans_removed() cuts the spans and drops documents whose hit share passes a limit.

The automata are sent to the executors in blocks of BLOCK_WORDS item words, one pass over the texts for each. A pass
holds one automaton and leaves rows for the texts that it hits; the passes' rows meet by a hash of the text at the end.
So the memory of a task does not grow with the benchmark. Most benchmarks are one block: then there is one pass and
nothing is shuffled.

Defined results: null and empty texts have no words and no hits; items without words are ignored; equal items are all
reported; items without an id are hit as `None`; repeated documents are treated alike, those without an id like others;
very long texts are read whole, at some bytes a word; an empty benchmark hits nothing; an empty table gives an empty
result; extra columns, whatever their names, are kept where documents are returned and ignored elsewhere.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.patterns import new_name
from tidewater.storage import stash

WINDOW = 10
#: A document with more than this share of its words hit is dropped by spans_removed().
COVERAGE = 0.5
BLOCK_WORDS = 100_000

# Word bytes: digits, letters (A-Z lowered) and all bytes of non-ASCII characters; anything else parts words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences. windows: the items that hold the window which is a state; short: the
    items that are a state as a whole; shorts: of each state, those above it. What is sent to executors is `state`, plain
    values, from which of() makes it again."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.window = window
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._own(items)

    @property
    def state(self) -> dict:
        return self.__dict__

    @classmethod
    def of(cls, state: dict) -> Automaton:
        made = cls.__new__(cls)
        made.__dict__ = state
        return made

    def _state(self, length: int, link: int, edges: dict[bytes, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _clone(self, p: int, w: bytes, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: bytes) -> int:
        if (q := self.next[last].get(w)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def step(self, state: int, size: int, w: bytes) -> tuple[int, int]:
        while (to := self.next[state].get(w)) is None:
            state = self.link[state]
            if state < 0:
                return 0, 0
            size = self.length[state]
        return to, size + 1

    def at_length(self, state: int, size: int) -> int:
        """The state of the suffix of that length of the state's strings."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _own(self, items: list[tuple[object, list[bytes]]]) -> None:
        """Which items hold the window that ends at a state, and which short items are the suffix of a state."""
        self.windows: dict[int, set] = {}
        self.short: dict[int, tuple[int, list]] = {}
        for item, words in items:
            state = 0
            size = 0
            for w in words:
                state, size = self.step(state, size, w)
                if size >= self.window:
                    self.windows.setdefault(self.at_length(state, self.window), set()).add(item)
            if 0 < len(words) < self.window:
                at = self.at_length(state, len(words))
                self.short.setdefault(at, (len(words), []))[1].append(item)
        #: For each state the states above it (itself included) that are whole short items.
        self.shorts: dict[int, tuple[int, ...]] = {}
        if self.short:
            for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
                above = self.shorts.get(self.link[s], ())
                if s in self.short:
                    above = (*above, s)
                if above:
                    self.shorts[s] = above

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (first word, word behind the last; in order of their ends, maybe overlapping) and hit items."""
        spans, found = [], set()
        edges, link, length, window, shorts = self.next, self.link, self.length, self.window, self.shorts
        state = size = 0
        start = edges[0]
        for k, w in enumerate(words):
            if not state:
                if (to := start.get(w)) is None:
                    continue
                state, size = to, 1
            else:
                while (to := edges[state].get(w)) is None:
                    state = link[state]
                    if state < 0:
                        break
                    size = length[state]
                if state < 0:
                    state = size = 0
                    continue
                state, size = to, size + 1
            if size >= window:
                spans.append((k + 1 - window, k + 1))
                found |= self.windows.get(self.at_length(state, window), set())
            if state in shorts:
                for s in shorts[state]:
                    n, names = self.short[s]
                    if n <= size:
                        spans.append((k + 1 - n, k + 1))
                        found.update(names)
        return spans, found


def _blocks(benchmark: DataFrame):
    """Automata over consecutive items, BLOCK_WORDS words each (a longer item is a block of its own)."""
    block, n = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        if words and n + len(words) > BLOCK_WORDS and block:
            yield Automaton(block)
            block, n = [], 0
        if words:
            block.append((str(row["item_id"]), words))
            n += len(words)
    if block:
        yield Automaton(block)


def _search(automaton: Automaton, spark: SparkSession):
    """A function of one text: its number of words, the hit words as bytes of 0 and 1 (None: none hit), the items hit."""
    sent = spark.sparkContext.broadcast(automaton.state)

    def start():
        a = Automaton.of(sent.value)

        def search(text: str | None) -> tuple[int, bytes | None, list[str]]:
            words = words_of(text)
            spans, found = a.hits(words)
            if not spans:
                return len(words), None, []
            mask = np.zeros(len(words), np.uint8)
            for i, j in spans:
                mask[i:j] = 1
            return len(words), mask.tobytes(), sorted(found)

        return search

    return start, sent


def _text_hash() -> tuple[Column, Column]:
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def _hits_in_passes(docs: DataFrame, automata) -> DataFrame:
    """h1, h2 (the text), mask, items of the texts that any block hits; one pass and one table for each block."""
    spark = docs.sparkSession
    h1, h2 = _text_hash()
    every = None
    for automaton in automata:
        start, sent = _search(automaton, spark)

        def of(batches, start=start):
            search = start()
            for batch in batches:
                found = [search(x.as_py()) for x in batch.column("text")]
                at = pa.array([k for k, f in enumerate(found) if f[1]], pa.int64())
                masks, items = pa.array([f[1] for f in found if f[1]], pa.binary()), pa.array([f[2] for f in found if f[1]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("h1").take(at), batch.column("h2").take(at), masks, items], names=["h1", "h2", "mask", "items"])

        one = docs.select(h1.alias("h1"), h2.alias("h2"), "text").mapInArrow(of, "h1 long, h2 long, mask binary, items array<string>")
        # Equal texts have equal hits.
        one = stash(one.groupBy("h1", "h2").agg(F.first("mask").alias("mask"), F.first("items").alias("items")), "hits")
        sent.destroy()
        every = one if every is None else every.union(one)

    def joined(table: pa.Table) -> pa.Table:
        masks = [np.frombuffer(m, np.uint8) for m in table.column("mask").to_pylist()]
        items = sorted({i for x in table.column("items").to_pylist() for i in x})
        return pa.table({"h1": table.column("h1")[:1], "h2": table.column("h2")[:1], "mask": pa.array([np.bitwise_or.reduce(masks).tobytes()], pa.binary()), "items": pa.array([items], pa.list_(pa.string()))})

    return every.groupBy("h1", "h2").applyInArrow(joined, "h1 long, h2 long, mask binary, items array<string>")  # a row for each block at most


def _marked(docs: DataFrame, benchmark: DataFrame, finish, result) -> DataFrame:
    """finish(batch, n_words, masks, items) -> batch of the schema result, for all batches of docs."""
    spark = docs.sparkSession
    automata = _blocks(benchmark)
    first, second = next(automata, None), next(automata, None)
    if second is None:
        start, _ = _search(first or Automaton([]), spark)

        def whole(batches):
            search = start()
            for batch in batches:
                yield finish(batch, *zip(*map(search, batch.column("text").to_pylist()), strict=True)) if batch.num_rows else finish(batch, (), (), ())

        return docs.mapInArrow(whole, result)
    names = [new_name(docs, x) for x in ("h1", "h2", "mask", "items")]
    hits = _hits_in_passes(docs, itertools.chain((first, second), automata)).toDF(*names)
    columns = docs.columns
    keyed = docs.withColumns(dict(zip(names, _text_hash(), strict=False))).join(hits, names[:2], "left").drop(*names[:2])

    def parts(batches):
        for batch in batches:
            texts, masks, items = (batch.column(c).to_pylist() for c in ("text", *names[2:]))
            yield finish(batch.select(columns), [len(words_of(t)) for t in texts], masks, [i or [] for i in items])

    return keyed.select(*(F.col(f"`{c}`") for c in (*columns, *names[2:]))).mapInArrow(parts, result)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings)."""

    def count(batch, n_words, masks, items):
        hit = [sum(m) if m else 0 for m in masks]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _marked(docs.select("doc_id", "text"), benchmark, count, f"doc_id {kind}, n_words long, n_hit long, items array<string>")


# A word of the text as it stands, for cutting spans out.
_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def _without(text: str, mask: bytes) -> str:
    """The text without its hit words and what stands between neighbouring hit words."""
    out, at, inside = [], 0, False
    for word, hit in zip(_WORD.finditer(text), mask, strict=True):
        if hit and not inside:
            out.append(text[at : word.start()])
        if not hit and inside:
            at = word.start()
        elif hit:
            at = word.end()
        inside = bool(hit)
    return "".join(out) + text[at:]


def spans_removed(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents, hit spans cut out of their texts (n_chars follows); those with more than that share hit go."""

    def cut(batch, n_words, masks, items):
        keep = [m is None or sum(m) <= coverage * len(m) for m in masks]
        old = batch.column("text").to_pylist()
        texts = [_without(t, m) if m and k else t for t, m, k in zip(old, masks, keep, strict=True)]
        columns = []
        for k, field in enumerate(batch.schema):
            column = batch.column(k)
            if field.name == "text":
                column = pa.array(texts, field.type)
            elif field.name == "n_chars":
                column = pa.array([len(t) if m else n for t, m, n in zip(texts, masks, column.to_pylist(), strict=True)], field.type)
            columns.append(column)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return _marked(docs, benchmark, cut, docs.schema)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.selectExpr("doc_id", "n_words", "n_hit", "cast(size(items) as long) as n_items", "sha2(cast(array_join(items, ',') as binary), 256) as items_sha256", "n_hit > 0 as contaminated")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
item AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i+least(10, len(ws))-1], ' ') AS g
         FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM item),
doc AS (SELECT doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') AS g
        FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM doc JOIN item USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
