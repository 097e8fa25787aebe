"""Connected components of a graph given by its edges: in one task where they are few, else by alternating large-star and
small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.storage import release, stash

#: So many links are worked off in one task, without a join or a shuffle; of so many a task keeps only those that connect.
FEW, THINNED = 500_000, 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smallest, other) that connect what the pairs (a, b) connect, one for each other."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        for x in (root[a], root[b], a, b):
            np.minimum.at(root, x, least)
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(names)))
    return names[root[other]], names[other]


def _connected(parts: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    """Each node (u) of the links that is not the smallest of its component, with that (v)."""
    u, v = (pa.chunked_array([p.column(c) for p in parts]).combine_chunks() for c in ("u", "v"))
    names = pa.chunked_array([u, v]).unique()
    names = names.take(pc.sort_indices(names))
    root, other = forest(*(pc.index_in(x, value_set=names).to_numpy() for x in (u, v)))
    return names.take(pa.array(other)), names.take(pa.array(root))


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect what these connect, one for each node at most of every THINNED or more."""
    parts, rows = [], 0
    for batch in batches:
        parts.append(batch)
        rows += batch.num_rows
        if rows >= THINNED:
            yield pa.RecordBatch.from_arrays(list(_connected(parts)), names=["u", "v"])
            parts, rows = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays(list(_connected(parts)), names=["u", "v"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links at once."""
    if parts := [b for b in batches if b.num_rows]:
        node, root = _connected(parts)
        roots = root.unique()
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([node, roots]), pa.concat_arrays([root, roots])], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): the smallest node of its component, for each node of an edge between different nodes;
    nulls are no nodes, edges may repeat, no edges give no rows. Of its edges a task passes on only those that connect. Every
    step is written to the shared folder, and the one before it goes; minima are combined before they are shuffled."""
    plain = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    kind = plain.schema["u"].dataType.simpleString()
    links = stash(plain.mapInArrow(_thinned, f"u {kind}, v {kind}").distinct(), "links")
    mark = _mark(links)
    if mark[0] <= FEW:
        out = stash(links.coalesce(1).mapInArrow(_whole, f"node {kind}, root {kind}"), "components")
        release(links.sparkSession, links)
        return out
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stash(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        used, links = links, stash(small, "links")
        release(links.sparkSession, used, large)
        before, mark = mark, _mark(links)
        if mark == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
