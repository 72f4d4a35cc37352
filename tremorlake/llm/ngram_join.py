"""Exact Jaccard join on sets of word shingles, by rare-first prefix filtering.

1. One pass over the texts gives every document's set size and a key of its set; documents with equal sets are one node
   from here on. The same pass counts shingles in a sketch, and the sketch's levels order shingles rare first. Any one
   order gives right results; a better one gives fewer candidates.
2. A second pass sends the rarest shingles of every set, those of its prefix, to buckets. Two sets that link share one of
   them. Within a bucket, nodes with a common prefix shingle and no gap in size too wide for a link become candidates.
   What leaves a bucket is a tree for each such run of nodes, never their pairs.
3. The candidates' components are divided into blocks, and each pair of blocks is decided at once: pairs pass the length,
   prefix, positional and suffix filters, and those left are verified, once each, by their exact overlap. A spanning
   forest of the links leaves the task.
4. The links' components are those of the documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, packed, shingles

#: Least percentage of the union that the intersection of linked sets is.
PERCENT = 80
#: Sketch counters: one to about eight shingles of the input within these powers of two. Slices of them are summed apart.
LEAST_BITS, MOST_BITS, SLICE_BITS = 16, 26, 16
#: Bytes of text to a shingle, roughly; used for the sketch's size only.
BYTES_A_SHINGLE = 6
#: Prefix records that a task holds before it sends them.
CHUNK = 1_000_000
#: Nodes and shingles of one block of a candidate component.
BLOCK_NODES, BLOCK_SHINGLES = 1000, 1_000_000
#: Bounds on the length of runs that leave as pairs: each record then brings at most half of this many pairs.
LEAST_SHORT, MOST_SHORT = 8, 64
PREFIX = np.dtype([("token", "<u8"), ("node", "<i8"), ("n", "<i4")])


def least_overlap(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap of a set of ``n`` with any set that it links to."""
    return -(-n * percent // 100)


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - least_overlap(n, percent) + 1


def sketch_bits(text_bytes: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, (int(text_bytes or 0) // BYTES_A_SHINGLE // 8).bit_length()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _slice_out(counts: np.ndarray) -> bytes:
    """A slice of counters: which ones are used, a bit each, and those."""
    used = counts > 0
    return zlib.compress(np.packbits(used).tobytes() + counts[used].tobytes(), 1)


def _slice_in(data: bytes) -> np.ndarray:
    data = np.frombuffer(zlib.decompress(data), np.uint8)
    counts = np.zeros(1 << SLICE_BITS, np.uint8)
    counts[np.unpackbits(data[: len(counts) // 8]).astype(bool)] = data[len(counts) // 8 :]
    return counts


def describe(docs: DataFrame, bits: int) -> DataFrame:
    """Rows ``doc_id, n, node`` of every document (node null for an empty set), and rows ``slice, data`` of the sketch's parts."""
    names = ["doc_id", "n", "node", "slice", "data"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << bits, np.uint8), set()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for first, group in shingles.groups(texts):
                values, at = shingles.shingle_sets(group)
                n = np.diff(at)
                nodes = [_signed(shingles.set_key(values[a:b])) if b > a else None for a, b in zip(at, at[1:])]
                new = []
                for k, node in enumerate(nodes):
                    if node is not None and node not in seen:
                        seen.add(node)
                        new.append(k)
                if new:
                    chosen = np.isin(np.repeat(np.arange(len(group)), n), new)
                    slots, times = np.unique((values[chosen] & mask).astype(np.int64), return_counts=True)
                    counts[slots] = np.minimum(counts[slots].astype(np.int64) + times, 255)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(group)), pa.array(n.astype(np.int32)), pa.array(nodes, types[2]), pa.nulls(len(group), types[3]), pa.nulls(len(group), types[4])], names
                )
        for k in range(1 << (bits - SLICE_BITS)):
            part = counts[k << SLICE_BITS : (k + 1) << SLICE_BITS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in types[:3]] + [pa.array([k], types[3]), pa.array([_slice_out(part)], types[4])], names)

    return docs.mapInArrow(run, "doc_id long, n int, node long, slice int, data binary")


def levels_of(parts: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """A level of commonness for every counter, the binary logarithm of its count above what chance puts there; and that chance count.

    A slice's counts are summed in one task; the driver gets one byte for each counter, 2^26 at most.
    """

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << SLICE_BITS, np.uint32)
        for data in rows["data"]:
            total += _slice_in(data)
        mean = total.mean()
        above = np.maximum(0, total - mean - 3 * np.sqrt(mean)).astype(np.int64)
        level = np.where(above > 0, np.floor(np.log2(np.maximum(above, 1))) + 1, 0).astype(np.uint8)
        chance = int(np.ceil(mean + 3 * np.sqrt(mean)))
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "data": [zlib.compress(level.tobytes(), 1)], "chance": [chance]})

    out, chance = np.zeros(1 << bits, np.uint8), 0
    for r in parts.groupBy("slice").applyInPandas(add, "slice int, data binary, chance int").toLocalIterator():
        chance = max(chance, r["chance"])
        out[r["slice"] << SLICE_BITS : (r["slice"] + 1) << SLICE_BITS] = np.frombuffer(zlib.decompress(bytes(r["data"])), np.uint8)
    return out, chance


def in_order(values: np.ndarray, at: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of every set rare first (equal levels by hash), their sets, and their places in them."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((values, levels[(values & np.uint64(len(levels) - 1)).astype(np.int64)], owner))
    return values[order], owner, np.arange(len(values)) - at[owner]


def candidate_edges(docs: DataFrame, levels, short: int, buckets: int, percent: int = PERCENT) -> DataFrame:
    """Edges ``a, b`` of nodes: any two that link are joined by a path. ``levels`` is a broadcast.

    Nodes that share a prefix shingle and could link by size form a run. Pairs of runs up to ``short`` nodes are edges if
    their common prefix shingles and the rest of the larger set could make up the overlap; two nodes that meet in a
    longer run are joined by its tree, so for the others this count is whole. No node of a tree has many children.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, set()
        for batch in batches:
            for _, group in shingles.groups(batch.column("text")):
                values, at = shingles.shingle_sets(group)
                n = np.diff(at)
                nodes = np.zeros(len(group), np.int64)
                new = np.zeros(len(group), bool)
                for k in np.flatnonzero(n):
                    nodes[k] = node = _signed(shingles.set_key(values[at[k] : at[k + 1]]))
                    new[k] = node not in seen  # equal sets are sent once by a task
                    seen.add(node)
                values, owner, place = in_order(values, at, levels.value)
                keep = new[owner] & (place < prefix_length(n, percent)[owner])
                r = np.empty(int(keep.sum()), PREFIX)
                r["token"], r["node"], r["n"] = values[keep], nodes[owner[keep]], n[owner[keep]]
                held.append(r)
                count += len(r)
                if count >= CHUNK:
                    yield from packed.bucketed(r := np.concatenate(held), r["token"], buckets)
                    held, count = [], 0
        if held:
            yield from packed.bucketed(r := np.concatenate(held), r["token"], buckets)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        r = packed.joined(rows["data"], PREFIX)
        r = r[np.lexsort((r["node"], r["n"], r["token"]))]
        fresh = np.append(True, (r["token"][1:] != r["token"][:-1]) | (r["node"][1:] != r["node"][:-1]))[: len(r)]
        r = r[fresh]
        # A run of nodes ends where the next one is too large to link with any before it.
        cut = (r["token"][1:] != r["token"][:-1]) | (r["n"][1:].astype(np.int64) * percent > r["n"][:-1].astype(np.int64) * 100)
        run = np.concatenate([[0], np.cumsum(cut)])[: len(r)]
        heads = np.flatnonzero(np.append(True, cut))[: run[-1] + 1 if len(run) else 0]
        length = np.bincount(run) if len(r) else run
        position = np.arange(len(r)) - heads[run] if len(r) else run
        tree = np.flatnonzero((length[run] > short) & (position > 0))
        above = r["node"][heads[run[tree]] + components.parents(position[tree])]
        parts = [np.stack([above, r["node"][tree], np.zeros(len(tree), np.int64), np.zeros(len(tree), np.int64)], 1)]
        for gap in range(1, short):
            at = np.flatnonzero((run[:-gap] == run[gap:]) & (length[run[gap:]] <= short)) if len(r) > gap else np.empty(0, int)
            n1, n2 = r["n"][at].astype(np.int64), r["n"][at + gap].astype(np.int64)
            fits = n2 * percent <= n1 * 100
            x, y = r["node"][at][fits], r["node"][at + gap][fits]
            # Of the overlap that is needed, the rest of the larger set gives this much at most.
            lacks = -(-(n1 + n2) * percent // (100 + percent)) - least_overlap(n2, percent) + 1
            parts.append(np.stack([np.minimum(x, y), np.maximum(x, y), np.ones(len(x), np.int64), lacks[fits]], 1))
        edges, times = np.unique(np.concatenate(parts), axis=0, return_counts=True)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1], "common": edges[:, 2] * times, "lacks": edges[:, 3]})

    sent = docs.select("text").mapInArrow(send, packed.SCHEMA)
    met = sent.groupBy("bucket").applyInPandas(meet, "a long, b long, common long, lacks long").groupBy("a", "b")
    return met.agg(F.sum("common").alias("common"), F.min("lacks").alias("lacks")).where("common >= lacks").select("a", "b")


def _classes(values: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """How many shingles of each set fall into each of 64 classes by hash."""
    return np.bincount(owner * 64 + (values >> np.uint64(58)).astype(np.int64), minlength=count * 64).reshape(count, 64).astype(np.int32)


def _common(tokens: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Numbers of common tokens of all pairs of sets: tokens that several sets have, in products of incidence matrices."""
    _, which, times = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = times[which] > 1
    names, which = np.unique(which[shared], return_inverse=True)
    owner, out = owner[shared], np.zeros((count, count), np.float32)
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    for low in range(0, len(names), 2048):
        a, b = np.searchsorted(which, [low, low + 2048])
        held = np.zeros((count, min(2048, len(names) - low)), np.float32)
        held[owner[a:b], which[a:b] - low] = 1
        rows = np.flatnonzero(held.any(1))
        out[np.ix_(rows, rows)] += held[rows] @ held[rows].T
    return out.astype(np.int64)


def linked_pairs(texts: list[bytes], side: np.ndarray, levels: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts that link, among those of different sides, or all when there is one side only.

    Length, prefix, positional and suffix filters drop pairs that can't link; the others are verified.
    """
    values, at = shingles.shingle_sets(texts)
    n, count = np.diff(at), len(texts)
    ordered, owner, place = in_order(values, at, levels)
    in_prefix = place < prefix_length(n, percent)[owner]
    low, high = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
    pair = np.triu(np.ones((count, count), bool), 1) & (high * percent <= low * 100)  # the length filter
    if side.any() and not side.all():
        pair &= side[:, None] != side
    need = -(-(low + high) * percent // (100 + percent))
    both = _common(ordered[in_prefix], owner[in_prefix], count)
    # Common shingles past both prefixes lie in the rest of the set whose prefix ends first in the order.
    level = levels[(ordered & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64)
    last = np.zeros(count, [("l", "u8"), ("v", "u8")])
    ends = np.flatnonzero(place == prefix_length(n, percent)[owner] - 1)
    last["l"][owner[ends]], last["v"][owner[ends]] = level[ends], ordered[ends]
    rank = np.empty(count, np.int64)
    rank[np.lexsort((last["v"], last["l"]))] = np.arange(count)
    rest = n - prefix_length(n, percent)
    pair &= (both > 0) & (both + np.where(rank[:, None] < rank, rest[:, None], rest) >= need)  # prefix and positional filters
    i, j = np.nonzero(pair)
    classes = _classes(values, np.repeat(np.arange(count), n), count)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 20_000):  # the suffix filter: what classes by hash leave in common at most
        a, b = i[k : k + 20_000], j[k : k + 20_000]
        keep[k : k + 20_000] = np.minimum(classes[a], classes[b]).sum(1) >= need[a, b]
    i, j = i[keep], j[keep]
    if len(i) > 50:
        overlap = _common(values, np.repeat(np.arange(count), n), count)[i, j]
    else:
        sets = [values[at[k] : at[k + 1]] for k in range(count)]
        overlap = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    union = n[i] + n[j] - overlap
    link = 100 * overlap >= percent * union
    return i[link], j[link]


def forest(i: np.ndarray, j: np.ndarray, count: int) -> np.ndarray:
    """The least member of every item's component."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verified_edges(docs: DataFrame, clusters: DataFrame, levels, percent: int = PERCENT) -> DataFrame:
    """Edges ``a, b`` that span the links among nodes of equal ``cluster``; ``clusters``: ``doc_id, node, cluster, n``, one document a node."""
    clusters = common.materialize(clusters.withColumn("cluster", F.col("cluster").cast("string")), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    blocks = F.ceil(F.greatest(F.col("k") / BLOCK_NODES, F.col("s") / BLOCK_SHINGLES)).cast("int")
    placed = common.join_back(clusters, common.materialize(sizes.select("cluster", "k", blocks.alias("blocks")), "sizes"), "cluster", "k", F.col("node"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("x"), F.greatest(k, F.col("own")).alias("y")))
    placed = common.materialize(placed.withColumn("own", own).select("doc_id", "node", "cluster", "blocks", "own"), "blocks")
    count = placed.count()
    texts = docs.select("doc_id", "text")
    # Few nodes are sent to the texts; otherwise texts and nodes are shuffled by id.
    joined = texts.join(F.broadcast(placed) if count <= common.BROADCAST_ROWS else placed, "doc_id")
    joined = joined.dropDuplicates(["node"]).select("node", "cluster", "own", "text", F.inline(meets))

    def decide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows["node"].to_numpy()
        texts = [t.encode() for t in rows["text"]]
        i, j = linked_pairs(texts, (rows["own"] != key[1]).to_numpy(), levels.value, percent)
        root = forest(i, j, len(nodes))
        order = np.argsort(root, kind="stable")
        heads = np.searchsorted(root[order], root[order])
        position = np.arange(len(order)) - heads
        return pd.DataFrame({"a": nodes[order[heads + components.parents(position)]], "b": nodes[order]}).loc[position > 0]

    return joined.groupBy("cluster", "x", "y").applyInPandas(decide, "a long, b long")


def link(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: its set's size, and the least id that links reach from it.

    Documents link when the intersection of their sets is at least ``percent`` of the union. Null text, and text without
    words, has an empty set and links with nothing. Rows with equal sets, so also repeated rows, are linked. A row without
    an id belongs to the component of the rows with an equal set, and has none (null) if it is alone. Other columns are
    ignored. An empty table gives no rows. Sets are told apart by 64-bit keys: among 10^9 different sets two share one with probability 0.03.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"]
    bits = sketch_bits(size)
    described = common.materialize(describe(docs, bits), "described")
    rows = described.where("slice is null").select("doc_id", "n", "node")
    found, chance = levels_of(described.where("slice is not null").select("slice", "data"), bits)
    levels, short = spark.sparkContext.broadcast(found), min(MOST_SHORT, max(LEAST_SHORT, chance))
    candidates = components.components(candidate_edges(docs, levels, short, packed.bucket_count(spark, size), percent))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count("*").alias("copies"))
    nodes = common.materialize(nodes, "nodes")
    clusters = nodes.where("doc_id is not null").join(candidates.select("node", F.col("root").alias("cluster")), "node")
    roots = components.components(verified_edges(docs, clusters.select("doc_id", "node", "cluster", "n"), levels, percent))
    named = common.materialize(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node").cast("string")), "named")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    least = common.materialize(least.where("members > 1"), "least")  # a node alone is its own component
    named = common.join_back(named, least, "root", "members", F.col("node")).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    named = named.where("copies > 1 or component_id != doc_id")
    named = common.materialize(named.select(F.col("node").cast("string").alias("key"), "component_id", "copies"), "components")
    out = common.join_back(rows.withColumn("key", F.coalesce(F.col("node").cast("string"), F.concat(F.lit("empty"), F.pmod("doc_id", F.lit(997))))), named, "key", "copies", F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of linked ones, that of the least id; columns stay.

    Rows of one id count as one document: all go if one of them links to a lesser id, and of equal texts among them one
    stays. Rows without an id stay. Texts are shuffled by id, unless the ids to drop are few.
    """
    links = common.materialize(link(docs, percent), "links").where("doc_id is not null")
    ids = links.groupBy("doc_id").agg(F.count("*").alias("k"), F.min("component_id").alias("least"))
    ids = common.materialize(ids.where("k > 1 or least < doc_id").select("doc_id", (F.col("least") == F.col("doc_id")).alias("stays")), "ids")
    few = ids.count() <= common.BROADCAST_ROWS
    side = lambda df: F.broadcast(df) if few else df
    once = docs.join(side(ids.select("doc_id")), "doc_id", "left_anti")
    again = docs.join(side(ids.where("stays").select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return once.select(*columns).unionByName(again.select(*columns))
