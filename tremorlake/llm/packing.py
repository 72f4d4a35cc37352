"""Best-fit packing of tokenized documents into sequences by minimum bin slack.

Every document is tokenized and ended by one id. Longer ones than a sequence are cut into full pieces, the remainder first.
The plan is made on the histogram of piece lengths: for each kind of bin, a bitset subset sum over the lengths left finds
the fullest combination with the longest of them, which is taken as often as the counts allow. Pieces find their place by
their rank among pieces of equal length, so the plan's size depends on the capacity and not on the data.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY, END_ID = 1024, 2
SPECIAL = "<|endoftext|>"
#: The tokenizer's split pattern, and one in the faster module's terms that splits alike where ``ODD`` finds nothing.
PATTERN = regex.compile(public_tokenizers.PATTERN)
FAST_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ODD = re.compile(r"[\x1c-\x1f²³¹¼½¾ɐ-᷿⁰-\U0010ffff]")
#: Pieces of text whose ids a worker remembers, and code points of text looked at together.
CACHE_SIZE, GROUP_CHARS = 600_000, 1 << 20


def _byte_names() -> dict[int, str]:
    """Byte-level alphabets write printable Latin-1 bytes as themselves and the others as characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_NAMES = _byte_names()


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple[Tokenizer, dict[str, bytes]]:
    return Tokenizer.from_file(path), {}


def _split(text: str) -> list[str]:
    return PATTERN.findall(text) if ODD.search(text) else FAST_PATTERN.findall(text)


def token_bytes(texts: list[str], path: str = TOKENIZER) -> list[bytes]:
    """The ids of each text, little-endian unsigned 32-bit.

    Text is split as the tokenizer splits it, and each distinct piece is tokenized once while a worker remembers it.
    """
    tokenizer, cache = _tokenizer(path)
    parts = [t.split(SPECIAL) if SPECIAL in t else [t] for t in texts]
    split = [[_split(p) for p in ps] for ps in parts]
    new = set().union(*(p for ps in split for p in ps)).difference(cache)
    if len(cache) + len(new) > CACHE_SIZE:
        cache.clear()
        new = set().union(*(p for ps in split for p in ps))
    model = tokenizer.model
    for x in new:
        ids = [t.id for t in model.tokenize(x.encode().decode("latin-1").translate(BYTE_NAMES))]
        cache[x] = struct.pack(f"<{len(ids)}I", *ids)
    special = np.array([tokenizer.token_to_id(SPECIAL)], "<u4").tobytes()
    return [special.join(b"".join(map(cache.__getitem__, p)) for p in ps) for ps in split]


def _pieces_of(capacity: int, end_id: int, path: str, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int64()), ("task_rank", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            doc_ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
            at = 0
            while at < len(doc_ids):
                texts, chars, begin = [], 0, at
                while at < len(doc_ids) and chars < GROUP_CHARS:
                    texts.append(column[at].as_py() or "")
                    chars += len(texts[-1])
                    at += 1
                rows = []
                for doc_id, data in zip(doc_ids[begin:at], token_bytes(texts, path), strict=True):
                    data += end
                    n = len(data) // 4
                    start, piece = 0, 0
                    while start < n:
                        length = (n % capacity or capacity) if start == 0 else capacity
                        own = data[4 * start : 4 * (start + length)]
                        row = (doc_id, piece, start, length, zlib.crc32(own), task, seen[length])
                        rows.append(row + (np.frombuffer(own, "<u4").astype(np.int32),) * with_ids)
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run, ", ".join(f"{f} {t}" for f, t in [("doc_id", "long"), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("task", "long"), ("task_rank", "long")] + [("ids", "array<int>")] * with_ids)


def tokenize(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32``, its task and its rank among the task's pieces of that length."""
    run, schema = _pieces_of(capacity, end_id, path, with_ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _extend(sums: int, length: int, count: int, mask: int) -> int:
    """Sums reachable from ``sums`` with up to ``count`` pieces of ``length`` more."""
    k = 1
    while count > 0:
        k = min(k, count)
        sums |= (sums << (length * k)) & mask
        count -= k
        k *= 2
    return sums


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins as (pieces used by length, number of such bins), from the number of pieces of each length.

    Each time the longest piece left is taken, with the fullest feasible combination of others, longer ones first.
    """
    lengths = sorted(counts)
    left = [counts[x] for x in lengths]
    mask = (1 << (capacity + 1)) - 1
    usable = lambda i: min(left[i], capacity // lengths[i])
    known = [usable(i) for i in range(len(lengths))]
    sums = [1]  # sums[i]: reachable with lengths before the i-th
    for i, x in enumerate(lengths):
        sums.append(_extend(sums[i], x, known[i], mask))
    bins, top = [], len(lengths) - 1
    while top >= 0:
        if not left[top]:
            top -= 1
            continue
        room = capacity - lengths[top]
        reach = _extend(sums[top], lengths[top], min(left[top] - 1, room // lengths[top]), mask) & ((1 << (room + 1)) - 1)
        goal = reach.bit_length() - 1
        used: dict[int, int] = {top: 1}
        i = top
        while goal:
            spare = left[i] - used.get(i, 0)
            k = min(spare, goal // lengths[i])
            while not sums[i] >> (goal - k * lengths[i]) & 1:
                k -= 1
            if k:
                used[i] = used.get(i, 0) + k
                goal -= k * lengths[i]
            i -= 1
        times = min(left[j] // k for j, k in used.items())
        bins.append(({lengths[j]: k for j, k in used.items()}, times))
        for j, k in used.items():
            left[j] -= k * times
        changed = [j for j in used if usable(j) != known[j]]
        if changed:
            for j in changed:
                known[j] = usable(j)
            for j in range(min(changed), top + 1):
                sums[j + 1] = _extend(sums[j], lengths[j], known[j], mask)
    return bins


def _places(bins: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For runs of ranks of each length: length and first rank in one number, first sequence, pieces a bin, offset of the first."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for used, times in bins:
        offset = 0
        for length, k in used.items():
            rank = taken.get(length, 0)
            rows.append(((length << 44) + rank, rank, sequence, k, offset))
            taken[length] = rank + k * times
            offset += k * length
        sequence += times
    rows.sort()
    columns = zip(*rows, strict=True) if rows else [()] * 5
    return {n: np.array(c, np.int64) for n, c in zip(("key", "rank", "sequence", "each", "offset"), columns, strict=True)}


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    Null and empty text hold the end id alone. Repeated rows are packed each. Pieces of a sequence lie gapless from
    offset 0. Other columns are ignored. An empty table gives no rows. Tokens are made once and written; the driver
    gets the histogram of lengths, at most ``capacity`` rows.
    """
    pieces = common.materialize(tokenize(docs, capacity, end_id, path, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = _places(plan(histogram, capacity))
    # Ranks over all tasks: a task's ranks follow those of the tasks before it.
    per_task = pieces.groupBy("task", "length").agg((F.max("task_rank") + 1).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = pieces.join(offsets, ["task", "length"]).select(*names, (F.col("earlier") + F.col("task_rank")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            length, rank = x["length"].to_numpy(), x["rank"].to_numpy()
            at = np.searchsorted(places["key"], (length << 44) + rank, side="right") - 1
            k, each = rank - places["rank"][at], places["each"][at]
            out = x.drop(columns="rank")
            out["sequence_id"] = places["sequence"][at] + k // each
            out["offset"] = places["offset"][at] + k % each * length
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return ranked.mapInPandas(place, schema)
