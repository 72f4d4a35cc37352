"""Document fingerprints by content-defined chunking.

A gear hash over the last ``WINDOW`` bytes proposes boundaries; below ``NORMAL`` bytes the stricter mask decides, above it
the looser one (normalised chunking). A fingerprint is the set of chunk digests with their lengths, and likeness is the
share of a fingerprint's length that the other one contains. An inserted or removed passage moves only the chunks around it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

WINDOW = 16
#: Least, normal and largest chunk in bytes. The least is no shorter than the window, so a chunk depends on its own bytes only.
LEAST, NORMAL, MOST = 16, 48, 192
STRICT_BITS, LOOSE_BITS = 7, 4
#: Bytes of text in one range of ids, until there are so many ranges; from then on ranges grow, which their tasks stream through. The driver holds an id a range.
RANGE_BYTES, MOST_RANGES = 16 << 20, 20_000
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _gear_table() -> np.ndarray:
    """256 numbers by the splitmix64 rule."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


GEAR = _gear_table()


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; empty data has none."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    k = 1
    while k < WINDOW:  # after each step h holds the gear sum of the last 2k bytes
        h[k:] += h[:-k] << np.uint64(k)
        k *= 2
    loose_at = np.flatnonzero(h >> np.uint64(64 - LOOSE_BITS) == 0)
    strict = loose_at[h[loose_at] >> np.uint64(64 - STRICT_BITS) == 0].tolist()
    loose = loose_at.tolist()
    ends, start, n_strict, n_loose = [], 0, len(strict), len(loose)
    while n - start > LEAST:
        i = bisect_left(strict, start + LEAST - 1)
        if i < n_strict and strict[i] < start + NORMAL - 1:
            end = strict[i] + 1
        else:
            i = bisect_left(loose, start + NORMAL - 1)
            end = loose[i] + 1 if i < n_loose and loose[i] < start + MOST - 1 else min(start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def digests(data: bytes, ends: list[int], start: int = 0) -> dict[str, int]:
    """Chunk digest (ten hex digits) to length."""
    out = {}
    for end in ends:
        out[xxhash.xxh64_hexdigest(data[start:end])[:10]] = end - start
        start = end
    return out


def as_text(chunks: dict[str, int]) -> str:
    """A fingerprint as text: digest and two-digit hex length of every chunk, sorted."""
    return "".join(sorted(f"{d}{n:02x}" for d, n in chunks.items()))


def parse(fingerprint: str) -> dict[str, int]:
    return {fingerprint[i : i + 10]: int(fingerprint[i + 10 : i + 12], 16) for i in range(0, len(fingerprint), 12)}


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """Share of ``a``'s length whose chunks are in ``b``; 1 for two empty fingerprints, 0 if only ``a`` is empty."""
    total = sum(a.values())
    return sum(n for d, n in a.items() if d in b) / total if total else float(not b)


def fingerprint(text: str | None) -> dict[str, int]:
    data = (text or "").encode()
    return digests(data, chunk_ends(data))


def _compare(doc_id: int | None, text: str, data: bytes, ends: list[int], own: dict, following: str, next_print: dict) -> tuple:
    k = len(text) // 3
    kept = text[: len(text) - k].encode()
    changed = kept + following[:k].encode()
    # Chunks that end inside the kept part are the same in both texts, unless the text's end made them.
    same = ends[: bisect_left(ends, min(len(kept), len(data) - 1) + 1)]
    start = same[-1] if same else 0
    rest = changed[start:]
    edited = digests(data, same) | digests(rest, chunk_ends(rest))
    sha = hashlib.sha256(changed).hexdigest()
    return doc_id, len(text), sha, as_text(own), as_text(edited), likeness(own, edited), likeness(own, next_print)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, then whether they only stand for the next range's first, then as the documents follow."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last = None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    out: list[tuple] = []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("range_no", "is_next", "doc_id")]
        texts = batch.column("text")
        for i, (range_no, is_next, doc_id) in enumerate(zip(*columns, strict=True)):
            if is_next and (last is None or last[0] != range_no):
                continue  # a further row with the next range's first id
            text = texts[i].as_py() or ""
            data = text.encode()
            ends = chunk_ends(data)
            own = digests(data, ends)
            if last is not None and last[0] == range_no:
                out.append(_compare(*last[1:], text, own))
            last = None if is_next else (range_no, doc_id, text, data, ends, own)
            if len(out) >= 500:
                yield batch_of(out)
                out = []
    if out:
        yield batch_of(out)


def edit_likeness(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness (columns of ``RESULT``).

    The edited text has its last third (rounded down) of code points replaced by the first as many, or all, of the next
    document in descending id, after the last the first; a lone document follows itself. Null text is empty. Rows with
    equal ids follow each other in the order of their texts; null ids come last. Other columns are ignored. An empty
    table gives no rows.

    Ids are dealt into ranges of about ``range_bytes`` of text by approximate quantiles; each range also gets the first
    document of the next one. Texts are shuffled once and sorted within ranges; a range is streamed, never held, also that
    of the rows without an id. The driver holds one id per range, ``MOST_RANGES`` or a few more at most.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    n = max(min(size // range_bytes + 1, MOST_RANGES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n)).alias("q")).first()["q"] or []
    bounds = np.unique(np.array(cuts, dtype=np.int64))

    @pandas_udf("int")
    def range_of(doc_id):
        known = doc_id.notna().to_numpy()
        at = len(bounds) - np.searchsorted(bounds, doc_id.fillna(0).to_numpy(dtype=np.int64), side="right")
        return pd.Series(np.where(known, at, len(bounds) + 1).astype(np.int32))

    firsts = docs.groupBy(range_of("doc_id").alias("r")).agg(F.max("doc_id").alias("first")).collect()  # a row per range
    firsts = sorted((r["r"], r["first"]) for r in firsts)
    if not firsts:
        return spark.createDataFrame([], RESULT)
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
    heads = spark.createDataFrame([(i, p) for i, p in before.items()], "head long, before int")
    dealt = docs.withColumn("r", range_of("doc_id")).join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    place = lambda r, is_next: F.struct(F.col(r).alias("range_no"), F.lit(is_next).alias("is_next"))
    places = F.when(F.col("before").isNull(), F.array(place("r", False))).otherwise(F.array(place("r", False), place("before", True)))
    dealt = dealt.select("doc_id", "text", F.inline(places))
    dealt = dealt.repartitionById(firsts[-1][0] + 1, F.col("range_no"))
    dealt = dealt.sortWithinPartitions("range_no", "is_next", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(_pairs, RESULT)
