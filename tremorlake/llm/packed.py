"""Shuffling many small records as a few packed rows.

Tasks sort fixed-width records into buckets and send each bucket's records of a chunk as one binary row; a reducer sees
the records of a bucket as one array. Records that a key repeats within a chunk are reduced before they are sent, so a
key brings a reducer at most one record from each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text to a bucket.
BUCKET_BYTES = 8 << 20
SCHEMA = "bucket int, data binary"


def bucket_count(spark: SparkSession, text_bytes: int) -> int:
    """Buckets in proportion to the text, no fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(text_bytes or 0) // BUCKET_BYTES), 1)


def bucketed(records: np.ndarray, key: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``SCHEMA`` holding ``records`` by ``key`` modulo ``buckets``."""
    if not len(records):
        return
    bucket = (key % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    for i in range(0, len(edges), 1000):
        some = edges[i : i + 1000]
        ends = np.append(edges, len(records))[i + 1 : i + 1 + len(some)]
        data = [records[a:b].tobytes() for a, b in zip(some, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[some], pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"])


def joined(blobs, dtype: np.dtype) -> np.ndarray:
    """The records of a bucket's rows as one array."""
    return np.frombuffer(b"".join(blobs), dtype)
