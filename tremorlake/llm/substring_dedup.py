"""Substring dedup over sliding runs of sentences.

From every sentence, and with ``ends`` up to every sentence, the shortest run of at least ``SENTENCES`` sentences and
``WORDS`` words is hashed; both together cover what all longer runs would. Runs found again, in the same text or another, are repeats, and sentences covered by any occurrence but the first are removed. Of several
occurrences within a chunk of a task only the first can be the first of all: the others are marked there, and one record
per run and chunk goes to the global comparison.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, packed

SENTENCES, WORDS = 2, 20
#: A sentence of so many words is a run by itself where lone sentences count.
LONE_WORDS = 50
#: A sentence ends after stops that a space follows, or at a line's end; what separates it from the next belongs to it. Nothing is read twice.
SENTENCE = re.compile(r"""(?:[^\n.!?]++|[.!?]++["')\]]*+(?![\x20\x09-\x0D]|\Z))*+(?:[.!?]++["')\]]*+)?[\x20\x09-\x0D]*+""")
#: Runs that a task gathers before it reduces and sends them.
CHUNK = 400_000
#: Marks that leave a task in one row.
MARKS_A_ROW = 2000
#: 96 bits of hash, the document's id and a hash of its text, first and last sentence.
RUN = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<i8"), ("key", "<u8"), ("i", "<i4"), ("j", "<i4")])
NO_ID = -(1 << 63)
MARKS = "doc long, key long, i int, j int"


def sentences(text: str) -> list[str]:
    """Sentences with what follows them; joined they are the text."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = SENTENCE.match(text, at).end()
        end = end if end > at else at + 1
        out.append(text[at:end])
        at = end
    return out


def runs(parts: list[str], least_sentences: int = SENTENCES, least_words: int = WORDS, ends: bool = False, lone: int | None = None) -> list[tuple[bytes, int, int]]:
    """(digest, first, last) of the shortest long enough run from every sentence, with ``ends`` of the shortest one up to every sentence, and with ``lone`` of every
    sentence of so many words.

    Case and kinds of space don't count; blank sentences join the next.
    """
    words = [p.encode().lower().split() for p in parts]
    real = [k for k, w in enumerate(words) if w]
    hashes = [xxhash.xxh64_digest(b" ".join(words[k])) for k in real]
    sizes = [len(words[k]) for k in real]
    spans, end, count = [], 0, 0
    for i in range(len(real)):
        end = max(end, i)
        while end < len(real) and (end - i < least_sentences or count < least_words):
            count += sizes[end]
            end += 1
        if end - i < least_sentences or count < least_words:
            break
        spans.append((i, end))
        count -= sizes[i]
    if ends:
        known, start, count = set(spans), 0, 0
        for end in range(1, len(real) + 1):
            count += sizes[end - 1]
            while end - start > least_sentences and count - sizes[start] >= least_words:
                count -= sizes[start]
                start += 1
            if end - start >= least_sentences and count >= least_words and (start, end) not in known:
                spans.append((start, end))
    if lone is not None:
        known = set(spans)
        spans += [(k, k + 1) for k, n in enumerate(sizes) if n >= lone and (k, k + 1) not in known]
    return [(xxhash.xxh3_128_digest(b"".join(hashes[i:end]))[:12], real[i], real[end - 1]) for i, end in spans]


def _text_key(text: str) -> int:
    """The JVM's ``xxhash64`` of the text, unsigned."""
    return xxhash.xxh64_intdigest(text.encode(), 42)


def split_firsts(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first occurrence of every run by (id, text, place), and the other ones; a repeated row's occurrence is the same one."""
    order = np.lexsort((records["i"], records["key"], records["doc"], records["g"], records["h"]))
    r = records[order]
    same_run = (r["h"][1:] == r["h"][:-1]) & (r["g"][1:] == r["g"][:-1])
    same_place = same_run & (r["doc"][1:] == r["doc"][:-1]) & (r["key"][1:] == r["key"][:-1]) & (r["i"][1:] == r["i"][:-1])
    first = np.append(True, ~same_run)[: len(r)]
    again = np.append(False, same_place)[: len(r)]
    return r[first], r[~first & ~again]


def _rows(marks: np.ndarray) -> dict[str, np.ndarray]:
    return {"doc": marks["doc"], "key": np.ascontiguousarray(marks["key"]).view(np.int64), "i": marks["i"], "j": marks["j"]}


def repeated_runs(docs: DataFrame, least_sentences: int = SENTENCES, least_words: int = WORDS, ends: bool = False, lone: int | None = None) -> DataFrame:
    """``MARKS``: every non-first occurrence of a repeated run, by document id (null: ``NO_ID``) and hash of its text."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"]
    buckets = packed.bucket_count(docs.sparkSession, size)
    names = ["bucket", "data", "marks"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def send() -> Iterator[pa.RecordBatch]:
            first, others = split_firsts(np.concatenate(held))
            for b in packed.bucketed(first, first["h"], buckets):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(b.num_rows, pa.binary())], names)
            for k in range(0, len(others), MARKS_A_ROW):  # decided already: they only pass through some bucket
                own = others[k : k + MARKS_A_ROW]
                yield pa.RecordBatch.from_arrays([pa.array([int(own["key"][0] % np.uint64(buckets))], pa.int32()), pa.nulls(1, pa.binary()), pa.array([own.tobytes()], pa.binary())], names)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for k, doc_id in enumerate(ids):
                text = texts[k].as_py()
                found = runs(sentences(text), least_sentences, least_words, ends, lone) if text else []
                if found:
                    r = np.empty(len(found), RUN)
                    digest = np.frombuffer(b"".join(f[0] for f in found), np.dtype([("h", "<u8"), ("g", "<u4")]))
                    r["h"], r["g"], r["doc"], r["key"] = digest["h"], digest["g"], NO_ID if doc_id is None else doc_id, _text_key(text)
                    r["i"], r["j"] = [f[1] for f in found], [f[2] for f in found]
                    held.append(r)
                    count += len(r)
                if count >= CHUNK:
                    yield from send()
                    held, count = [], 0
        if held:
            yield from send()

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        across = split_firsts(packed.joined(rows["data"].dropna(), RUN))[1]
        return pd.DataFrame(_rows(np.concatenate([across, packed.joined(rows["marks"].dropna(), RUN)])))

    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(gather, f"{packed.SCHEMA}, marks binary")
    return sent.groupBy("bucket").applyInPandas(compare, MARKS)


def remove_repeats(docs: DataFrame, least_sentences: int = SENTENCES, least_words: int = WORDS, ends: bool = False, lone: int | None = None) -> DataFrame:
    """``docs`` with repeated sentences removed from ``text``, and ``n_sentences``, ``n_removed``, ``removed``.

    With ``ends`` every run of any length counts; without, only the shortest from each sentence, so a repeated passage's last
    sentences stay where they make no run of their own.

    ``removed`` lists the removed sentences' numbers (from 0). Occurrences order by id (null first), then a hash of the
    text, then place; the first keeps its sentences. Rows with equal id and text are one document: each keeps or loses the
    same sentences. Null text stays null, with no sentences. Texts shorter than a run stay. With ``lone``, a sentence of so
    many words counts as a run. Columns named like the added ones are replaced. An empty table gives no rows. Marks are
    joined to texts by a shuffle on the id and a hash of the text, so rows without an id don't meet under one key.
    """
    columns = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "removed")]
    marks = repeated_runs(docs, least_sentences, least_words, ends, lone)
    spans = F.collect_set(F.struct("i", "j")).alias("__marks")  # at most three for each of the text's sentences
    marks = marks.groupBy(F.col("doc").alias("__doc"), F.col("key").alias("__key")).agg(spans)
    keyed = docs.withColumns({"__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__key": F.xxhash64(F.col("text").cast("string"))})
    with_marks = keyed.join(marks, ["__doc", "__key"], "left").select(*columns, "__marks")
    at = columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, numbers, dropped = [], [], []
            for text, marks in zip(b.column(at), b.column("__marks"), strict=True):
                text = text.as_py()
                parts = sentences(text or "")
                gone: set[int] = set()
                for s in (marks.as_py() or []) if text is not None else []:
                    gone.update(range(s["i"], s["j"] + 1))
                texts.append("".join(p for k, p in enumerate(parts) if k not in gone) if gone else text)
                numbers.append(len(parts))
                dropped.append(sorted(gone))
            arrays = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(columns))]
            arrays += [pa.array(numbers, pa.int64()), pa.array([len(d) for d in dropped], pa.int64()), pa.array(dropped, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "n_sentences", "n_removed", "removed"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return with_marks.mapInArrow(cut, f"{fields}, n_sentences long, n_removed long, removed array<int>")
