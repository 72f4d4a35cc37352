"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions of features are inner products of low-rank vectors, summed in linear time as half the square of the
sum less the sum of squares. It is trained in numpy on a bounded sample of labelled rows and scores every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD_BUCKETS, RANK = 4096, 8
#: Structure statistics are cut into this many bins each; one feature a bin.
BINS = 12
#: At most about this many labelled rows are trained on.
SAMPLE_ROWS = 5000
EPOCHS, BATCH, RATE, L2, SEED = 12, 64, 0.03, 1e-5, 11
THRESHOLD = 0.3
STATS = ("words", "chars", "word_length", "upper", "symbols", "digits", "stops", "distinct", "repeated_lines", "line_words", "padded", "bars", "letters", "stutter", "n_chars")
SYMBOLS = re.compile(rb"[#*$%&|<>!]")
PADDED = re.compile(rb"[#*$%&!]{2,}")
FEATURES = WORD_BUCKETS + BINS * len(STATS)


def _bin(x: float) -> int:
    """Shares and small ratios into even bins, clipped."""
    return min(BINS - 1, max(0, int(x)))


def structure(text: str, n_chars: int | None) -> list[int]:
    """The bin of every statistic of ``STATS``."""
    data = text.encode()
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    lines = [x for x in (line.strip() for line in data.split(b"\n")) if x]
    letters = sum(map(len, re.findall(rb"[A-Za-z\x80-\xff]+", data)))
    upper = sum(map(len, re.findall(rb"[A-Z]+", data)))
    values = (
        np.log2(len(words) + 1), np.log2(len(data) + 1) * 0.6, 12 * min(1, len(b"".join(words)) / n / 18), 24 * upper / max(1, letters),
        120 * len(SYMBOLS.findall(data)) / size, 60 * len(re.findall(rb"[0-9]", data)) / size, 24 * len(re.findall(rb"[.!?](?=\s|\Z)", data)) / n,
        12 * len(set(words)) / n, 12 * (1 - len(set(lines)) / max(1, len(lines))), np.log2(n / max(1, len(lines)) + 1) * 1.5,
        24 * len(PADDED.findall(data)) / n, 24 * data.count(b" | ") / n, 12 * letters / size, 40 * sum(map(bytes.__eq__, words, words[1:])) / n, 0 if n_chars is None else 1 + np.log2(max(0, n_chars) + 1) * 0.6,
    )
    return [_bin(v) for v in values]


def features(text: str | None, n_chars: int | None, memory: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: words by hash with values of unit length together, and one feature per statistic."""
    text = text or ""
    counts = Counter(text.encode().lower().split())
    memory = {} if memory is None else memory
    for w in counts:
        if w not in memory:  # a difference of key views would walk all of the memory
            memory[w] = zlib.crc32(w) % WORD_BUCKETS
    x = np.bincount([memory[w] for w in counts], list(counts.values()), WORD_BUCKETS) if counts else np.zeros(WORD_BUCKETS)
    at = np.flatnonzero(x)
    values = x[at] / max(1e-9, np.sqrt((x[at] ** 2).sum()))
    stats = WORD_BUCKETS + BINS * np.arange(len(STATS)) + np.array(structure(text, n_chars))
    return np.concatenate([at, stats]).astype(np.int32), np.concatenate([values, np.full(len(STATS), 0.5)]).astype(np.float32)


def raw_score(model: dict[str, np.ndarray], at: np.ndarray, x: np.ndarray) -> float:
    """Log-odds: bias, linear part and all pairwise interactions by the sum-of-squares identity."""
    vx = model["v"][at] * x[:, None]
    total = vx.sum(0)
    return float(model["b"] + model["w"][at] @ x + 0.5 * (total @ total - (vx * vx).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Logistic loss by Adagrad over small batches; rare labels weigh as much as frequent ones up to fourfold. Reruns agree."""
    rng = np.random.default_rng(seed)
    model = {"b": np.zeros(()), "w": np.zeros(FEATURES), "v": rng.standard_normal((FEATURES, RANK)) * 0.05}
    square = {n: np.full_like(a, 1e-3) for n, a in model.items()}
    share = max(1e-3, min(y.mean(), 1 - y.mean()))
    rare = float(y.mean() < 0.5)
    weight = np.where(y == rare, min(4.0, (1 - share) / share), 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            grad = {n: np.zeros_like(a) for n, a in model.items()}
            own = order[i : i + BATCH]
            for k in own:
                at, x = rows[k]
                vx = model["v"][at] * x[:, None]
                total = vx.sum(0)
                s = float(model["b"] + model["w"][at] @ x + 0.5 * (total @ total - (vx * vx).sum()))
                e = weight[k] * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[k]) / len(own)
                grad["b"] += e
                grad["w"][at] += e * x
                grad["v"][at] += e * (x[:, None] * total - vx * x[:, None])
            for n, g in grad.items():
                g = g + L2 * model[n]
                square[n] += g * g
                model[n] = model[n] - RATE * g / np.sqrt(square[n])
    # Back to the odds of the sample: the rare class was given weight, not frequency.
    model["b"] = model["b"] - np.log(min(4.0, (1 - share) / share)) * (1 if rare else -1) * 0.5
    return model


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", rows: int = SAMPLE_ROWS) -> tuple[list, np.ndarray]:
    """Features and labels of a bounded sample of the labelled rows that ``allowed`` admits, chosen by a hash of their id."""
    known = labels.where(allowed & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("__y"))
    count = known.count()
    chance = min(1.0, rows / max(1, count))
    picked = known.where(common.unit_hash(F.lit("fm"), F.col("doc_id")) < chance).limit(2 * rows)
    sample = docs.select("doc_id", "text", "n_chars").join(F.broadcast(picked), "doc_id").select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), "__y")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, n_chars, y in zip(*(b.column(i) for i in range(4)), strict=True):
                at, x = features(text.as_py(), n_chars.as_py())
                out.append((doc_id.as_py(), y.as_py(), at.tobytes(), x.tobytes()))
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["doc_id", "y", "at", "x"])

    got = sample.mapInArrow(extract, "doc_id long, y int, at binary, x binary").limit(2 * rows).collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], bytes(r["at"])))
    return [(np.frombuffer(bytes(r["at"]), np.int32), np.frombuffer(bytes(r["x"]), np.float32).astype(float)) for r in got], np.array([r["y"] for r in got], float)


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label: str = "quality") -> dict[str, np.ndarray] | None:
    """The machine, or none when the sample has no rows."""
    rows, y = training_rows(docs, labels, F.lit(True) if allowed is None else allowed, label)
    return fit(rows, y) if rows else None


def score(docs: DataFrame, model: dict[str, np.ndarray] | None, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``columns`` of every row with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Inputs are ``text`` and ``n_chars`` alone; null text counts as empty. An untrained model scores 0.5. Columns named
    ``score`` or ``predicted`` are replaced; repeated rows score alike; an empty table gives no rows.
    """
    columns = [c for c in columns if c not in ("score", "predicted")]
    small = None if model is None else {"b": model["b"], "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, int] = {}
        for b in batches:
            values = []
            for text, n_chars in zip(b.column("__text"), b.column("__n"), strict=True):
                if len(memory) > 300_000:
                    memory.clear()
                s = 0.0 if small is None else raw_score(small, *features(text.as_py(), n_chars.as_py(), memory))
                values.append(1 / (1 + np.exp(-np.clip(s, -30, 30))))
            out = np.array(values, float)
            arrays = [*(b.column(c) for c in columns), pa.array(out), pa.array((out >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "score", "predicted"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    chosen = docs.select(*columns, F.col("text").alias("__text"), F.col("n_chars").cast("long").alias("__n"))
    return chosen.mapInArrow(run, f"{fields}, score double, predicted int")
