"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads texts as segments of ``STEPS`` bytes, labels every byte, and a document's probabilities are the means
over its bytes. Its gates are piecewise linear, which keeps the cost per byte low. It is trained here, in numpy, by
backpropagation through time on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HIDDEN, STEPS = 8, 64
#: The training sample: rows per language, fewer where there are so many languages that all would pass the total, and segments of each row, evenly spaced over its
#: whole text. Every language is learned.
SAMPLE_ROWS, SAMPLE_TOTAL, SAMPLE_SEGMENTS = 600, 24_000, 6
EPOCH_BATCH, UPDATES, RATE, SEED = 256, 160, 0.02, 5
#: Segments that run through the network together.
SEGMENTS = 4096
UNKNOWN = "und"


def _params(rng: np.random.Generator, classes: int) -> dict[str, np.ndarray]:
    p = {}
    for d in ("f", "b"):
        p[f"x{d}"] = (rng.standard_normal((256, 3 * HIDDEN)) * 0.3).astype(np.float32)
        p[f"u{d}"] = (rng.standard_normal((HIDDEN, 3 * HIDDEN)) * 0.3).astype(np.float32)
        p[f"c{d}"] = np.zeros(3 * HIDDEN, np.float32)
    p["o"] = (rng.standard_normal((2 * HIDDEN, classes)) * 0.3).astype(np.float32)
    p["k"] = np.zeros(classes, np.float32)
    return p


def _run(p: dict[str, np.ndarray], d: str, steps: np.ndarray, keep: bool = False):
    """States after every step (steps x rows x hidden) of one direction; ``keep`` returns what backpropagation needs too."""
    h = np.zeros((steps.shape[1], HIDDEN), np.float32)
    out = np.empty((*steps.shape, HIDDEN), np.float32)
    x, u, c, memory, n2 = p[f"x{d}"], p[f"u{d}"], p[f"c{d}"], [], 2 * HIDDEN
    for t in range(len(steps)):
        g = x[steps[t]]
        r = h @ u
        r += c
        g[:, :n2] += r[:, :n2]
        gates = g[:, :n2]
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        raw = g[:, n2:] + gates[:, HIDDEN:] * r[:, n2:]
        new = np.clip(raw, -1, 1)
        if keep:
            memory.append((h, gates.copy(), r[:, n2:].copy(), raw, new))
        h = new + gates[:, :HIDDEN] * (h - new)
        out[t] = h
    return (out, memory) if keep else out


def _back(p: dict[str, np.ndarray], d: str, steps: np.ndarray, memory: list, dout: np.ndarray, grads: dict[str, np.ndarray]) -> None:
    u, dh = p[f"u{d}"], np.zeros(dout.shape[1:], np.float32)
    gx, gu, gc = grads[f"x{d}"], grads[f"u{d}"], grads[f"c{d}"]
    for t in range(len(steps) - 1, -1, -1):
        h, gates, rn, raw, new = memory[t]
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        dh = dh + dout[t]
        dn = dh * (1 - z) * (np.abs(raw) < 1)
        live = (gates > 0) & (gates < 1)
        dgates = np.concatenate([dh * (h - new), dn * rn], 1) * live * np.float32(0.25)
        dr = np.concatenate([dgates, dn * r], 1)
        np.add.at(gx, steps[t], np.concatenate([dgates, dn], 1))
        gu += h.T @ dr
        gc += dr.sum(0)
        dh = dh * z + dr @ u.T


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def loss_and_grads(p: dict[str, np.ndarray], segments: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of the labels of all bytes, and its gradients. ``segments``: rows x steps of bytes."""
    steps, backward = segments.T, segments.T[::-1]
    hf, mf = _run(p, "f", steps, True)
    hb, mb = _run(p, "b", backward, True)
    both = np.concatenate([hf, hb[::-1]], -1)
    q = _softmax(both @ p["o"] + p["k"])
    weight = mask.T / mask.sum()
    rows = np.arange(len(y))
    loss = -float((np.log(q[:, rows, y] + 1e-9) * weight).sum())
    q[:, rows, y] -= 1
    dlogit = (q * weight[..., None]).astype(np.float32)
    grads = {n: np.zeros_like(v) for n, v in p.items()}
    grads["o"] = np.tensordot(both, dlogit, ([0, 1], [0, 1]))
    grads["k"] = dlogit.sum((0, 1))
    dboth = dlogit @ p["o"].T
    _back(p, "f", steps, mf, dboth[..., :HIDDEN], grads)
    _back(p, "b", backward, mb, dboth[::-1, :, HIDDEN:], grads)
    return loss, grads


def fit(segments: np.ndarray, mask: np.ndarray, y: np.ndarray, classes: int, updates: int = UPDATES, seed: int = SEED) -> dict[str, np.ndarray]:
    """Train by Adam on batches with classes drawn evenly; reruns agree."""
    rng = np.random.default_rng(seed)
    p = _params(rng, classes)
    m, v = ({n: np.zeros_like(a) for n, a in p.items()} for _ in range(2))
    own = [np.flatnonzero(y == c) for c in range(classes)]
    for i in range(1, updates + 1):
        pick = np.concatenate([rng.choice(o, max(1, EPOCH_BATCH // classes)) for o in own if len(o)])
        _, grads = loss_and_grads(p, segments[pick], mask[pick], y[pick])
        rate = RATE * min(1, 2 * (1 - (i - 1) / updates))
        for n, g in grads.items():
            m[n] = 0.9 * m[n] + 0.1 * g
            v[n] = 0.99 * v[n] + 0.01 * g * g
            p[n] -= rate * (m[n] / (1 - 0.9**i)) / (np.sqrt(v[n] / (1 - 0.99**i)) + 1e-6)
    return p


def segments_of(data: bytes) -> tuple[np.ndarray, int]:
    """A text's bytes as rows of ``STEPS``, the last one filled with spaces, and the number of bytes."""
    n = len(data)
    rows = -(-n // STEPS)
    return np.frombuffer(data.ljust(rows * STEPS), np.uint8).reshape(rows, STEPS), n


def byte_probabilities(p: dict[str, np.ndarray], segments: np.ndarray) -> np.ndarray:
    """Probabilities of every byte: rows x steps x classes."""
    steps = np.ascontiguousarray(segments.T)
    both = np.concatenate([_run(p, "f", steps), _run(p, "b", steps[::-1])[::-1]], -1)
    return _softmax(both @ p["o"] + p["k"]).transpose(1, 0, 2)


def _pooled(p: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Mean byte probabilities of each text; zeros for empty ones."""
    classes = len(p["k"])
    sums, sizes = np.zeros((len(texts), classes)), np.array([max(1, len(t)) for t in texts])
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    count = 0

    def flush() -> None:
        nonlocal held, count
        rows, owner, filled = (np.concatenate(x) for x in zip(*held, strict=True))
        for i in range(0, len(rows), SEGMENTS):
            q = byte_probabilities(p, rows[i : i + SEGMENTS])
            q = q * (np.arange(STEPS) < filled[i : i + SEGMENTS, None])[..., None]
            np.add.at(sums, owner[i : i + SEGMENTS], q.sum(1))
        held, count = [], 0

    for k, data in enumerate(texts):
        if data:
            rows, n = segments_of(data)
            held.append((rows, np.full(len(rows), k), np.minimum(n - STEPS * np.arange(len(rows)), STEPS)))
            count += len(rows)
            if count >= SEGMENTS:
                flush()
    if held:
        flush()
    return sums / sizes[:, None]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def training_rows(docs: DataFrame, allowed: Column, rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, segments, byte masks and class numbers of a bounded sample of labelled rows, about ``rows`` a language.

    Rows are chosen by a hash of their id. The driver gets a row per language and at most ``SAMPLE_SEGMENTS`` segments of
    each sampled text.
    """
    spark = docs.sparkSession
    labelled = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = labelled.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return [], np.empty((0, STEPS), np.uint8), np.empty((0, STEPS), bool), np.empty(0, int)
    rows = max(1, min(rows, SAMPLE_TOTAL // len(languages)))
    # A language of few rows gives all of them; the others a little more than asked, so that none comes out empty by chance.
    share = spark.createDataFrame([(r["lang"], min(1.0, (rows + 3 * rows**0.5 + 3) / r["count"])) for r in counts], "lang string, __share double")
    sample = labelled.join(F.broadcast(share), "lang").where(common.unit_hash(F.lit("lang"), F.col("doc_id")) < F.col("__share")).select("doc_id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, lang, text in zip(*(b.column(i) for i in range(3)), strict=True):
                if has_letter(text := text.as_py()):
                    whole, n = segments_of(text.encode())
                    for i in np.unique(np.linspace(0, len(whole) - 1, SAMPLE_SEGMENTS).astype(int)):
                        out.append((doc_id.as_py(), lang.as_py(), whole[i].tobytes(), int(min(n - STEPS * i, STEPS))))
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.int32()), strict=True)], ["doc_id", "lang", "data", "filled"])

    got = sample.mapInArrow(cut, "doc_id long, lang string, data binary, filled int").limit(2 * rows * SAMPLE_SEGMENTS * len(languages)).collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], bytes(r["data"])))
    segments = np.frombuffer(b"".join(bytes(r["data"]) for r in got), np.uint8).reshape(-1, STEPS)
    filled = np.array([r["filled"] for r in got], int).reshape(-1, 1)
    return languages, segments, np.arange(STEPS) < filled, np.array([languages.index(r["lang"]) for r in got], int)


def train(docs: DataFrame, allowed: Column | None = None) -> tuple[list[str], dict[str, np.ndarray] | None]:
    """Languages and network from the labelled rows of ``docs`` that ``allowed`` admits; no network without any."""
    languages, segments, mask, y = training_rows(docs, F.lit(True) if allowed is None else allowed)
    return languages, fit(segments, mask, y, len(languages)) if len(y) else None


def predict(docs: DataFrame, languages: list[str], network: dict[str, np.ndarray] | None, columns: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``columns`` of every row, whatever their names, with the language and its score, the mean probability over all bytes, under ``names``.

    Null text, text without a letter and an untrained network give ``und`` and score 0. Only ``text`` is an input.
    Columns named like the added ones are replaced; repeated rows are labelled alike; an empty table gives no rows.
    """
    columns = [c for c in columns if c not in names]
    inner = [f"x{k}" for k in range(len(columns))]
    chosen = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(columns, inner, strict=True)], *([] if "text" in columns else [F.col("text")]))
    at = columns.index("text") if "text" in columns else len(columns)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                b = batch.slice(first, 512)
                texts = b.column(at).to_pylist()
                known = [network is not None and has_letter(t) for t in texts]
                q = _pooled(network, [t.encode() if k else b"" for t, k in zip(texts, known, strict=True)]) if network is not None else np.zeros((len(texts), 1))
                best = q.argmax(1)
                found = [languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                score = np.where(known, np.minimum(q[np.arange(len(q)), best], 1.0), 0.0)
                arrays = [b.column(k) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, pa.string()), pa.array(score, pa.float64())], [*inner, "found", "likely"])

    fields = "".join(f"{x} {docs.schema[c].dataType.simpleString()}, " for c, x in zip(columns, inner, strict=True))
    out = chosen.mapInArrow(label, f"{fields}found string, likely double")
    return out.toDF(*columns, *names)


def remainder(docs_id: str = "doc_id", modulus: int = 4) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(docs_id).cast("string")) % modulus
