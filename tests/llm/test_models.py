import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.llm import langid, quality_fm


def _network(classes=3, seed=0):
    return langid._params(np.random.default_rng(seed), classes)


def test_gradients_equal_differences():
    rng = np.random.default_rng(1)
    segments, mask = rng.integers(97, 120, (6, 20)).astype(np.uint8), np.arange(20) < rng.integers(5, 21, (6, 1))
    y, p = rng.integers(0, 3, 6), {n: v.astype(np.float64) for n, v in _network().items()}
    _, grads = langid.loss_and_grads(p, segments, mask, y)
    for n in p:
        for i in np.argsort(-np.abs(grads[n]).ravel())[:4]:
            at = np.unravel_index(i, p[n].shape)
            lo, hi = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            lo[n][at] -= 1e-3
            hi[n][at] += 1e-3
            slope = (langid.loss_and_grads(hi, segments, mask, y)[0] - langid.loss_and_grads(lo, segments, mask, y)[0]) / 2e-3
            assert grads[n][at] == pytest.approx(slope, rel=0.05, abs=1e-4)


def test_pooling_equals_plain_means_over_all_bytes():
    p, rng = _network(), random.Random(2)
    texts = ["".join(rng.choices("abc é", k=n)).encode() for n in (0, 1, 63, 64, 65, 500, 20_000)]
    got = langid._pooled(p, texts)
    for t, q in zip(texts, got):
        if t:
            segments, n = langid.segments_of(t)
            assert q == pytest.approx(langid.byte_probabilities(p, segments).reshape(-1, 3)[:n].mean(0), abs=1e-5)


def _plain_states(p, d, data):
    """The recurrence of one direction, a byte and a unit at a time."""
    size, x, u, c = langid.HIDDEN, *(p[f"{n}{d}"].tolist() for n in "xuc")
    cut = lambda v, low: min(1.0, max(low, v))
    h, out = [0.0] * size, []
    for byte in data:
        r = [c[j] + sum(h[i] * u[i][j] for i in range(size)) for j in range(3 * size)]
        gates = [cut((x[byte][j] + r[j]) / 4 + 0.5, 0.0) for j in range(2 * size)]
        new = [cut(x[byte][2 * size + j] + gates[size + j] * r[2 * size + j], -1.0) for j in range(size)]
        h = [(1 - gates[j]) * new[j] + gates[j] * h[j] for j in range(size)]
        out.append(h)
    return out


def _plain_probabilities(p, text):
    """Means over a text's bytes; segments are read in both directions, the last one filled with spaces."""
    data, total = text.encode(), np.zeros(len(p["k"]))
    for a in range(0, len(data), langid.STEPS):
        part = data[a : a + langid.STEPS].ljust(langid.STEPS)
        ahead, back = _plain_states(p, "f", part), _plain_states(p, "b", part[::-1])[::-1]
        for f, b in list(zip(ahead, back))[: len(data) - a]:
            e = np.exp([p["k"][j] + sum(v * p["o"][i][j] for i, v in enumerate(f + b)) for j in range(len(p["k"]))])
            total += e / e.sum()
    return total / len(data)


def test_predictions_equal_a_plain_network(spark):
    network, languages, rng = _network(seed=9), ["aa", "bb", "cc"], random.Random(10)
    texts = ["".join(rng.choices("abcdeé ß日1.", k=n)) + "x" for n in (0, 1, 30, 63, 64, 90, 200)]
    docs = spark.createDataFrame([*enumerate(texts), (50, "12"), (51, None)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in langid.predict(docs, languages, network, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        q = _plain_probabilities(network, t)
        assert got[i]["lang_pred"] == languages[q.argmax()] and got[i]["score"] == pytest.approx(q.max(), abs=1e-5)
    assert {(got[i]["lang_pred"], got[i]["score"]) for i in (50, 51)} == {("und", 0.0)} and len(got) == len(texts) + 2


def _docs(spark, n=240):
    rng = random.Random(3)
    words = {"en": "the of and to in is that was", "de": "der die und nicht mit sich auf für", "fr": "le la les des est une qui élan"}
    rows = [(i, " ".join(rng.choices(words[l].split(), k=rng.randint(3, 60))), l, "s", 1.5) for i in range(n) for l in [rng.choice(list(words))]]
    rows += [(900, None, "en", "s", 1.0), (901, "", None, "s", 1.0), (902, "12 !?", "de", "s", 1.0), (None, "und nicht mit", "de", "s", 1.0), (1, rows[1][1], rows[1][2], "s", 1.0), (903, "der die und " * 20_000, "de", "s", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").repartition(4)


def test_language_is_learned_and_edges_are_defined(spark):
    docs = _docs(spark)
    held_out = F.coalesce(langid.remainder() == 2, F.lit(False))
    languages, network = langid.train(docs, ~held_out)
    assert languages == ["de", "en", "fr"]
    got = langid.predict(docs, languages, network, ["doc_id", "lang"]).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[900] == by[901] == by[902] == "und" and by[None] == by[903] == "de"
    known = [r for r in got if r["lang_pred"] != "und"]
    assert np.mean([r["lang"] == r["lang_pred"] for r in known]) > 0.97
    empty = docs.limit(0)
    assert langid.train(empty) == ([], None) and langid.predict(empty, [], None, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, [], None, ["doc_id"]).collect()} == {"und"}


def test_factorisation_machine_identity():
    rng = np.random.default_rng(4)
    model = {"b": np.float64(0.3), "w": rng.standard_normal(quality_fm.FEATURES), "v": rng.standard_normal((quality_fm.FEATURES, quality_fm.RANK))}
    at, x = quality_fm.features("The cat sat, the Cat ran. The END", 30)
    x = x.astype(float)
    plain = model["b"] + sum(model["w"][i] * v for i, v in zip(at, x))
    plain += sum(model["v"][at[i]] @ model["v"][at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert quality_fm.raw_score(model, at, x) == pytest.approx(plain)


def _plain_structure(text, n_chars):
    """The statistics by single bytes, words and lines."""
    data, spaces = list(text.encode()), b" \t\n\r\x0b\x0c"
    words, lines, word = [], [], b""
    for b in [*data, 32]:
        if b in spaces:
            words += [word] if word else []
            word = b""
        else:
            word += bytes([b])
    for line in text.encode().split(b"\n"):
        lines += [line.strip(spaces)] if line.strip(spaces) else []
    among = lambda chars: sum(b in chars for b in data)
    upper, padded, run, bars, at = sum(65 <= b <= 90 for b in data), 0, 0, 0, 0
    letters = upper + sum(97 <= b <= 122 or b >= 128 for b in data)
    for b in [*data, 32]:
        run = run + 1 if b in b"#*$%&!" else 0
        padded += run == 2
    while at + 3 <= len(data):
        hit = bytes(data[at : at + 3]) == b" | "
        bars, at = bars + hit, at + (3 if hit else 1)
    stops = sum(b in b".!?" and (k + 1 == len(data) or data[k + 1] in spaces) for k, b in enumerate(data))
    n, size, n_lines = max(1, len(words)), max(1, len(data)), max(1, len(lines))
    values = [np.log2(len(words) + 1), 0.6 * np.log2(len(data) + 1), 12 * min(1, sum(map(len, words)) / n / 18), 24 * upper / max(1, letters), 120 * among(b"#*$%&|<>!") / size]
    values += [60 * among(b"0123456789") / size, 24 * stops / n, 12 * len(set(words)) / n, 12 * (1 - len(set(lines)) / n_lines), 1.5 * np.log2(n / n_lines + 1), 24 * padded / n]
    values += [24 * bars / n, 12 * letters / size, 40 * sum(words[k] == words[k - 1] for k in range(1, len(words))) / n, 0 if n_chars is None else 1 + 0.6 * np.log2(max(0, n_chars) + 1)]
    return [min(11, max(0, int(v))) for v in values]


def _plain_score(model, text, n_chars):
    """Log-odds with every pair of features multiplied out."""
    at, x = quality_fm.features(text, n_chars)
    s = float(model["b"]) + sum(model["w"][i] * v for i, v in zip(at, x))
    return s + sum(model["v"][at[i]] @ model["v"][at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))


def _odd_texts():
    rng = random.Random(12)
    return ["", " \n ", "A", "!!! ## $", "one one one. Two!\nsame | line | | x\n same | line | | x\n\n12 34", "é ß 日本 x."] + [
        "".join(rng.choices(["the ", "Dog ", "x", "7", "!", "#", " | ", "\n", "\t", ". ", "ü", "\x0b"], k=rng.randint(1, 300))) for _ in range(40)
    ]


def test_structure_and_scores_equal_plain_ones(spark):
    rng, texts = np.random.default_rng(13), _odd_texts()
    for k, t in enumerate(texts):
        assert quality_fm.structure(t, k or None) == _plain_structure(t, k or None)
    model = {"b": np.float64(-0.2), "w": rng.standard_normal(quality_fm.FEATURES) / 4, "v": rng.standard_normal((quality_fm.FEATURES, quality_fm.RANK)) / 4}
    rows = [(k, t, k or None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (900, None, None)], "doc_id long, text string, n_chars long").repartition(3)
    got = {r["doc_id"]: r["score"] for r in quality_fm.score(docs, model, ["doc_id"]).collect()}
    for k, t, n in [*rows, (900, "", None)]:
        assert got[k] == pytest.approx(1 / (1 + np.exp(-np.clip(_plain_score(model, t, n), -30, 30))), abs=1e-4)


def test_a_training_step_follows_the_loss():
    texts = _odd_texts()[:12]
    rows, y = [(a, x.astype(float)) for a, x in (quality_fm.features(t, len(t)) for t in texts)], np.array([1.0, 0, 0, 0] * 3)
    got = quality_fm.fit(rows, y, epochs=1)
    start = {"b": np.zeros(()), "w": np.zeros(quality_fm.FEATURES), "v": np.random.default_rng(quality_fm.SEED).standard_normal((quality_fm.FEATURES, quality_fm.RANK)) * 0.05}

    def loss(model):  # label 1 has a quarter of the rows, so it weighs three times
        s = np.array([_plain_score(model, t, len(t)) for t in texts])
        return np.mean(np.where(y == 1, 3.0, 1.0) * (np.logaddexp(0, s) - y * s))

    places = [("b", ())] + [("w", (i,)) for i in rows[4][0][::9]] + [("v", (i, r)) for i in rows[4][0][::12] for r in (0, 5)]
    for n, at in places:
        ends = []
        for step in (1e-4, -1e-4):
            moved = {k: v.copy() for k, v in start.items()}
            moved[n][at] += step
            ends.append(loss(moved))
        g = (ends[0] - ends[1]) / 2e-4 + quality_fm.L2 * start[n][at]
        want = start[n][at] - quality_fm.RATE * g / np.sqrt(1e-3 + g * g) - (np.log(3) / 2 if n == "b" else 0)
        assert got[n][at] == pytest.approx(want, abs=2e-4)


def test_quality_is_learned_and_edges_are_defined(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    make = lambda good: " ".join(w if good else w.upper() + "!!" for w in rng.choices(words, k=rng.randint(20, 80)))
    rows = [(i, make(i % 4 != 0), None if i % 7 == 0 else 100, "x") for i in range(400)] + [(900, None, None, "x"), (901, "", 0, "x"), (902, "ok " * 50_000, 1, "x"), (None, "w1 w2", 5, "x"), (1, "w3 w4 w5", 8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(400)] + [(5, None), (None, 1), (7777, 0)], "doc_id long, quality int")
    allowed = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    got = quality_fm.score(docs, quality_fm.train(docs, labels, allowed), ["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    own = [(r["doc_id"], r["predicted"]) for r in got if r["doc_id"] is not None and 1 < r["doc_id"] < 400]
    assert np.mean([p == int(i % 4 != 0) for i, p in own]) > 0.97
    assert quality_fm.train(docs, labels.limit(0)) is None
    assert {r["score"] for r in quality_fm.score(docs, None, ["doc_id"]).collect()} == {0.5}
    assert quality_fm.score(docs.limit(0), None, ["doc_id"]).count() == 0
