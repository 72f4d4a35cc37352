import hashlib
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from tremorlake.llm import fingerprints as fp
from tremorlake.llm import packing


def _text(rng, n):
    return "".join(rng.choice("abc déß\n.") for _ in range(n))


def test_chunks_cover_and_obey_sizes():
    rng = random.Random(1)
    for n in (0, 1, 15, 16, 17, 48, 300, 5000):
        data = _text(rng, n).encode()
        ends = fp.chunk_ends(data)
        assert (ends[-1] if ends else 0) == len(data)
        sizes = np.diff([0, *ends])
        assert all(s <= fp.MOST for s in sizes) and all(s >= fp.LEAST for s in sizes[:-1])
        for a, b in zip([0, *ends], ends):  # each chunk depends on what follows its start alone
            assert fp.chunk_ends(data[a:])[0] == b - a


def test_fingerprint_is_shift_resistant_and_round_trips():
    rng = random.Random(2)
    text = _text(rng, 4000)
    own = fp.fingerprint(text)
    assert fp.parse(fp.as_text(own)) == own
    assert fp.likeness(own, fp.fingerprint("xyz " + text)) > 0.9
    assert fp.likeness(own, fp.fingerprint(_text(rng, 4000))) < 0.1
    assert fp.likeness({}, {}) == 1 and fp.likeness({}, own) == 0


def test_edit_likeness_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, None if i == 5 else _text(rng, rng.choice([0, 1, 2, 40, 700])), i) for i in rng.sample(range(500), 60)]
    rows += [(rows[0][0], rows[0][1], 0), (None, "no id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, range_no int").repartition(5)
    got = {tuple(r[:3]): r for r in fp.edit_likeness(df, 2000).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = 0
    for i, (doc_id, text, _) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = got[(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest())]
        a, e, b = fp.fingerprint(text), fp.fingerprint(edited), fp.fingerprint(after)
        assert r[3:5] == (fp.as_text(a), fp.as_text(e))
        assert r[5:] == (fp.likeness(a, e), fp.likeness(a, b))
        want += 1
    assert fp.edit_likeness(df, 2000).count() == want
    assert fp.edit_likeness(df.limit(0)).count() == 0
    assert fp.edit_likeness(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()["n_chars"] == 6


def test_token_bytes_equal_the_tokenizer():
    rng = random.Random(4)
    alphabet = ["the", " ", "  ", "\n", "\t", "don't", "É", "x²", "½", "Ⅷ", "a_b", "__", "!?", "12", "٣", "中文", "\x1c", "\x85", "\xa0", "é́", "<|endoftext|>", "'ll", "''s", "€", "🙂", "ª"]
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    for text, got in zip(texts, packing.token_bytes(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def _least_bins(counts, c):
    """A known lower bound: pieces over half a bin exclude each other, the smaller ones need what room they leave."""
    best = -(-sum(x * k for x, k in counts.items()) // c)
    for small in range(c // 2 + 1):
        n1 = sum(k for x, k in counts.items() if x > c - small)
        middle = [(x, k) for x, k in counts.items() if c / 2 < x <= c - small]
        n2 = sum(k for _, k in middle)
        low = sum(x * k for x, k in counts.items() if small <= x <= c / 2)
        best = max(best, n1 + n2 + max(0, -(-(low - n2 * c + sum(x * k for x, k in middle)) // c)))
    return best


def test_plan_uses_every_piece_once_and_fills_bins():
    rng = random.Random(5)
    counts = {rng.randint(1, 1024): rng.randint(1, 50) for _ in range(300)}
    bins = packing.plan(counts)
    used = {}
    for b, times in bins:
        assert sum(x * k for x, k in b.items()) <= 1024
        for x, k in b.items():
            used[x] = used.get(x, 0) + k * times
    assert used == counts
    assert sum(t for _, t in bins) <= _least_bins(counts, 1024) * 1.003 + 2
    assert sum(t for _, t in packing.plan({6: 2, 4: 2, 5: 2}, 10)) == 3
    assert packing.plan({}) == []


def test_pack_places_whole_documents(spark):
    rng = random.Random(6)
    rows = [(i, None if i % 17 == 0 else "word " * rng.choice([0, 1, 100, 1023, 1024, 3000]), "x") for i in range(120)] + [(3, "again", "y")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(4)
    got = packing.pack(df, with_ids=True).collect()
    by_sequence = {}
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    for doc_id, text, _ in rows:
        if doc_id != 3:
            own = sorted((r for r in got if r["doc_id"] == doc_id), key=lambda r: r["piece"])
            ids = [x for r in own for x in r["ids"]]
            assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
            assert [r["start"] for r in own] == list(np.cumsum([0, *[r["length"] for r in own]])[:-1])
            assert all(r["length"] == 1024 for r in own[1:])
    assert sum(r["doc_id"] == 3 for r in got) >= 4
    assert packing.pack(df.limit(0)).count() == 0
