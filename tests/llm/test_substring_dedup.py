import random

from tremorlake.llm import substring_dedup as sd


def _brute(rows):
    """Every run of every text against all others, the plain way."""
    seen, gone = {}, {}
    order = sorted(set((r[0], r[1]) for r in rows if r[1]), key=lambda r: (sd.NO_ID if r[0] is None else r[0], sd._text_key(r[1])))
    for doc in order:
        parts = sd.sentences(doc[1])
        words = [p.lower().split() for p in parts]
        real = [k for k, w in enumerate(words) if w]
        for a in range(len(real)):
            for b in range(a + sd.SENTENCES, len(real) + 1):
                if sum(len(words[k]) for k in real[a:b]) >= sd.WORDS:
                    run = tuple(tuple(words[k]) for k in real[a:b])
                    if run in seen:
                        gone.setdefault(doc, set()).update(range(real[a], real[b - 1] + 1))
                    seen[run] = True
                    break
    return gone


def _sentence(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randint(0, 99)) for _ in range(n)) + rng.choice([". ", "! ", ".\n", "\n", ".\n\n  "])


def test_sentences_join_to_the_text():
    rng = random.Random(0)
    for _ in range(2000):
        text = "".join(rng.choices(["a", "b c", ".", "!", " ", "\n", '"', "3.14", "\t", "é", ")"], k=rng.randint(0, 25)))
        assert "".join(sd.sentences(text)) == text


def test_removal_equals_brute_force(spark):
    rng = random.Random(1)
    shared = ["".join(_sentence(rng, rng.randint(4, 14)) for _ in range(5)) for _ in range(3)]
    rows = []
    for i in range(60):
        own = "".join(_sentence(rng, rng.randint(1, 15)) for _ in range(rng.randint(0, 8)))
        rows.append((i, own + (rng.choice(shared) if rng.random() < 0.4 else "") + "".join(_sentence(rng, 9) for _ in range(3)), 7))
    rows += [(100 + i, rows[3][1].upper() if i % 2 else rows[3][1], 7) for i in range(20)]
    rows += [(4, rows[4][1], 7), (5, shared[0], 7), (None, shared[1], 7), (200, None, 7), (201, "", 7), (202, shared[2] * 3, 7), (203, "x" * 100_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int").repartition(7)
    old, sd.CHUNK = sd.CHUNK, 50
    try:
        got = sd.remove_repeats(df).collect()
    finally:
        sd.CHUNK = old
    gone = _brute(rows)
    assert len(got) == len(rows) and sum(r["n_removed"] for r in got) > 100
    want = sorted(
        ((r[0] is None, r[0] or 0, r[1] is None, None if r[1] is None else "".join(p for k, p in enumerate(sd.sentences(r[1])) if k not in gone.get(r[:2], ()))) for r in rows), key=str
    )
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"]) for r in got), key=str) == want
    assert sd.remove_repeats(df.limit(0)).count() == 0


def _brute_all(rows):
    """As ``_brute``, with runs of every length."""
    seen, gone = set(), {}
    for doc_id, text in rows:
        words = [p.lower().split() for p in sd.sentences(text)]
        real = [k for k, w in enumerate(words) if w]
        for a in range(len(real)):
            for b in range(a + sd.SENTENCES, len(real) + 1):
                run = tuple(tuple(words[k]) for k in real[a:b])
                if sum(map(len, run)) >= sd.WORDS:
                    if run in seen:
                        gone.setdefault(doc_id, set()).update(range(real[a], real[b - 1] + 1))
                    seen.add(run)
    return gone


def test_ends_of_passages_go_too(spark):
    from tremorlake.llm import queries

    rng = random.Random(3)
    sentence = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) + ". "
    passage = sentence(30) + sentence(5) + sentence(5)
    shared = ["".join(sentence(rng.randint(1, 25)) for _ in range(6)) for _ in range(3)]
    texts = [passage + sentence(9), sentence(9) + passage, passage + sentence(9)]
    texts += ["".join(rng.choice([sentence(rng.randint(1, 12)), rng.choice(shared), "\n"]) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    gone = _brute_all(rows)
    assert gone[1] == {1, 2, 3} and gone[2] == {0, 1, 2}
    old = queries.common.table
    queries.common.table = lambda *_: df
    try:
        got = {r["doc_id"]: set(r["removed"]) for r in queries.op9_substring_dedup(spark, "").collect()}
    finally:
        queries.common.table = old
    assert got == {k: gone.get(k, set()) for k, _ in rows}
