import random

import numpy as np

from tremorlake.llm import components, ngram_join, shingles


def _set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def _roots(ids, sets):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * u:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def _rows(rng):
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "straße", "A", "a"]
    rows, k = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 12, 60, 150]))]
        for _ in range(rng.choice([1, 2, 25])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 14))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((k, rng.choice([" ", "\n", "\t ", "  "]).join(own) + rng.choice(["", " ", "\n"])))
            k += 1
    rows += [(k + i, "THE same WORDS in each OF these\x0brows" if i % 2 else "the same words in each of these rows") for i in range(40)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (None, "one"), (None, "alone here"), (0, rows[0][1]), (905, "x" * 50_000), (906, "w1 " * 9000)]
    rng.shuffle(rows)
    return rows


def test_shingle_sets_equal_plain_sets():
    rng = random.Random(3)
    texts = [(t or "").encode() for _, t in _rows(rng)]
    values, at = shingles.shingle_sets(texts)
    names = {}
    for k, t in enumerate(texts):
        own = values[at[k] : at[k + 1]]
        plain = _set(t.decode())
        assert len(own) == len(plain) and (np.diff(own.astype(object)) > 0).all()
        assert names.setdefault(tuple(own), plain) == plain
    one = {(v): s for t in texts for v, s in [(tuple(shingles.shingle_sets([t])[0]), _set(t.decode()))]}
    assert one == names


def test_link_equals_all_pairs(spark, monkeypatch):
    for seed, nodes in ((1, 1000), (2, 7)):
        monkeypatch.setattr(ngram_join, "BLOCK_NODES", nodes)  # the second time clusters are divided into blocks
        rows = _rows(random.Random(seed))
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, node string").repartition(6)
        got = sorted((tuple(r) for r in ngram_join.link(df).collect()), key=str)
        sets = [_set(t) for _, t in rows]
        want = sorted(((i, len(s), c) for (i, _), s, c in zip(rows, sets, _roots([r[0] for r in rows], sets))), key=str)
        assert got == want
    assert ngram_join.link(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(50)] * 2
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {k: v for k, v in root.items() if k in got} == got
    assert all(root[k] == k for k in root.keys() - got.keys())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
