"""Word shingles as sorted 64-bit hashes, made for many texts at a time on their bytes.

Words are hashed by prefix sums of a polynomial over the bytes, shingles by mixing the hashes of their words. Equal
shingles always have equal hashes; two different ones share a hash with probability of about 2^-64.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_ROOT = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Code points 9 to 13 and 32 separate words.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_PLACE = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xDA942042E4DD58B5)) | np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, n: int) -> np.ndarray:
    """Powers of the root, or of its inverse, up to the ``n``-th."""
    have = _powers[name]
    if len(have) < n:
        base = _ROOT if name == "up" else np.uint64(pow(int(_ROOT), -1, 1 << 64))
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 20), base, np.uint64)]))
        _powers[name] = have
    return have[:n]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one text after another, and where each text's begin (one more than texts).

    A-Z count as lower case. A text of fewer words than a shingle has one, of all its words; one without words has none.
    """
    count = len(texts)
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))  # words begin and end by turns
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(count + 1, np.int64)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _power("up", len(data)))])
        word = mix((sums[end] - sums[start]) * _power("down", len(data))[start] + (end - start).astype(np.uint64) * _PLACE[0])
        first = np.concatenate([[0], np.searchsorted(start, ends_of_text)])  # each text's first word
        n_words = np.diff(first)
        owner = np.repeat(np.arange(count), n_words)
        rank = np.arange(len(word)) - first[owner]
        whole = rank + WORDS <= n_words[owner]
        at = np.flatnonzero(whole)
        total = np.zeros(len(at), np.uint64)
        for k in range(WORDS):
            total += word[at + k] * _PLACE[k]
        value, of = mix(total), owner[at]
        short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
        if len(short):
            sums = np.zeros(len(short), np.uint64)
            for k in range(WORDS - 1):
                inside = n_words[short] > k
                sums[inside] += word[first[short][inside] + k] * _PLACE[k]
            value = np.concatenate([value, mix(sums + n_words[short].astype(np.uint64))])
            of = np.concatenate([of, short])
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1]))[: len(value)]
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(count + 1))


def groups(texts, most: int = 1 << 20):
    """(first, texts as bytes) in groups of about ``most`` bytes; null counts as empty."""
    held, size, first = [], 0, 0
    for k in range(len(texts)):
        held.append((texts[k].as_py() or "").encode())
        size += len(held[-1])
        if size >= most:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def set_key(values: np.ndarray) -> int:
    """A 64-bit key of a whole set."""
    return xxhash.xxh3_64_intdigest(values.tobytes())
