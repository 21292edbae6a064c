"""Word-shingle sets of texts and their fast similarity sketches.

Words are the runs of bytes other than ASCII white space, A-Z lower-cased. A
text's set holds its distinct ``width``-word shingles as 64-bit hashes (a text
of fewer words has one shingle, its whole sequence; one without words has
none).

*Fast similarity sketching* (Dahlgaard, Knudsen and Thorup, 2017): in round i
every element is hashed to a coordinate and a value i + fraction, and each
coordinate keeps its least value; in rounds t to 2t - 1 all elements go to
coordinate i - t, so every coordinate is filled. A set is done as soon as all
t are filled, after about t log t / n rounds. Two sets agree in a coordinate
with the probability of their Jaccard similarity, with Chernoff-like
concentration of the number of agreements over all t.
"""

from __future__ import annotations

import numpy as np

from .common import mix64, worker_state

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


SEGMENT = 1 << 18
BLANKS = np.array([c == 0x20 or 9 <= c <= 13 for c in range(256)])


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit number for each byte, powers of an odd base, and powers of its inverse (modulo 2 ** 64)."""
    base = int(ODD[1])
    inverse = pow(base, -1, 1 << 64)
    table = mix64(np.arange(1, 257, dtype=np.uint64) * ODD[0])
    up, down = (np.full(SEGMENT + 1, x, np.uint64) for x in (base, inverse))
    up[0] = down[0] = 1
    return table, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts in order, number of words of each text).

    A word's hash is the polynomial of its bytes' numbers, had from running sums over a segment
    of text, with its length mixed in; no word becomes a Python object. A word longer than a segment
    goes by its digest."""
    import xxhash
    table, up, down = worker_state("word powers", _powers)
    raw = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    out, starts_seen, a = [], [], 0
    while a < len(data):
        b = min(a + SEGMENT, len(data))
        own = data[a:b]
        word = ~BLANKS[own]
        if b < len(data) and word[-1] and not BLANKS[data[b]]:  # do not cut a word
            last = np.flatnonzero(~word)
            if len(last):
                b = a + int(last[-1]) + 1
                own, word = own[:b - a], word[:b - a]
            else:
                stop = b + int(np.argmax(BLANKS[data[b:]]))
                starts_seen.append(np.array([a]))
                out.append(np.array([xxhash.xxh64_intdigest(data[a:stop].tobytes())], np.uint64))
                a = stop
                continue
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(table[own] * up[:len(own)], out=total[1:])
        out.append(mix64((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * ODD[3]))
        starts_seen.append(first + a)
        a = b
    if not out:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.searchsorted(np.concatenate(starts_seen), ends)
    return np.concatenate(out), np.diff(at, prepend=0)


def _set(h: np.ndarray, width: int) -> np.ndarray:
    if not len(h):
        return np.zeros(0, np.uint64)
    n = min(width, len(h))
    s = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        s += mix64(h[k:len(h) - n + 1 + k] + ODD[k % 8]) * np.uint64(int(ODD[k % 8]) + 2 * (k // 8) & 0xFFFFFFFFFFFFFFFF)
    return np.unique(mix64(s))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    h, n = hash_words(texts)
    return [_set(x, width) for x in np.split(h, np.cumsum(n)[:-1])] if len(texts) else []


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches (len(sets) x t) of non-empty sets."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), t), top)
    active = np.arange(len(sets))
    flat = out.reshape(-1)
    elements = owner = None
    for i in range(2 * t):
        if elements is None:
            elements = np.concatenate([sets[a] for a in active]) if len(active) else np.zeros(0, np.uint64)
            owner = np.repeat(active, [len(sets[a]) for a in active])
        v = mix64(elements + np.uint64((i + 1) * int(ODD[0]) & 0xFFFFFFFFFFFFFFFF))
        place = (v % np.uint64(t)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, owner * t + place, np.uint64(i) << np.uint64(48) | v >> np.uint64(16))
        left = active[(out[active] == top).any(axis=1)]
        if not len(left):
            break
        if len(left) < len(active):
            active, elements = left, None
    return out


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; the band's number is part of it."""
    n, t = sketches.shape
    bands = sketches.reshape(n, t // rows, rows)
    key = np.arange(t // rows, dtype=np.uint64)[None, :] * ODD[7]
    for k in range(rows):
        key = mix64((key ^ bands[:, :, k]) * ODD[k % 7] + ODD[(k + 1) % 7])
    return key
