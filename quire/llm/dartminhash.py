"""DartMinHash: sparse weighted minwise signatures from hashed darts.

A weighted set is laid out as one column of unit width for each unit of an element's weight (the last may be narrower).
Over every column darts are thrown by hash alone, as a Poisson process of rate one on weight x rank, in rank regions
that double from 2**-6 to 1 and then keep width one. A dart inside the element's weight belongs to the signature
coordinate that its hash names; each coordinate keeps the dart of least rank. Two sets agree in a coordinate with
probability equal to their weighted Jaccard similarity. Regions are visited upward only until every coordinate has
its dart, so a set of n columns costs O(n + k log k).
"""

from __future__ import annotations

import math

import numpy as np
import xxhash

SHINGLE_WORDS = 5
_LOWEST = 6
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _salt(i: int) -> np.uint64:
    return np.uint64((i + 1) * int(_M3) & 0xFFFFFFFFFFFFFFFF)


def _share(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def regions():
    """(first cell, number of cells, lowest rank, width of a cell) of the rank regions, without end."""
    yield 0, 1, 0.0, 2.0**-_LOWEST
    for e in range(_LOWEST, 0, -1):
        yield _LOWEST - e + 1, 1, 2.0**-e, 2.0**-e
    n = 1
    while True:  # cells of width one, in regions that double
        yield _LOWEST + n, n, float(n), 1.0
        n *= 2


def signatures(columns: np.ndarray, owner: np.ndarray, n_sets: int, k: int, width: np.ndarray | None = None) -> np.ndarray:
    """[n_sets, k] dart ids. columns: hashes of (element, unit); owner: their sets, each with one column at least;
    width: how much of each column's unit weight there is (1 if not given)."""
    best = np.zeros(n_sets * k, dtype=np.uint64)
    missing = np.ones(n_sets * k, dtype=bool)
    for first_cell, cells, low, wide in regions():
        if cells == 1:
            first = mix(columns + _salt(first_cell))
        else:
            first = mix((columns[:, None] + np.array([_salt(first_cell + c) for c in range(cells)], dtype=np.uint64)).ravel())
        u, darts, p, below, i = _share(first), [], math.exp(-wide), math.exp(-wide), 0
        on = np.flatnonzero(u >= below)
        while len(on):  # the cells with more than i darts
            spot, column = mix(first[on] + _salt(i)), on // cells
            rank = low + on % cells + wide * _share(spot)
            name = mix(spot ^ _M3)
            if width is None:
                darts.append((owner[column], rank, name))
            else:
                keep = _share(mix(name ^ _M2)) < width[column]
                darts.append((owner[column][keep], rank[keep], name[keep]))
            i += 1
            p *= wide / i
            below += p
            on = on[u[on] >= below] if i < 40 else on[:0]
        if darts:
            who, rank, name = (np.concatenate(x) for x in zip(*darts, strict=True))
            place = who * k + ((name >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            new = missing[place]
            place, rank, name = place[new], rank[new], name[new]
            order = np.argsort(-rank, kind="stable")  # the least rank is written last
            best[place[order]] = name[order]
            missing[place] = False
        full = ~missing.reshape(n_sets, k).any(axis=1)
        if full.all():
            return best.reshape(n_sets, k)
        if full[owner].any():
            left = ~full[owner]
            columns, owner = columns[left], owner[left]
            width = width if width is None else width[left]


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def shingle_columns(texts: list[str], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns and owners of the texts' bags of word shingles, and the number of columns of each text.

    A text of fewer than size words, but not none, has one shingle of all its words.
    """
    flat: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    digest = xxhash.xxh3_64_intdigest
    for i, text in enumerate(texts):
        found = [digest(w) for w in words(text)]
        counts[i] = len(found)
        if 0 < len(found) < size:
            found += [0] * (size - len(found))
        flat += found
    padded = np.where(counts > 0, np.maximum(counts, size), 0)
    hashes = np.array(flat, dtype=np.uint64)
    made = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), made)
    if not len(owner):
        return np.zeros(0, dtype=np.uint64), owner, made
    at = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + np.repeat(np.cumsum(padded) - padded, made)
    shingle = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        shingle = mix(shingle + hashes[at + j] + _M3)
    # the j-th copy of a shingle in a text gets a column of its own
    order = np.lexsort((shingle, owner))
    s, o = shingle[order], owner[order]
    fresh = np.ones(len(s), dtype=bool)
    fresh[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(s)), 0))
    copy = (np.arange(len(s)) - start).astype(np.uint64)
    return mix(s + copy * _M1), o, made


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of columns."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """[n_sets, bands] int64 bucket names, different in each band."""
    n, k = signature.shape
    bands = k // rows
    out = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
    for j in range(rows):
        out = mix(out * _M3 + signature[:, j : bands * rows : rows])
    return out.view(np.int64)
