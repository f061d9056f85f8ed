"""Hashes of many texts at once in numpy: mixing, substring hashes, exact multiset overlap.

Texts are handled in blocks of bounded size, so that a batch with long texts needs no more memory.
"""

from __future__ import annotations

import sys

import numpy as np

from clinflow.session import send_by_value

send_by_value(__name__)

BASE = 0x9E3779B97F4A7C15
BLOCK_CHARS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on an array of unsigned 64-bit integers."""
    x = x + np.uint64(BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes_of(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every codes[start:end]: equal spans hash equally wherever they stand."""
    n = 1 << max(int(len(codes)).bit_length(), 10)
    if n not in _powers:
        _powers.clear()
        _powers[n] = powers(n, BASE), powers(n, pow(BASE, -1, 1 << 64))
    up, down = _powers[n]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64)) * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def blocks(texts: list[str], size: int = BLOCK_CHARS):
    """(first, last) of runs of texts that together have about `size` characters."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def word_shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the runs of `width` words of each text, in lower case, with every repetition.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    owners, starts, ends, parts, at = [], [], [], [], 0
    for i, text in enumerate(texts):
        codes = codes_of(" ".join(text.lower().split()))
        if len(codes):
            spaces = np.flatnonzero(codes == 32)
            first = np.concatenate(([0], spaces + 1))
            last = np.concatenate((spaces, [len(codes)]))
            k = min(width, len(first)) - 1
            starts.append(first[: len(first) - k] + at)
            ends.append(last[k:] + at)
            owners.append(np.full(len(first) - k, i))
            parts.append(codes)
            at += len(codes)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), span_hashes(np.concatenate(parts), np.concatenate(starts), np.concatenate(ends))


def char_shingles(texts: list[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the runs of `width` characters of each text; a shorter text is one shingle."""
    codes = codes_of("".join(texts))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    stop = np.cumsum(size)
    runs = np.where(size > 0, np.maximum(size - width + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), runs)
    first = np.arange(len(owner)) + np.repeat(stop - size - (np.cumsum(runs) - runs), runs)
    return owner, span_hashes(codes, first, np.minimum(first + width, stop[owner]))


def counted(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, count) of the different hashes of each owner, in order."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner)))


def overlaps(left: tuple, right: tuple, n: int, multiset: bool) -> np.ndarray:
    """Jaccard of pairs 0 … n-1 from (owner, hash) of both sides; as multisets, or as sets.

    Two sides without shingles are equal, so 1.
    """
    sides = []
    for owner, hashes in (left, right):
        owner, hashes, count = counted(owner, hashes)
        sides.append((owner, hashes, count if multiset else np.ones(len(count), np.int64)))
    total = sum(np.bincount(owner, weights=count, minlength=n) for owner, _, count in sides)
    owner, hashes, count = (np.concatenate(x) for x in zip(*sides))
    order = np.lexsort((hashes, owner))
    owner, hashes, count = owner[order], hashes[order], count[order]
    twice = np.flatnonzero((owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1]))
    shared = np.bincount(owner[twice], weights=np.minimum(count[twice], count[twice + 1]), minlength=n)
    return np.where(total == 0, 1.0, shared / np.maximum(total - shared, 1))


def set_overlaps(left: tuple, right: tuple, n: int) -> np.ndarray:
    """Jaccard of the sets of pairs 0 … n-1 from (owner, hash) of both sides; 1 where both are empty.

    Owner and the upper bits of the hash (40 at least) share a 64-bit number, so that plain sorts do the work.
    """
    bits = np.uint64(max(int(n).bit_length(), 1))
    assert bits <= 24
    sides = []
    for owner, hashes in (left, right):
        found = np.sort((owner.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits))
        new = np.ones(len(found), bool)
        np.not_equal(found[1:], found[:-1], out=new[1:])
        sides.append(found[new])
    total = sum(np.bincount((x >> (np.uint64(64) - bits)).astype(np.int64), minlength=n) for x in sides)
    both = np.sort(np.concatenate(sides))
    twice = both[1:][both[1:] == both[:-1]]
    shared = np.bincount((twice >> (np.uint64(64) - bits)).astype(np.int64), minlength=n)
    return np.where(total == 0, 1.0, shared / np.maximum(total - shared, 1))


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature (an array of unsigned 64-bit integers)."""
    keys = np.zeros((len(signatures), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        keys = mix(keys ^ signatures[:, r : bands * rows : rows])
    return keys.view(np.int64)


assert sys.byteorder == "little"
