"""Word shingles, MinHash and odd sketches of many texts at once, as array operations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

CJK_FIRST, CJK_LAST = 0x4E00, 0x9FFF
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@lru_cache(1)
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(4)
def _powers(count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    out[1:] = np.uint64(0x5851F42D4C957F2D)
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of the lower-cased texts, in order.

    Words are the longest runs of letters and digits, except that each character
    U+4E00 to U+9FFF is a word by itself.
    """
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _word_characters()[points]
    single = (points >= CJK_FIRST) & (points <= CJK_LAST)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | single[1:] | single[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    word = np.cumsum(begins)[at] - 1
    offset = at - starts[word]
    longest = int(offset.max()) + 1
    powers = _powers(1 << (longest - 1).bit_length() if longest > 1 else 1)
    values = (points[at].astype(np.uint64) + np.uint64(1)) * powers[offset]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    hashes = mix(np.add.reduceat(values, first))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    return hashes, np.searchsorted(ends, starts, "right")


def shingle_sets(texts: list[str], width: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts with ``least_words`` words or more.

    Returns the hashes, sorted inside each text, the place where each text's
    begin, and the numbers of those texts.
    """
    none = np.zeros(0, np.int64)
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    if len(words) < width:
        return np.zeros(0, np.uint64), none, none
    count = len(words) - width + 1
    hashes = words[:count].copy()
    for k in range(1, width):
        hashes = mix(hashes * ODD + words[k : k + count])
    usable = (owner[:count] == owner[width - 1 :]) & (counts[owner[:count]] >= least_words)
    hashes, owner = hashes[usable], owner[:count][usable]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    distinct = np.ones(len(hashes), dtype=bool)
    distinct[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[distinct], owner[distinct]
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    return hashes, starts, owner[starts]


def set_fingerprints(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit number for each set; equal sets have equal ones."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix(np.add.reduceat(mix(hashes), starts) ^ np.add.reduceat(mix(hashes ^ ODD), starts) * ODD)


def min_hashes(hashes: np.ndarray, starts: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """``samples`` MinHash values of every set, one row per set."""
    factors = np.random.default_rng(seed).integers(0, 2**63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(starts), samples), np.uint64)
    for k in range(samples):
        scaled = hashes * factors[k]
        out[:, k] = np.minimum.reduceat(scaled ^ (scaled >> np.uint64(32)), starts) if len(starts) else 0
    return out


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps of MinHash samples, ``bits`` / 8 bytes each.

    Sample k of a set flips one bit chosen by (k, value); samples two sets share
    cancel in the XOR of their sketches.
    """
    count, width = samples.shape
    tag = mix(np.arange(1, width + 1, dtype=np.uint64))
    place = (mix(samples + tag) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount((np.arange(count)[:, None] * bits + place).ravel(), minlength=count * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(count, bits), axis=1)


def estimated_similarity(differing_bits: np.ndarray, samples: int, bits: int) -> np.ndarray:
    """Jaccard similarity estimated from the XOR population count of two odd sketches."""
    rest = np.maximum(1 - 2 * differing_bits / bits, 1e-9)
    return 1 + bits / (4 * samples) * np.log(rest)
