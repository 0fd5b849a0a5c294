"""Byte-pair encoding with a pair occurrence index.

All new words of a batch are laid side by side in one symbol sequence.  An index
maps every mergeable pair, by its rank, to all positions where it occurs; ranks
are applied in ascending order, and each merge adds the pairs it creates to the
lists of their ranks.  A created pair contains the merged symbol, so its rank is
higher than the current one and one ascending sweep is enough.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

# the fixed split pattern of the byte-level vocabularies
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of every byte: itself if visible in Latin-1, else the next code from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in visible}
    hidden = [b for b in range(256) if b not in set(visible)]
    stand_in.update({chr(256 + i): b for i, b in enumerate(hidden)})
    return stand_in


@dataclass(frozen=True)
class Merges:
    """A byte-level vocabulary: the id of each byte, and pair -> (rank, merged id)."""

    byte_ids: tuple[int, ...]
    pairs: dict[tuple[int, int], tuple[int, int]]


def load_merges(path: str) -> Merges:
    """Read a vocabulary file in the JSON form (``model.vocab`` and ``model.merges``)."""
    with open(path, encoding="utf-8") as handle:
        model = json.load(handle)["model"]
    vocab = model["vocab"]
    byte_ids = [0] * 256
    for symbol, byte in byte_symbols().items():
        byte_ids[byte] = vocab[symbol]
    pairs = {}
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
    return Merges(tuple(byte_ids), pairs)


class Encoder:
    """Encodes texts; words already seen are remembered up to ``keep`` of them."""

    def __init__(self, merges: Merges, keep: int = 150_000):
        import regex

        self._split = regex.compile(SPLIT).findall
        self._byte_ids = merges.byte_ids
        self._pairs = merges.pairs
        self._keep = keep
        self._known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty and a null text give an empty list."""
        words = [self._split(text) if text else [] for text in texts]
        new = {w for ws in words for w in ws if w not in self._known}
        if new:
            if len(self._known) + len(new) > self._keep:
                self._known.clear()
                new = {w for ws in words for w in ws}
            self._known.update(self._encode_words(sorted(new)))
        known = self._known
        return [[i for w in ws for i in known[w]] for ws in words]

    def _encode_words(self, words: list[str]) -> dict[str, list[int]]:
        byte_ids, pairs = self._byte_ids, self._pairs
        symbols: list[int] = []
        starts = []
        for word in words:
            starts.append(len(symbols))
            symbols.extend(byte_ids[b] for b in word.encode("utf-8"))
            symbols.append(-1)  # no pair contains it, so nothing merges across words
        size = len(symbols)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        index: dict[int, list[int]] = {}
        merge_of: dict[int, tuple[int, int, int]] = {}
        for at in range(size - 1):
            pair = (symbols[at], symbols[at + 1])
            hit = pairs.get(pair)
            if hit is not None:
                places = index.get(hit[0])
                if places is None:
                    index[hit[0]] = [at]
                    merge_of[hit[0]] = (*pair, hit[1])
                else:
                    places.append(at)
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right, merged = merge_of[rank]
            # ascending order, so that overlapping occurrences merge from the left
            for at in sorted(index.pop(rank)):
                follower = after[at]
                if symbols[at] != left or symbols[follower] != right:
                    continue
                symbols[at] = merged
                symbols[follower] = -2
                beyond = after[follower]
                after[at] = beyond
                before[beyond] = at
                for start, pair in ((before[at], (symbols[before[at]], merged)), (at, (merged, symbols[beyond]))):
                    hit = pairs.get(pair)
                    if hit is not None and start >= 0:
                        places = index.get(hit[0])
                        if places is None:
                            index[hit[0]] = [start]
                            merge_of[hit[0]] = (*pair, hit[1])
                            heapq.heappush(active, hit[0])
                        else:
                            places.append(start)
        encoded = {}
        for word, at in zip(words, starts):
            ids = []
            while symbols[at] != -1:
                ids.append(symbols[at])
                at = after[at]
            encoded[word] = ids
        return encoded
