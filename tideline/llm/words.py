"""Words of whole texts and of their shingles, many texts at a time.

A word stands for 128 bits (``hashes``, ``others``).  Of a word of up to 16 bytes they
are its bytes, permuted, so two such words never share them; longer words have their
BLAKE2b digest.  What is built from them (shingles, sequences, set keys) comes from bits
that are permuted once more with a key drawn for the run, so nobody can choose words
whose bits cancel out; results do not depend on the key.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def numbered(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each pair of values, equal pairs the same; and where the first of each number stands."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, order[new]


def identities(raw: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two whole numbers for each word: its first 16 bytes permuted, or the digest of a longer one (or of one with a zero byte)."""
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(raw) + 9, "<u8", padded, strides=(1,))  # eight bytes from every place on
    mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    low = eight[starts] & mask[np.minimum(length, 8)]
    high = eight[np.minimum(starts + 8, len(raw))] & mask[np.clip(length - 8, 0, 8)]
    long = length > 16
    if len(zeros := np.flatnonzero(raw == 0)):
        word = np.searchsorted(starts, zeros, side="right") - 1
        long[word[(word >= 0) & (zeros < starts[word] + length[word])]] = True
    one = mixed(low ^ mixed(high, 1), 2)
    two = mixed(high ^ one, 3)
    if len(at := np.flatnonzero(long)):
        text = raw.tobytes()
        both = np.frombuffer(b"".join([blake2b(text[a : a + n], digest_size=16).digest() for a, n in zip(starts[at].tolist(), length[at].tolist())]), "<u8")
        one[at], two[at] = both[::2], both[1::2]
    return one, two


def word_spans(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes (A-Z lower-cased if asked for), where each word begins, how long it is, and the first word of each text (one more than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = bounds[:-1][bounds[:-1] < len(raw)]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cut[cut > 0] - 1] = inside[cut[cut > 0] - 1]
    return raw, starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(starts, bounds)


def keyed(one: np.ndarray, two: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits permuted with a key: four rounds, each of which adds a mix of one half and a part of the key to the other."""
    parts = np.frombuffer(blake2b(key.to_bytes(16, "little"), digest_size=32).digest(), "<u8")
    for part in parts:
        one, two = two ^ mixed(mixed(one ^ part) + part), one
    return one, two


class Words:
    """Of some texts: the words' bits (``hashes``, ``others``; with a ``key`` permuted by it), and the first word of each text (``edges``, one more than texts)."""

    def __init__(self, texts: pa.Array, lower: bool, key: int | None = None):
        raw, starts, length, self.edges = word_spans(texts, lower)
        self.hashes, self.others = identities(raw, starts, length)
        if key is not None:
            self.hashes, self.others = keyed(self.hashes, self.others, key)

    def grams(self, n: int) -> np.ndarray:
        """A hash of the n words from each word on; those that leave their text are not meaningful."""
        out = np.zeros(max(0, len(self.hashes) - n + 1), np.uint64)
        for k in range(n):
            out = mixed(out ^ self.hashes[k : k + len(out)] ^ (self.others[k : k + len(out)] << np.uint64(k)), k + 1)
        return out

    def sequences(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each text's whole word sequence."""
        n = np.diff(self.edges)
        place = mixed((np.arange(len(self.hashes)) - np.repeat(self.edges[:-1], n)).astype(np.uint64), 3)
        both = []
        for bits, seed in ((self.hashes, 5), (self.others, 6)):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(bits ^ place, seed))])
            both.append(mixed(sums[self.edges[1:]] - sums[self.edges[:-1]], seed))
        return both[0], both[1]


def shingle_sets(words: Words, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct n-word shingles, sorted, and further bits of each; with fewer words the whole sequence as one; empty without words."""
    grams, (whole, rest) = words.grams(n), words.sequences()
    more = np.zeros_like(grams)
    for k in range(n):
        more = (more << np.uint64(7) | more >> np.uint64(57)) + words.others[k : k + len(more)]
    more, out = mixed(more, 8), []
    for k, (a, b) in enumerate(zip(words.edges[:-1].tolist(), words.edges[1:].tolist())):
        if b - a >= n:
            shingles, at = np.unique(grams[a : b - n + 1], return_index=True)
            out.append((shingles, more[a + at]))
        else:
            filled = slice(k, k + 1 if b > a else k)
            out.append((whole[filled], rest[filled]))
    return out
