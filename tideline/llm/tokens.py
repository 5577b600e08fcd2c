"""Byte-level BPE ids with the tokenizers library, encoded stretch by stretch.

In the pre-tokenizer's pattern a single space or line end between two characters
that are not white space always parts two pre-tokens, and so does the step from a
letter to punctuation.  So a text can be cut there, and the ids of its stretches,
end to end, are the ids of the whole text.  Stretches repeat all over a corpus: a
worker keeps the ids of those it has seen in flat arrays (``Known``, bounded in
bytes) and asks the library only for new ones.  When the arrays are full, those
stay that were found again since the last time.  A stretch is known only if its
bytes equal those kept; a hash merely says where to look.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import release

#: Bytes that a worker's known stretches may take, about.
KEPT = 32 << 20
#: Bytes of text that are encoded at once.
SLICE = 1 << 21
#: Punctuation that is cut off after a letter.
TAIL = ".,;:!?&%#$*|"
#: Marks at the front of a stretch: after a line end, and at the start of a text.  Others stood after a space.
LINE, START = "\x01", "\x02"
#: Stretches that the library gets in one text, and those that it gets alone: at the start of a text, or with white space at the end.
TOGETHER = 256
ALONE = r"^\x02|[\x00-\x20\x{85}\p{Z}]$"
#: Texts with white space other than single spaces and line ends between other characters, or with the marks.
ODD = r"[\x00-\x20\x{85}\p{Z}][\x00-\x20\x{85}\p{Z}]|^[ \n]|[ \n]$|^$|[\x01\x02]"
_LOADED: dict[str, "Encoder"] = {}


class Strings:
    """Bytes of some strings: ``raw``, where each begins, how long it is, and a hash of it."""

    def __init__(self, strings: pa.Array):
        strings = strings.cast(pa.large_binary())
        raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
        self.raw, self.starts, self.length = raw[ends[0] : ends[-1]], ends[:-1] - ends[0], np.diff(ends)
        place = np.arange(len(self.raw)) - np.repeat(self.starts, self.length)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, int(self.length.max(initial=0)) - 1), 0x9E3779B97F4A7C15, np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * power[place])]) if len(self.raw) else np.zeros(1, np.uint64)
        h = sums[self.starts + self.length] - sums[self.starts] + self.length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        self.hashes = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)

    def __len__(self) -> int:
        return len(self.length)


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """Room for ``size`` values at least."""
    if size <= len(array):
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class Known:
    """An open-addressing table from strings to runs in a flat array of ids; arrays grow by doubling."""

    def __init__(self, slots: int = 1 << 16):
        self.n, self.slots = 0, np.full(slots, -1, np.int32)
        self.hashes, self.again = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, bool)
        self.raw, self.raw_ends = np.zeros(1 << 17, np.uint8), np.zeros(1 << 14, np.int64)
        self.flat, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def size(self) -> int:
        return sum(x.nbytes for x in (self.slots, self.hashes, self.again, self.raw, self.raw_ends, self.flat, self.ends))

    def find(self, strings: Strings, which: np.ndarray) -> np.ndarray:
        """The entry of each of the strings ``which``, or -1."""
        out = np.full(len(which), -1, np.int64)
        open_, mask = np.arange(len(which)), len(self.slots) - 1
        at = (strings.hashes[which] & np.uint64(mask)).astype(np.int64)
        while len(open_):
            got = self.slots[at]
            taken = got >= 0
            open_, at, got = open_[taken], at[taken], got[taken]
            same = self.same(strings, which[open_], got)
            out[open_[same]] = got[same]
            open_, at = open_[~same], (at[~same] + 1) & mask
        self.again[out[out >= 0]] = True
        return out

    def kept(self) -> "Known":
        """A table of the entries that were found again."""
        out, mine, which = Known(), Strings.__new__(Strings), np.flatnonzero(self.again[: self.n])
        mine.raw, mine.starts, mine.length, mine.hashes = self.raw, self.raw_ends[: self.n], np.diff(self.raw_ends[: self.n + 1]), self.hashes[: self.n]
        lengths = np.diff(self.ends[: self.n + 1])[which]
        out.add(mine, which, gather(self.flat, self.ends[which], lengths), lengths)
        return out

    def same(self, strings: Strings, which: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Whether a string's bytes are those of an entry."""
        length = strings.length[which]
        out = (self.hashes[entry] == strings.hashes[which]) & (self.raw_ends[entry + 1] - self.raw_ends[entry] == length)
        at = np.flatnonzero(out)
        n = length[at]
        differ = gather(strings.raw, strings.starts[which[at]], n) != gather(self.raw, self.raw_ends[entry[at]], n)
        sums = np.concatenate([[0], np.cumsum(differ)])
        ends = np.cumsum(n)
        out[at] = sums[ends] == sums[ends - n]
        return out

    def add(self, strings: Strings, which: np.ndarray, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Enter strings that differ from each other and are not yet known; their entries."""
        n, m = self.n, len(which)
        entry = np.arange(n, n + m)
        self.n += m
        self.hashes, self.again = grown(self.hashes, n + m), grown(self.again, n + m)
        self.ends, self.raw_ends = grown(self.ends, n + m + 1), grown(self.raw_ends, n + m + 1)
        self.hashes[entry] = strings.hashes[which]
        self.ends[entry + 1] = self.ends[n] + np.cumsum(lengths)
        self.raw_ends[entry + 1] = self.raw_ends[n] + np.cumsum(strings.length[which])
        self.flat, self.raw = grown(self.flat, int(self.ends[n + m])), grown(self.raw, int(self.raw_ends[n + m]))
        self.flat[self.ends[n] : self.ends[n + m]] = flat
        self.raw[self.raw_ends[n] : self.raw_ends[n + m]] = gather(strings.raw, strings.starts[which], strings.length[which])
        if 2 * self.n > len(self.slots):
            self.slots = np.full(4 << (self.n - 1).bit_length(), -1, np.int32)
            self.place(np.arange(self.n))
        else:
            self.place(entry)
        return entry

    def place(self, entry: np.ndarray) -> None:
        mask = len(self.slots) - 1
        open_, at = entry, (self.hashes[entry] & np.uint64(mask)).astype(np.int64)
        while len(open_):
            free = self.slots[at] < 0
            self.slots[at[free]] = open_[free]  # of several for one slot the last gets it
            got = self.slots[at] == open_
            open_, at = open_[~got], (at[~got] + 1) & mask


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``starts``, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class Encoder:
    """Ids of texts, without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known = Known()
        vocabulary = self.library.get_vocab()
        self.first = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that begin with a space or line end: the first of a stretch
        self.first[[i for t, i in vocabulary.items() if t[:1] in ("\u0120", "\u010a")]] = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end (uint32), and how many each text has."""
        texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
        odd = pc.match_substring_regex(texts, ODD)
        plain = texts.filter(pc.invert(odd))
        ids, lengths = self._stretches(plain)
        if len(plain) == len(texts):
            return ids, lengths
        mine = [np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.filter(odd).to_pylist()]
        is_odd = odd.to_numpy(zero_copy_only=False)
        all_lengths = np.empty(len(texts), np.int64)
        all_lengths[~is_odd], all_lengths[is_odd] = lengths, [len(x) for x in mine]
        starts = np.empty(len(texts), np.int64)
        starts[~is_odd] = np.cumsum(lengths) - lengths
        starts[is_odd] = len(ids) + np.cumsum(all_lengths[is_odd]) - all_lengths[is_odd]
        return gather(np.concatenate([ids, *mine]), starts, all_lengths), all_lengths

    def _stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.binary_join_element_wise(START, pc.replace_substring(texts, "\n", " " + LINE), "")
        parts = pc.split_pattern(marked, " ")
        edges = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        entry = self._entries(coded.dictionary)[coded.indices.to_numpy()]
        known = self.known
        starts, length = known.ends[entry], known.ends[entry + 1] - known.ends[entry]
        bounds = np.concatenate([[0], np.cumsum(length)])[edges]
        return gather(known.flat, starts, length), np.diff(bounds)

    def _entries(self, stretches: pa.Array) -> np.ndarray:
        """The entries of distinct marked stretches, entered where they are new."""
        if self.known.size() > KEPT:
            self.known = self.known.kept()
            if 2 * self.known.size() > KEPT:
                self.known = Known()
        known, strings = self.known, Strings(stretches)
        entry = known.find(strings, np.arange(len(strings)))
        new = np.flatnonzero(entry < 0)
        if not len(new):
            return entry
        fresh = stretches.take(pa.array(new))
        stems = pc.utf8_rtrim(fresh, characters=TAIL)
        cut = pc.and_(pc.less(pc.binary_length(stems), pc.binary_length(fresh)), pc.match_substring_regex(stems, r"\p{L}$")).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(~cut)
        entry[new[whole]] = self._ask(fresh.take(pa.array(whole)), strings, new[whole])
        if cut.any():
            rows = np.flatnonzero(cut)
            stems = stems.take(pa.array(rows))
            stem_of = stems.dictionary_encode()
            words = Strings(stem_of.dictionary)
            s_entry = known.find(words, np.arange(len(words)))
            missing = np.flatnonzero(s_entry < 0)
            s_entry[missing] = self._ask(stem_of.dictionary.take(pa.array(missing)), words, missing)
            b, t_flat, t_start, t_len = self._tails(strings, new[rows], pc.binary_length(stems).to_numpy())
            a = s_entry[stem_of.indices.to_numpy()]
            s_len = known.ends[a + 1] - known.ends[a]
            used = int(known.ends[known.n])
            both = np.concatenate([known.flat[:used], t_flat])
            starts = np.stack([known.ends[a], used + t_start[b]], 1).ravel()
            lengths = np.stack([s_len, t_len[b]], 1).ravel()
            entry[new[rows]] = known.add(strings, new[rows], gather(both, starts, lengths), s_len + t_len[b])
        return entry

    def _tails(self, strings: Strings, which: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What follows each stem (of ``stem`` bytes): a code per row, and the ids of each code."""
        size = strings.length[which] - stem
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = gather(strings.raw, strings.starts[which] + stem, size)
        tails = pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(ends), pa.py_buffer(raw)).dictionary_encode()
        ids = [e.ids for e in self.library.encode_batch_fast(tails.dictionary.to_pylist(), add_special_tokens=False)]
        length = np.array([len(x) for x in ids], np.int64)
        return tails.indices.to_numpy().astype(np.int64), np.array(sum(ids, []), np.uint32), np.cumsum(length) - length, length

    def _ask(self, marked: pa.Array, strings: Strings, which: np.ndarray) -> np.ndarray:
        """Have the library encode new stretches, which are the strings ``which``; their entries."""
        alone = pc.match_substring_regex(marked, ALONE)
        flat, lengths = self._together(marked.filter(pc.invert(alone)))
        if len(lengths) < len(marked):
            is_alone = alone.to_numpy(zero_copy_only=False)
            more, each = self._singly(marked.filter(alone))
            every, starts = np.empty(len(marked), np.int64), np.empty(len(marked), np.int64)
            every[~is_alone], every[is_alone] = lengths, each
            starts[~is_alone], starts[is_alone] = np.cumsum(lengths) - lengths, len(flat) + np.cumsum(each) - each
            flat, lengths = gather(np.concatenate([flat, more]), starts, every), every
        return self.known.add(strings, which, flat, lengths)

    def _together(self, marked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stretches, many to a text: a stretch has its only space or line end in front, so its first id, and no other, begins with one."""
        n = len(marked)
        asked = pc.replace_substring(pc.binary_join_element_wise(" ", marked, ""), " " + LINE, "\n")
        edges = np.append(np.arange(0, n, TOGETHER), n).astype(np.int32)
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), asked), "").to_pylist()
        ids = np.concatenate([np.zeros(0, np.uint32), *[np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(whole, add_special_tokens=False)]])
        starts = np.flatnonzero(self.first[ids])
        if len(starts) != n:  # another kind of vocabulary
            return self._singly(marked)
        return ids, np.diff(np.append(starts, len(ids)))

    def _singly(self, marked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        real = {LINE: "\n", START: ""}
        asked = [real[s[0]] + s[1:] if s[:1] in real else " " + s for s in marked.to_pylist()]
        got = [e.ids for e in self.library.encode_batch_fast(asked, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((x for ids in got for x in ids), np.uint32, int(lengths.sum())), lengths


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about ``size`` bytes of text, or one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    release()


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
