"""Byte-level BPE by a finite-state transducer that is determinised as it reads, and streaming decode.

A sequence of tokens is what the merges make of its bytes exactly if that holds for
every two neighbours.  Two tokens stay apart unless a unit at the end of the first (the
token, its last merge's right part, and so on) and one at the front of the second make a
token and both are there when that merge has its turn (``Merges``).  So a nondeterministic
machine can read bytes down a trie of tokens and at any token start the next one if the two
stay apart; of the threads that end with a token at some byte exactly one survives.

``Transducer`` runs all threads at once.  A thread is a place in the trie and the class of the
token before it: what that token would merge with, among the tokens that can still come.  A state
is the list of threads and the token that has just ended; classes make few states of many.
The machine gives for each byte the token that ends there; tokens on the way to all live
threads are certain and are put out, after a delay that the longest token bounds.
Transitions are made when they are first needed and kept.

``Utf8`` takes up ids in pieces of any size and gives text as soon as its characters are
whole.  Its machine has a state for what a character still lacks; tokens that begin and end
between characters (nearly all) leave it as it is, so only the others are stepped through.

The bytes of a text that no merge crosses (``tokens.py``) are encoded once for each worker.

Cases: null text is empty and has no ids; null and repeated ids are rows like any other; an
empty table gives no rows; other columns are ignored.  Ids that make no UTF-8 decode to
U+FFFD for each largest part of a character that is whole as far as it goes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import texts
from .tokens import Encoder, Known, slices

#: States that a worker keeps; beyond, they are made anew.
STATES = 100_000
#: Bytes of a pre-token after which certain tokens are put out.
DELAY = 1024
NEVER = 1 << 40
#: Ids that are decoded at once.
IDS = 1 << 14
_LOADED: dict[tuple[str, str], "BpeEncoder"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """What the ranks say of two tokens that meet.

    Each token longer than a byte has a last merge.  ``ends[t]`` are the units at the end of a token with the rank that
    uses each up, ``fronts[t]`` those at its front.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, size = ranks, max(ranks.values(), default=-1) + 1
        self.text: list[bytes] = [b""] * size
        for t, r in ranks.items():
            self.text[r] = t
        self.ends: list[tuple] = [()] * size
        self.fronts: list[tuple] = [()] * size
        joins = []
        for r, t in enumerate(self.text):
            if not t:
                continue
            left, right = [ranks[p] for p in self.merged(t, r)] if len(t) > 1 else (r, r)
            if max(left, right) > r:
                raise ValueError(f"the merges do not lead to the token {t!r}")
            tail, front = ((right, left) if len(t) > 1 else (None, None))
            self.ends[r] = ((r, NEVER), *(() if tail is None else ((u, r if u == tail else n) for u, n in self.ends[tail])))
            self.fronts[r] = ((r, NEVER), *(() if front is None else ((u, r if u == front else n) for u, n in self.fronts[front])))
            joins += [(x << 8 | t[k], y, r) for k in range(1, len(t)) if (x := ranks.get(t[:k])) is not None and (y := ranks.get(t[k:])) is not None]
        # Whatever two tokens make a token: by the first and the first byte of the second.
        made = np.array(sorted(joins), np.int64).reshape(-1, 3)
        keys, starts = np.unique(made[:, 0], return_index=True)
        self.made, self.run = made[:, 1:].astype(np.int32), dict(zip(keys.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(made)])))

    def merged(self, text: bytes, before: int = NEVER) -> list[bytes]:
        """What merges of ranks below ``before`` make of a few bytes: again and again the lowest, the first of equals."""
        parts = [text[k : k + 1] for k in range(len(text))]
        pairs = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < before:
            k = pairs.index(low)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = self.ranks.get(parts[k - 1] + parts[k], NEVER)
            if k < len(pairs):
                pairs[k] = self.ranks.get(parts[k] + parts[k + 1], NEVER)
        return parts

    def wanted(self, a: int, byte: int) -> dict[int, int]:
        """The units beginning with ``byte`` that would merge with an end of ``a``, and when."""
        out: dict[int, int] = {}
        for unit, used in self.ends[a]:
            lo, hi = self.run.get(unit << 8 | byte, (0, 0))
            for y, m in self.made[lo:hi].tolist():
                when = max(m, unit, y)  # as soon as both are there
                if when < used and when < out.get(y, NEVER):
                    out[y] = when
        return out

    def taken(self, wanted: dict[int, int], b: int) -> bool:
        """Whether one of the wanted units stands at the front of ``b`` when its time comes; of equal merges the left one is first."""
        return any(wanted.get(u, used + 1) <= used for u, used in self.fronts[b])


class Transducer:
    """From the bytes of one pre-token to ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges, self.ranks = Merges(ranks), ranks
        self.token_bytes = self.merges.text
        self.length = [len(t) for t in self.token_bytes]
        # The trie: nodes are numbered by (length, bytes) of what they stand for.
        self.prefixes = sorted({t[:k] for t in ranks for k in range(len(t) + 1)}, key=lambda p: (len(p), p))
        number = {p: k for k, p in enumerate(self.prefixes)}
        self.child = {number[p[:-1]] << 8 | p[-1]: k for p, k in number.items() if p}
        self.token_at = [ranks.get(p, -1) for p in self.prefixes]
        self.inner = bytearray(len(self.prefixes))
        for key in self.child:
            self.inner[key >> 8] = 1
        self.clear()

    def clear(self) -> None:
        self.classes: list[dict[int, int]] = [{}]
        self.class_of: dict[frozenset, int] = {frozenset(): 0}
        self.first: dict[int, int] = {}
        self.later: dict[tuple[int, int], int] = {}
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.ended: list[int] = []
        self.numbers: dict[tuple[int, tuple], int] = {}
        self.delta: dict[int, int] = {}
        self.state(-1, ())

    def state(self, ended: int, threads: tuple) -> int:
        k = self.numbers.get((ended, threads))
        if k is None:
            k = self.numbers[ended, threads] = len(self.states)
            self.states.append(threads)
            self.ended.append(ended)
        return k

    def class_number(self, wanted: dict[int, int]) -> int:
        key = frozenset(wanted.items())
        k = self.class_of.get(key)
        if k is None:
            k = self.class_of[key] = len(self.classes)
            self.classes.append(wanted)
        return k

    def after(self, token: int, byte: int) -> int:
        """The class of threads that begin after ``token`` with ``byte``."""
        k = self.first.get(token << 8 | byte)
        if k is None:
            k = self.first[token << 8 | byte] = self.class_number(self.merges.wanted(token, byte))
        return k

    def narrowed(self, c: int, node: int) -> int:
        """The class at a node: units that the bytes read so far rule out no longer count."""
        k = self.later.get((c, node))
        if k is None:
            at, text = self.prefixes[node], self.token_bytes
            k = self.later[c, node] = self.class_number({y: e for y, e in self.classes[c].items() if text[y].startswith(at) or at.startswith(text[y])})
        return k

    def step(self, k: int, byte: int) -> int:
        """The state after one more byte."""
        out, ended, last = [], -1, self.ended[k]
        begun = (0 if last < 0 else self.after(last, byte), 0)
        for c, node in (*self.states[k], begun):
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            c = c and self.narrowed(c, node)
            t = self.token_at[node]
            if ended < 0 <= t and not (c and self.merges.taken(self.classes[c], t)):
                ended = t
            if self.inner[node]:
                out.append((c, node))
        if ended < 0:
            raise ValueError(f"no token for the byte {byte}")
        after = self.delta[k << 8 | byte] = self.state(ended, tuple(out))
        return after

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a pre-token; a token as a whole is itself even if no merges lead to it."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > STATES:
            self.clear()
        k, out, path, known = 0, [], [], self.delta.get
        for lo in range(0, len(piece), DELAY):
            for byte in piece[lo : lo + DELAY]:
                n = known(k << 8 | byte)
                k = self.step(k, byte) if n is None else n
                path.append(k)
            if lo + DELAY < len(piece):
                path = self.put_out(path, out)
        return out + self.back(path, len(path))

    def back(self, path: list[int], at: int) -> list[int]:
        """The tokens up to a byte, given the state after each."""
        out, ended, length = [], self.ended, self.length
        while at > 0:
            out.append(t := ended[path[at - 1]])
            at -= length[t]
        out.reverse()
        return out

    def put_out(self, path: list[int], out: list[int]) -> list[int]:
        """Put out what all live threads share; the rest is kept."""
        begins = {len(path), *(len(path) - len(self.prefixes[node]) for _, node in self.states[path[-1]])}
        while len(begins) > 1:
            at = max(begins)
            begins.remove(at)
            begins.add(at - self.length[self.ended[path[at - 1]]])
        sure = begins.pop()
        out += self.back(path, sure)
        return path[sure:]


class Splitter:
    """Matches of a pattern with the character classes of the tiktoken library; Python's engine may know another version of Unicode.

    Texts without a character on which they differ, nearly all, take the pattern as it is.
    """

    def __init__(self, pattern: str):
        import tiktoken

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        raw = {bytes([k]): k for k in range(256)}
        fitted, chars = pattern, set()
        listed = lambda chars: "".join(f"\\U{ord(c):08x}" for c in sorted(chars))
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            theirs = set(bytes(tiktoken.Encoding("probe", pat_str=name, mergeable_ranks=raw, special_tokens={}).encode_ordinary(every)).decode())
            mine = set(regex.findall(name, every))
            made = f"[{name}--[{listed(mine - theirs)}]]" if mine - theirs else name
            made = f"[{made}||[{listed(theirs - mine)}]]" if theirs - mine else made
            fitted, chars = fitted.replace(name, made), chars | (mine ^ theirs)
        self.plain, self.fitted = regex.compile(pattern).findall, regex.compile(fitted, regex.V1).findall
        self.differs, self.least = regex.compile(f"[{listed(chars)}]" if chars else "(?!)").search, min(chars, default="")

    def __call__(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() or max(text) < self.least or not self.differs(text) else self.fitted(text)


class _Ids:
    __slots__ = ("ids",)

    def __init__(self, ids: list[int]):
        self.ids = ids


class BpeEncoder(Encoder):
    """Ids of many texts: stretches that have not been seen go through the transducer, match of the pattern by match."""

    def __init__(self, path: str, pattern: str):
        self.library, self.known = self, Known()
        self.pieces = Splitter(pattern)
        self.transducer = Transducer(read_ranks(path))
        self.bytes = np.frombuffer(b"".join(self.transducer.token_bytes), np.uint8)
        self.length = np.array([len(t) for t in self.transducer.token_bytes], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.utf8 = Utf8Tables(self.bytes, self.start, self.length)

    def encode(self, texts, add_special_tokens: bool = False):
        """Of an Arrow array as ``Encoder.encode``; of one text an object with its ``ids``."""
        return self.encode_batch_fast([texts])[0] if isinstance(texts, str) else super().encode(texts)

    def encode_batch_fast(self, asked: list[str], add_special_tokens: bool = False) -> list[_Ids]:
        one = self.transducer.encode
        return [_Ids([i for piece in self.pieces(t) for i in one(piece.encode())]) for t in asked]

    def _together(self, marked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each alone: matches of the pattern are encoded one by one here, so a text of many saves nothing."""
        return self._singly(marked)


def bpe_encoder(path: str, pattern: str) -> BpeEncoder:
    """One for each worker process, vocabulary file and pattern."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = BpeEncoder(path, pattern)
    return _LOADED[path, pattern]


#: States of the machine: what may come next.  0: any character; 1 to 3: so many continuation bytes;
#: 4: A0-BF, then one more; 5: 80-9F, then one more; 6: 90-BF, then two more; 7: 80-8F, then two more; 8: not UTF-8.
WRONG = 8


def utf8_steps() -> np.ndarray:
    """The state after a byte, by state and byte."""
    to = np.full((9, 256), WRONG, np.uint8)
    to[0, :0x80] = 0
    to[0, 0xC2:0xE0], to[0, 0xE1:0xF0], to[0, 0xF1:0xF4] = 1, 2, 3
    to[0, [0xE0, 0xED, 0xF0, 0xF4]] = [4, 5, 6, 7]
    for state, after in ((1, 0), (2, 1), (3, 2)):
        to[state, 0x80:0xC0] = after
    to[4, 0xA0:0xC0], to[5, 0x80:0xA0], to[6, 0x90:0xC0], to[7, 0x80:0x90] = 1, 1, 2, 2
    return to


class Utf8Tables:
    """The machine's steps over bytes and, composed, over whole tokens."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray):
        self.flat, self.start, self.length, self.byte = flat, start, length, utf8_steps()
        self.token = np.repeat(np.arange(9, dtype=np.uint8)[:, None], len(length), axis=1)
        for k in range(int(length.max(initial=0))):
            more = np.flatnonzero(length > k)
            self.token[:, more] = self.byte[self.token[:, more], flat[start[more] + k]]
        self.plain = self.token[0] == 0


class Utf8:
    """Text from ids as they come; ``feed`` gives what is whole, ``end`` what is left.  ``raw`` digests the bytes."""

    def __init__(self, tables: Utf8Tables):
        self.t, self.state, self.rest, self.raw = tables, 0, b"", hashlib.sha256()

    def feed(self, ids: np.ndarray) -> str:
        t = self.t
        length = t.length[ids]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        data = t.flat[np.repeat(t.start[ids] - (ends - length), length) + np.arange(total)].tobytes()
        self.raw.update(data)
        state, done = self.state, 0
        for k in np.flatnonzero(~t.plain[ids]).tolist() if not state else [0, *np.flatnonzero(~t.plain[ids]).tolist()]:
            if k < done:
                continue
            while k < len(ids):  # until the machine stands between characters again
                state = int(t.token[state, ids[k]])
                k += 1
                if state in (0, WRONG):
                    break
            done = k
            if state == WRONG:
                return self.mend(data)
        data, self.rest = self.rest + data, b""
        if state:  # the begun character's first byte is the last that is no continuation
            k = len(data) - 1
            while data[k] & 0xC0 == 0x80:
                k -= 1
            data, self.rest = data[:k], data[k:]
        self.state = state
        return data.decode()

    def mend(self, data: bytes) -> str:
        """Byte by byte, U+FFFD for what is no character."""
        out, begun, state = [], bytearray(self.rest), self.state
        for b in data:
            after = int(self.t.byte[state, b])
            if after == WRONG and state:  # what was begun is broken off; the byte may begin something
                out.append("\N{REPLACEMENT CHARACTER}")
                begun.clear()
                after = int(self.t.byte[0, b])
            if after == WRONG:
                out.append("\N{REPLACEMENT CHARACTER}")
                after = 0
            else:
                begun.append(b)
                if not after:
                    out.append(begun.decode())
                    begun.clear()
            state = after
        self.rest, self.state = bytes(begun), state
        return "".join(out)

    def end(self) -> str:
        left, self.rest, self.state = self.rest, b"", 0
        return "\N{REPLACEMENT CHARACTER}" if left else ""


def decoded(ids: np.ndarray, tables: Utf8Tables) -> tuple[str, str]:
    """The text of some ids and the SHA-256 of their bytes, decoded in pieces."""
    stream = Utf8(tables)
    text = "".join([stream.feed(ids[k : k + IDS]) for k in range(0, len(ids), IDS)]) + stream.end()
    return text, stream.raw.hexdigest()


def _per_text(docs: DataFrame, path: str, pattern: str, schema: str, make) -> DataFrame:
    """Rows that ``make(doc_ids, ids of each text, encoder)`` gives, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe_encoder(path, pattern)
        for batch in slices(batches):
            ids, counts = own.encode(batch.column("text"))
            yield make(batch.column("doc_id"), ids.astype("<u4"), counts, own)

    return texts(docs).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text."""

    def make(doc_id, ids, counts, own):
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return _per_text(docs, path, pattern, "doc_id long, ids array<int>", make)


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows with ``doc_id`` and ``ids`` (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = bpe_encoder(path, pattern).utf8
        for batch in batches:
            made = [decoded(np.array(ids or [], np.int64), tables)[0] for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], names=["doc_id", "text"])

    return rows.selectExpr("cast(doc_id as long) as doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Of every whole text: ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers), ``decoded_sha256`` (the bytes that the ids decode to).

    Ids are encoded and decoded in one task; a decoded text that is not the encoded one is an error.
    """

    def make(doc_id, ids, counts, own):
        raw, made, at = memoryview(ids).cast("B"), [], 0
        for n in counts.tolist():
            made.append((hashlib.sha256(raw[4 * at : 4 * (at + n)]).hexdigest(), decoded(ids[at : at + n], own.utf8)[1]))
            at += n
        columns = [doc_id, pa.array(counts, pa.int64()), *[pa.array([m[k] for m in made], pa.string()) for k in (0, 1)]]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _per_text(docs, path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
