"""Operators 11 to 13 against plain versions."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_operators import DOC, corpus, words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = corpus()
    for k in range(30):
        unit = words(rng, rng.randint(1, 9), 5)
        out.append((600 + k, " ".join([words(rng, rng.randint(0, 9)), *[unit] * rng.randint(3, 9), words(rng, rng.randint(0, 4))]), "en", "a", 1, 1, "x", 2))
    out += [(700 + k, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 120))), "en", "a", 1, 1, "x", 2) for k in range(40)]
    out += [(800, "a " * 5000, "en", "a", 1, 1, "x", 2), (801, "a b " * 40 + "a a a a a a a", "en", "a", 1, 1, "x", 2), (802, "x\x1cy \x0bz" * 9, "en", "a", 1, 1, "x", 2), (None, "q " * 9, "en", "a", 1, 1, "x", 2)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# ---- 11: runs


def plain_runs(w, least=6, exponent=4):
    """Every period at every stretch; equal stretches keep the smallest period."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        at = 0
        while at + q < len(w):
            if w[at] != w[at + q]:
                at += 1
                continue
            end = at
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            if end + q - at >= max(least, exponent * q):
                found.setdefault((at, end + q - at), q)
            at = end
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_words(doc_id, text, echo):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if echo and doc_id is not None and w and h % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    return w


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_row(doc_id, text, echo=True):
    w = plain_words(doc_id, text, echo)
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_runs(docs, none, rows):
    from tideline.llm.periodic import collapse, longest_runs

    got = [tuple(r) for r in longest_runs(collapse(docs, echo=True)).collect()]
    assert sorted(got, key=str) == sorted((plain_row(r[0], r[1]) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 30
    plain = collapse(docs).select("doc_id", "n_words", F.size("runs").alias("n")).collect()
    assert sorted(map(tuple, plain), key=str) == sorted(((r[0], len(w := plain_words(r[0], r[1], False)), len(plain_runs(w))) for r in rows), key=str)
    assert longest_runs(collapse(none, echo=True)).count() == 0


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (5, 3)])
def test_runs_of_small_alphabets(least, exponent, monkeypatch):
    from tideline.llm import periodic

    monkeypatch.setattr(periodic, "CHUNK", 50)
    rng = np.random.default_rng(3)
    for _ in range(60):
        texts = [rng.integers(0, rng.integers(1, 4), rng.integers(0, 70)).tolist() for _ in range(rng.integers(1, 9))]
        texts.append((rng.integers(0, 3, rng.integers(1, 12)).tolist() * 9)[: rng.integers(1, 99)])
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        got = periodic.find_runs(np.array(sum(texts, []), np.int64), edges, least, exponent) if edges[-1] else np.zeros((0, 4))
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, t in enumerate(texts) for r in plain_runs(t, least, exponent)]


def test_extensions_from_a_difference_cover():
    from tideline.llm.periodic import Lce

    rng = np.random.default_rng(4)
    for kinds, n in ((1, 40), (2, 200), (2, 1), (50, 100)):
        x = np.concatenate([rng.integers(0, kinds, n)] * 2)
        i, j = (rng.integers(0, len(x), 500) for _ in range(2))
        i, j = i[i != j], j[i != j]
        want = [next((k for k in range(len(x)) if max(a, b) + k >= len(x) or x[a + k] != x[b + k]), 0) for a, b in zip(i.tolist(), j.tolist())]
        assert Lce(x)(i, j).tolist() == want


# ---- 12: byte-pair encoding


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, p.PATTERN, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


AWKWARD = ["", " ", "a  b", "\n\n a\n", "don't  I'm", "a<|endoftext|>b", "１２ ３", "x\x1c y \x85 z", "𝒳😀é中文字 ひらがな", "\x01 a\x02", "\U0001dfe7a \U00018d80럻 \U0001c864", "=" * 3000, "ab" * 2500, " " * 900, "中" * 700, "tab\there", "naïve-façade_über"]


def test_transducer_gives_the_library_s_ids(vocabulary):
    import pyarrow as pa

    from tideline.llm.transducer import bpe_encoder, decoded

    path, pattern, library = vocabulary
    own, rng = bpe_encoder(path, pattern), random.Random(12)
    some = ["a", "e", "th", "tion", " ", "  ", "\n", "中", "é", "😀", "0", "-", "д", "ا", "'s"]
    texts = AWKWARD + ["".join(rng.choice(some) if rng.random() < 0.8 else chr(rng.choice([rng.randint(32, 0x2FFF), rng.randint(0x3000, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for _ in range(2):  # unknown, then known
        ids, n = own.encode(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        for t, e, k in zip(texts, ends.tolist(), n.tolist()):
            assert ids[e - k : e].tolist() == library.encode_ordinary(t), t
            assert decoded(ids[e - k : e], own.utf8) == (t, hashlib.sha256(t.encode()).hexdigest())


def test_transducer_of_new_stretches(vocabulary):
    """An encoder that has seen nothing yet; it has no ``first``, by which the library's ids are cut."""
    import pyarrow as pa

    from tideline.llm.transducer import BpeEncoder

    path, pattern, library = vocabulary
    own = BpeEncoder(path, pattern)
    given = ["one two, three.\nfour  five", None, "", "中文 字\n0 '", " ".join(f"w{k}x!" for k in range(600))]
    ids, n = own.encode(pa.array(given, pa.string()))
    want = [library.encode_ordinary(t or "") for t in given]
    assert ids.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]


def test_transducer_of_small_vocabularies(monkeypatch):
    """Merges of random bytes, with few states kept and tokens put out early."""
    from tideline.llm import transducer

    monkeypatch.setattr(transducer, "STATES", 40)
    monkeypatch.setattr(transducer, "DELAY", 5)
    rng = random.Random(13)
    for _ in range(30):
        ranks = {bytes([k]): k for k in range(3)}
        while len(ranks) < rng.randint(4, 40):
            ranks.setdefault(rng.choice(list(ranks)) + rng.choice(list(ranks)), len(ranks))
        try:
            own = transducer.Transducer(ranks)
        except ValueError:  # a token that no merges make
            continue
        for _ in range(200):
            text = bytes(rng.randrange(3) for _ in range(rng.randint(1, 60)))
            want = [ranks[text]] if text in ranks else [ranks[p] for p in own.merges.merged(text)]
            assert own.encode(text) == want


def test_streaming_decode(vocabulary):
    from tideline.llm.transducer import Utf8, bpe_encoder

    path, pattern, _ = vocabulary
    own, rng = bpe_encoder(path, pattern), random.Random(14)
    for _ in range(800):  # any ids at all, in pieces of any size
        ids, at, got, stream = np.array([rng.randrange(50256) for _ in range(rng.randint(0, 30))], np.int64), 0, "", Utf8(own.utf8)
        while at < len(ids):
            n = rng.randint(1, 5)
            got, at = got + stream.feed(ids[at : at + n]), at + n
        raw = b"".join(own.transducer.token_bytes[k] for k in ids)
        assert got + stream.end() == raw.decode("utf-8", "replace") and stream.raw.hexdigest() == hashlib.sha256(raw).hexdigest()


def test_op12_round_trip(spark, docs, none, rows, vocabulary):
    from tideline.llm.transducer import decode, encode, round_trip

    path, pattern, library = vocabulary
    want = []
    for r in rows:
        ids = np.array(library.encode_ordinary(r[1] or ""), "<u4")
        want.append((r[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), sha(r[1] or "")))
    assert sorted(map(tuple, round_trip(docs, path, pattern).collect()), key=str) == sorted(want, key=str)
    back = decode(encode(docs, path, pattern), path, pattern)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((r[0], r[1] or "") for r in rows), key=str)
    assert round_trip(none, path, pattern).count() == 0 and encode(none, path, pattern).count() == 0


# ---- 13: codes


VEC = "vec_id long, embedding array<float>, label int, code string, v long"


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in e], g) for i, e, g, *_ in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = sorted(((i, v + [0] * (width - len(v)), g) for i, v, g in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = width // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, b: min((sum((s - t) ** 2 for s, t in zip(x, e)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(near(c[p], book[p])[1], []).append(c[p])
            book[p] = [[sum(x) // len(mine[k]) for x in zip(*mine[k])] if k in mine else e for k, e in enumerate(book[p])]
    out = []
    for (i, _, g), c in zip(kept, cut):
        got = [near(c[p], book[p]) for p in range(parts)]
        out.append((i, g, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got)))
    return out, hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()


@pytest.mark.parametrize(("parts", "entries"), [(4, 16), (16, 64)])
def test_op13_codes(spark, parts, entries):
    from tideline.llm.codes import compress, with_label_errors

    rng = np.random.default_rng(15)
    rows = [(k, [float(x) for x in np.round(rng.normal(size=32), 1).astype(np.float32)], int(k % 5) if k % 7 else None) for k in range(150)]
    rows += [(150 + k, rows[k % 9][1], 0) for k in range(40)]  # copies and ties
    rows += [(300, None, 1), (301, [1.0, None], 1), (302, [float("nan")] * 32, 1), (303, [float("inf")] * 32, 1), (304, [], 1), (305, [0.5, -0.5], None), (None, rows[3][1], 2), (7, rows[4][1], 2)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], VEC).repartition(3)
    codes, book = compress(table, parts, entries)
    want, digest = plain_codes(rows, parts, entries, 2)
    got = with_label_errors(codes).collect()
    assert sorted(((r["vec_id"], r["label"], r["code"], r["error"]) for r in got), key=str) == sorted(want, key=str) and book.sha256() == digest
    sums = {}
    for r in want:
        sums[r[1]] = sums.get(r[1], 0) + r[3]
    assert all(r["label_error"] == sums[r["label"]] for r in got)
    assert len(book.decode(got[0]["code"])) == 32


def test_op13_few_and_no_rows(spark):
    from tideline.llm.codes import compress, with_label_errors

    one = spark.createDataFrame([(5, [1.0, 2.0, 3.0], 1, "", 0)], VEC)
    codes, book = compress(one, 4, 16)
    assert [tuple(r) for r in codes.collect()] == [(5, 1, "00000000", 0)] and book.entries.tolist() == [[[256]], [[512]], [[768]], [[0]]]
    codes, book = compress(one.limit(0))
    assert with_label_errors(codes).count() == 0 and book.sha256() == hashlib.sha256(b"").hexdigest()
    with pytest.raises(Exception, match="27 bits"):
        compress(spark.createDataFrame([(1, [1e9], 1, "", 0)], VEC))[0].collect()


def test_trees_leave_subtrees_out_and_keep_ties():
    from tideline.llm.codes import Gnat, squared

    rng = np.random.default_rng(16)
    for spread in (2, 40, 1 << 26):
        points, queries = rng.integers(-spread, spread, (64, 4)), rng.integers(-spread, spread, (400, 4))
        who, far, measured = Gnat(points, np.arange(64)).nearest(queries)
        d = squared(queries, points)
        assert (who == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()
        if spread > 2:
            assert measured < 0.8 * d.size
