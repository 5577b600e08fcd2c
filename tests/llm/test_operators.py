"""The ten operators against plain versions, with the awkward rows: nulls, empties, ties, repeats, long texts, no rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long, h long, norm string, block long"


def words(rng, n, kinds=40):
    return " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, kinds)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = words(rng, 60, 400)
    passage = words(rng, 45, 400)
    rows = [(k, words(rng, rng.randint(0, 90), 400), "en", rng.choice(["a", "b", "hot", "hot", None])) for k in range(40)]
    rows += [(100 + k, base.upper() if k % 2 else base, "en", "hot") for k in range(9)]
    for k in range(8):  # near copies: a word or two changed
        w = base.split()
        w[rng.randint(0, 59)] = f"x{k}"
        rows.append((200 + k, " ".join(w), "en", "b"))
    rows += [(300 + k, words(rng, 20, 400) + " " + passage + "\n" + words(rng, 9, 400), "en", "a") for k in range(4)]
    rows += [(400, None, None, None), (401, "", "en", "a"), (402, " \t\n", "en", "a"), (403, "one two", "en", "a"), (404, "ONE two", "en", "a"), (None, "no id here at all", "en", "z"), (405, "same row", "en", "a"), (405, "same row", "en", "a")]
    rows += [(500, words(rng, 3000, 400), "en", "hot"), (501, "long" * 9000, "en", "a"), (502, "éà  ü　x  y ", "fr", "a")]
    return [(i, t, g, s, len(t or ""), 1, "clash", 2) for i, t, g, s in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    from tideline.llm.entries import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def key(row):
    return tuple((x is None, x) for x in row)


def test_stretches_give_the_library_s_ids(tokenizer):
    import pyarrow as pa

    from tideline.llm.entries import tokenizer_path
    from tideline.llm.tokens import Encoder

    texts = ["", " ", "a", "a  b", "a \n b  c", "x\x1c y \x85 z", "a<|endoftext|> b", "'s don't  I'm", "\n\n a\n", "１２ ３", "a　b ", "a,\nb. c\n d,\n", "x.\n y", ".\na,b,", "\x01 a\x02", "ok, fine.\nNext'll do…", "tab\there now"]
    encoder = Encoder(tokenizer_path())
    for _ in range(2):  # unknown, then known
        ids, n = encoder.encode(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        for t, e, k in zip(texts, ends, n):
            assert ids[e - k : e].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_wavelet_matrix():
    from tideline.llm.wavelet import WaveletMatrix

    ids = np.random.default_rng(1).integers(0, 900, 3000).astype(np.uint32)
    w = WaveletMatrix.build(ids)
    assert (w.ids() == ids).all() and [w.access(k) for k in (0, 511, 512, 2999)] == ids[[0, 511, 512, 2999]].tolist()
    for t in (int(ids[7]), int(ids[-1]), 5000):
        places = np.flatnonzero(ids == t)
        assert w.count(t) == len(places) and w.count(t, 1500) == int((places < 1500).sum())
        assert [w.locate(t, k) for k in range(len(places))] == places.tolist() and w.locate(t, len(places)) == -1


def test_op1_files_hold_every_id(spark, docs, none, rows, tokenizer, tmp_path):
    from tideline.llm.entries import tokenizer_path
    from tideline.llm.wavelet import encode_corpus, token_counts, write_shards

    got = sorted((tuple(r) for r in encode_corpus(docs, tokenizer_path(), tokens_per_shard=700).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    want, start = [], 0
    for r in sorted(rows, key=lambda r: key((r[0] is not None, r[0], r[1] or ""))):
        ids = ids_of(tokenizer, r[1], 0)
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert encode_corpus(none, tokenizer_path()).count() == 0
    shards = write_shards(docs, tokenizer_path(), f"file://{tmp_path}/shards", tokens_per_shard=700)
    assert token_counts(shards, [0]).agg(F.sum("n")).first()[0] == len(rows)


def test_op2_rules_and_mined_verdicts(spark):
    from tideline.llm.entries import URL_RULES
    from tideline.llm.urlrules import judge

    urls = [f"https://h{k}.example.net/{'en' if k % 2 else 'es'}/{k}" for k in range(40)] + [f"http://s{k}.example.com/de/{k}?x=1" for k in range(20)] + [f"http://s{k}.example.com/es/{k}" for k in range(9)] + ["HTTP://A.Example.ORG/fr/1", "http://notexample.net.org/x", "http://xnet/en/", None, "", "no scheme", "http://NET", "://"]
    pages = spark.createDataFrame([(k, u, "h", "t") for k, u in enumerate(urls)] + [(None, "http://a.net/", "h", "t")], "page_id long, url string, html string, tokens string")
    got = {r["page_id"]: r for r in judge(pages, URL_RULES).collect()}
    assert len(got) == len(urls) + 1
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[k]["host"], got[k]["path"]) == (host, path), u
        assert got[k]["rule"] == (max(fits)[1] if fits else None), u
        if fits:
            assert got[k]["verdict"] == max(fits)[2]
    assert got[60]["rule"] is None and got[60]["verdict"] == "block" and got[60]["mined"]
    assert got[len(urls) - 1]["verdict"] == "allow"
    assert judge(pages.limit(0), URL_RULES).count() == 0


def url_tokens(url):
    import re

    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0].lower()
    path = re.split("[?#]", rest[len(host) :])[0]
    labels = [x for x in host.split(".") if x][::-1]
    out = [f"host{k}:{x}" for k, x in enumerate(labels)]
    out += ["under:" + ".".join(labels[:n][::-1]) for n in range(2, len(labels) + 1)]
    out += ["path:" + x for x in re.split("[/._-]+", re.sub("[0-9]+", "#", path)) if x]
    out += ["query:" + x for x in re.findall(r"[?&]([^=&#]+)=", url)]
    return set(out)


def plain_mined(judged, others, support, confidence):
    """Verdicts of ``others`` by all rules over classes of tokens that the same pages of ``judged`` hold."""
    from itertools import combinations

    rows = [(url_tokens(u), v) for u, v in judged]
    where = {}
    for k, (tokens, _) in enumerate(rows):
        for t in tokens:
            where.setdefault(t, set()).add(k)
    first = {}
    for t in sorted(where):
        first.setdefault(frozenset(where[t]), t)
    item = {t: first[frozenset(w)] for t, w in where.items()}
    baskets = [({item[t] for t in tokens}, v) for tokens, v in rows]
    rules = {}
    for size in range(1, 9):
        for basket, _ in baskets:
            for need in combinations(sorted(basket), size):
                if need not in rules:
                    holds = [v for b, v in baskets if set(need) <= b]
                    rules[need] = {v: (holds.count(v) / len(holds), holds.count(v) / len(baskets)) for v in set(holds)}
    good = {(need, v): (c, s) for need, by in rules.items() for v, (c, s) in by.items() if s >= support and c >= confidence}
    kept = {(n, v): x for (n, v), x in good.items() if not any(good.get((n[:k] + n[k + 1 :], v), (0,))[0] >= x[0] for k in range(len(n)))}
    out = []
    for u in others:
        have = {item[t] for t in url_tokens(u) if t in item}
        fits = [(c, s, len(n), list(n), v) for (n, v), (c, s) in kept.items() if set(n) <= have]
        out.append(max(fits)[-1] if fits else "allow")
    return out


def test_op2_mined_verdicts_match_plain_rules(spark):
    from tideline.llm.entries import URL_RULES
    from tideline.llm.urlrules import judge

    rng = random.Random(4)
    judged, others = [], []
    for k in range(160):
        good = rng.random() < 0.5
        word = rng.choice(["news", "guide"] if good else ["casino", "win", "news"])
        tail = f"{word}/{rng.choice(['a', 'b', 'c'])}/{k % 7}?{rng.choice(['id', 'ref'])}={k}"
        judged.append((f"http://x{k % 3}.example.net/{'en' if good else 'de'}/{tail}", "allow" if good else "block"))
        others.append(f"http://x{k % 5}.example.com/es/{rng.choice(['news', 'guide', 'casino', 'win', 'else'])}/{rng.choice(['a', 'b', 'd'])}/{k}?{rng.choice(['id', 'q'])}=1")
    judged += judged[:5]  # repeated rows
    pages = [(k, u) for k, u in enumerate([u for u, _ in judged] + others)]
    got = {r["page_id"]: r for r in judge(spark.createDataFrame(pages, "page_id long, url string"), URL_RULES, support=0.05).collect()}
    assert [got[k]["verdict"] for k in range(len(judged))] == [v for _, v in judged]
    assert [got[len(judged) + k]["verdict"] for k in range(len(others))] == plain_mined(judged, others, 0.05, 0.8)
    assert {got[len(judged) + k]["verdict"] for k in range(len(others))} == {"allow", "block"}


def test_op2_long_urls_of_one_shape(spark):
    from tideline.llm.entries import URL_RULES
    from tideline.llm.urlrules import judge

    tail = "/".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))
    pages = [(k, f"http://s{k}.example.com/de/{tail}/{k}") for k in range(220)] + [(900, f"http://other.example.org/{tail}/1"), (901, "http://a.b/" + "x/" * 3000)]
    got = {r["page_id"]: r["verdict"] for r in judge(spark.createDataFrame(pages, "page_id long, url string"), URL_RULES).collect()}
    assert len(got) == 222 and got[900] == "block" and got[901] == "allow"


@pytest.mark.parametrize("capacity", [64, 1024])
def test_op3_packs_everything(docs, none, rows, tokenizer, capacity):
    from tideline.llm.entries import tokenizer_path
    from tideline.llm.packing import pack

    got = pack(docs, tokenizer_path(), capacity).collect()
    want = Counter()
    for r in rows:
        ids = ids_of(tokenizer, r[1], 2)
        head = len(ids) % capacity or capacity
        lo, piece = 0, 0
        while lo < len(ids):
            hi = head if lo == 0 else lo + capacity
            want[r[0], piece, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())] += 1
            lo, piece = hi, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in got)
    assert len(by) <= -(-total // capacity) * 1.1 + 2
    assert pack(none, tokenizer_path()).count() == 0


def test_op3_plan_is_exact_where_it_can_be():
    from tideline.llm.packing import plan

    stock = {10: 5, 7: 3, 3: 3, 6: 2, 2: 4, 5: 2}
    patterns = plan(stock, 10)
    used = Counter()
    for p, n in patterns:
        assert sum(p) <= 10
        for x in p:
            used[x] += n
    assert used == stock and sum(n for _, n in patterns) == 11
    rng = random.Random(3)
    for _ in range(20):
        stock = {n: rng.randint(1, 40) for n in rng.sample(range(1, 101), 40)}
        patterns, used = plan(stock, 100), Counter()
        for p, n in patterns:
            assert sum(p) <= 100
            for x in p:
                used[x] += n
        assert used == stock
        assert sum(n for _, n in patterns) <= 1.3 * -(-sum(k * v for k, v in stock.items()) // 100)
    stock = {60: 2, 40: 2, 50: 2, 70: 1, 20: 1, 10: 1, 91: 1, 5: 1, 3: 1, 1: 1}  # single, pair and triple complements
    assert all(sum(p) == 100 for p, _ in plan(stock, 100))


def hostile():
    """Two words of 2,048 letters that polynomial hashes modulo 2**64 cannot tell apart, whatever their base."""
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_with_equal_weak_hashes_stay_apart(spark, tokenizer):
    import pyarrow as pa

    from tideline.llm.entries import tokenizer_path
    from tideline.llm.fmindex import remove_repeats
    from tideline.llm.jaccard import link_documents
    from tideline.llm.packing import pack
    from tideline.llm.tokens import Encoder
    from tideline.llm.wavelet import encode_corpus
    from tideline.llm.words import Words

    a, b = hostile()
    rows = []
    for k, x in enumerate((a, b)):
        rows.append((k, f"{x} q"))
        rows.append((2 + k, " ".join([*[f"w{i}" for i in range(30)], x, *[f"w{i}" for i in range(31, 61)]])))
        rows.append((4 + k, " ".join(["s1", "s2", x, "s3", "s4"])))
        rows.append((6 + k, f"{x} 0 {x}"))
    encoder = Encoder(tokenizer_path())
    for _ in range(2):
        ids, n = encoder.encode(pa.array([t for _, t in rows]))
        for (_, t), e, m in zip(rows, np.cumsum(n), n):
            assert ids[e - m : e].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    table = spark.createDataFrame(rows, "doc_id long, text string")
    crc = lambda t, end: zlib.crc32(ids_of(tokenizer, t, end).tobytes())
    assert {r["doc_id"]: r["ids_crc32"] for r in encode_corpus(table, tokenizer_path()).collect()} == {k: crc(t, 0) for k, t in rows}
    assert {r["doc_id"]: r["ids_crc32"] for r in pack(table, tokenizer_path(), 1 << 14).collect()} == {k: crc(t, 2) for k, t in rows}
    assert Counter(tuple(r) for r in remove_repeats(table).collect()) == plain_removal(rows, 35)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in link_documents(table).collect()) == plain_components(rows, 5, 75)
    words = ["a", "a\x00", "12345678", "12345678a", "12345678a\x00", "0123456789abcdef", "0123456789abcdefg", a, b, "é", "\x00"]
    w = Words(pa.array([" ".join(words), "x\x00 " + a]), lower=False)
    assert len({*zip(w.hashes.tolist(), w.others.tolist())}) == len(words) + 1 and w.hashes[7] == w.hashes[-1]


def test_words_chosen_to_cancel_out_stay_apart(spark):
    """Words whose public bits differ by 2^63 in both halves, and short texts whose public first halves are equal."""
    from tideline.llm.fmindex import remove_repeats
    from tideline.llm.jaccard import link_documents

    x, y = r"i5thy\U6$C+s*ma<", "0CG|lVr6O2$%1{|Z"
    long = [(k, " ".join([*[f"w{i}" for i in range(29)], u, u, *[f"w{i}" for i in range(31, 60)]])) for k, u in enumerate((x, y))]
    short = [(10, "[]n{#*r{16v=3s2<"), (11, '^3s@v2_<=:g[9$r"'), (12, x), (13, y), (14, f"{x} {x}"), (15, f"{y} {y}")]
    rows = [*long, *short, *[(20 + k, " ".join(f"{u} a{k} {u} b c d".split())) for k, u in enumerate((x, y))]]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for _ in range(2):  # with another key each time
        assert all(r["n_removed"] == 0 for r in remove_repeats(table).collect())
        assert all(r["component_id"] == r["doc_id"] for r in link_documents(table).collect() if r["doc_id"] > 1)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_op4_groups_of_equal_texts(docs, none, rows):
    from tideline.llm.contentsort import deduplicate

    got = deduplicate(docs).drop("h").collect()
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    want = Counter()
    for r in rows:
        g = groups[lower(r[1])]
        want[r[0], max((i for i in g if i is not None), default=None), len(g), hashlib.sha256(lower(r[1]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert deduplicate(none).count() == 0


def test_op5_learns_and_does_not_peek(spark, none):
    from tideline.llm.quality import score

    rng = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        good = rng.random() < 0.7
        w = words(rng, rng.randint(20, 120)).split()
        rows.append((k, " ".join(w if good else [x.upper() + "!!" for x in w]), "en", "s", 1, 1, "n", 2))
        labels.append((k, int(good), 9))
    rows += [(None, "x", None, None, None, None, None, None), (9001, None, None, None, None, None, None, None), (9002, "", None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, DOC)
    given = spark.createDataFrame([*labels, (5, None, 1), (None, 1, 1), (9001, 7, 1)], "doc_id long, quality int, text int")
    got = {r["doc_id"]: r for r in score(table, given, size=64).collect()}
    assert len(got) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k]["held_out"] == (k in set(held)) for k in range(600)) and not got[None]["held_out"]
    assert np.mean([got[k]["predicted"] == labels[k][1] for k in held]) > 0.95
    flipped = spark.createDataFrame([(k, 1 - y if k in set(held) else y, 9) for k, y, _ in labels], "doc_id long, quality int, text int")
    again = {r["doc_id"]: r["score"] for r in score(table, flipped, size=64).collect()}
    assert all(abs(again[k] - got[k]["score"]) < 1e-6 for k in range(600))
    assert score(none, given).count() == 0 and score(table, given.limit(0)).select("score").distinct().first()[0] == 0.5


def plain_scores(rows, labels, size, seed=7, width=5.0, alpha=1e-3, bins=2048):
    """The same model by plain linear algebra and pooling of neighbours."""
    from tideline.llm.quality import statistics

    stats = np.array([statistics((t or "").encode()) for _, t in rows])
    fold = np.array([zlib.crc32(str(i).encode()) % 5 if i is not None else -1 for i, _ in rows])
    at = {i: k for k, (i, _) in enumerate(rows)}
    known = [(at[i], y) for i, y in labels if i is not None and y in (0, 1) and i in at and fold[at[i]] != 0]
    fit = [(k, y) for k, y in known if fold[k] != 4]
    x = stats[[k for k, _ in fit]]
    mean, std = x.mean(0), x.std(0, ddof=1)
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 1 / width, (stats.shape[1], size)), rng.uniform(0, 2 * np.pi, size)
    z = np.clip((stats - mean) / np.where(std > 1e-9, std, 1), -6, 6)
    phi = np.hstack([np.cos(z @ w + b) * np.sqrt(2 / size), np.ones((len(z), 1))])
    a = phi[[k for k, _ in fit]]
    raw = phi @ np.linalg.solve(a.T @ a + alpha * len(fit) * np.eye(size + 1), a.T @ np.array([y for _, y in fit], float))
    place = np.clip(np.floor((raw + 0.5) / 2 * bins), 0, bins - 1).astype(int)
    cal = {}
    for k, y in known:
        if fold[k] == 4:
            cal.setdefault(place[k], []).append(y)
    pools = []  # mean, weight, bins
    for c in sorted(cal):
        pools.append([np.mean(cal[c]), len(cal[c]), [c]])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m, n, cs = pools.pop()
            last = pools[-1]
            pools[-1] = [(last[0] * last[1] + m * n) / (last[1] + n), last[1] + n, last[2] + cs]
    xs = [c for p in pools for c in p[2]]
    return np.interp(place, xs, [p[0] for p in pools for _ in p[2]])


def test_op5_scores_match_a_plain_fit(spark):
    from tideline.llm.quality import score

    rng = random.Random(12)
    rows, labels = [], []
    for k in range(500):
        good = rng.random() < 0.7
        w = words(rng, rng.randint(5, 80)).split()
        rows.append((k, " ".join(w if good or rng.random() < 0.2 else [x.upper() + "!!" if rng.random() < 0.6 else x for x in w])))
        labels.append((k, int(good)))
    rows += [(None, "x y"), (600, None), (601, ""), (602, "long " * 20_000), (603, rows[3][1]), (604, rows[3][1])]
    labels += [(7, None), (None, 1), (603, 1), (9999, 0)]
    got = {r["doc_id"]: r["score"] for r in score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int"), size=48).collect()}
    want = plain_scores(rows, labels, 48)
    assert len(got) == len(rows)
    # A raw score beside a bin's edge may fall on either side of it.
    off = [i for (i, _), x in zip(rows, want) if abs(got[i] - x) > 1e-6]
    assert len(off) <= 2
    assert got[603] == got[604] == got[3] and got[600] == got[601]


def test_op6_base_spans_and_discovery(spark, none):
    import re

    from tideline.llm.pii import find

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def plain(t):
        out = []
        for k, p in patterns.items():
            for m in re.finditer(p, t):
                g = re.sub("[^0-9]", "", m[0])
                luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(g)))) % 10 == 0
                ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(g) <= 19 and luhn, "phone": 9 <= len(g) <= 15}[k]
                if ok:
                    out.append(f"{k}:{m.start()}:{m.end()}")
        return ",".join(out)

    texts = ["é a.b@c.de_f@g.h x@y", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 123-4567 +12 +123456789012345678", "a@b..c @x.y a@b.c.", None, "", "1" * 30_000, "w" * 30_000 + "@", "12.34.56", "💡 a@b.co 💡 +49 30 901820 0"]
    texts += [f"please call the desk phone +1555555{1000 + k} now thanks" for k in range(12)] + ["please call the desk phone 0800-123456x now thanks", "version 2.0 is out", "version 3.1 is out"]
    table = spark.createDataFrame([(k, t, 1, "c") for k, t in enumerate(texts)] + [(None, "a@b.c", 1, "c")], "doc_id long, text string, h long, c string")
    got = {r["doc_id"]: r for r in find(table, confidence=0.7, belief=0.9).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        want = plain(t or "")
        assert got[k]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[k]["spans"].startswith(want), t
        assert got[k]["n_email"] == want.count("email")
    hidden = texts.index("please call the desk phone 0800-123456x now thanks")
    assert got[hidden]["n_found"] == 1 and got[hidden + 1]["n_found"] == 0
    assert find(none.select("doc_id", "text")).count() == 0


def test_op6_seeds_without_digits_runs_and_single_patterns(spark):
    from tideline.llm.pii import find

    name = lambda k: "".join(chr(97 + int(d)) for d in f"{k:03d}")
    filler = lambda k: f"w{name(k)}"
    seeds = [f"write to member {name(k)}@example.org today {filler(k)}" for k in range(60)]
    seeds += [f"{filler(k)} reachable under {name(k)}@example.org {filler(k)}x" for k in range(60)]
    hidden = {
        "write to member klmnopqr today then": "klmnopqr",  # no digits
        "write to member 123 45 6789 today then": "123 45 6789",  # groups
        "now\tmember  AB 12 34 56 C today": "AB 12 34 56 C",
        "é 💡 write to member jane van doe today": "jane van doe",  # a run without digits
        "reachable under X99-1234567 zzz": "X99-1234567",  # one pattern, seen once
        "page 7 member 987 65 4321 today": "987 65 4321",
    }
    clean = ["they write today and then again", "room 12 is free at 10 30 today", "jane van doe wrote klmnopqr", ""]
    texts = seeds + list(hidden) + clean
    got = {r["doc_id"]: r for r in find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for k, t in enumerate(texts):
        ids = [s.split(":")[1:] for s in got[k]["spans"].split(",") if s.startswith("id:")]
        assert [t[int(a) : int(b)] for a, b in ids] == ([hidden[t]] if t in hidden else []), t


def test_op6_many_matches_in_one_text_and_repeated_rows(spark):
    import time

    from tideline.llm.pii import find

    numbers = " ".join(f"{k % 97}.5" for k in range(20_000))
    mails = " ".join(f"u{k}@example.org" for k in range(20_000))
    rows = [(1, numbers), (2, mails), (3, "key " + "0f" * 20 + " end"), (3, "key " + "0f" * 20 + " end"), (None, "call 4111111111111112 now")]
    start = time.time()
    got = sorted(((r["doc_id"], r["n_email"], r["spans"]) for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert time.time() - start < 120
    assert [(r[0], r[1]) for r in got] == [(1, 0), (2, 20_000), (3, 0), (3, 0), (None, 0)]
    at = 0
    for k, span in enumerate(got[1][2].split(",")[:20_000]):
        n = len(f"u{k}@example.org")
        assert span == f"email:{at}:{at + n}"
        at += n + 1
    assert got[2][2] == got[3][2] == "id:4:44" and got[4][2] == "id:5:21"


def test_op7_matches_brute_force(spark):
    from tideline.llm.topk import by_id, top_k

    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=8) * 0.3).astype(float).tolist(), 1) for k in range(700)]
    rows += [(1000 + k, rows[3][1], 1) for k in range(60)] + [(2000, None, 1), (2002, [1.0] * 7 + [float("nan")], 1), (2003, [1.0] * 7 + [None], 1), (2004, [float("inf")] + [0.0] * 7, 1), (None, [0.1] * 8, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int").repartition(3)
    sound = {k: np.floor(np.array(v) * 1024).astype(int) for k, v, _ in rows if k is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    got = {}
    for r in top_k(table, by_id(100), candidates_per_block=150, queries_per_block=4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q in (k for k in sound if k % 100 == 0):
        best = sorted(((-int(sound[q] @ v), k) for k, v in sound.items() if k != q))[:10]
        assert [got[q][i + 1] for i in range(10)] == [(k, -s) for s, k in best]
    assert set(got) == {k for k in sound if k % 100 == 0}
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k(few, by_id()).collect()] == [(0, 1, 1, 512 * 1024 + 512 * 2048)]
    assert top_k(few.limit(0), by_id()).count() == 0


def test_op7_mixed_lengths_large_components_and_repeated_ids(spark):
    from tideline.llm.topk import by_id, top_k

    rng = np.random.default_rng(8)
    rows = [(k, (rng.normal(size=rng.integers(0, 6)) * 10.0 ** rng.integers(-2, 13)).tolist()) for k in range(400)]
    rows += [(100, [5.0, 1.0]), (17, [3.0]), (17, [3.0]), (401, [1e300, -1e300]), (402, [9e9 + 1, 2.0**40 + 0.5, -7.0])]
    whole = [(k, [max(-(1 << 63), min((1 << 63) - 1, int(np.floor(x * 1024)))) for x in v]) for k, v in rows]
    queries = {}
    for k, v in whole:
        if k % 100 == 0:
            queries[k] = min(queries.get(k, v), v)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for blocks in ({}, {"candidates_per_block": 60, "queries_per_block": 2}):
        got = {}
        for r in top_k(table, by_id(100), **blocks).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert set(got) == set(queries)
        for q, x in queries.items():
            held = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
            best = sorted((-held(sum(a * b for a, b in zip(x, v))), k) for k, v in whole if k != q)[:10]
            assert [(k, s) for _, k, s in sorted(got[q])] == [(k, -s) for s, k in best], q


def plain_removal(rows, window):
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in split for k in range(len(w) - window + 1))
    out = Counter()
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    return out


@pytest.mark.parametrize(("window", "anchor", "block"), [(35, 8, 8192), (6, 3, 8192), (6, 3, 2)])
def test_op8_removes_what_repeats(docs, none, rows, window, anchor, block):
    from tideline.llm.fmindex import remove_repeats

    got = Counter(tuple(r) for r in remove_repeats(docs, window, anchor, block).collect())
    assert got == plain_removal(rows, window)
    assert remove_repeats(none).count() == 0


def test_op8_segments_that_meet_many_blocks_do_not_repeat_themselves(spark):
    from tideline.llm.fmindex import remove_repeats

    own = iter(range(10**6))
    many = lambda n: [f"w{next(own)}" for _ in range(n)]
    common = many(30)
    rows = [(k, " ".join(many(40) + common + many(40))) for k in range(24)]
    rows += [(None, rows[3][1]), (0, rows[3][1]), (0, rows[3][1])]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block=2)
    assert Counter(tuple(r) for r in got.collect()) == plain_removal(rows, 35)


def test_op8_one_of_equal_segments_in_a_batch_stands_for_all(spark):
    from tideline.llm.fmindex import segments_of

    docs = spark.createDataFrame([(k, "ab cd " * 200) for k in range(5)] + [(9, " ".join(f"w{k}" for k in range(99)))], "doc_id long, text string").coalesce(1)
    rows = segments_of(docs, 35, 8, 12345).collect()
    number = Counter((r["a"], r["c1"], r["c2"]) for r in rows)
    stands = [r for r in rows if r["copies"]]
    assert {(r["a"], r["c1"], r["c2"]): r["copies"] for r in stands} == number and len(stands) == len(number) < len(rows) / 5
    assert all((r["spread"] == 0) == (r["copies"] > 0) for r in rows)


def test_op8_bitmap_leaves_out_most_other_texts(spark):
    from tideline.llm.fmindex import TEXT, keyed, marked

    rows = [(k, f"text {k}") for k in range(3000)] + [(None, "text 0"), (None, None), (None, "text 7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    chosen = keyed(docs).where("doc_id % 30 = 7 or text = 'text 0'").select(*TEXT)
    got = {(r["doc_id"], r["text"]): r["maybe"] for r in marked(keyed(docs), chosen).collect()}
    wanted = {(k, t) for k, t in rows if t == "text 0" or k is not None and k % 30 == 7}
    assert len(got) == len(rows) and all(got[x] for x in wanted)
    assert sum(got.values()) < len(wanted) + 400
    assert not any(r["maybe"] for r in marked(keyed(docs), chosen.limit(0)).collect())


def test_fm_index_counts():
    from tideline.llm.fmindex import FMIndex

    rng = np.random.default_rng(4)
    text = np.append(rng.integers(1, 5, 400), 0)
    index = FMIndex(text, 5)
    for length in (1, 3, 5):
        for at in range(0, 300, 37):
            word = text[at : at + length]
            lo, hi = np.array([0]), np.array([len(text)])
            for w in word[::-1]:
                lo, hi = index.extend(lo, hi, np.array([w]))
            assert int(hi[0] - lo[0]) == sum((text[k : k + length] == word).all() for k in range(len(text) - length))


def plain_targets(sizes, weights, total, most):
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / weight > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / weight
            break
        for k in over:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in over]
    return out


def plain_slots(slots, there, shards, seed, k):
    """Every output shard's slots of a source: as many of its own region as it draws, the rest where there is room."""
    regions = [range(there * s // shards, there * (s + 1) // shards) for s in range(shards)]
    drawn = np.random.default_rng([seed, k]).multinomial(slots, np.array([len(r) for r in regions]) / max(1, there)).tolist()
    taken = [min(d, len(r)) for d, r in zip(drawn, regions)]
    left = slots - sum(taken)
    for s, r in enumerate(regions):
        more = min(left, len(r) - taken[s])
        taken[s], left = taken[s] + more, left - more
    return [j for r, n in zip(regions, taken) for j in r[:n]]


def plain_mix(rows, block, shards, seed=11):
    """Words taken of each (doc_id, text), by going through every slot."""
    from tideline.llm.mixing import permuted
    from tideline.llm.words import _SPACE

    assert _SPACE.sum() == 6
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    count = lambda t: len((t or "").encode().split())
    sizes = [sum(count(r[1]) for r in rows if r[3] == s) for s in sources]
    goals = plain_targets(sizes, [(3, 1, 2)[k % 3] for k in range(len(sources))], 1.5 * sum(sizes), 2)
    taken = {}
    for k, (s, n, goal) in enumerate(zip(sources, sizes, goals)):
        blocks = -(-n // block)
        slots = min(round(goal * blocks / n), 2 * blocks) if n else 0
        times = Counter()
        for j in plain_slots(slots, 2 * blocks, shards, seed, k):
            times[int(permuted(np.array([j % blocks]), np.array([blocks]), np.array([(j // blocks) * 1_000_003 + k * 7919 + seed]))[0])] += 1
        yield s, n, goal, [times[w // block] for w in range(n)]


def test_op9_takes_what_the_slots_say(docs, none, rows):
    from tideline.llm.mixing import mix

    got = mix(docs, block=8, shards=4).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(1.5 * sum(rs[0]["source_size"] for rs in by.values()))
    for source, size, goal, times in plain_mix(rows, 8, 4):
        rs = sorted(by[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["h"] is not None, r["h"]))
        assert rs[0]["source_size"] == size == sum(r["size"] for r in rs) and rs[0]["target"] == pytest.approx(goal)
        at = 0
        for r in rs:
            mine = times[at : at + r["size"]]
            assert r["taken"] == sum(mine), (source, r)
            assert sum((b["until"] - b["from"]) * b["times"] for b in r["blocks"] or []) == sum(mine)
            at += r["size"]
        assert abs(sum(r["taken"] for r in rs) - goal) <= 16, source
    again = {(r["doc_id"], r["h"], r["taken"]) for r in mix(docs.repartition(5), block=8, shards=4).collect()}
    assert again == {(r["doc_id"], r["h"], r["taken"]) for r in got}
    assert mix(none).count() == 0
    # What the shards draw decides what is taken; targets hold all the same.
    for other in ({"shards": 7}, {"shards": 1}, {"seed": 12}):
        rest = mix(docs, **({"block": 8, "shards": 4} | other)).collect()
        assert {(r["doc_id"], r["h"], r["taken"]) for r in rest} != {(r["doc_id"], r["h"], r["taken"]) for r in got}
        for rs in by.values():
            assert abs(sum(r["taken"] for r in rest if r["source"] == rs[0]["source"]) - rs[0]["target"]) <= 16


def test_op9_targets_and_permutations(spark):
    from tideline.llm.mixing import permuted, slot_ranges, targets

    rng = random.Random(1)
    for _ in range(6):
        sizes, weights = [rng.randint(0, 100) for _ in range(7)], [float(rng.randint(1, 3)) for _ in range(7)]
        table = spark.createDataFrame(list(zip(range(7), sizes, weights)), "k int, source_size long, weight double")
        got = [r["target"] for r in targets(table, 1.5, 2.0).orderBy("k").collect()]
        assert got == pytest.approx(plain_targets(sizes, weights, 1.5 * sum(sizes), 2))
    assert plain_targets([10, 100, 100], [3, 1, 2], 150, 2) == [20.0, 130 / 3, 260 / 3]
    for n in (1, 2, 7, 100):
        assert sorted(permuted(np.arange(n), np.full(n, n), np.full(n, 5)).tolist()) == list(range(n))
    ranges = slot_ranges(spark.createDataFrame([(0, 10_000, 6_000), (1, 0, 0), (2, 5, 3), (3, 6, 3)], "k long, slots long, blocks long"), 4, 1).collect()
    for k, n, blocks in ((0, 10_000, 6_000), (2, 5, 3), (3, 6, 3)):
        assert sorted(j for r in ranges if r["k"] == k for j in range(r["lo"], r["hi"])) == plain_slots(n, 2 * blocks, 4, 1, k)


def plain_components(rows, n, percent):
    sets = []
    for r in rows:
        w = lower(r[1]).encode().split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                label[root(a)] = root(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k][0])
    return Counter((rows[k][0], len(sets[k]), min((i for i in groups[root(k)] if i is not None), default=None)) for k in range(len(rows)))


@pytest.mark.parametrize("percent", [75, 55, 90])
def test_op10_components(docs, none, rows, percent):
    from tideline.llm.jaccard import link_documents

    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in link_documents(docs, percent=percent).collect())
    assert got == plain_components(rows, 5, percent)
    if percent == 75:
        assert link_documents(none).count() == 0


def test_op10_links_through_members(spark):
    """Chains of near copies: neighbours are linked, their ends are not."""
    from tideline.llm.jaccard import link_documents

    rng = random.Random(9)
    rows = []
    for c in range(6):
        w = [f"c{c}w{k}" for k in range(80)]
        for k in range(9):
            rows.append((len(rows), " ".join(w), "", "", 0, 0, "", 0))
            for _ in range(rng.randint(1, 2)):
                w[rng.randint(0, 79)] = f"n{rng.random()}"
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in link_documents(spark.createDataFrame(rows, DOC)).collect())
    assert got == plain_components(rows, 5, 75)


def test_op10_large_group_with_far_members(spark, monkeypatch):
    """Near copies of one text, many too far from it to be linked with it, some linked with each other only."""
    from tideline.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(21)
    base = [f"b{k}" for k in range(70)]

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            at = rng.randint(0, len(w) - 1)
            kind = rng.random()
            if kind < 0.6:
                w[at] = f"e{rng.randint(0, 60)}"
            elif kind < 0.8 and len(w) > 50:
                del w[at]
            else:
                w.insert(at, f"e{rng.randint(0, 60)}")
        return w

    texts = [edited(base, rng.choice([0, 1, 2, 3, 5, 8])) for _ in range(130)]
    for _ in range(12):  # far ones with a close relative each
        far = edited(base, rng.randint(4, 9))
        texts += [far, edited(far, 1), edited(far, 2)]
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    rng.shuffle(rows)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = plain_components(rows, 5, 75)
    assert got == want and len({c for _, _, c in want}) > 5


def test_new_stretches_are_asked_many_to_a_text():
    import pyarrow as pa

    from tideline.llm.entries import tokenizer_path
    from tideline.llm.tokens import Encoder

    encoder, asked = Encoder(tokenizer_path()), []
    library = encoder.library

    class Counted:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.append(len(texts))
            return library.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

        def encode(self, text, add_special_tokens):
            return library.encode(text, add_special_tokens=add_special_tokens)

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeXé中🙂0'.,-\t\u00a0\u200b\r") for _ in range(rng.randint(1, 9)))
    made = ["".join(word() + rng.choice("  \n") for _ in range(60))[:-1] for _ in range(100)]
    given = [*made, "ends in a tab\t", "ends in a tab\t", "ends in a no-break space\u00a0", "\tfirst", "new\nline\r", "x", ""]
    encoder.library = Counted()
    ids, lengths = encoder.encode(pa.array(given))
    want = [library.encode(t, add_special_tokens=False).ids for t in given]
    assert ids.tolist() == [x for w in want for x in w] and lengths.tolist() == [len(w) for w in want]
    encoder.known, asked[:] = type(encoder.known)(), []
    encoder.encode(pa.array([" ".join(f"w{k}x" for k in range(5000))]))
    assert sum(asked) < 50  # before: 5000, one for each new stretch


def test_stretches_found_again_stay_known(tokenizer, monkeypatch):
    import pyarrow as pa

    from tideline.llm import tokens
    from tideline.llm.entries import tokenizer_path

    monkeypatch.setattr(tokens, "KEPT", 3 << 20)
    encoder, asked, full = tokens.Encoder(tokenizer_path()), [], 0
    library = encoder.library

    class Noted:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return library.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    encoder.library = Noted()
    for k in range(40):
        before = encoder.known
        text = "at " + " ".join(f"often{j}x new{k}x{j}x" for j in range(2000))
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        full += encoder.known is not before
    assert full > 1 and sum(t.count("often7x") for t in asked) == 1  # before: once more whenever the arrays were full
