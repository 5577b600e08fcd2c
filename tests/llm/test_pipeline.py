"""The pipeline's stages on a small corpus, each against what its operator must keep."""

import random
import zlib
from collections import Counter

import pytest

from .test_operators import DOC, corpus, ids_of, lower, plain_components, plain_mix, tokenizer, words  # noqa: F401

# Names that the stages use inside.
CLASH = DOC.replace("h long, norm string, block long", "h long, row string, taken_blocks long, left_id long, __blocks string, d long, hh long, _sum long, part long")


def clashing(rows):
    return [(*r[:5], 1, "clash", 2, 3, "b", 4, 5, 6, 7) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [(*r[:5], r[5], r[6], r[7]) for r in corpus()]
    rows += [(1000 + k, " ".join(w.upper() + "!!" for w in words(rng, 60).split()), "en", "bad", 1, 1, "c", 2) for k in range(60)]
    rows += [(2000 + k, words(rng, 60, 900), "en", "a", 1, 1, "c", 2) for k in range(120)]
    labels = [(k, int(k < 1000 or k >= 2000), 0) for k in [*range(40), *range(1000, 1060), *range(2000, 2120)]]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(clashing(rows), CLASH).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def cut_runs(text, times, least):
    """The words of a text that are taken ``least`` times or more; neighbours keep what stands between them."""
    import re

    spans, runs = [m.span() for m in re.finditer("[^ \\x09-\\x0d]+", text)], []
    for k, n in enumerate(times):
        if n >= least:
            if runs and runs[-1][1] == k:
                runs[-1][1] = k + 1
            else:
                runs.append([k, k + 1])
    if runs == [[0, len(spans)]]:
        return text
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs) if runs else None


def test_stages(spark, folder, tokenizer):  # noqa: F811
    import corpus_pipeline as P
    from tideline.llm.shared import keep, table

    docs = table(spark, folder, "documents")
    seen = {}
    for name, stage in P.STAGES:
        before = docs
        docs = keep(stage(spark, docs, folder), name)
        seen[name] = [tuple(r) for r in docs.collect()]
        if name != "pack":
            assert docs.columns == before.columns
        if name == "quality":
            left = {r[0] for r in seen[name]}
            assert len(left & set(range(1000, 1060))) <= 3 and len(left & set(range(2000, 2120))) >= 117
        elif name == "exact_dedup":
            assert Counter(lower(r[1]) for r in seen[name]) == Counter({lower(r[1]) for r in seen["quality"]})
            last = {}
            for r in seen["quality"]:
                last[lower(r[1])] = max(last.get(lower(r[1]), -1), -1 if r[0] is None else r[0])
            assert all(r[0] is None or r[0] == last[lower(r[1])] for r in seen[name])
        elif name == "near_dedup":
            groups = plain_components(seen["exact_dedup"], 5, 75)
            firsts = {c for _, n, c in groups if n} | {i for i, n, _ in groups if not n}
            assert sorted(r[0] for r in seen[name] if r[0] is not None) == sorted(i for i in firsts if i is not None)
        elif name == "mix":
            want = Counter()
            for source, _, _, times in plain_mix(seen["near_dedup"], 64, 64):
                # Rows without ids or words aside, a source's documents stand in the order of their ids.
                at = 0
                for r in sorted((r for r in seen["near_dedup"] if r[3] == source), key=lambda r: (r[0] is not None, r[0])):
                    n = len((r[1] or "").encode().split())
                    mine = times[at : at + n]
                    at += n
                    for least in (1, 2):
                        part = cut_runs(r[1] or "", mine, least)
                        if part is not None and n:
                            want[(r[0], part, r[2], r[3], len(part), *r[5:])] += 1
            assert Counter(seen[name]) == want
    want = Counter()
    for r in seen["mix"]:
        ids = ids_of(tokenizer, r[1], 2)
        head, lo, piece = len(ids) % 1024 or 1024, 0, 0
        while lo < len(ids):
            hi = head if lo == 0 else lo + 1024
            want[r[0], piece, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())] += 1
            lo, piece = hi, piece + 1
    assert Counter(r[:5] for r in seen["pack"]) == want
    by = {}
    for r in seen["pack"]:
        by.setdefault(r[5], []).append((r[6], r[3]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_no_rows(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], DOC).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0
