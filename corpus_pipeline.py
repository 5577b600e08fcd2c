"""A corpus from ``documents``: quality, exact copies, near copies, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
has kept.  All but the last return the columns of ``documents``.

* ``quality``: documents that the classifier rejects go.
* ``exact_dedup``: of equal texts (A-Z lower-cased) the row with the largest id stays.
* ``near_dedup``: of documents that links connect the one with the smallest id stays.
* ``mix``: of each document the words that the mix takes, once or twice: a row for the
  words taken at least once, another for those taken twice.  Words next to each other
  keep what stands between them; a whole document stays as it is.
* ``pack``: the pieces in their sequences.

Null and repeated ids, null or empty texts, clashing columns and empty tables are
treated as the operators' docstrings say; documents without words are in no mix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.contentsort import deduplicate
from tideline.llm.entries import tokenizer_path
from tideline.llm.jaccard import link_documents
from tideline.llm.mixing import mix
from tideline.llm.packing import pack
from tideline.llm.quality import score
from tideline.llm.shared import WORD, chosen_rows, keep, rows_of, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more.

    Null and empty texts get the score of empty statistics and stay or go by it, rows with null ids too; equal rows go
    or stay together; without labels all have 0.5 and stay; an empty table stays empty.
    """
    judged = score(docs, table(spark, sf_dir, "labels"))
    return rows_of(docs, judged.where(F.col("predicted") == 1).select("doc_id", "h"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each normalised text: the one with the largest id.

    Null and empty texts are one text; a null id is smaller than any other; of rows that share id and text one stays.
    """
    kept = keep(deduplicate(docs).where("kept").select("doc_id", "h"), "kept")
    return one_each(docs, kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links connect, the one with the smallest id; a null id only where all are null.

    Texts without words are linked with nothing and all stay.
    """
    linked = keep(link_documents(docs), "linked")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    kept = linked.where(F.col("group").isNotNull()).groupBy("group").agg(first).select("first.doc_id", "first.h")
    empty = linked.where(F.col("group").isNull()).select("doc_id", "h").distinct()
    return one_each(docs, kept.unionByName(empty))


def one_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen rows; of rows that share id and text, one."""
    h = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h")
    twice = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h).groupBy("doc_id", "h").agg(F.count("*").alias("c"))
    if twice.where(F.col("c") > 1).isEmpty():
        return rows_of(docs, chosen)
    return rows_of(docs, chosen).dropDuplicates(["doc_id", "text"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for words taken once or more and another for those taken twice.

    Documents without words, or of which nothing is taken, have no row; a null source is a source; ``n_chars`` is that
    of the new text, all other columns stay as they are.
    """
    taken = mix(docs).where(F.col("taken") > 0).select("doc_id", "h", F.col("blocks").alias("taken_blocks"))
    rows = chosen_rows(docs, taken.dropDuplicates(["doc_id", "h"]))
    names, kinds = docs.columns, docs.dtypes
    word = re.compile(WORD.replace(r"\x20", " "))

    def cut(text: str, blocks: list[dict], times: int) -> str | None:
        runs: list[list[int]] = []
        for b in blocks:
            if b["times"] >= times:
                if runs and runs[-1][1] == b["from"]:
                    runs[-1][1] = b["until"]
                else:
                    runs.append([b["from"], b["until"]])
        if not runs:
            return None
        spans = [m.span() for m in word.finditer(text)]
        if runs == [[0, len(spans)]]:
            return text
        return "\n".join(text[spans[lo][0] : spans[hi - 1][1]] for lo, hi in runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, row = [], [], dict(zip(names, batch.column("row").flatten()))
            for k, (text, blocks) in enumerate(zip(row["text"].to_pylist(), batch.column("taken_blocks").to_pylist())):
                for times in range(1, 1 + max(b["times"] for b in blocks)):
                    part = cut(text, blocks, times)
                    if part is not None:
                        at.append(k)
                        out.append(part)
            take = pa.array(at, pa.int64())
            made = {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else row[n].take(take) for n in names], names=names)

    return rows.mapInArrow(run, ", ".join(f"`{n}` {'long' if n == 'n_chars' else 'string' if n == 'text' else k}" for n, k in kinds))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of at most 1024 ids, with its sequence and place; an empty text is one piece."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix_sources), ("pack", pack_sequences)]

#: The classifier and the mix are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
