"""Repeated passages by compressed FM-indexes, and their removal.

A window is ``window`` consecutive words of one text; it is repeated if its word
sequence also starts anywhere else.

1. A window's anchors are the leftmost smallest of the ``anchor``-word grams in it by
   two hashes, so equal windows have equal anchors in equal places.  The windows of a
   text that share both anchors are consecutive; their words are a segment.  Two
   anchors keep a very common line from gathering all texts: it rarely gives both.
2. Segments whose anchors no other segment has hold no repeated window.  The others are
   told apart by content (96 bits); the first place of each content leads, with its number.
3. The distinct segments of equal anchors are dealt to shards as texts; where they are
   more than ``BLOCK``, they are cut into blocks, and every two blocks meet in a shard.
   A shard joins its segments (those that occur more than once, twice) to one sequence
   of word numbers, builds the FM-index of it (Burrows-Wheeler transform in a wavelet
   matrix with rank directories), and streams the segments through it: backward search
   from the end of a stretch as far as the words occur a second time gives the matching
   statistic.  A whole segment is searched at once: if the search fails at a word, all
   windows behind that are repeated.  Then it is gone through from its first window: one
   that fails rules out all windows that hold the failed words; behind one that is
   matched, the rest is searched at once again.
4. Repeated intervals go to all texts that hold the segment; the words they cover are removed.
5. Texts are shuffled only where a segment's words are wanted of them, or where words go:
   a bitmap of these texts' hashes leaves out all others but a few beforehand.

Cases: null text has no words; texts shorter than a window keep all words; rows with a
null or repeated ``doc_id`` are texts of their own (a text given twice is repeated); an
empty table gives no rows; very long texts are judged whole; other columns are ignored.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import keep, release, texts
from .tokens import slices
from .words import Words, mixed, numbered

#: Words in a shard, about.
SHARD = 500_000
#: Segments of equal anchors that stay together.
BLOCK = 8192
#: Bits of a bitmap for each text in it, and in all at most (16 MB); a fuller one only leaves out fewer texts.
BITS, MOST_BITS = 16, 1 << 27
#: Bits that Spark's bitmap functions put into one row.
ROW_BITS = 1 << 15
TEXT = ["d", "h"]  # what tells rows apart
KEY = ["a", "c1", "c2"]  # anchors and content of a segment
KEY_TYPE = "a long, c1 long, c2 int"
KEY_FIELDS = [("a", pa.int64()), ("c1", pa.int64()), ("c2", pa.int32())]
SEGMENT = f"d long, h long, {KEY_TYPE}, first int, n int, copies int, spread int"


class FMIndex:
    """Counts of word sequences in a text of small whole numbers, by backward search."""

    def __init__(self, text: np.ndarray, longest: int):
        """``text`` ends with its only 0; other numbers are 1 and above.  Sequences of up to ``longest`` words can be counted."""
        suffixes = suffix_order(text, longest)
        bwt = text[suffixes - 1]
        self.n = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.levels = max(1, int(text.max()).bit_length())
        # Of each plane, the inverted words and the words themselves, and where the zeros or ones before a word lead.
        self.planes, self.places = [], []
        rows = bwt
        for level in range(self.levels - 1, -1, -1):
            one = (rows >> level & 1).astype(bool)
            words = np.zeros(len(one) // 64 + 1, np.uint64)
            packed = np.packbits(one, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
            zeros = int(len(one) - np.count_nonzero(one))
            self.planes.append(np.concatenate([~words, words]))
            self.places.append(np.concatenate([np.arange(len(words)) * 64 - ones, zeros + ones]))
            rows = np.concatenate([rows[~one], rows[one]])
        # From where the planes lead to a word's suffixes.
        every = np.arange(int(text.max()) + 1)
        self.shift = self.before[every] - self.down(np.zeros(len(every), np.int64), every)

    def down(self, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where places of the transform go when the planes are followed for a word."""
        half = len(self.planes[0]) // 2
        for level, (plane, places) in enumerate(zip(self.planes, self.places)):
            block = (at >> 6) + (word >> (self.levels - 1 - level) & 1) * half
            inside = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            at = places[block] + np.bitwise_count(plane[block] & inside)
        return at

    def extend(self, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of ``word`` put before what the intervals stand for."""
        both = self.down(np.concatenate([lo, hi]), np.concatenate([word, word]))
        shift = self.shift[word]
        return shift + both[: len(lo)], shift + both[len(lo) :]


def suffix_order(text: np.ndarray, enough: int) -> np.ndarray:
    """Suffixes in the order of their first ``enough`` words at least, by doubling the length that ranks compare.

    Backward search for as many words needs no finer order: suffixes that share them are in one interval anyhow.
    """
    n = len(text)
    # As many words as fit a number make the first rank.
    bits = max(1, int(text.max()).bit_length())
    rank, k = text.astype(np.int64), 1
    while bits * (k + 1) <= 62 and k < enough:
        rank = rank << bits
        rank[: n - k] |= text[k:]
        k += 1
    _, rank = np.unique(rank, return_inverse=True)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair)
        ordered = pair[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        k *= 2
        if fresh[-1] == n - 1 or k >= enough:
            return order


def repeated_windows(words: np.ndarray, edges: np.ndarray, twice: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that occur twice in segments of word numbers: the segment, and the first words of the first and last window.

    Segment k is ``words[edges[k] : edges[k + 1]]``; those in ``twice`` occur more than once.
    """
    size = np.diff(edges)
    # A 1 after each segment; no window holds it.
    joined = np.concatenate([np.arange(len(size)), np.flatnonzero(twice)])
    length = size[joined]
    text = np.ones(int(length.sum()) + len(joined) + 1, np.int64)
    starts = np.cumsum(length + 1) - (length + 1)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    text[np.repeat(starts, length) + inside] = words[np.repeat(edges[joined], length) + inside].astype(np.int64) + 2
    text[-1] = 0
    index = FMIndex(text, int(size.max(initial=1)))

    def unmatched(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of stretches of ``text``, how many words are left when the search from their end has them no second time."""
        lo, hi, left = np.zeros(len(begin), np.int64), np.full(len(begin), index.n), length.copy()
        open_ = np.flatnonzero(left > 0)
        again = np.ones(len(begin), bool)
        while len(open_):
            lo[open_], hi[open_] = index.extend(lo[open_], hi[open_], text[begin[open_] + left[open_] - 1])
            left[open_] -= 1
            again[open_] = hi[open_] - lo[open_] >= 2
            open_ = open_[again[open_] & (left[open_] > 0)]
        return np.where(again, 0, left + 1)

    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * 3]
    seg = np.flatnonzero(size >= window)
    b = size[seg] - window  # windows from a to b are not yet judged
    fails = unmatched(starts[seg], size[seg]) - 1
    behind = fails < b
    found.append([seg[behind], fails[behind] + 1, b[behind]])
    seg, b = seg[fails >= 0], np.minimum(fails, b - 1)[fails >= 0]
    seg, b = seg[b >= 0], b[b >= 0]
    a = np.zeros(len(seg), np.int64)
    while len(seg):
        left = unmatched(starts[seg] + a, np.full(len(seg), window))
        yes = left == 0
        rest = np.zeros(len(seg), np.int64)
        rest[yes] = unmatched(starts[seg[yes]] + a[yes], b[yes] - a[yes] + window)
        fails = a + rest - 1
        found.append([seg[yes], a[yes], np.where(rest[yes] == 0, b[yes], a[yes])])
        behind = yes & (rest > 0) & (fails < b)
        found.append([seg[behind], fails[behind] + 1, b[behind]])
        b = np.where(yes, np.where(rest == 0, -1, np.minimum(fails, b - 1)), b)
        a = np.where(yes, a + 1, a + left)
        more = a <= b
        seg, a, b = seg[more], a[more], b[more]
    which, first, last = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((first, which))
    return which[order], first[order], last[order]


def anchors(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` hashes the place of the leftmost smallest, by doubling."""
    best, width = np.arange(len(hashes)), 1
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best, width = np.where(hashes[a] <= hashes[b], a, b), width + step
    return best


class Stretches:
    """Hashes of stretches of words, from sums of the words' bits times powers of an odd ``base``."""

    def __init__(self, bits: np.ndarray, base: int):
        mask = (1 << 64) - 1
        up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(bits), b, np.uint64)])) for b in (base, pow(base, -1, mask + 1)))
        self.sums, self.down = np.concatenate([[np.uint64(0)], np.cumsum(bits * up[:-1])]), down

    def __call__(self, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self.sums[begin + length] - self.sums[begin]) * self.down[begin] + np.asarray(length).astype(np.uint64))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and what tells rows apart: ``d`` and ``h`` are never null, so that one shuffle serves grouping and joins."""
    rows = texts(docs)
    return rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("d"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h"), "text")


def bitmap(chosen: DataFrame) -> tuple[DataFrame, int]:
    """A bitmap of the texts in ``chosen``: rows of ``ROW_BITS`` bits (``bits``) by number (``bucket``), and how many rows there may be."""
    n = chosen.agg(F.approx_count_distinct(F.xxhash64(*TEXT))).first()[0]
    rows = max(1, min(MOST_BITS, BITS * n) // ROW_BITS)
    at = slot(rows)
    return chosen.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")), rows


def slot(rows: int) -> Column:
    """A text's bit in a bitmap of so many rows."""
    return F.pmod(F.xxhash64(*TEXT), F.lit(rows * ROW_BITS)) + 1


def marked(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: true for the texts of ``chosen`` (and a few others), else false."""
    bits, n = bitmap(chosen)
    rows = rows.withColumn("at", slot(n)).withColumn("bucket", F.bitmap_bucket_number("at")).withColumn("place", F.bitmap_bit_position("at"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, (F.col("place") % 8).cast("int")), F.lit(0)) == 1
    return rows.join(F.broadcast(bits), "bucket", "left").withColumn("maybe", maybe).drop("at", "bucket", "place", "bits")


def copies_of(a: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
    """For one row of equal keys their number, for the others 0."""
    copies = np.ones(len(c1), np.int64)
    order = np.argsort(c1)
    same = c1[order[1:]] == c1[order[:-1]]
    rows = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    number, first = numbered(numbered(a[rows], c1[rows])[0], c2[rows])
    copies[rows] = 0
    copies[rows[first]] = np.bincount(number)[: len(first)]
    return copies


def segments_of(docs: DataFrame, window: int, anchor: int, base: int) -> DataFrame:
    """Segments of all texts: a hash of their anchors, 96 bits of their content, first word and length.

    Of equal segments in a batch one stands for all: it has their number in ``copies``, the others have 0 there and a number
    in ``spread`` by which they are dealt, so that what occurs all over does not meet in one task.
    """
    out = pa.schema([("d", pa.int64()), ("h", pa.int64()), *KEY_FIELDS, *[(x, pa.int32()) for x in ("first", "n", "copies", "spread")]])
    span = window - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"), False, base)
            edges, count = words.edges, np.diff(words.edges)
            if not (count >= window).any():
                continue
            one, two = Stretches(words.hashes, base), Stretches(words.others, base)
            grams = one(np.arange(len(words.hashes) - anchor + 1), anchor)
            doc = np.repeat(np.arange(len(count)), count)
            first = np.arange(len(words.hashes)) - edges[doc]
            real = np.flatnonzero(first + window <= count[doc])
            own, left, right = doc[real], anchors(grams, span)[real], anchors(mixed(grams, 7), span)[real]
            new = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (own[1:] != own[:-1])])
            begin = real[new]
            length = np.diff(np.append(np.flatnonzero(new), len(real))) + window - 1
            d = doc[begin]
            at = pa.array(d)
            keys = [mixed(grams[left[new]] ^ mixed(grams[right[new]], 3)), one(begin, length), two(begin, length)]
            keys = [k.view(np.int64).astype(t.to_pandas_dtype()) for k, (_, t) in zip(keys, KEY_FIELDS)]
            copies = copies_of(*keys)
            spread = np.where(copies > 0, 0, 1 + np.arange(len(copies)) % 65536)
            numbers = [(begin - edges[d]), length, copies, spread]
            yield pa.RecordBatch.from_arrays([batch.column("d").take(at), batch.column("h").take(at), *map(pa.array, keys), *[pa.array(x.astype(np.int32)) for x in numbers]], schema=out)

    return keyed(docs).select(*TEXT, "text").mapInArrow(run, SEGMENT)


def with_words(docs: DataFrame, places: DataFrame, leads: DataFrame) -> DataFrame:
    """``places`` (texts' segments, ``leads`` without repeats) with their ``words`` as text."""
    names = [n for n in places.columns if n not in TEXT]
    kinds = dict(places.dtypes)
    by_text = places.groupBy(*TEXT).agg(F.collect_list(F.struct(*names)).alias("at"))
    rows = marked(keyed(docs), leads).where("maybe").select(*TEXT, "text").dropDuplicates(TEXT).join(by_text, TEXT).select("at", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.column("at")
            size = np.diff(at.offsets.to_numpy())
            flat = at.flatten()
            first, n = flat.field("first").to_numpy(), flat.field("n").to_numpy()
            raw, lo = [], 0
            for text, k in zip(batch.column("text").cast(pa.binary()).to_pylist(), size.tolist()):
                words = text.split()
                raw += [b" ".join(words[a : a + m]) for a, m in zip(first[lo : lo + k].tolist(), n[lo : lo + k].tolist())]
                lo += k
            for a in range(0, len(raw), 8192):
                part = flat.slice(a, 8192)
                yield pa.RecordBatch.from_arrays([*[part.field(x) for x in names], pa.array(raw[a : a + 8192], pa.binary())], names=[*names, "words"])

    return rows.mapInArrow(run, ", ".join([*[f"{n} {kinds[n]}" for n in names], "words binary"]))


def search_shards(segments: DataFrame, window: int) -> DataFrame:
    """Intervals of repeated windows in distinct segments, by an FM-index for each ``shard``."""
    out = pa.schema([*KEY_FIELDS, ("lo", pa.int32()), ("hi", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        # A segment that meets several blocks in this shard is in it once.
        keys = [table.column(k).to_numpy() for k in KEY]
        order = np.lexsort(keys)
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
        table = (table if new.all() else table.take(pa.array(np.sort(order[new])))).combine_chunks()
        words = Words(table.column("words").combine_chunks(), lower=False)
        numbers, _ = numbered(words.hashes, words.others)
        which, first, last = repeated_windows(numbers, words.edges, table.column("times").to_numpy() > 1, window)
        at = pa.array(which)
        release()
        return pa.Table.from_arrays([*[table.column(k).take(at) for k in KEY], pa.array(first.astype(np.int32)), pa.array((last + window).astype(np.int32))], schema=out)

    return segments.groupBy("shard").applyInArrow(run, f"{KEY_TYPE}, lo int, hi int")


def repeated_intervals(docs: DataFrame, window: int = 35, anchor: int = 8, block: int = BLOCK) -> DataFrame:
    """Per text (``d``, ``h``) the intervals of words (``lo``, ``hi``) that repeated windows cover; they may overlap."""
    # What the hashes of stretches are taken with is drawn anew each time, so nobody can prepare texts for it; the result does not depend on it.
    base = secrets.randbits(64) | 1
    same_anchors, same = W.partitionBy("a", "spread"), W.partitionBy("spread", *KEY)
    # One shuffle, by anchors, serves all of this; segments that others stand for are known to be shared.
    shared = segments_of(docs, window, anchor, base).withColumn("c", F.sum("copies").over(same_anchors)).where((F.col("c") > 1) | (F.col("copies") == 0)).drop("c")
    first = F.row_number().over(same.orderBy(*TEXT, "first")) == 1
    shared = shared.withColumn("lead", first & (F.col("copies") > 0)).withColumn("times", F.sum("copies").over(same))
    shared = shared.withColumn("kinds", F.count_if("lead").over(same_anchors))
    # Of each content the first segment leads: only it has its number (2 stands for more) and that of the blocks of its anchors.
    times, blocks = F.least("times", F.lit(2)), F.expr(f"(kinds - 1) div {block} + 1")
    shared = keep(shared.select(*TEXT, *KEY, "first", "n", *[F.when(F.col("lead"), x).otherwise(0).cast("int").alias(y) for x, y in ((times, "times"), (blocks, "blocks"))]), "segments")
    leads = shared.where(F.col("times") > 0)
    # Segments of equal anchors are in one block, or every two blocks of them meet.
    mine = F.pmod(F.xxhash64("c1", "c2"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: (b != mine) | (F.col("blocks") == 1))
    places = leads.select(*TEXT, "first", "n", *KEY, "times", F.explode(others).alias("other"), mine.alias("mine"))
    meets = F.xxhash64("a", F.least("mine", "other"), F.greatest("mine", "other"))
    size = leads.agg(F.sum("n")).first()[0] or 0
    shard = F.pmod(meets, F.lit(-(-size // SHARD) or 1)).cast("int").alias("shard")
    found = keep(search_shards(with_words(docs, places.select(*TEXT, "first", "n", *KEY, "times", shard), leads), window), "found")
    return shared.select(*TEXT, *KEY, "first").join(found.distinct(), KEY).select(*TEXT, (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))


def remove_repeats(docs: DataFrame, window: int = 35, anchor: int = 8, block: int = BLOCK) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by one space)."""
    hits = keep(repeated_intervals(docs, window, anchor, block), "hits")
    cuts = hits.groupBy(*TEXT).agg(F.collect_set(F.struct("lo", "hi")).alias("cuts"))
    rows = marked(keyed(docs), hits)
    cut = rows.where("maybe").join(cuts, TEXT, "left").select("doc_id", "text", "cuts")
    rows = cut.union(rows.where(~F.col("maybe")).select("doc_id", "text", F.lit(None).cast(cut.schema["cuts"].dataType)))
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, gone, kept = [], [], []
            for text, cuts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("cuts").to_pylist()):
                words = text.split()
                left = words
                if cuts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [c["lo"] for c in cuts], 1)
                    np.add.at(edge, [c["hi"] for c in cuts], -1)
                    left = [w for w, covered in zip(words, np.cumsum(edge).tolist()) if not covered]
                total.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=out)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")
