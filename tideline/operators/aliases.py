"""Alias dictionary and the scan of texts for its entries.

Each market has a dictionary of its own and so an automaton of its own (Aho-Corasick): one
pass over a text finds all its forms, of which the leftmost-longest stay, so a form of one
market neither hides nor credits one of another.  What is found is joined back to the
dictionary by market and form.

Tasks build the automata from the dictionary's forms, which are broadcast, up to ``PART_BYTES``.
A greater dictionary stays where it is (``scan_joined``, ``hits_joined``): texts give the places at which a form may
begin, found by a filter of at most ``FILTER_BITS`` bits, with the longest that may stand there.  A place is shuffled once, to
the forms that share its beginning, where the longest form of each market is looked up.  Places that overlap
no other need not come back to their texts: their hits are made where the forms are.
"""

from __future__ import annotations

import bisect
import functools
import io
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring as S
from ..functions.constants import MIN_ALIGNMENT
from ..functions.text import compact_alias, normalize_text
from .tables import written

#: Bytes of forms in a part of the dictionary; an automaton takes some fifty times as much.
PART_BYTES = 4 << 20
#: Bytes of texts that go to Python at once, about: a worker's memory depends on this and on its longest text, not on the table.
BATCH = "4m"
#: If the dictionary is greater: forms too short for a beginning, which are broadcast; entries that share one, which a task holds; bits of the filter; characters of texts that are hashed at once.
BEGINNINGS, SHARED, FILTER_BITS, HASHED = 100_000, 100_000, 1 << 28, 1 << 20
#: Aliases of these characters have to stand between characters that are no letters or digits.
LATIN = "^[A-Za-z0-9 .&_-]+$"


def derive_aliases(companies: DataFrame) -> DataFrame:
    """All aliases of companies; of equal compact forms of a company the first kind listed counts.

    ``companies`` has ``market``, ``ticker``, ``company_name``, ``query_name``, ``raw_code``, ``aliases`` (delimited text)
    and the membership ``valid_from``, ``valid_to``.
    """
    name, short = normalize_text(F.col("company_name")), S.without_suffix(F.col("company_name"))
    kind = lambda a, k: F.array(F.struct(a.alias("alias"), k.alias("kind")))
    typed = lambda a: S.alias_type(a, F.col("company_name"), F.col("ticker"), F.coalesce("raw_code", F.lit("")))
    share = F.when(F.lower(name).endswith("a") & (F.char_length(name) > 2), F.left(name, F.char_length(name) - 1))
    listed = F.concat(
        kind(name, F.lit("legal_or_stock_name")),
        kind(short, F.lit("short_name")),
        kind(normalize_text(F.col("query_name")), typed(normalize_text(F.col("query_name")))),
        F.transform(S.alias_values(F.col("aliases")), lambda a: F.struct(a.alias("alias"), F.lit("manual_alias").alias("kind"))),
        kind(F.col("ticker"), F.lit("ticker")),
        kind(F.coalesce("raw_code", F.lit("")), F.lit("ticker")),
        kind(share, F.lit("short_name")),
    )
    rows = companies.select("market", "ticker", "valid_from", "valid_to", F.posexplode(listed).alias("pos", "a")).select("*", "a.alias", F.col("a.kind").alias("alias_type")).drop("a")
    rows = rows.where(F.col("alias").isNotNull()).withColumn("compact", compact_alias(F.col("alias"))).where(S.usable_alias(F.col("compact")))
    first = W.partitionBy("market", "ticker", "compact").orderBy("pos")
    rows = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1)
    return rows.select("market", "ticker", "alias", "compact", "alias_type", S.alias_confidence(F.col("compact"), F.col("alias_type")).alias("confidence"), "valid_from", "valid_to")


def override(derived: DataFrame, explicit: DataFrame) -> DataFrame:
    """Explicit aliases in place of derived ones of the same company and compact form."""
    return derived.join(explicit.select("market", "ticker", "compact"), ["market", "ticker", "compact"], "left_anti").unionByName(explicit)


def best_per_alias(aliases: DataFrame) -> DataFrame:
    """Of equal compact forms of a company the one with the highest confidence, then the first by name."""
    order = W.partitionBy("market", "ticker", "compact").orderBy(F.desc("confidence"), "alias")
    return aliases.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def dictionary_forms(aliases: DataFrame) -> DataFrame:
    latin = F.when(F.col("alias").rlike(LATIN), F.col("alias"))
    return aliases.where(F.col("compact") != "").select("market", "compact", latin.alias("latin")).distinct()


def form_bytes(forms: DataFrame) -> int:
    return forms.agg(F.sum(F.octet_length("compact") + F.coalesce(F.octet_length("latin"), F.lit(0)))).first()[0] or 0


def is_large(aliases: DataFrame) -> bool:
    """Equal forms count once; they are told apart only if all together are many."""
    rows = aliases.select("market", "compact", F.when(F.col("alias").rlike(LATIN), F.col("alias")).alias("latin"))
    return form_bytes(rows) >= PART_BYTES and form_bytes(dictionary_forms(aliases)) >= PART_BYTES


def dictionary_parts(aliases: DataFrame) -> list[Broadcast]:
    """Forms and Latin aliases by market, in parts that are bounded in bytes; each is collected on its own."""
    forms = dictionary_forms(aliases)
    n = form_bytes(forms) // PART_BYTES + 1
    context, out = aliases.sparkSession.sparkContext, []
    for k in range(n):
        part = forms.where(F.pmod(F.xxhash64("market", "compact"), F.lit(n)) == k).toArrow()
        buffer = io.BytesIO()
        with pa.ipc.new_stream(buffer, part.schema) as writer:
            writer.write_table(part)
        out.append(context.broadcast(buffer.getvalue()))
    return out


class Forms:
    """A part's automaton for each market, and the Latin aliases of its forms in lower case."""

    def __init__(self, raw: bytes):
        self.automata: dict[str | None, ahocorasick.Automaton] = {}
        self.latin: dict[tuple[str | None, str], list[str]] = {}
        with pa.ipc.open_stream(raw) as reader:
            for batch in reader:
                for market, form, latin in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                    self.automata.setdefault(market, ahocorasick.Automaton()).add_word(form, len(form))
                    if latin is not None:
                        self.latin.setdefault((market, form), []).append(latin)
        for a in self.automata.values():
            a.make_automaton()


@functools.lru_cache(maxsize=2)
def part_forms(part: Broadcast) -> Forms:
    """One for each worker process and part."""
    return Forms(part.value)


def leftmost_longest(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of matches (start, length) those that a scan from left to right takes, the longest at each place."""
    out, free = [], 0
    for start, negative in sorted((s, -n) for s, n in found):
        if start >= free:
            out.append((start, -negative))
            free = start - negative
    return out


def stands_free(text: str, alias: str) -> bool:
    """Whether the alias stands in the text between characters that are no ASCII letters or digits; both in lower case."""
    at = text.find(alias)
    while at >= 0:
        before, after = text[at - 1 : at], text[at + len(alias) : at + len(alias) + 1]
        if not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum()):
            return True
        at = text.find(alias, at + 1)
    return False


def found_in(batches: Iterator[pa.RecordBatch], forms: Forms, own: bool) -> Iterator[pa.RecordBatch]:
    """The forms in each text; the places where they stand are held for one text at a time."""
    for batch in batches:
        column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        at, out = [], {"market": [], "location": [], "compact": [], "free": []}
        for row in range(batch.num_rows):
            markets = forms.automata if not own else {column["market"][row].as_py()} & forms.automata.keys()
            for location in ("title", "content"):
                text, lower = column[f"{location}_flat"][row].as_py(), None
                for market in markets if text else ():
                    spots = [(end + 1 - n, n) for end, n in forms.automata[market].iter(text)]
                    for form in dict.fromkeys(text[s : s + n] for s, n in leftmost_longest(spots)):
                        latin = forms.latin.get((market, form), ())
                        if latin and lower is None:
                            lower = column[location][row].as_py().lower()
                        at.append(row)
                        for name, value in (("market", market), ("location", location), ("compact", form), ("free", [a for a in latin if stands_free(lower, a.lower())])):
                            out[name].append(value)
        take = pa.array(at, pa.int64())
        made = [pa.array(out["market"], pa.string()), pa.array(out["location"], pa.string()), pa.array(out["compact"], pa.string()), pa.array(out["free"], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *made], names=["id", "day", *out])


def scan(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per form found in a place: the texts' ``id`` and ``day``, ``market``, ``location``, ``compact``, ``free`` (its Latin aliases that stand between other characters).

    ``texts`` has ``id``, ``day``, ``title``, ``content``; with a ``market`` too, a text is scanned for that market only.
    """
    if is_large(aliases):
        return scan_joined(texts, aliases)
    (part,) = dictionary_parts(aliases)  # it is smaller than a part
    own = "market" in texts.columns
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    keys = ["id", "day", *(["market"] if own else [])]
    raw = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "content")]
    flat = [compact_alias(F.coalesce(F.col(c), F.lit(""))).alias(f"{c}_flat") for c in ("title", "content")]
    rows = texts.select(*keys, *raw, *flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return found_in(batches, part_forms(part), own)

    kinds = dict(texts.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, day {kinds['day']}, market string, location string, compact string, free array<string>")


class Hashes:
    """Hashes of all stretches of a text in constant time each; a filter's false hits are told by the forms, so 64 bits will do."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        powers = np.cumprod(np.full(len(codes), self.BASE, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers)])
        self.back = np.cumprod(np.full(len(codes) + 1, self.INVERSE, np.uint64))

    def of(self, start: np.ndarray, n: int | np.ndarray, salt: int = 0) -> np.ndarray:
        h = (self.sums[start + n] - self.sums[start]) * self.back[start] + np.uint64(salt)
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(32))


PROBES = 3


def probe(h: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The ``k``-th of a hash's bits in the filter."""
    return ((h + np.uint64(k) * ((h >> np.uint64(33)) | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def holds(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of the hashes that the filter may hold."""
    out = np.arange(len(h))
    for k in range(PROBES):
        at = probe(h[out], k, len(filter_) * 8)
        out = out[(filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
    return out


def form_filter(words: DataFrame, least: int, k: int, n: int) -> np.ndarray:
    """Bits for each form and, salted, for its first ``least`` and ``k`` characters, brought together in words by Spark."""
    bits = min(max(1 << (16 * n).bit_length(), 64), FILTER_BITS)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column(0).to_pylist()
            size = np.array([len(f) for f in forms], np.int64)
            start, hashes = np.cumsum(size) - size, Hashes("".join(forms))
            long = start[size >= k]
            all_ = [hashes.of(start, size), hashes.of(start, np.full(len(start), least), 1), hashes.of(long, np.full(len(long), k), 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([probe(h, j, bits) for h in all_ for j in range(PROBES)])))], names=["at"])

    at = words.select("compact").mapInArrow(placed, "at long")
    set_ = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[set_.column("w").to_numpy()] = set_.column("v").to_numpy()
    return out.view(np.uint8)


class Plan:
    """What tasks know of a great dictionary: the characters ``k`` of a beginning, the lengths of forms, a filter, and the forms shorter than ``k``."""

    def __init__(self, words: DataFrame):
        sizes = sorted((r["n"], r["rows"]) for r in words.groupBy(F.char_length("compact").alias("n")).agg(F.count("*").alias("rows")).collect())
        self.lengths = [n for n, _ in sizes]
        shared = lambda k: words.groupBy(F.left("compact", F.lit(k))).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        least = self.k = self.lengths[0] if sizes else 1
        while sizes and self.k < self.lengths[-1] and sum(m for n, m in sizes if n <= self.k) <= BEGINNINGS and shared(self.k) > SHARED:
            self.k += 1
        self.least = least
        self.filter = form_filter(words, least, self.k, sum(m for _, m in sizes))
        self.short: dict[str, dict[str | None, list[str]]] = {}
        for r in words.where(F.char_length("compact") < self.k).groupBy("compact", "market").agg(F.collect_set("entry._latin").alias("latin")).collect():
            self.short.setdefault(r["compact"], {})[r["market"]] = r["latin"]

    def places(self, text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the joined texts (which end at ``ends``) where a form may begin, the longest it may be, and whether it overlaps no other."""
        hashes = Hashes(text)
        room = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(text))
        at = np.flatnonzero(room >= self.least)
        at = at[holds(self.filter, hashes.of(at, self.least, 1))]
        long = at[room[at] >= self.k]
        long = long[holds(self.filter, hashes.of(long, self.k, 1))]
        n = np.zeros(len(text), np.int64)
        for m in reversed(self.lengths):
            some = long if m >= self.k else at
            some = some[(n[some] == 0) & (room[some] >= m)]
            n[some[holds(self.filter, hashes.of(some, m))]] = m
        at = np.flatnonzero(n)
        n = n[at]
        reach = np.maximum.accumulate(at + n)
        alone = np.concatenate([[True], reach[:-1] <= at[1:]]) & np.concatenate([at[1:] >= reach[:-1], [True]]) if len(at) else np.zeros(0, bool)
        return at, n, alone


def runs_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.Table]:
    """Sorted rows in tables that part no rows of the same beginning, kind of place and id."""
    key = lambda t, r: (t.column("compact")[r].as_py()[:k], t.column("spot")[r].as_py(), t.column("id")[r].as_py())
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = key(batch, batch.num_rows - 1)
        cut = bisect.bisect_left(range(batch.num_rows), True, key=lambda r: key(batch, r) == last)  # equal keys are neighbours
        if not cut and kept and key(kept[-1], kept[-1].num_rows - 1) == last:
            kept.append(batch)
            continue
        if kept or cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
        kept = [batch.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept)


class Met(NamedTuple):
    """What the places with a text find: the longest form of each market, the entries that make hits on any day and whether they are ambiguous, and the markets and lengths left to the texts."""

    longest: tuple
    entries: tuple
    unclear: tuple
    rest: tuple
    dated: bool


class Lookup:
    """The entries of the forms that share a beginning, while places with it pass by."""

    def __init__(self, k: int, lengths: list[int], short: dict, own: bool):
        self.k, self.short, self.own = k, short, own
        self.long_lengths, self.short_lengths = [n for n in reversed(lengths) if n >= k], [n for n in reversed(lengths) if n < k]
        self.beginning, self.index, self.members = None, {}, []
        self.met: dict = {}  # places repeat
        self.store: pa.Table | None = None
        self.info: list[tuple] = []

    def entries(self, market: str | None, form: str) -> list[int]:
        return [e for e in self.index[form] if self.info[e][0] == market]

    def longest(self, form: str, market: str | None) -> dict[str | None, int]:
        """For each market the length of its longest form that the place begins with."""
        out: dict[str | None, int] = {}
        for n in self.long_lengths:
            for e in self.index.get(form[:n], ()) if n <= len(form) else ():
                out.setdefault(self.info[e][0], n)
        for n in self.short_lengths:
            for m in self.short.get(form[:n], ()) if n <= len(form) else ():
                out.setdefault(m, n)
        return out if not self.own else {m: n for m, n in out.items() if m == market}

    def of(self, form: str, market: str | None) -> Met:
        key = (form, market) if self.own else form
        out = self.met.get(key)
        if out is None:
            longest, entries, unclear, rest, dated = self.longest(form, market), [], [], [], False
            for m, n in longest.items():
                if n < self.k or self.latin(m, form[:n]):
                    rest.append((m, n))
                elif m is not None:
                    first = {}
                    for e in self.entries(m, form[:n]):
                        _, ticker, begins, ends, _ = self.info[e]
                        first.setdefault(ticker, e)
                        dated |= begins is not None or ends is not None
                    entries += first.values()
                    unclear += [len(first.keys() - {None}) > 1] * len(first)
            if len(self.met) >= SHARED:
                self.met.clear()
            out = self.met[key] = Met(tuple(longest.items()), tuple(entries), tuple(unclear), tuple(rest), dated)
        return out

    def latin(self, market: str | None, form: str) -> list[str]:
        if len(form) < self.k:
            return self.short[form][market]
        return sorted({self.info[e][4] for e in self.entries(market, form)} - {None})

    def tables(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Table, Iterator[tuple[int, int]]]]:
        """Places by column (what is not looked at as it came), the entries at hand, and from where to where the places of an id go."""
        for t in runs_of(batches, self.k):
            t = t.combine_chunks()
            column = {c: t.column(c).combine_chunks() for c in t.column_names}
            rows = column | {c: column[c].to_pylist() if column[c].null_count < t.num_rows else [None] * t.num_rows for c in ("compact", "market", "start")}
            spots = column["spot"].to_pylist()
            entries, offset = t.select(["market", "compact", "entry"]), 0
            if 0 in spots:
                offset = 0 if self.store is None else self.store.num_rows
                self.store = entries if self.store is None else pa.concat_tables([self.store, entries])
                self.info += zip(column["market"].to_pylist(), *[pa.compute.struct_field(column["entry"], c).to_pylist() for c in ("ticker", "valid_from", "valid_to", "_latin")])
            yield rows, self.store if self.store is not None else entries.slice(0, 0), self.runs(rows["compact"], column["id"].to_pylist(), spots, offset)
            if 0 in spots:  # only the entries of the beginning that goes on are kept
                self.store, self.info = self.store.take(pa.array(self.members, pa.int64())).combine_chunks(), [self.info[e] for e in self.members]
                new = {e: j for j, e in enumerate(self.members)}
                self.index = {f: [new[e] for e in es] for f, es in self.index.items()}
                self.members, self.met = list(range(len(self.members))), {}

    def runs(self, forms: list, ids: list, spots: list, offset: int) -> Iterator[tuple[int, int]]:
        r, total, k = 0, len(forms), self.k
        while r < total:
            b, spot, id_ = forms[r][:k], spots[r], ids[r]
            if b != self.beginning:
                self.beginning, self.index, self.members, self.met = b, {}, [], {}
            if spot == 0:
                self.index.setdefault(forms[r], []).append(offset + r)
                self.members.append(offset + r)
                r += 1
                continue
            end = r + 1
            while end < total and ids[end] == id_ and spots[end] == spot and forms[end][:k] == b:
                end += 1
            yield r, end
            r = end


def crossing(look: Lookup, rows: dict, r: int, end: int) -> set:
    """Matches in an id's places that overlap others; all places of such a match are left to the texts."""
    return {(m, rows["compact"][q][:n]) for q in range(r, end) if rows["start"][q] is not None for m, n in look.of(rows["compact"][q], rows["market"][q]).longest}


def placed(texts: DataFrame, words: DataFrame, plan: Plan, keyed: bool) -> DataFrame:
    """Places of texts and the entries of ``words`` (``spot`` 0), dealt and sorted by beginnings, then kind of place and id.

    ``_text`` tells texts of equal ids apart; places that overlap no other have none, and no ``start``, unless ``keyed``.
    """
    own = "market" in texts.columns
    sent = texts.sparkSession.sparkContext.broadcast(plan)
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    spots = F.array(*[F.struct(F.lit(n).cast("byte").alias("spot"), compact_alias(F.coalesce(F.col(c), F.lit(""))).alias("flat")) for n, c in ((1, "title"), (2, "content"))])
    market = F.col("market") if own else F.lit(None).cast("string")
    flat = texts.select("id", "day", market.alias("market"), text_key().alias("_text"), F.explode(spots).alias("f")).select("id", "day", "market", "_text", "f.*").where(F.col("flat") != "")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        for batch in batches:
            flat, first = batch.column("flat").to_pylist(), 0
            while first < len(flat):
                last, size = first + 1, len(flat[first])
                while last < len(flat) and size + len(flat[last]) <= HASHED:
                    size += len(flat[last])
                    last += 1
                text, ends = "".join(flat[first:last]), np.cumsum([len(x) for x in flat[first:last]])
                at, n, alone = plan.places(text, ends)
                row = np.searchsorted(ends, at, side="right")
                forms = [text[a : a + m] for a, m in zip(at.tolist(), n.tolist())]
                once = list({(r, f, a if not o else -1): j for j, (r, f, a, o) in enumerate(zip(row.tolist(), forms, at.tolist(), alone.tolist()))}.values())
                row, gone = row[once], alone[once] & (not keyed)
                take, start = pa.array(row + first), (at - np.concatenate([[0], ends[:-1]])[np.searchsorted(ends, at, side="right")])[once]
                key = pa.compute.if_else(pa.array(gone), pa.scalar(None, pa.int64()), batch.column("_text").take(take))
                made = [pa.array([forms[j] for j in once], pa.string()), *[batch.column(c).take(take) for c in ("market", "spot", "id", "day")], key, pa.array(start.astype(np.int32), pa.int32(), mask=alone[once])]
                yield pa.RecordBatch.from_arrays(made, names=["compact", "market", "spot", "id", "day", "_text", "start"])
                first = last

    kinds = dict(texts.dtypes)
    places = flat.mapInArrow(found, f"compact string, market string, spot byte, id {kinds['id']}, day {kinds['day']}, _text long, start int")
    null = lambda c: F.lit(None).cast(places.schema[c].dataType).alias(c)
    known = words.where(F.char_length("compact") >= plan.k).select("compact", "market", F.lit(0).cast("byte").alias("spot"), *[null(c) for c in ("id", "day", "_text", "start")], "entry")
    both = places.withColumn("entry", F.lit(None).cast(words.schema["entry"].dataType)).unionByName(known)
    b = F.left("compact", F.lit(plan.k))
    return both.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), b).sortWithinPartitions(b, "spot", "id")


def text_key() -> Column:
    return F.xxhash64("title", "content")


def entry_table(aliases: DataFrame) -> DataFrame:
    """Forms and markets with all else that the dictionary holds; written, as it is read several times."""
    more = [c for c in aliases.columns if c not in ("market", "compact")]
    latin = F.when(F.col("alias").rlike(LATIN), F.col("alias")).alias("_latin")
    dated = [F.lit(None).cast("date").alias(c) for c in ("valid_from", "valid_to") if c not in more]
    return written(aliases.where(F.col("compact") != "").select("market", "compact", F.struct(*more, *dated, latin).alias("entry")), "aliases")


def location(spots: pa.Array) -> pa.Array:
    return pa.array(["title" if x == 1 else "content" for x in spots.to_pylist()], pa.string())


def whole(t: pa.Table, *columns: str) -> list[pa.Array]:
    return [t.column(c).combine_chunks() for c in columns]


def kept_matches(texts: DataFrame, sorted_places: DataFrame, plan: Plan, latin: bool, direct: bool) -> DataFrame:
    """``scan``'s rows; with ``direct`` without those that ``direct_hits`` makes into hits."""
    own = "market" in texts.columns
    kinds = dict(texts.dtypes)
    sent = texts.sparkSession.sparkContext.broadcast((plan.k, plan.lengths, plan.short))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(*sent.value, own)
        for rows, _, runs in look.tables(batches):
            forms, markets, starts = rows["compact"], rows["market"], rows["start"]
            at, out = [], {"market": [], "n": [], "compact": [], "latin": []}
            for r, end in runs:
                crossed = crossing(look, rows, r, end) if direct and (end > r + 1 or starts[r] is not None) else ()
                for q in range(r, end):
                    form = forms[q]
                    got = look.met.get(form) or look.of(form, markets[q])
                    for m, n in got.rest if direct and not crossed else got.longest:
                        if direct and crossed and starts[q] is None and (m, form[:n]) not in crossed and (m, n) not in got.rest:
                            continue
                        at.append(q)
                        for c, value in (("market", m), ("n", n), ("compact", form[:n]), ("latin", look.latin(m, form[:n]) if latin else [])):
                            out[c].append(value)
            take = pa.array(at, pa.int64())
            some = {c: rows[c].take(take) for c in ("id", "day", "_text")}
            made = [pa.array(out["market"], pa.string()), pa.array([starts[q] for q in at], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["compact"], pa.string()), pa.array(out["latin"], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*some.values(), location(rows["spot"].take(take)), *made], names=["id", "day", "_text", "location", "market", "start", "n", "compact", "latin"])

    found = sorted_places.mapInArrow(met, f"id {kinds['id']}, day {kinds['day']}, _text long, location string, market string, start int, n int, compact string, latin array<string>")
    spot = ["id", "day", "_text", "location", "market"]
    ordered = found.repartition(*spot).sortWithinPartitions(*spot, "start", F.desc("n"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, free, seen = None, 0, set()  # a text's matches may go on in the next batch
        for batch in batches:
            take = []
            spots = zip(*[batch.column(c).to_pylist() for c in spot])
            for r, (now, start, n, form) in enumerate(zip(spots, *[batch.column(c).to_pylist() for c in ("start", "n", "compact")])):
                if now != before:
                    before, free, seen = now, 0, set()
                if start is not None:  # one without a start overlaps no other
                    if start < free:
                        continue
                    free = start + n
                if form not in seen:
                    seen.add(form)
                    take.append(r)
            some = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column(c) for c in (*spot, "compact", "latin")], names=[*spot, "compact", "latin"])

    taken = ordered.mapInArrow(kept, f"id {kinds['id']}, day {kinds['day']}, _text long, location string, market string, compact string, latin array<string>")
    if not latin:
        return taken.select("id", "day", "market", "location", "compact", F.col("latin").alias("free"))
    free = standing(texts, taken.where(F.size("latin") > 0))
    return taken.where(F.size("latin") == 0).select("id", "day", "market", "location", "compact", F.col("latin").alias("free")).unionByName(free)


def standing(texts: DataFrame, taken: DataFrame) -> DataFrame:
    """Matches whose forms have Latin aliases, with those that stand free in the raw text; such texts are shuffled once."""
    kinds = dict(texts.dtypes)
    raw = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "content")]
    m = taken.groupBy("id", "day", "_text").agg(F.collect_set(F.struct("location", "market", "compact", "latin")).alias("m")).alias("m")
    t = texts.select("id", "day", text_key().alias("_text"), *raw).dropDuplicates(["id", "day", "_text"]).alias("t")
    met = m.join(t, [F.col("m._text") == F.col("t._text"), *[F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("id", "day")]]).select("t.id", "t.day", "t.title", "t.content", "m.m")

    def stand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], {"market": [], "location": [], "compact": [], "free": []}
            for r, (title, content, matches) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("title", "content", "m")])):
                lower = {"title": title.lower(), "content": content.lower()}
                for x in matches:
                    at.append(r)
                    for name in ("market", "location", "compact"):
                        out[name].append(x[name])
                    out["free"].append([a for a in x["latin"] if stands_free(lower[x["location"]], a.lower())])
            take = pa.array(at, pa.int64())
            made = [pa.array(out[c], pa.string()) for c in ("market", "location", "compact")] + [pa.array(out["free"], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("day").take(take), *made], names=["id", "day", *out])

    return met.mapInArrow(stand, f"id {kinds['id']}, day {kinds['day']}, market string, location string, compact string, free array<string>")


def direct_hits(texts: DataFrame, sorted_places: DataFrame, words: DataFrame, plan: Plan) -> DataFrame:
    """Hits of forms with a whole beginning, no Latin alias, and places that overlap no other, made where places and forms meet."""
    own = "market" in texts.columns
    kinds = {f.name: f.dataType for f in texts.schema}
    entry = words.schema["entry"].dataType
    sent = texts.sparkSession.sparkContext.broadcast((plan.k, plan.lengths, plan.short))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(*sent.value, own)
        for rows, store, runs in look.tables(batches):
            forms, markets, starts = rows["compact"], rows["market"], rows["start"]
            days = rows["day"].to_pylist() if rows["day"].null_count < len(forms) else [None] * len(forms)
            at, of, unclear = [], [], []
            for r, end in runs:
                each = [look.met.get(forms[q]) or look.of(forms[q], markets[q]) for q in range(r, end)]
                if starts[r:end].count(None) == end - r and not any(got.dated and days[q] is not None for q, got in enumerate(each, r)):
                    seen = set()
                    for q, got in enumerate(each, r):
                        for e, u in zip(got.entries, got.unclear):
                            if e not in seen:
                                seen.add(e)
                                at.append(q)
                                of.append(e)
                                unclear.append(u)
                    continue
                crossed, matches = crossing(look, rows, r, end), defaultdict(list)
                for q in range(r, end):
                    got = look.of(forms[q], markets[q])
                    for m, n in got.longest:
                        if m is not None and (m, n) not in got.rest and (m, forms[q][:n]) not in crossed:
                            matches[m, forms[q][:n]].append(q)
                for (m, form), places in matches.items():
                    first = {}  # of each ticker that has the form on a day of these texts
                    for q in places:
                        for e in look.entries(m, form):
                            _, ticker, begins, ends, _ = look.info[e]
                            if days[q] is None or (begins or days[q]) <= days[q] <= (ends or days[q]):
                                first.setdefault(ticker, (q, e))
                    at += [q for q, _ in first.values()]
                    of += [e for _, e in first.values()]
                    unclear += [len(first.keys() - {None}) > 1] * len(first)
            take, known = pa.array(at, pa.int64()), store.take(pa.array(of, pa.int64())).combine_chunks()
            yield pa.RecordBatch.from_arrays([*whole(known, "market", "compact"), rows["id"].take(take), rows["day"].take(take), location(rows["spot"].take(take)), *whole(known, "entry"), pa.array(unclear, pa.bool_())], names=["market", "compact", "id", "day", "location", "entry", "ambiguous"])

    fields = [("market", T.StringType()), ("compact", T.StringType()), ("id", kinds["id"]), ("day", kinds["day"]), ("location", T.StringType()), ("entry", entry), ("ambiguous", T.BooleanType())]
    return sorted_places.mapInArrow(met, T.StructType([T.StructField(n, k) for n, k in fields]))


def scan_joined(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``scan`` for dictionaries that are joined, not broadcast; the same rows."""
    words = entry_table(aliases)
    plan = Plan(words)
    return kept_matches(texts, placed(texts, words, plan, True), plan, has_latin(words), False)


def has_latin(words: DataFrame) -> bool:
    return bool(words.where(F.col("entry._latin").isNotNull()).limit(1).count())


def hits_joined(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``hits`` of ``scan_joined``; most places are shuffled once, and their matches not at all."""
    words = entry_table(aliases)
    plan, latin = Plan(words), has_latin(words)
    more = [c for c in aliases.columns if c not in ("market", "compact")]
    places = placed(texts, words, plan, latin)
    rest = hits(kept_matches(texts, places, plan, latin, True), words.select("market", "compact", *[F.col(f"entry.{c}").alias(c) for c in more]))
    direct = direct_hits(texts, places, words, plan).select("market", "compact", "id", "day", "location", F.array().cast("array<string>").alias("free"), *[F.col(f"entry.{c}").alias(c) for c in more], "ambiguous")
    return rest.unionByName(scored(direct))


def text_hits(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """``hits`` of ``scan``, for a dictionary of any size."""
    return hits_joined(texts, aliases) if is_large(aliases) else hits(scan(texts, aliases), aliases)


def hits(matches: DataFrame, aliases: DataFrame) -> DataFrame:
    """Scored hits, one per text, market, ticker, alias form and location.

    A form is ambiguous if more than one ticker of its market has it on the day, counted before anything is filtered.  Latin aliases
    have to be among those that stand free in the raw text.
    """
    day = F.col("day")
    on_day = (day.isNull() | ((F.coalesce("valid_from", day) <= day) & (F.coalesce("valid_to", day) >= day)))
    joined = matches.join(aliases, ["market", "compact"]).where(on_day)
    spot = W.partitionBy("id", "market", "location", "compact")
    tickers = F.size(F.collect_set("ticker").over(spot))
    latin = F.col("alias").rlike(LATIN)
    clear = joined.withColumn("ambiguous", tickers > 1).where(~latin | F.array_contains("free", F.col("alias")))
    return scored(clear).dropDuplicates(["id", "market", "ticker", "compact", "location"])


def scored(matches: DataFrame) -> DataFrame:
    """Matches with aliases and whether they are ambiguous, with their ``score``."""
    title = F.col("location") == "title"
    base = F.when(title, 42.0).otherwise(20.0) * F.col("confidence") + F.when(F.col("alias_type") == "ticker", 4.0).otherwise(0.0)
    score = F.when(~F.col("ambiguous"), base).when(title, base * 0.55).otherwise(base * 0.35)
    return matches.withColumn("score", F.round(score, 3))


def best_hits(found: DataFrame) -> DataFrame:
    """The best hit of each text and company: by score, alias length, title first, alias."""
    order = W.partitionBy("id", "market", "ticker").orderBy(F.desc("score"), F.desc(F.char_length("compact")), F.desc("location"), "compact")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == 1).drop("_r")


def accepted(found: DataFrame, minimum: float = MIN_ALIGNMENT) -> DataFrame:
    """Whether hits are unambiguous, score enough and, in the content, do not just name the news source."""
    own = (F.col("location") == "content") & (F.col("compact") == compact_alias(F.col("source"))) if "source" in found.columns else F.lit(False)
    return found.withColumn("accepted", ~F.col("ambiguous") & (F.col("score") >= minimum) & ~own)


def match_tickers(found: DataFrame, minimum: float = MIN_ALIGNMENT) -> DataFrame:
    """Tickers of each text and market whose best hit, ambiguous ones too, scores enough; sorted."""
    best = found.groupBy("id", "market", "ticker").agg(F.max("score").alias("score")).where(F.col("score") >= minimum)
    return best.groupBy("id", "market").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"))


def with_company(found: DataFrame, companies: DataFrame) -> DataFrame:
    """Hits with the attributes of their companies (``market``, ``ticker`` and what else the table has)."""
    return found.join(companies, ["market", "ticker"])
