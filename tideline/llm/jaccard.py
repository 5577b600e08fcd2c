"""Exact n-gram Jaccard links and their components by a token-group matrix.

Texts are sets of shingles; equal sets are one set.  A link needs a Jaccard
similarity of ``percent`` per cent.

1. ``document_sets`` gives every text the size of its set and a 128-bit key of it.
2. Shingles are dealt to shards.  A shard counts in how many sets each shingle is
   (copies counted once) and passes on those in two or more.  Shingles that one set in
   ``RARE`` or more has (found in the first pass) are shared anyhow and skip the shards.
3. Per set, shingles in one set only come first, the others by rising count.  A set
   with a partner shares one of its first ``n - needed + 1`` shingles with it; if
   those are all in one set, the set has none.  The others are candidates; all that
   two sets can share is in what they kept, so similarities are exact from there on.
4. Similar sets are partitioned into groups: of the sets that share such a shingle the
   one with the smallest part of shingles of its own (an original, among its copies)
   leads.  Every member is compared with its leader once.  Two members that are both
   linked with their leader are in one component; only members that are not (queries)
   are looked at further.
5. The token-group matrix: groups are cut into blocks of about ``BLOCK`` members, and
   each block's union of shingles outside its leader's is stored.  What a query has in
   common with a member of a block is at most what it or any member shares with the
   leader, and what it has of the block's union.  Only blocks that can qualify are
   opened, and only their members that can qualify are compared with the query.

So no link between components is missed, and links inside one are not enumerated: a
large group of near copies costs comparisons in proportion to its members.

A shingle is known by 64 bits beside those that choose its shard of about ``SHARD``
shingles, a set by 128; both derive from the exact bytes of words of up to 16 bytes and from
128-bit digests of longer ones, permuted with a key drawn for the run.

Cases: texts without words (or null) have no shingles and are linked with nothing;
texts with fewer words than ``n`` have their whole sequence as one shingle; rows with
a null ``doc_id`` take part, and a component of only such has a null id; repeated rows
are linked copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, release, texts
from .tokens import slices
from .words import Words, mixed, numbered, shingle_sets

#: Shingles in a shard, about.
SHARD = 4_000_000
#: One set in so many has a shingle that skips the shards.
RARE = 200
#: Members of a block of the matrix, about.
BLOCK = 64
HEAD = np.dtype([("a", "<u8"), ("b", "<u8"), ("n", "<u4"), ("here", "<u4")])
CANDIDATE = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("own", pa.int64()), ("room", pa.int32()), ("shared", pa.list_(pa.int64()))])
#: Ids of common shingles begin here, above those of shards.
COMMON = 1 << 62


def key_of(shingles: np.ndarray, more: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, from both numbers of each shingle."""
    return int(mixed(shingles ^ mixed(more, 3), 1).sum(dtype=np.uint64)), int(mixed(more ^ mixed(shingles, 4), 2).sum(dtype=np.uint64))


def document_sets(docs: DataFrame, words: int, secret: int) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text), ``n`` (set size) and ``key`` (null for an empty set) of every row.

    In one row of each slice ``often`` has the shingles that one set in ``RARE`` has there, and in how many.
    """
    many = pa.list_(pa.struct([("shingle", pa.int64()), ("sets", pa.int64())]))
    out = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("often", many)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = shingle_sets(Words(batch.column("text"), True, secret), words)
            sets, names = [s for s, _ in both], [key_of(*s) if len(s[0]) else None for s in both]
            distinct = {k: s for k, s in zip(names, sets) if k}
            often: list[dict] = []
            if len(distinct) > 1:
                shingle, count = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
                there = count >= max(2, len(distinct) // RARE)
                often = [{"shingle": s, "sets": c} for s, c in zip(shingle[there].view(np.int64).tolist(), count[there].tolist())] if len(distinct) >= RARE else []
            keys = [None if k is None else np.array(k, "<u8").tobytes() for k in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([often] + [None] * (len(sets) - 1), many)], schema=out)

    return texts(docs).select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, n long, key binary, often array<struct<shingle:bigint,sets:bigint>>")


def common_shingles(rows: DataFrame) -> np.ndarray:
    """Shingles that one set in ``RARE`` has at least, sorted: at most ``RARE`` times a set's mean size."""
    n = rows.where(F.col("key").isNotNull()).count()
    often = rows.select(F.explode("often").alias("o")).groupBy("o.shingle").agg(F.sum("o.sets").alias("sets")).where(F.col("sets") >= max(2, n // RARE))
    return np.sort(np.array([r["shingle"] for r in often.select("shingle").collect()], np.int64).view(np.uint64))


def dealt(docs: DataFrame, words: int, secret: int, bits: int, common: np.ndarray) -> DataFrame:
    """Shingles by shard, many sets to a row, eight bytes a shingle; and those of ``common`` by set (``shard`` -1)."""
    out = pa.schema([("shard", pa.int64()), ("sets", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by_key = {key_of(s, at): (s, at) for s, at in shingle_sets(Words(batch.column("text"), True, secret), words) if len(s)}
            if not by_key:
                continue
            flat = np.concatenate([s for s, _ in by_key.values()])
            size = np.array([len(s) for s, _ in by_key.values()])
            doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
            shard = (np.concatenate([at for _, at in by_key.values()]) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(flat), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
                shard[common[at] == flat] = -1
            order = np.argsort(shard, kind="stable")  # sets stay in order within a shard
            flat, doc, shard = flat[order], doc[order], shard[order]
            names = np.array(list(by_key), "<u8").reshape(-1, 2)
            cuts = np.flatnonzero(np.diff(shard)) + 1
            rows = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(flat)]):
                which, here = np.unique(doc[lo:hi], return_counts=True)
                heads = np.empty(len(which), HEAD)
                heads["a"], heads["b"], heads["n"], heads["here"] = names[which, 0], names[which, 1], size[which], here
                rows.append((int(shard[lo]), heads.tobytes(), flat[lo:hi].astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    return texts(docs).select("text").mapInArrow(run, "shard long, sets binary, shingles binary")


BUCKETS = pa.schema([("bucket", pa.int64()), ("sets", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])
BUCKET = "bucket long, sets binary, ids binary, counts binary"


def to_buckets(heads: np.ndarray, doc: np.ndarray, ids: np.ndarray, counts: np.ndarray, bits: int) -> pa.Table:
    """Shared shingles of the sets ``heads[doc]``, dealt anew by set."""
    bucket = (heads["a"] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(heads), np.int64)
    order = np.lexsort((ids, doc, bucket[doc]))
    doc, ids, counts = doc[order], ids[order].astype("<i8"), counts[order].astype("<i8")
    cuts = (np.flatnonzero(np.diff(bucket[doc])) + 1).tolist() if len(doc) else []
    rows = []
    for lo, hi in zip([0, *cuts], [*cuts, len(doc)]) if len(doc) else []:
        which, here = np.unique(doc[lo:hi], return_counts=True)
        mine = heads[which].copy()
        mine["here"] = here
        rows.append((int(bucket[doc[lo]]), mine.tobytes(), ids[lo:hi].tobytes(), counts[lo:hi].tobytes()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), BUCKETS.types)] if rows else [pa.array([], t) for t in BUCKETS.types], schema=BUCKETS)


def shared_shingles(shards: DataFrame, bits: int, common: np.ndarray) -> DataFrame:
    """Shingles in two or more sets with their counts, dealt anew by set (``bucket``)."""

    def run(table: pa.Table) -> pa.Table:
        # A shard holds millions of shingles, so what is not needed any more goes at once.
        shard = table.column("shard")[0].as_py()
        heads = np.concatenate([np.frombuffer(x.as_py(), HEAD) for x in table.column("sets")])
        flat = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in table.column("shingles")])
        del table
        doc = np.repeat(np.arange(len(heads), dtype=np.int32), heads["here"])
        order = np.lexsort((heads["b"], heads["a"]))
        copy = np.zeros(len(heads), bool)  # sets that another batch has sent too
        copy[order[1:]] = (heads["a"][order[1:]] == heads["a"][order[:-1]]) & (heads["b"][order[1:]] == heads["b"][order[:-1]])
        if copy.any():
            first = ~copy[doc]
            flat, doc = flat[first], doc[first]
        order = np.argsort(flat).astype(np.int32)
        flat, doc = flat[order], doc[order]
        del order
        start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
        count = np.diff(np.append(start, len(flat))).astype(np.int32)
        del flat
        group = np.repeat(np.arange(len(start), dtype=np.int32), count)
        many = count[group] >= 2
        doc, group = doc[many], group[many]
        del many
        out = to_buckets(heads, doc, group.astype(np.int64) | shard << 32, count[group].astype(np.int64), bits)
        release()
        return out

    def straight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets, shingles in zip(batch.column("sets"), batch.column("shingles")):
                heads, flat = np.frombuffer(sets.as_py(), HEAD), np.frombuffer(shingles.as_buffer(), "<u8")
                ids = COMMON + np.searchsorted(common, flat)
                yield from to_buckets(heads, np.repeat(np.arange(len(heads)), heads["here"]), ids, ids, bits).to_batches()

    dealt_ = shards.where(F.col("shard") >= 0).groupBy("shard").applyInArrow(run, BUCKET)
    return dealt_.unionByName(shards.where(F.col("shard") < 0).mapInArrow(straight, BUCKET)) if len(common) else dealt_


def candidates(shared: DataFrame, percent: int) -> DataFrame:
    """Sets that may have a partner: their shared shingles by rising count, and how many of the first may be shared (``room``)."""

    def run(table: pa.Table) -> pa.Table:
        heads = np.concatenate([np.frombuffer(x.as_py(), HEAD) for x in table.column("sets")])
        ids = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in table.column("ids")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in table.column("counts")])
        which, at = numbered(heads["a"], heads["b"])
        names = np.stack([heads["a"][at], heads["b"][at]], 1)
        doc = np.repeat(which, heads["here"])
        n = np.zeros(len(names), np.int64)
        n[which] = heads["n"]
        order = np.lexsort((ids, counts, doc))
        ids, doc = ids[order], doc[order]
        once = np.concatenate([[True], (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])]) if len(ids) else np.zeros(0, bool)
        ids, doc = ids[once], doc[once]  # copies of a set have sent common shingles each for themselves
        kept = np.bincount(doc, minlength=len(names))
        needed = -(-percent * n // 100)
        room = n - needed + 1 - (n - kept)  # places among the first that shared shingles have
        edges = np.searchsorted(doc, np.arange(len(names) + 1))
        rows = []
        for k in np.flatnonzero(room > 0):
            rows.append((names[k].tobytes(), int(n[k]), int(n[k] - kept[k]), int(room[k]), ids[edges[k] : edges[k + 1]]))
        release()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CANDIDATE.types)] if rows else [pa.array([], t) for t in CANDIDATE.types], schema=CANDIDATE)

    return shared.groupBy("bucket").applyInArrow(run, "key binary, n long, own long, room int, shared array<long>")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) with both sizes, what ``a`` has outside ``b`` (``rest``), what they have in ``common``, and whether they are ``linked``."""
    one = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    two = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", F.size("sa").alias("all"), F.array_except("sa", "sb").alias("rest"))
    rows = rows.select("a", "b", "na", "nb", "rest", (F.col("all") - F.size("rest")).alias("common"))
    return rows.withColumn("linked", 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common")))


def star_groups(sets: DataFrame, percent: int) -> DataFrame:
    """Members ``a`` of groups led by ``b``, compared with their leaders."""
    # ``behind``: shingles of the set from this one on, in the common order.
    first = F.posexplode(F.slice("shared", 1, F.col("room"))).alias("pos", "shingle")
    places = sets.select("key", "n", "own", first).select("key", "n", "shingle", F.expr("own * 1000000 div n").alias("own"), (F.col("n") - F.col("own") - F.col("pos")).alias("behind"))
    lead = F.min(F.struct("own", -F.col("n"), "key")).alias("lead")
    crowd = places.groupBy("shingle").agg(F.count("*").alias("c"), F.min("n").alias("least"), lead).where(F.col("c") > 1).select("shingle", "least", F.col("lead.key").alias("b"))
    # Two sets of n and m shingles need common >= percent * (n + m) / (100 + percent) of them.  If this is the first
    # one that they share, all others stand behind it in both.  A set without enough behind it for any partner of a
    # fitting size in the group has none here.
    partner = F.greatest(F.col("least") * 100, F.col("n") * percent)  # a hundredfold
    enough = F.col("behind") * (100 + percent) * 100 >= percent * (partner + F.col("n") * 100)
    pairs = places.join(crowd, "shingle").where(enough & (F.col("key") != F.col("b"))).select(F.col("key").alias("a"), "b").distinct()
    return compared(pairs, sets, percent)


def opened_pairs(stars: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be linked and are not both linked with a leader of theirs, by the token-group matrix."""
    fits = lambda bound, n, m: bound * (100 + percent) >= percent * (n + m)  # noqa: E731  enough in common for a link
    partner = lambda least: F.greatest(least, F.ceil(F.col("na") * percent / 100))  # noqa: E731  the smallest that can fit
    # The groups: their size and smallest member; members that are linked with the leader are no queries.
    # What is joined by leader is written first: a leader may have a third of all rows, and joins of written tables are split.
    groups = keep(stars.groupBy("b").agg(F.count("*").alias("members"), F.min("na").alias("least"), F.max("common").alias("most")).where(F.col("members") > 1), "stargroups")
    rows = stars.join(groups, "b")
    query = ~F.col("linked") & fits(F.least("common", "most") + F.size("rest"), F.col("na"), partner(F.col("least")))
    rows = rows.select("a", "b", "na", "common", "rest", query.alias("query"), F.pmod(F.xxhash64("a"), F.expr(f"members div {BLOCK} + 1")).alias("block"))
    rows = keep(rows, "starmembers")
    rows = keep(rows.join(keep(rows.where("query").select("b").distinct(), "asked"), "b", "left_semi"), "members")
    # The matrix: each block's union outside the leader, and how many members have a shingle.
    union = keep(rows.select("b", "block", F.explode("rest").alias("shingle")).groupBy("b", "block", "shingle").agg(F.count("*").alias("n")), "matrix")
    blocks = keep(rows.groupBy("b", "block").agg(F.min("na").alias("least"), F.max("common").alias("most")), "blocks")
    asks = rows.where("query").select("b", F.col("a").alias("q"), F.col("na").alias("nq"), F.col("common").alias("cq"), F.size("rest").alias("rq"), F.col("block").alias("own"), "rest")
    hits = asks.select("b", "q", "own", F.explode("rest").alias("shingle")).join(union, ["b", "shingle"]).where((F.col("block") != F.col("own")) | (F.col("n") > 1))
    hits = hits.groupBy("b", "q", "block").agg(F.count("*").alias("hits"))
    # Blocks that qualify by their union, and those whose members may share enough with the leader alone.
    asks, smallest = asks.drop("rest"), F.greatest(F.col("least"), F.ceil(F.col("nq") * percent / 100))
    by_union = asks.join(hits, ["b", "q"]).join(blocks, ["b", "block"]).where(fits(F.least("cq", "most") + F.col("hits"), F.col("nq"), smallest))
    by_leader = asks.join(blocks, "b").where(fits(F.least("cq", "most"), F.col("nq"), smallest))
    columns = ["b", "q", "nq", "cq", "rq", "block"]
    open_ = by_union.select(*columns).unionByName(by_leader.select(*columns)).distinct()
    member = rows.select("b", "block", "a", "na", "common", F.size("rest").alias("ra"))
    able = (F.col("a") != F.col("q")) & (F.least("na", "nq") * 100 >= F.greatest("na", "nq") * percent) & fits(F.least("cq", "common") + F.least("rq", "ra"), F.col("na"), F.col("nq"))
    return open_.join(member, ["b", "block"]).where(able).select(F.greatest("a", "q").alias("a"), F.least("a", "q").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) by alternating large and small stars."""
    stars = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "stars")
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).unionByName(low.select("a", F.col("m").alias("b")))
        stars = keep(small.distinct(), "stars")
        now = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def linked_sets(sets: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``label`` of the candidate sets that have links."""
    stars = keep(star_groups(sets, percent), "stars")
    found = compared(keep(opened_pairs(stars, percent), "opened"), sets, percent)
    return components(stars.where("linked").select("a", "b").unionByName(found.where("linked").select("a", "b")))


def link_documents(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id that links reach).

    Also ``h``, the hash of the text, and ``group``, a name of the component (null for an empty set).
    """
    secret = secrets.randbits(128)  # of the words' bits; no result depends on it
    rows = keep(document_sets(docs, words, secret), "sets")
    total = rows.agg(F.sum("n")).first()[0] or 0
    bits = max(0, (int(total) // SHARD).bit_length())
    common = common_shingles(rows)
    sets = keep(candidates(shared_shingles(dealt(docs, words, secret, bits, common), bits, common), percent), "candidates")
    labels = linked_sets(sets, percent)
    smallest = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("low"))
    placed = smallest.join(labels.withColumnRenamed("node", "key"), "key", "left")
    meets = placed.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("low").alias("lowest"))
    placed = placed.join(meets, "label", "left").select("key", F.coalesce("lowest", "low").alias("component_id"), F.coalesce("label", "key").alias("group"))
    full = rows.join(placed, "key", "left")
    return full.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "h", "group")
