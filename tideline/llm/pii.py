"""Personal data: base patterns, and identifiers found by bootstrapped contexts; DataFrame operations only.

Base spans come from one regular expression for each kind, checked afterwards
(octets, Luhn, digit counts).  Beside them, strings that can hardly be anything but
identifiers (``SEED``: long hexadecimal keys, numbers of 13 to 19 digits) are marked
as kind ``id``.  All of these seed a bootstrap over contexts:

1. Contexts are lexical patterns: the word before a span, the word after it, and
   the mark before ``=`` or ``:`` glued to it.  Every such span, with or without
   digits, is a known instance of the patterns around it.  Candidates are all runs
   of up to ``RUN`` neighbouring words that hold digits, with short groups of
   capitals among them (``123 45 6789``, ``AB 12 34 C``), outside base spans.
2. Patterns and distinct instances form a graph.  A pattern's confidence is the
   (smoothed) mean belief in what stands at its places, each place counted once
   however many runs begin or end there; an instance is believed as far as its
   confident patterns say (noisy or).  Known instances stay at 1.  The two scores
   are computed in turn for ``rounds`` rounds.
3. Candidates that look like identifiers (``LOOKS``, over the whole run) and whose
   belief reaches ``belief`` become spans of kind ``id``, wherever they stand.  One
   pattern that reaches ``belief`` by itself is enough.
4. Runs of up to ``PLAIN`` words of any look, digits or not, are judged by their own
   place: a pattern's confidence is taken anew with all words that stand at it
   counted, and the patterns at both ends of a run must reach ``belief`` together,
   or one of them alone for a single word.  Such a word is no identifier elsewhere.

Of spans that overlap, the more believed stays, then the longer.  Only distinct
(pattern, instance) pairs are shuffled, so copies of a document do not count twice.
For step 4 the words at patterns are first counted by sketches, and exactly for
patterns that could still be confident at half the sketch's count.

Cases: null text counts as empty and has no spans; null or repeated ``doc_id`` rows
are judged for themselves; long runs of digits or letters are scanned once, not
from each of their characters, and places and contexts of many spans in a long text are
found by sums over blocks, not from its start; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep, texts

KINDS = ["email", "ip", "card", "phone"]
#: The contract's expressions, with starts inside a run that cannot match left out and no pointless backtracking.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text holds that can have a span of the kind.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
#: Strings that are taken for identifiers wherever they stand.
SEED = r"(?<![0-9A-Za-z])(?:(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,128}|[0-9]{13,19})(?![0-9A-Za-z])"
#: Stands for each character of a base span, so that a span is one word at its place.
FILL = "\ue000"
DIGIT_WORD = r"[^\x20\x{E000}0-9]*+[0-9][^\x20\x{E000}]*+(?![^\x20])"
CAPITALS = r"[A-Z]{1,4}(?![^\x20])"
#: Neighbouring words with digits, short groups of capitals among them.
STRETCH = rf"(?<![^\x20])(?:{CAPITALS}\x20){{0,2}}{DIGIT_WORD}(?:\x20(?:{DIGIT_WORD}|{CAPITALS}))*+"
MARK = r"^([^=:0-9\x{E000}]{1,24}[=:])"
#: Most words of a candidate with digits, and of one that its place alone decides.
RUN = 6
PLAIN = 4
#: Identifier-like: at least six letters or digits, of them three digits.
LOOKS = r"^(?=(?:[^A-Za-z0-9]*[A-Za-z0-9]){6})(?:[^0-9]*[0-9]){3}"
SPANS = "array<struct<start:int,end:int,match:string>>"
#: Found instances up to this number are broadcast.
SMALL = 100_000


#: Characters of a block of a text.
PIECE = 1024


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def with_sums(each: Column, f, **more: Column) -> Column:
    """``f`` of a struct with ``each``, ``more``, and sums of each 256 numbers (``blocks``), for ``before``."""
    last = lambda v: F.shiftright(F.size(v["each"]), 8)
    blocks = lambda v: F.transform(F.sequence(F.lit(0), last(v)), lambda j: total(F.slice(v["each"], F.shiftleft(j, 8) + 1, F.lit(256))))
    named = lambda v: [v[n].alias(n) for n in more]
    return let(F.struct(each.alias("each"), *[c.alias(n) for n, c in more.items()]), lambda v: let(F.struct(v["each"].alias("each"), *named(v), blocks(v).alias("blocks")), f))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda x, y: x + y)


def before(v: Column, n: Column) -> Column:
    """The sum of the first ``n`` numbers of ``with_sums``."""
    whole = F.shiftright(n, 8)
    return total(F.slice(v["blocks"], F.lit(1), whole)) + total(F.slice(v["each"], F.shiftleft(whole, 8) + 1, n.bitwiseAND(F.lit(255))))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, n: Column) -> Column:
    """``n`` characters from ``start`` (0 is the first) of a text in ``pieces``."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((start + n - 1) / PIECE).cast("int")
    held = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.when(n > 0, F.substring(held, start - first * PIECE + 1, n)).otherwise("")


def matches(text: Column, pattern: str) -> Column:
    """All matches with their places in code points, from the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    span = lambda m, end: F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("match"))
    placed = lambda v: F.transform(v["found"], lambda m, i: let(before(v, i + 1), lambda end: span(m, end)))
    each = lambda v: F.transform(v["found"], lambda m, i: F.get(v["gaps"], i) + F.char_length(m))
    return let(F.struct(found.alias("found"), gaps.alias("gaps")), lambda v: with_sums(each(v), placed, found=v["found"]))


def fill(text: Column, spans: Column) -> Column:
    """The text with each character of the spans, which may overlap, replaced by ``FILL``."""
    tops = lambda v: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(v["spans"]), 8)), lambda j: F.array_max(F.slice(v["spans"]["end"], F.shiftleft(j, 8) + 1, F.lit(256))))

    def reach(v: Column, i: Column) -> Column:
        """Where the first ``i`` spans end."""
        whole = F.shiftright(i, 8)
        return F.coalesce(F.greatest(F.array_max(F.slice(v["tops"], F.lit(1), whole)), F.array_max(F.slice(v["ends"], F.shiftleft(whole, 8) + 1, i.bitwiseAND(F.lit(255))))), F.lit(0))

    def run(v: Column) -> Column:
        one = lambda s, r: F.concat(cut(v["parts"], r, s["start"] - r), F.repeat(F.lit(FILL), F.greatest(s["end"] - F.greatest(s["start"], r), F.lit(0))))
        filled = F.transform(v["spans"], lambda s, i: let(reach(v, i), lambda r: one(s, r)))
        return F.array_join(F.concat(filled, F.array(let(reach(v, F.size(v["spans"])), lambda r: cut(v["parts"], r, v["n"] - r)))), "")

    sorted_ = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    whole = lambda v: F.struct(v["spans"].alias("spans"), v["spans"]["end"].alias("ends"), tops(v).alias("tops"), pieces(v["text"]).alias("parts"), F.char_length(v["text"]).alias("n"))
    return F.when(F.size(spans) > 0, let(F.struct(sorted_.alias("spans"), text.alias("text")), lambda v: let(whole(v), run))).otherwise(text)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.char_length(number)

    def worth(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """What a match must meet beside its expression."""
    if kind == "ip":
        octet = lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.left(F.ltrim(p, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), octet)
    number = digits(match)
    if kind == "card":
        return F.when(F.char_length(number).between(13, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.char_length(number).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    none = F.array().cast(SPANS)
    possible = text.contains(HINTS[kind]) if kind in HINTS else text.rlike(r"[0-9][\x20-]?[0-9]")
    return F.when(possible, F.filter(matches(text, PATTERNS[kind]), lambda s: holds(kind, s["match"]))).otherwise(none)


def joined(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def pattern(name: str, word: Column) -> Column:
    """The lexical pattern of a word beside a span; base spans are none."""
    return F.when((word != "") & ~word.contains(FILL), F.concat(F.lit(name), F.lower(word)))


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^[^A-Za-z0-9+@]+|[^A-Za-z0-9]+$", "")


def scan(docs: DataFrame) -> DataFrame:
    """Per row: its key, base spans of each kind, further seeds (``seeds``), its words with all of these filled (``m``), known instances (``k``) and candidates (``c``)."""
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("h"), F.col("text"))
    rows = rows.withColumns({k: base_spans(F.col("text"), k) for k in KINDS})
    rows = rows.withColumn("m", fill(F.translate("text", FILL + "\t\n\x0b\x0c\r", "�     "), F.concat(*KINDS))).drop("text")
    m = F.col("m")
    rows = rows.withColumn("seeds", F.when(m.rlike("[0-9]"), matches(m, SEED)).otherwise(F.array().cast(SPANS)))
    rows = rows.withColumn("m", fill(m, F.col("seeds")))

    def around(parts: Column, s: Column) -> tuple[Column, Column, Column]:
        """The word before, the word after and what is glued to the front."""
        front = cut(parts, F.greatest(s["start"] - 120, F.lit(0)), F.least(s["start"], F.lit(120)))
        after = cut(parts, s["end"], F.lit(120))
        return F.regexp_extract(front, r"([^\x20]{1,24})\x20+[^\x20]*$", 1), F.regexp_extract(after, r"^[^\x20]*\x20+([^\x20]{1,24})", 1), F.regexp_extract(front, r"([^\x20]*)$", 1)

    def known(parts: Column, s: Column) -> Column:
        left, right, glued = around(parts, s)
        return F.struct(trimmed(s["match"]).alias("value"), F.array_compact(F.array(pattern("before ", left), pattern("after ", right), pattern("mark ", F.regexp_extract(glued, MARK, 1)))).alias("patterns"))

    def run(v: Column, i: Column, n: Column) -> Column:
        """Words ``i`` to ``i + n - 1`` of a stretch; beside each pattern, what stands at its place at most."""
        w, size = v["w"], F.size(v["w"])
        text = lambda at, count: F.array_join(F.slice(w, at + 1, count), " ")
        first = F.greatest(i + n - RUN, F.lit(0))
        at = lambda p, x: F.when(p.isNotNull(), F.struct(p.alias("pattern"), x.alias("place")))

        def made(x: Column) -> Column:
            bare = lambda y: trimmed(F.substring(y, F.char_length(x["mark"]) + 1, F.lit(1 << 30)))
            patterns = F.array(
                at(pattern("before ", F.right(F.when(i > 0, F.get(w, i - 1)).otherwise(v["left"]), F.lit(24))), bare(x["onward"])),
                at(pattern("after ", F.left(F.when(i + n < size, F.get(w, i + n)).otherwise(v["right"]), F.lit(24))), trimmed(text(first, i + n - first))),
                at(pattern("mark ", x["mark"]), bare(x["onward"])),
            )
            return F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["match"])).alias("end"), bare(x["match"]).alias("value"), F.array_compact(patterns).alias("patterns"))

        start = (v["start"] + before(v, i)).alias("start")
        return let(F.struct(start, text(i, n).alias("match"), text(i, F.lit(RUN)).alias("onward"), F.regexp_extract(F.get(w, i), MARK, 1).alias("mark")), made)

    def runs(parts: Column, s: Column) -> Column:
        left, right, _ = around(parts, s)
        each = lambda v: F.flatten(F.transform(F.sequence(F.lit(0), F.size(v["w"]) - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), F.size(v["w"]) - i)), lambda n: run(v, i, n))))
        words = lambda x: with_sums(F.transform(x["w"], lambda y: F.char_length(y) + 1), each, w=x["w"], start=x["start"], left=x["left"], right=x["right"])
        return let(F.struct(s["start"].alias("start"), F.split(s["match"], " ").alias("w"), left.alias("left"), right.alias("right")), words)

    seen = F.concat(*KINDS, "seeds")
    rows = rows.withColumn("k", F.when(F.size(seen) > 0, let(pieces(m), lambda parts: F.transform(seen, lambda s: known(parts, s)))))
    found = let(F.struct(pieces(m).alias("parts"), matches(m, STRETCH).alias("s")), lambda v: F.flatten(F.transform(v["s"], lambda s: runs(v["parts"], s))))
    return rows.withColumn("c", F.when(m.rlike("[0-9]"), F.filter(found, lambda c: c["value"].rlike("[0-9]"))))


def bootstrap(known: DataFrame, candidates: DataFrame, rounds: int, confidence: float, belief: float, support: int) -> tuple[DataFrame, DataFrame]:
    """Values that the contexts of known ones reveal, with their belief, and the patterns trusted at last (``mass`` of ``n`` places)."""
    one = known.select("value", F.lit(1.0).alias("known"), F.explode("patterns").alias("pattern")).select("pattern", F.col("value").alias("place"), "value", "known")
    two = candidates.where(F.col("value") != "").select("value", F.explode("patterns").alias("p")).select("p.pattern", "p.place", "value", F.lit(0.0).alias("known"))
    edges = keep(one.unionByName(two).groupBy("pattern", "place", "value").agg(F.max("known").alias("known")), "edges")
    score = edges.withColumn("score", F.col("known"))
    for k in range(rounds):
        # How much what stands at a pattern's places is believed, one doubt added.
        places = score.groupBy("pattern", "place").agg(F.max("score").alias("score"))
        trust = places.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.sum("score").alias("mass"), F.count("*").alias("n"))
        trusted = trust.where((F.col("confidence") >= confidence) & (F.col("mass") >= support))
        pairs = edges.select("pattern", "value").distinct()
        said = pairs.join(trusted.select("pattern", "confidence"), "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("said"))
        if k + 1 < rounds:
            score = keep(edges.join(said, "value", "left").select("pattern", "place", "value", "known", F.greatest("known", F.coalesce("said", F.lit(0.0))).alias("score")), f"beliefs{k}")
    return said.where((F.col("said") >= belief) & F.col("value").rlike(LOOKS)), trusted.select("pattern", "mass", "n")


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def at_patterns(scanned: DataFrame, trusted: DataFrame) -> DataFrame:
    """Every word outside base spans at a place of a pattern: ``doc_id``, ``h``, its number ``i``, ``word``, ``pattern``."""
    words = F.array_remove(F.split("m", " "), "")
    pairs = scanned.select("doc_id", "h", words.alias("w")).select("doc_id", "h", F.posexplode(F.arrays_zip("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("y"))).alias("i", "p"))
    pairs = pairs.select("doc_id", "h", "i", F.col("p.w").alias("x"), F.col("p.y").alias("y"))
    x, y = F.col("x"), F.col("y")
    marked = F.when(x.contains("=") | x.contains(":"), pattern("mark ", F.regexp_extract(x, MARK, 1)))
    pairs = pairs.withColumns({"b": F.concat(F.lit("before "), F.lower(F.right(x, F.lit(24)))), "a": F.concat(F.lit("after "), F.lower(F.left(y, F.lit(24)))), "k": marked})
    for name, kind in (("b", "before "), ("a", "after "), ("k", "mark ")):
        pairs = pairs.join(small(trusted.where(F.col("pattern").startswith(kind)).select(F.col("pattern").alias(f"{name}_"))), F.col(name) == F.col(f"{name}_"), "left")
    hit = lambda name, i, word: F.when(F.col(name).isNotNull() & word.isNotNull() & ~word.contains(FILL), F.struct(F.col(name).alias("pattern"), i.alias("i"), word.alias("word")))
    hits = F.array_compact(F.array(hit("b_", F.col("i") + 1, y), hit("a_", F.col("i"), x), hit("k_", F.col("i"), x)))
    found = pairs.where(F.coalesce("b_", "a_", "k_").isNotNull()).select("doc_id", "h", F.explode(hits).alias("p"))
    return found.select("doc_id", "h", "p.*")


def by_place(scanned: DataFrame, trusted: DataFrame, confidence: float, belief: float, support: int) -> DataFrame:
    """Runs of words of any look that the patterns around them reveal: ``doc_id``, ``h``, ``start``, ``end``, ``said``."""
    trusted = keep(trusted, "trusted")
    plain = ~F.col("word").rlike("[0-9]")
    value = F.lower(trimmed(F.when(F.col("pattern").startswith("mark "), F.regexp_replace("word", MARK, "")).otherwise(F.col("word"))))
    about = at_patterns(scanned, trusted).where(plain).groupBy("pattern").agg(F.approx_count_distinct("word").alias("about"))
    could = (F.col("mass") >= confidence * (F.col("n") + 0.5 * F.coalesce("about", F.lit(0)) + 1)) & (F.col("mass") >= support)
    likely = keep(trusted.join(about, "pattern", "left").where(could).drop("about"), "likely")
    hits = keep(at_patterns(scanned, likely), "hits")
    words = hits.where(plain).groupBy("pattern").agg(F.count_distinct(value).alias("others"))
    sure = likely.join(words, "pattern", "left").withColumn("confidence", F.col("mass") / (F.col("n") + F.coalesce("others", F.lit(0)) + 1)).where(F.col("confidence") >= confidence)
    doubt = F.sum(F.log1p(-F.col("confidence")))
    sides = hits.join(small(keep(sure.select("pattern", "confidence"), "sure")), "pattern").groupBy("doc_id", "h", "i", F.col("pattern").startswith("after ").alias("last")).agg(doubt.alias("doubt"))
    sides = keep(sides, "sides")
    first, last = sides.where(~F.col("last")).drop("last"), sides.where("last").select(F.col("doc_id").alias("d"), F.col("h").alias("hh"), F.col("i").alias("j"), F.col("doubt").alias("more"))
    both = first.join(last, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")) & F.col("j").between(F.col("i"), F.col("i") + PLAIN - 1)).select("doc_id", "h", "i", "j", (F.col("doubt") + F.col("more")).alias("doubt"))
    runs = both.unionByName(sides.select("doc_id", "h", "i", F.col("i").alias("j"), "doubt"))
    runs = runs.groupBy("doc_id", "h", "i", "j").agg((1 - F.exp(F.min("doubt"))).alias("said")).where(F.col("said") >= belief)
    runs = runs.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("hh")).agg(F.collect_list(F.struct("i", "j", "said")).alias("runs"))
    rows = scanned.select("doc_id", "h", "m").join(runs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh"))).dropDuplicates(["doc_id", "h"])
    # Words with their places in the text.
    words = lambda v: F.filter(F.transform(v["w"], lambda w, k: F.struct(w.alias("w"), before(v, k).alias("at"))), lambda s: s["w"] != "")
    numbered = let(F.split("m", " "), lambda w: with_sums(F.transform(w, lambda x: F.char_length(x) + 1), words, w=w))
    rows = rows.withColumn("w", numbered).select("doc_id", "h", "w", F.explode("runs").alias("r"))
    run = F.slice("w", F.col("r.i") + 1, F.col("r.j") - F.col("r.i") + 1)
    rows = rows.where(F.forall(run, lambda s: ~s["w"].contains(FILL)) & F.exists(run, lambda s: s["w"].rlike("[\\p{L}\\p{N}]")))
    first, last = F.get("w", F.col("r.i")), F.get("w", F.col("r.j"))
    return rows.select("doc_id", "h", first["at"].alias("start"), (last["at"] + F.char_length(last["w"])).alias("end"), "r.said")


def apart(spans: Column) -> Column:
    """Of spans (``rank``, ``size``, ``start``, ``end``), those that overlap none before them in order; by place."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    clear = lambda taken, s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (t["end"] > s["start"]))
    return F.array_sort(F.aggregate(F.array_sort(spans), none, lambda taken, s: F.when(clear(taken, s), F.concat(taken, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(taken)))


def find(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, belief: float = 0.95, support: int = 4) -> DataFrame:
    """Per row: ``doc_id``, counts of base spans, ``base_sha256``, ``spans``, ``n_found`` (spans beside base ones) and ``n_spans`` (all)."""
    scanned = keep(scan(docs), "scanned")
    each = scanned.select("doc_id", "h", F.explode("c").alias("c")).select("doc_id", "h", "c.*")
    found, trusted = bootstrap(scanned.select(F.explode("k").alias("k")).select("k.*"), each, rounds, confidence, belief, support)
    found = small(keep(found, "found"))
    more = each.join(found, "value").select("doc_id", "h", "start", "end", "said")
    more = more.unionByName(by_place(scanned, trusted, confidence, belief, support)).groupBy("doc_id", "h", "start", "end").agg(F.max("said").alias("said"))
    span = F.struct(F.round(-F.col("said"), 9).alias("rank"), (F.col("start") - F.col("end")).alias("size"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    more = more.groupBy("doc_id", "h").agg(apart(F.collect_list(span)).alias("more")).select(F.col("doc_id").alias("d"), F.col("h").alias("hh"), "more")
    rows = scanned.drop("c", "k", "m").join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")), "left")
    base = F.concat(*[joined(F.col(k), k) for k in KINDS])
    seeds = F.transform("seeds", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    extra = joined(F.array_sort(F.concat(F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>")), seeds)), "id")
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, extra), ",").alias("spans"),
        F.size(extra).cast("long").alias("n_found"),
        F.size(F.concat(base, extra)).cast("long").alias("n_spans"),
    )
