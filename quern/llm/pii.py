r"""Personal data, and the terms of the corpus that give it away.

Base kinds are found by pattern, natively: a text is split at its matches, and
the lengths of pieces and matches in turn give every match its place in code
points.  Lookbehind and possessive quantifiers keep each pattern linear in the
text; they match what the plain patterns match.

Information-theoretic sanitisation.  Each matched value is a protected entity, and
so are its group (an address's domain, a network of IPs, a card's issuer, a phone
number without its last digits) and its kind: what a value seen once cannot show,
its group or kind can.  A word of ``TERM_CHARS`` letters or more outside the values is
a term, and over the whole corpus

    disclosure(entity, term) = PMI(entity; term) / IC(entity)

with probabilities from how many distinct texts hold the term, the entity, and
both, anywhere in the text; copies of a text are one.  It is 1 when the term never occurs without the
entity.  A share of the entity's information alone would loosen as the corpus grows
(a third of it is 4 bits among 10**4 texts and 10 among 10**10), so a term also must
leave no more than ``LEFT_BITS`` of uncertainty: -log2 of the share of its texts that
hold the entity.  A pair needs ``MIN_SUPPORT`` texts that hold both.  A value in two texts
needs both of them, and a value in one text counts with the words it is made of
alone; such a term must be within ``CONTEXT`` characters of the value once, and half
of its texts must hold the value.  A pair of a group or kind
must be no chance as well: ``SURE_BITS`` bound the odds of drawing it.  Terms that
reach ``GENERALISE`` are generalised to a placeholder wherever they occur, those
that reach ``REMOVE`` are removed.

Cost at scale.  Patterns run once over each text and leave a narrow table.  Terms
are counted over the corpus with map-side combining, then joined to those that
have the support; texts that are copies are read once more to count them once.
The table of disclosing terms is broadcast if its files are small enough for the
session's limit and merge-joined otherwise.  Of the texts, those are shuffled that
have copies or hold such a term, and few others.  Only texts with personal data are
joined, a text's terms to its entities, and of these pairs only such as can reach
``generalise``: a term in more texts than that leaves room for makes no row.

Defined results.  Null texts are empty and have no spans; ids may be null or
repeat, each row is searched on its own (rows with equal id and text alike).
Only id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import between, let, parted, running
from .scratch import discard, materialize

TERM_CHARS = 4
CONTEXT = 64
MIN_SUPPORT = 3
GENERALISE = 0.7
REMOVE = 0.9
LEFT_BITS = 2
SURE_BITS = 20
SLOTS = 1 << 20

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_TOKEN = rf"\p{{L}}{{{TERM_CHARS},}}"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def matches(text: Column, pattern: Column, kind: str) -> Column:
    """Structs (kind, start, end, value) of the leftmost non-overlapping matches, in code points."""

    def placed(found: Column) -> Column:
        def of_steps(steps: Column) -> Column:
            def at_ends(ends: Column) -> Column:
                one = lambda v, i: F.struct(F.lit(kind).alias("kind"), (F.get(ends, i + 1) - F.length(v)).alias("start"), F.get(ends, i + 1).alias("end"), v.alias("value"))
                return F.transform(found, one)

            return let(running(steps, F.lit(0), lambda a, b: a + b), at_ends)

        pieces = F.split(text, pattern, -1)
        steps = let(pieces, lambda p: F.transform(found, lambda v, i: F.length(F.get(p, i)) + F.length(v)))
        return F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(let(steps, of_steps))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)


def _luhn(digits: Column) -> Column:
    def doubled(x: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    values = F.transform(F.split(F.reverse(digits), ""), lambda c: F.ascii(c) - 48)
    return F.aggregate(F.transform(values, doubled), F.lit(0), lambda s, x: s + x) % 10 == 0


def _card(value: Column) -> Column:
    digits = F.translate(value, " -", "")
    return F.length(digits).between(16, 19) & _luhn(digits)


#: kind: (pattern, what a text must hold for any match, what a match must pass)
BASE: dict[str, tuple[str, str, Callable[[Column], Column]]] = {
    "email": (EMAIL, "@", lambda v: F.lit(True)),
    "ip": (IP, r"[0-9]\.[0-9]", lambda v: v.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")),
    "card": (CARD, r"[0-9][\x20-]?[0-9]", _card),
    "phone": (PHONE, r"\+[0-9]", lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(8, 15)),
}
PLACEHOLDERS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>", "gone": ""}


def _passing(spans: Column, ok: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda s: ok(s["value"]))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind and then by start."""
    none = F.array().cast(SPAN)
    return F.concat(*(F.when(text.rlike(guard), _passing(matches(text, F.lit(pattern), kind), ok)).otherwise(none) for kind, (pattern, guard, ok) in BASE.items()))


def _terms(text: Column) -> Column:
    """Distinct lower-cased terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda w: F.lower(w)))


def _context_terms(parts: Column, size: Column, span: Column) -> Column:
    """Distinct lower-cased terms near a span of a parted text; words that the window cuts do not count."""
    left = between(parts, F.greatest(F.lit(0), span["start"] - CONTEXT), span["start"])
    right = between(parts, span["end"], F.least(size, span["end"] + CONTEXT))
    left = F.when(span["start"] > CONTEXT, F.regexp_replace(left, r"^\S*", "")).otherwise(left)
    right = F.when(span["end"] + CONTEXT <= size, F.regexp_replace(right, r"\S*$", "")).otherwise(right)
    return _terms(F.concat_ws(" | ", left, right))


def _group(kind: Column, value: Column) -> Column:
    """What the values of one owner tend to share; null where there is nothing."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == "email", F.substring_index(value, "@", -1))
        .when(kind == "ip", F.substring_index(value, ".", 3))
        .when(kind == "card", F.substring(digits, 1, 6))
        .when(kind == "phone", F.substring(digits, F.lit(1), F.length(digits) - 4))
    )


def find_base(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, row, text) of the texts, and the written table (id, row, spans, near, terms, inner) of what is in them.

    Of texts with spans, terms are those outside the spans and inner those inside alone.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    found = own.select("id", "row", "text", base_spans(F.col("text")).alias("spans"))
    beside = lambda parts, size: F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), F.lower(s["value"]).alias("value"), _context_terms(parts, size, s).alias("terms")))
    near = F.when(F.size("spans") > 0, let(parted(F.col("text")), lambda parts: let(F.length("text"), lambda size: beside(parts, size)))).otherwise(F.array().cast("array<struct<kind:string,value:string,terms:array<string>>>"))
    found = found.withColumn("all", F.when(F.size("spans") > 0, _terms(F.col("text"))))
    terms = F.when(F.size("spans") > 0, _terms(_rewritten(F.col("text"), F.col("spans"), dict.fromkeys(BASE, "|"))))
    found = found.select("id", "row", "spans", near.alias("near"), "all", terms.alias("terms"))
    return own, materialize(found.select("id", "row", "spans", "near", "terms", F.array_except("all", "terms").alias("inner")), "spans")


def _entities(texts: DataFrame) -> DataFrame:
    """(row, entity, level, words, beside), once a text and entity: the words that a value (level 0) is made of, and the terms near it."""
    near = texts.select("row", F.explode("near").alias("n")).select("row", "n.kind", "n.value", "n.terms")
    level = lambda number, *of: F.struct(F.concat_ws(":", F.lit(number), *of).alias("entity"), F.lit(number).alias("level"))
    levels = F.array(level(0, "kind", "value"), level(1, "kind", _group(F.col("kind"), F.col("value"))), level(2, "kind"))
    each = near.select("row", "value", "terms", F.explode(levels).alias("l")).withColumn("value", F.when(F.col("l.level") == 0, F.col("value")))
    once = each.groupBy("row", "l.entity", "l.level").agg(F.max("value").alias("value"), F.array_distinct(F.flatten(F.collect_set("terms"))).alias("beside"))
    return once.select("row", "entity", "level", F.regexp_extract_all("value", F.lit(_TOKEN), F.lit(0)).alias("words"), "beside")


def _near_rows(own: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts that may be in ``rows``: a broadcast of at most ``SLOTS`` numbers spares the others the exact join's shuffle."""
    slot = F.pmod("row", F.lit(SLOTS)).alias("slot")
    return own.withColumn("slot", slot).join(F.broadcast(rows.select(slot).distinct()), "slot", "left_semi").drop("slot")


def _term_counts(own: DataFrame, texts: DataFrame) -> DataFrame:
    """(term, n_term): in how many distinct texts each term is, outside personal data."""
    counts = _held(own).groupBy("term").agg(F.count("*").alias("n"))
    copies = own.groupBy("row").agg((F.count("*") - 1).alias("over")).where("over > 0")
    again = _near_rows(own, copies).groupBy("row").agg(F.min("id").alias("id"), F.min("text").alias("text")).join(copies, "row")
    over = _held(again, "over").select("term", "over").unionByName(texts.select(F.explode("inner").alias("term"), F.lit(1).cast("long").alias("over")))
    over = over.groupBy("term").agg(F.sum("over").alias("over"))
    return counts.join(over, "term", "left").select("term", (F.col("n") - F.coalesce("over", F.lit(0))).alias("n_term"))


def _pairs(own: DataFrame, texts: DataFrame, total: Column, min_support: int, generalise: float) -> DataFrame:
    """(entity, level, term, n_both, n_entity, n_term) of the pairs that have the support."""
    every = materialize(_entities(texts), "entities")
    # Counts are written before they are joined: only a join of two plain shuffles is split where a kind is in a third of all texts.
    entities = materialize(every.groupBy("entity").agg(F.count("*").alias("n_entity")), "entity_counts")
    # No term in more texts reaches ``generalise``, even if the entity is in none without it.
    most = total * F.pow(F.greatest(F.lit(2.0), total / F.col("n_entity")), F.lit(-generalise)) * (1 + 1e-9)
    most = F.least(most, F.col("n_entity") * 2.0**LEFT_BITS)
    rare = (F.col("level") == 0) & (F.col("n_entity") < min_support)
    most = F.when(rare, F.least(most, 2.0 * F.col("n_entity"))).otherwise(most)
    least = F.when(rare, F.col("n_entity")).otherwise(F.lit(min_support))
    each = every.join(entities, "entity").select("row", "entity", "level", "n_entity", rare.alias("rare"), F.when(rare, F.col("beside")).alias("beside"), "words", most.alias("most"), least.alias("least"))
    held = texts.select("row", F.explode("terms").alias("term")).join(_term_counts(own, texts), "term").withColumnRenamed("row", "h_row")
    near = F.coalesce(F.array_contains("beside", F.col("term")) & ((F.col("n_entity") > 1) | F.array_contains("words", F.col("term"))), F.lit(False))
    can = (F.col("row") == F.col("h_row")) & (F.col("n_term") <= F.col("most")) & (F.col("n_term") >= F.col("least")) & (~F.col("rare") | (F.col("n_entity") > 1) | near)
    pairs = each.join(held, can).groupBy("entity", "level", "rare", "least", "n_entity", "term", "n_term").agg(F.count("*").alias("n_both"), F.max(near).alias("near"))
    pairs = pairs.where((F.col("n_both") >= F.col("least")) & (~F.col("rare") | F.col("near"))).select("entity", "level", "term", "n_both", "n_entity", "n_term")
    written = materialize(pairs, "pairs")
    discard(every, entities)
    return written


def disclosing_terms(own: DataFrame, found: DataFrame, min_support: int = MIN_SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(term, action, disclosure) of the terms that give an entity away; action is term (generalised) or gone (removed)."""
    spark = own.sparkSession
    texts = found.where(F.size("near") > 0).groupBy("row").agg(*(F.first(c).alias(c) for c in ("near", "terms", "inner")))
    total = F.lit(float(max(2, found.select("row").distinct().count())))
    pairs = _pairs(own, texts, total, min_support, generalise)
    if pairs.isEmpty():
        return spark.createDataFrame([], "term string, action string, disclosure double")
    share, chance = F.col("n_both") / F.col("n_term"), F.col("n_entity") / total
    mutual = F.log2(share / chance)
    content = F.log2(F.greatest(F.lit(2.0), total / F.col("n_entity")))
    others = F.when(share < 1, (F.col("n_term") - F.col("n_both")) * F.log2((1 - share) / (1 - chance))).otherwise(0.0)
    sure = F.when(F.col("level") == 0, (F.col("n_entity") >= min_support) | (share >= 0.5)).otherwise((share > chance) & (F.col("n_both") * mutual + others >= SURE_BITS))
    scored = pairs.where(sure & (share >= 2.0**-LEFT_BITS)).groupBy("term").agg(F.max(mutual / content).alias("disclosure")).where(F.col("disclosure") >= generalise)
    terms = materialize(scored.select("term", F.when(F.col("disclosure") >= remove, "gone").otherwise("term").alias("action"), "disclosure"), "terms")
    discard(pairs)
    return terms


def _held(own: DataFrame, *more: str) -> DataFrame:
    """(id, row, more.., term): the distinct terms of each text."""
    return own.select("id", "row", *more, F.explode(_terms(F.col("text"))).alias("term"))


def _term_spans(own: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, row, extra): places of disclosing terms in the texts that hold any."""
    slot = F.pmod(F.xxhash64("term"), F.lit(SLOTS)).alias("slot")
    # A broadcast of at most ``SLOTS`` numbers; what it lets through is joined by the terms themselves.
    held = _held(own).withColumn("slot", slot).join(F.broadcast(terms.select(slot).distinct()), "slot", "left_semi")
    hits = held.join(terms.select("term", "action"), "term").groupBy("id", "row", "action").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    hits = materialize(hits.withColumnRenamed("id", "h_id").withColumnRenamed("row", "h_row"), "held")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    placed = _near_rows(own, hits.select(F.col("h_row").alias("row"))).join(hits, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("row") == F.col("h_row"))).select("id", "row", "action", "text", pattern.alias("pattern"))
    placed = placed.withColumn("spans", matches(F.col("text"), F.col("pattern"), "term"))
    spans = F.transform("spans", lambda s: F.struct(F.col("action").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return placed.select("id", "row", spans.alias("spans")).groupBy("id", "row").agg(F.flatten(F.collect_set("spans")).alias("extra"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """(id, row, spans, extra): base spans and disclosing terms of every text; ``row`` is a hash of the text."""
    own, found = find_base(docs, id_col, text_col)
    terms = disclosing_terms(own, found, **limits)
    found = found.select("id", "row", "spans")
    none = F.array().cast(SPAN)
    if terms.isEmpty():
        return found.withColumn("extra", none)
    extra = _term_spans(own, terms).withColumnRenamed("id", "e_id").withColumnRenamed("row", "e_row")
    joined = found.join(extra, F.col("id").eqNullSafe(F.col("e_id")) & (F.col("row") == F.col("e_row")), "left")
    return joined.select("id", "row", "spans", F.coalesce(_free(F.col("extra"), F.col("spans")), none).alias("extra"))


def _ordered(spans: Column, own: Column | None = None) -> Column:
    """Spans by start, then longest first, as structs (start, less, end, kind, value, own)."""
    own = F.lit(True) if own is None else own
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), own.alias("own"))))


def _free(extra: Column, spans: Column) -> Column:
    """The extra spans that overlap no base span, by start."""
    last = F.lit(2**31 - 1)

    def of_all(every: Column) -> Column:
        before = running(F.transform(every, lambda s: F.when(s["own"], F.lit(0)).otherwise(s["end"])), F.lit(0), lambda a, b: F.greatest(a, b))
        after = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(s["own"], last).otherwise(s["start"]))), last, lambda a, b: F.least(a, b)))
        return let(before, lambda b: let(after, lambda a: F.filter(every, lambda s, i: s["own"] & (F.get(b, i) <= s["start"]) & (F.get(a, i + 1) >= s["end"]))))

    both = F.array_sort(F.concat(_ordered(extra), _ordered(spans, F.lit(False))))
    plain = lambda xs: F.transform(xs, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return plain(F.when(F.size(spans) == 0, _ordered(extra)).otherwise(let(both, of_all)))


def listed(spans: Column, kind: Column | None = None) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"] if kind is None else kind, s["start"], s["end"])), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): one row per row of ``docs``."""
    found = find_pii(docs, id_col, text_col, **limits)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE]
    base = listed(F.col("spans"))
    every = F.when(F.size("extra") == 0, base).otherwise(F.concat_ws(",", F.when(F.size("spans") > 0, base), listed(F.col("extra"), F.lit("term"))))
    return found.select(F.col("id").alias("doc_id"), *counts, base.alias("base"), every.alias("spans"))


def _rewritten(text: Column, spans: Column, placeholders: dict[str, str] = PLACEHOLDERS) -> Column:
    """The text with each span replaced by its kind's placeholder; of overlapping spans the first, then longest, counts."""

    def mark(s: Column) -> Column:
        out = F.lit("")
        for kind, word in placeholders.items():
            out = F.when(s["kind"] == kind, F.lit(word)).otherwise(out)
        return out

    def of_parts(parts: Column, ordered: Column, at: Column) -> Column:
        one = lambda s, i: F.when(s["start"] >= F.get(at, i), F.concat(between(parts, F.get(at, i), s["start"]), mark(s)))
        # What is left after the last span begins at the furthest end.
        return F.concat(F.array_join(F.transform(ordered, one), ""), between(parts, F.element_at(at, -1), F.length(text)))

    ends = lambda ordered: running(F.transform(ordered, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
    return let(parted(text), lambda parts: let(_ordered(spans), lambda ordered: let(ends(ordered), lambda at: of_parts(parts, ordered, at))))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: float) -> DataFrame:
    """``docs`` with personal data and disclosing terms replaced in the text column; other columns as they are."""
    spans = find_pii(docs, id_col, text_col, **limits)
    spans = spans.where((F.size("spans") > 0) | (F.size("extra") > 0)).select(F.col("id").alias("_quern_id"), F.col("row").alias("_quern_row"), F.concat("spans", "extra").alias("_quern_spans")).dropDuplicates(["_quern_id", "_quern_row"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.join(spans, docs[id_col].eqNullSafe(spans["_quern_id"]) & (F.xxhash64(text) == spans["_quern_row"]), "left")
    return joined.withColumn(text_col, F.when(F.col("_quern_spans").isNull(), F.col(text_col)).otherwise(_rewritten(text, F.col("_quern_spans")))).select(*docs.columns)
