"""Personal data and terms that give it away (operator 11), in DataFrame operations only.

1. Base spans: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers, each kind's
   matches leftmost and non-overlapping over the whole text; matches that fail their check are dropped.
   Patterns begin only where a match of their kind can begin and give nothing back, so that no text
   takes quadratic time.
2. Every base value is a protected entity e. Its neighbourhoods are the ``reach`` words (runs of letters
   and digits) on either side of its occurrences, up to the next one.
3. With N words in the corpus, f(t) occurrences of a term t, n(e) of an entity, n(t, e) of t in a
   neighbourhood of e: the information of e is log2(N / n(e)), the pointwise mutual information
   log2(N n(t, e) / (f(t) n(e))), and a term's disclosure is their ratio, so 1 if t stands only near e.
   All texts count. Pairs seen in fewer than ``contexts`` different neighbourhoods tell nothing (a passage
   that was copied is one neighbourhood), so their disclosure is 0.
4. In the neighbourhoods of e, terms whose disclosure is ``remove`` or more are removed, those of
   ``generalise`` or more replaced by their class ([NAME], [NUMBER], [WORD]); both become ``term`` spans.
   Base spans become [EMAIL], [IP], [CARD], [PHONE].

Positions are code points from 0, the end exclusive. All of a row's spans are found inside the row.
Shuffled are neighbourhoods, the corpus' term counts, and pairs; a hot entity's rows are counted before
they are shuffled and are joined over ``SALTS`` parts. Nothing is broadcast by force or collected but N.

Defined results: null and empty texts have no spans and stay as they are; null ids are kept; rows that
repeat id and text have equal results; base spans of several kinds may overlap (all are listed, the
sanitised text replaces what they cover once); an empty table gives no rows; other columns are not
read and not returned.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import bound, stored

#: The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LONG_CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
WORD = r"[\p{L}\p{N}]++"
#: Code points of a piece of text from which parts are cut, and values whose sum is kept.
CHUNK, BLOCK = 4096, 64
SALTS = 16
SPAN = "struct<start: bigint, kind_no: int, end: bigint, kind: string, action: string>"


@dataclass(frozen=True)
class Settings:
    reach: int = 10
    contexts: int = 3
    remove: float = 0.9
    generalise: float = 0.8


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Per value the ``step`` total (from 0) of all before it. Totals of blocks are kept, so an array of
    n values takes n (``BLOCK`` + n / ``BLOCK`` ** 2) steps."""
    zero = F.lit(0).cast("bigint")

    def all_before(v: Column, totals: Column) -> Column:
        return F.transform(v, lambda _, i: F.aggregate(
            F.slice(v, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), F.get(totals, F.floor(i / BLOCK).cast("int")), step))

    def totals(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int"))
        return F.transform(numbers, lambda j: F.aggregate(F.slice(v, j * BLOCK + 1, BLOCK), zero, step))

    return bound(values, lambda v: bound(totals(v), lambda t: bound(
        F.transform(t, lambda _, j: F.aggregate(F.slice(t, F.lit(1), j), zero, step)), lambda p: all_before(v, p))))


def placed(text: Column, pattern: str) -> Column:
    """All matches as (start, end, value), in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))
    return bound(F.struct(found.alias("found"), gaps.alias("gaps")), lambda m: bound(
        running(F.transform(m["found"], lambda x, i: F.get(m["gaps"], i) + F.length(x)), lambda a, x: a + x),
        lambda before: F.transform(m["found"], lambda x, i: F.struct(
            (F.get(before, i) + F.get(m["gaps"], i)).alias("start"),
            (F.get(before, i) + F.get(m["gaps"], i) + F.length(x)).alias("end"), x.alias("value")))))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_ip(value: Column) -> Column:
    return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")


def is_card(value: Column) -> Column:
    """14 to 19 digits; from the right every second one doubled, their digits' sum is a multiple of 10."""
    digits = F.transform(F.split(F.reverse(digits_of(value)), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    luhn = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)),
                       F.lit(0), lambda a, d: a + d)
    return F.length(digits_of(value)).between(14, 19) & (luhn % 10 == 0)


def is_phone(value: Column) -> Column:
    return F.length(digits_of(value)).between(10, 15)


def base_spans(text: Column) -> Column:
    """Spans of the four kinds by start, then kind."""
    checks = {"email": (EMAIL, text.contains("@"), lambda v: F.lit(True)),
              "ip": (IP, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), is_ip),
              "card": (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), is_card),
              "phone": (PHONE, text.contains("+"), is_phone)}
    none = F.array().cast(f"array<{SPAN}>")

    def of_kind(kind: str, pattern: str, check: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(placed(text, pattern), lambda m: check(m["value"])), lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), m["end"].alias("end"),
            F.lit(kind).alias("kind"), F.lit("replace").alias("action")))

    each = [F.when(may_hold, of_kind(kind, pattern, check)).otherwise(none) for kind, (pattern, may_hold, check) in checks.items()]
    return F.coalesce(F.array_sort(F.concat(*each)), none)


def entity(value: Column) -> Column:
    """kind:value without its ways of writing, null if no kind's check holds."""
    return (F.when(value.contains("@"), F.concat(F.lit("email:"), F.lower(value)))
            .when(value.startswith("+"), F.when(is_phone(value), F.concat(F.lit("phone:"), digits_of(value))))
            .when(is_ip(value), F.concat(F.lit("ip:"), value))
            .when(is_card(value), F.concat(F.lit("card:"), digits_of(value))))


def neighbourhoods(text: Column, reach: int) -> Column:
    """Per entity occurrence (entity, context, terms (term, start, end)); ``context`` is a hash of the
    words around it."""
    pattern = "|".join((EMAIL, IP, PHONE, LONG_CARD))
    head = rf"^(?:[^\p{{L}}\p{{N}}]*+{WORD}){{0,{reach}}}"

    def near(m: Column, i: Column) -> Column:
        match = F.get(m["matches"], i)
        before = F.reverse(F.regexp_extract(F.reverse(F.get(m["pieces"], i)), head, 0))
        after = F.regexp_extract(F.get(m["pieces"], i + 1), head, 0)
        return bound(F.struct(match.alias("m"), (match["start"] - F.length(before)).alias("low"), before.alias("before"), after.alias("after")), words)

    def words(n: Column) -> Column:
        def terms(side: Column, low: Column) -> Column:
            return F.transform(placed(side, WORD), lambda w: F.struct(
                F.lower(w["value"]).alias("term"), w["value"].alias("shown"), (low + w["start"]).alias("start"), (low + w["end"]).alias("end")))

        left, right = terms(n["before"], n["low"]), terms(n["after"], n["m"]["end"])
        return bound(F.struct(left.alias("left"), right.alias("right")), lambda s: F.struct(
            entity(n["m"]["value"]).alias("entity"),
            F.xxhash64(F.transform(s["left"], lambda w: w["term"]), F.lit("|"), F.transform(s["right"], lambda w: w["term"])).alias("context"),
            F.concat(s["left"], s["right"]).alias("terms")))

    both = F.struct(placed(text, pattern).alias("matches"), F.split(text, pattern, -1).alias("pieces"))
    return bound(both, lambda m: F.transform(m["matches"], lambda _, i: near(m, i)))


def row_key(docs: DataFrame) -> DataFrame:
    """doc_id, text, base spans, and a 128-bit mark of the text; rows of equal id and text are alike."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", "text", base_spans(F.col("text")).alias("base"), F.xxhash64("text").alias("x"), F.xxhash64(F.lit("mark"), "text").alias("y"))


def occurrences(rows: DataFrame, s: Settings) -> DataFrame:
    """One row per entity occurrence of the rows of ``row_key``."""
    near = rows.where(F.size("base") > 0).select("doc_id", "x", "y", F.explode(neighbourhoods(F.col("text"), s.reach)).alias("n"))
    return near.where("n.entity is not null").select("doc_id", "x", "y", "n.*")


def disclosures(docs: DataFrame, near: DataFrame, s: Settings) -> DataFrame:
    """entity, term, disclosure of the pairs above the lower threshold. ``docs`` is the whole corpus."""
    words = docs.select(F.explode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[^\p{L}\p{N}]+")).alias("word"))
    counts = stored(words.where("word <> ''").groupBy(F.lower("word").alias("term")).agg(F.count("*").alias("f")), "term-counts")
    total = counts.agg(F.sum("f")).first()[0] or 0
    known = near.groupBy("entity").agg(F.count("*").alias("n"))
    by_context = near.select("entity", "context", F.explode("terms.term").alias("term")).groupBy("entity", "term", "context").agg(F.count("*").alias("c"))
    pairs = by_context.groupBy("entity", "term").agg(F.sum("c").alias("c"), F.count("*").alias("contexts")).where(F.col("contexts") >= s.contexts)
    information = F.log2(F.lit(float(total)) / F.col("n"))
    share = F.least(F.lit(1.0), F.col("c") / F.col("f"))
    return pairs.join(counts, "term").join(known, "entity").where(information > 0).select(
        "entity", "term", (1 + F.log2(share) / information).alias("disclosure")).where(F.col("disclosure") >= s.generalise)


def find_spans(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, text (as it was) and all spans (start, end, kind, action), by
    start, then kind."""
    s = s or Settings()
    rows = row_key(docs)
    near = stored(occurrences(rows, s), "neighbourhoods")
    known = stored(disclosures(docs, near, s), "disclosures")
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    terms = near.select("doc_id", "x", "y", "entity", F.explode("terms").alias("w"), F.pmod(F.xxhash64("doc_id", "x"), F.lit(SALTS)).cast("int").alias("salt"))
    terms = terms.withColumn("term", F.col("w.term")).join(salted, ["entity", "term", "salt"])
    own = ["doc_id", "x", "y"]
    told = terms.groupBy(*own, F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.col("w.shown").alias("shown")).agg(F.max("disclosure").alias("d"))
    shape = (F.when(F.col("shown").rlike(r"^\p{N}+$"), "[NUMBER]").when(F.col("shown").rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]"))
    span = F.struct("start", F.lit(4).alias("kind_no"), "end", F.lit("term").alias("kind"), F.when(F.col("d") >= s.remove, "remove").otherwise(shape).alias("action"))
    told = told.groupBy(*own).agg(F.collect_list(span).alias("told"))  # places of one text
    told = told.select(F.col("doc_id").alias("of_id"), F.col("x").alias("of_x"), F.col("y").alias("of_y"), "told")
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("x") == F.col("of_x")) & (F.col("y") == F.col("of_y"))
    held = rows.where(F.size("base") > 0).join(told, same, "left").select(
        "doc_id", "text", F.array_sort(F.concat("base", F.coalesce("told", F.array().cast(f"array<{SPAN}>")))).alias("spans"))
    return held.unionByName(rows.where(F.size("base") == 0).select("doc_id", "text", F.col("base").alias("spans")))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced as its action says; what several spans cover is replaced once."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def between(c: Column, a: Column, b: Column) -> Column:
        cut = F.transform(F.sequence(F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")), lambda j: F.substr(
            F.get(c, j), (F.greatest(a - j * CHUNK, F.lit(0)) + 1).cast("int"), (F.least(b - j * CHUNK, F.lit(CHUNK)) - F.greatest(a - j * CHUNK, F.lit(0))).cast("int")))
        return F.when(b > a, F.array_join(cut, "")).otherwise("")

    def put(x: Column) -> Column:
        return (F.when(x["action"] == "replace", F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
                .when(x["action"] == "remove", "").otherwise(x["action"]))

    def parts(v: Column) -> Column:
        shown = F.transform(v["spans"], lambda x, i: F.concat(
            between(v["chunks"], F.get(v["reached"], i), x["start"]), F.when(x["end"] > F.get(v["reached"], i), put(x)).otherwise("")))
        end = F.array_max(F.transform(v["spans"], lambda x: x["end"]))
        return F.concat(F.array_join(shown, ""), between(v["chunks"], end, v["n"]))

    reached = running(F.transform(spans, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
    return F.when(F.size(spans) > 0, bound(F.struct(chunks.alias("chunks"), spans.alias("spans"), reached.alias("reached"),
                                                    F.length(text).cast("bigint").alias("n")), parts)).otherwise(text)


def sanitise(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, the sanitised text and its spans in the text as it was."""
    return find_spans(docs, s).select("doc_id", sanitised(F.col("text"), F.col("spans")).alias("text"), "spans")
