"""Personal data spans, with DataFrame functions only.

Method: regular expressions propose spans, checksum validators (Luhn for
cards, mod 97 for account numbers) and range rules confirm them, and words
near a span adjust its score. Base spans are kept whatever their score; the
score decides about the proposals that this operator adds: account numbers
(``iban``) whose checksum holds, whatever follows them, and numbers in national phone notation
(``local_phone``), which count only where a context word raises them to
``LEAST_SCORE``.

Positions come from two native functions: what ``split`` leaves between the
matches and what ``regexp_extract_all`` gives as matches alternate, so
running lengths of both are the offsets. Arrays are built in blocks and
pieces of a text are taken from chunks of it, so the work on a text follows its
length and its number of matches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh


class Kind(NamedTuple):
    """``pattern`` proposes; it is written without backtracking so that long runs cost linear time."""

    name: str
    pattern: str
    context: str
    base_score: float


# The base kinds, in the order in which they are listed. Each
# pattern matches exactly where the plain one in ``PLAIN`` does and where a
# match can pass its validator; possessive runs and the look-behinds only
# save the retries inside one run.
EMAIL = Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "mail|contact|write|schreib|correo", 0.9)
IP = Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "address|host|server|login|ip", 0.7)
CARD = Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", "card|visa|credit|karte|carte|tarjeta", 0.8)
PHONE = Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "call|phone|tel|fax|mobile|anruf", 0.8)
BASE = (EMAIL, IP, CARD, PHONE)
# The kinds that the method adds.
IBAN = Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})", "iban|account|bank|konto|compte|cuenta", 0.8)  # the head alone, see _accounts
LOCAL_PHONE = Kind("local_phone", r"(?<![0-9A-Za-z+().-])(?<![0-9+).-] )\(?0?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])(?![ .-][0-9])", "call|phone|tel|fax|mobile|anruf", 0.3)
ADDED = (IBAN, LOCAL_PHONE)
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Characters of an account number without spaces, and the usual number by country.
ACCOUNT_SIZES = (15, 34)
_USUAL = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
    "JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()

#: Code points before and after a span in which context words count.
NEARBY = 40
CONTEXT_BONUS = 0.4
LEAST_SCORE = 0.6


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    digits = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(digits, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod_97(account: Column) -> Column:
    """Whether an account number without spaces has remainder 1, its first four characters moved to the end."""
    turned = F.concat(F.substring(account, 5, 100), F.substring(account, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(value < 10, 10).otherwise(100) + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)(?:\.|$)){4}$")
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "local_phone":
        return F.length(_digits(match)).between(9, 11)
    return F.lit(True)


#: Items that are appended to one array before a new one begins, and code points of a chunk.
BLOCK, CHUNK = 128, 256
_SPAN = "struct<start:int,end:int,match:string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _fold(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """struct<at, out>: a running position from 0 and what each step gives out, in order.

    ``step(at, item)`` is (the new position, whether to give out, what). An
    aggregation copies all that it carries at every item: the one over blocks
    carries positions alone, and each block then gives out from its own.
    """

    def one(acc: Column, x: Column) -> Column:
        at, emit, what = step(acc["at"], x)
        return F.struct(at.cast("int").alias("at"), F.when(emit, F.concat(acc["out"], F.array(what))).otherwise(acc["out"]).alias("out"))

    def onward(acc: Column, block: Column) -> Column:
        after = F.aggregate(block, acc["at"], lambda at, x: step(at, x)[0].cast("int"))
        return F.struct(after.alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins"))

    def folded(blocks: Column, places: Column) -> Column:
        none = F.array().cast(f"array<{kind}>")
        out = F.transform(blocks, lambda block, k: F.aggregate(block, F.struct(places["begins"][k].alias("at"), none.alias("out")), one, lambda acc: acc["out"]))
        return F.struct(places["at"].alias("at"), F.flatten(out).alias("out"))

    def placed(blocks: Column) -> Column:
        places = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")), onward)
        return _let(places, lambda p: folded(blocks, p))

    def dealt(items: Column) -> Column:
        last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))

    return _let(_let(items, dealt), placed)


def chunks_of(text: Column) -> Column:
    """The text in chunks of ``CHUNK`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _piece(chunks: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of the text, at a cost that does not depend on the place."""
    first = F.floor(start / CHUNK).cast("int")
    several = F.floor((F.greatest(end, start + 1) - 1) / CHUNK).cast("int") - first + 1
    return F.when(end > start, F.substring(F.array_join(F.slice(chunks, first + 1, several), ""), start - first * CHUNK + 1, end - start)).otherwise(F.lit(""))


def _accounts(chunks: Column, heads: Column) -> Column:
    """Account numbers (array of ``_SPAN``) that begin at some heads and whose checksum holds, none inside another.

    Capitals and digits may follow a number, so each prefix of allowed size
    that ends where a word does is tested: the country's usual size counts
    first, then the longest.
    """
    least, most = ACCOUNT_SIZES
    usual = F.create_map(*(F.lit(x) for u in _USUAL for x in (u[:2], int(u[2:]))))

    def account(window: Column) -> Column:
        prefixes = F.transform(
            F.sequence(F.lit(least), F.lit(most)),
            lambda n: F.struct(
                F.coalesce(F.try_element_at(usual, F.substring(window, 1, 2)) == n, F.lit(False)).alias("usual"),
                n.alias("size"),
                F.regexp_substr(window, F.concat(F.lit("^[A-Z0-9](?: ?[A-Z0-9]){"), (n - 1).cast("string"), F.lit("}(?![A-Za-z0-9])"))).alias("match"),
            ),
        )
        return F.array_max(F.filter(prefixes, lambda p: p["match"].isNotNull() & mod_97(F.replace(p["match"], F.lit(" "), F.lit("")))))["match"]

    window = lambda s: _piece(chunks, s["start"], s["start"] + 2 * most)  # noqa: E731  with the spaces, and the character after it
    tried = F.filter(F.transform(heads, lambda s: F.struct(s["start"].alias("start"), _let(window(s), account).alias("match"))), lambda s: s["match"].isNotNull())

    def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
        end, free = s["start"] + F.char_length(s["match"]), s["start"] >= at
        return F.when(free, end).otherwise(at), free, F.struct(s["start"].alias("start"), end.alias("end"), s["match"].alias("match"))

    return _fold(tried, _SPAN, step)["out"]


def _spans(text: Column, chunks: Column, kind: Kind) -> Column:
    """array<struct<kind,start,end,score>> of one kind's confirmed proposals, by start."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.char_length(g))

    def step(at: Column, x: Column) -> tuple[Column, Column, Column]:
        start = at + x["g"]
        end = start + F.coalesce(F.char_length(x["m"]), F.lit(0))
        return end, x["m"].isNotNull(), F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"))

    at = _fold(F.arrays_zip(matches.alias("m"), gaps.alias("g")), _SPAN, step)["out"]
    if kind.name == "iban":
        at = _accounts(chunks, at)
    return F.transform(
        F.filter(at, lambda s: _valid(kind.name, s["match"])),
        lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _score(chunks, kind, s).alias("score")),
    )


def _score(chunks: Column, kind: Kind, s: Column) -> Column:
    """The kind's own score, raised where a context word stands nearby."""
    around = F.concat(_piece(chunks, F.greatest(s["start"] - NEARBY, F.lit(0)), s["start"]), F.lit(" "), _piece(chunks, s["end"], s["end"] + NEARBY))
    return F.least(F.lit(1.0), F.lit(kind.base_score) + F.when(around.rlike(rf"(?i)\b(?:{kind.context})"), CONTEXT_BONUS).otherwise(0.0))


#: What a text must hold for a kind to be looked for at all.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]", "local_phone": r"[0-9]{2}\)?[ .-][0-9]{3}"}


def with_spans(docs: DataFrame, text_col: str = "text", column: str = "__pii") -> DataFrame:
    """``docs`` and an array<struct<kind,start,end,score>> column of all spans.

    Spans are ordered by kind as listed (base kinds first), then by start;
    positions count code points, ends are exclusive. Added spans never
    overlap a base span. A null text has no spans; one row comes back for
    each input row, all other columns as they are; a column named ``column``
    is replaced.
    """
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    hints = {k.name: text.contains("@") if k.name == "email" else text.rlike(_HINT[k.name]) for k in (*BASE, *ADDED)}

    def found(chunks: Column) -> Column:
        base, added = (reduce(lambda a, b: F.concat(a, b), [F.when(hints[k.name], _spans(text, chunks, k)).otherwise(none) for k in kinds]) for kinds in (BASE, ADDED))
        return F.struct(base.alias("base"), added.alias("added"))

    any_hint = reduce(lambda a, b: a | b, hints.values())
    held = F.when(any_hint, _let(chunks_of(text), found)).otherwise(F.struct(none.alias("base"), none.alias("added")))

    def together(h: Column) -> Column:
        free = F.filter(h["added"], lambda s: (s["score"] >= LEAST_SCORE) & ~F.exists(h["base"], lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))
        return F.when(F.size(h["added"]) == 0, h["base"]).otherwise(F.concat(h["base"], free))

    return docs.withColumn(column, _let(held, together))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row for each input row, see ``with_spans``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_spans(source).select("doc_id", F.col("__pii").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of ``text_col`` replaced by its kind in brackets.

    Overlapping spans are replaced together, under the kind of the first.
    Rows without spans, nulls included, come back as they are.
    """
    column = fresh(docs, "__pii")
    held = with_spans(docs, text_col, column)
    text, spans = F.col(text_col), F.col(column)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
        return F.greatest(at, s["end"]), s["start"] >= at, F.struct(at.alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))

    def replaced(chunks: Column, done: Column) -> Column:
        parts = F.transform(done["out"], lambda o: F.concat(_piece(chunks, o["from"], o["to"]), F.lit("["), F.upper(o["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), _piece(chunks, done["at"], F.char_length(text)))

    both = F.struct(chunks_of(text).alias("chunks"), _fold(ordered, "struct<from:int,to:int,kind:string>", step).alias("done"))
    redacted = F.when(F.size(spans) == 0, text).otherwise(_let(both, lambda x: replaced(x["chunks"], x["done"])))
    return held.withColumn(text_col, redacted).drop(column)
