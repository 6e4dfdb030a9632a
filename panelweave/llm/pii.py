"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans; validators confirm them (number ranges, digit counts, Luhn for
cards, mod 97 for IBANs); words nearby raise the score. The base kinds stay whatever their score;
the kinds of this method's own (``iban``, ``ssn``, ``local_phone``) need a score of MIN_SCORE and
give way to a base span that they touch.

Spans count code points, end exclusive. Everything happens inside a row: nothing moves between
tasks, and the work on a text grows in proportion to its length.

Defined cases: a null text is an empty one and has no spans. Rows with any id, repeated or null,
are treated each for itself; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import let, running

MIN_SCORE = 0.5
BEFORE, AFTER = 48, 24  # code points of context


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    # A text without this has no match; None: always look.
    trigger: str | None
    score: float
    context: str
    boost: float
    base: bool


# The first four patterns find what the plain ones in the comments find. Possessive repeats and a
# start that must not follow a character of the same run (unless a match has just ended there) only
# take away repeated attempts and deep recursion on long runs.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"e-?mail|contact|write|mailto", 0.1, True),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"ip|address|server|host|client|login", 0.3, True),
    # [0-9]([\x20-]?[0-9])+, 14 to 19 digits passing Luhn
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", None, 0.7, r"card|visa|master|amex|credit|debit|pay", 0.3, True),
    # \+[0-9][\x20().0-9-]+[0-9], 10 to 15 digits
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, r"call|phone|tel|fax|mobile|cell", 0.3, True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])", None, 0.8, r"iban|bank|account|konto|compte|cuenta", 0.2, False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", 0.3, r"ssn|social|security|tax", 0.5, False),
    Kind("local_phone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])", None, 0.3, r"call|phone|tel|fax|mobile|cell", 0.4, False),
)
BASE = tuple(k.name for k in KINDS if k.base)

SPANS = "array<struct<start:long,rank:int,kind:string,end:long,score:double>>"


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, digits of the products summed; divisible by ten."""

    def total(rev: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            d = F.substring(rev, i, F.lit(1)).cast("int")
            return s + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

        return F.aggregate(F.sequence(F.lit(1), F.char_length(rev)), F.lit(0), add)

    return let(F.reverse(digits), total) % 10 == 0


def _mod97(iban: Column) -> Column:
    """The four leading characters moved to the end, letters as 10 to 35: the number leaves 1."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(r: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return let(digits, lambda d: F.char_length(d).between(14, 19) & _luhn(d))
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    if kind == "iban":
        return _mod97(match)
    return F.lit(True)


def _spans_of(kind: Kind, rank: int, text: Column) -> Column:
    """Valid spans of one kind.

    A match's place follows from the lengths of the matches and of the pieces between them, so
    texts are cut at the matches, and only texts that have some.
    """

    def placed(found: Column) -> Column:
        pieces = F.split(text, kind.pattern, -1)

        def items(ps: Column) -> Column:
            return F.transform(found, lambda m, i: F.struct(
                m.alias("m"), F.char_length(F.get(ps, i)).alias("gap"), F.char_length(m).alias("n"),
                F.lower(F.concat_ws(" ", F.substring(F.get(ps, i), -BEFORE, BEFORE), F.substring(F.get(ps, i + 1), 1, AFTER))).alias("near"),
            ))

        def spans(xs: Column) -> Column:
            before = running(xs, lambda x: x["gap"] + x["n"])
            both = F.zip_with(xs, before, lambda x, b: F.struct(x.alias("x"), (b + x["gap"]).alias("start")))
            good = F.filter(both, lambda y: _valid(kind.name, y["x"]["m"]))
            return F.transform(good, lambda y: F.struct(
                y["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), (y["start"] + y["x"]["n"]).alias("end"),
                (F.lit(kind.score) + F.when(y["x"]["near"].rlike(rf"\b(?:{kind.context})"), kind.boost).otherwise(0.0)).alias("score"),
            )).cast(SPANS)

        return F.when(F.size(found) > 0, let(let(pieces, items), spans)).otherwise(F.array().cast(SPANS))

    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), 0), placed)
    return F.when(F.contains(text, F.lit(kind.trigger)), found).otherwise(F.array().cast(SPANS)) if kind.trigger else found


def find_spans(text: Column) -> Column:
    """All spans of a text, ordered by start and then by kind as in KINDS."""

    def whole(t: Column) -> Column:
        base = F.concat(*[_spans_of(k, i, t) for i, k in enumerate(KINDS) if k.base])
        own = F.concat(*[_spans_of(k, i, t) for i, k in enumerate(KINDS) if not k.base])

        def merged(s: Column) -> Column:
            clear = lambda x: ~F.exists(s["base"], lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
            extra = F.filter(s["own"], lambda x: (x["score"] >= MIN_SCORE) & clear(x))
            return F.array_sort(F.concat(s["base"], extra))

        return let(F.struct(base.alias("base"), own.alias("own")), merged)

    return let(F.coalesce(text, F.lit("")), whole)


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span (or group of overlapping ones) replaced by its kind in brackets."""

    def whole(x: Column) -> Column:
        cut = lambda a, b: F.decode(F.substring(x["raw"], a * 4 + 1, (b - a) * 4), "UTF-32")

        def put(s: Column, reached: Column) -> Column:
            return F.when(s["start"] >= reached, F.concat(cut(reached, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        reached = running(x["spans"], lambda s: s["end"], F.greatest)
        last = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(F.zip_with(x["spans"], reached, put), ""), cut(last, F.char_length(text).cast("long")))

    given = F.struct(F.encode(text, "UTF-32").alias("raw"), spans.alias("spans"))
    return F.when(F.size(spans) > 0, let(given, whole)).otherwise(text)


def with_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    return docs.withColumn(spans, find_spans(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; a null text stays null."""
    return docs.withColumn(text, let(find_spans(F.col(text)), lambda s: redacted(F.col(text), s)))


def op3(docs: DataFrame) -> DataFrame:
    def said(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def digest(s: Column) -> Column:
        base = F.filter(s, lambda x: x["rank"] < len(BASE))
        counts = [F.size(F.filter(s, lambda x: x["rank"] == F.lit(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]  # noqa: B023
        added = F.size(F.filter(s, lambda x: x["rank"] >= len(BASE))).cast("long").alias("n_added")
        score = F.coalesce(F.array_max(F.transform(s, lambda x: x["score"])), F.lit(0.0)).alias("top_score")
        return F.struct(*counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(s).alias("spans"), added, score)

    return docs.select("doc_id", let(find_spans(F.col("text")), digest).alias("d")).select("doc_id", "d.*")
