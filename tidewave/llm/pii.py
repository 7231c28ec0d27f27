"""Operator 6: personal data, found with DataFrame expressions only.

Regular expressions propose spans; checksum validators (Luhn for cards, mod-97
for IBANs) and range checks confirm them; whole words near a span, before or behind
it, adjust its score.
Kinds ``email ip card phone`` are kept whenever they validate. Two kinds are
added by the method: ``iban`` (mod-97 must hold) and ``ssn`` (no checksum, so
it needs a context word to reach the score threshold).

Null text counts as empty; texts of any length are searched whole. Offsets are
code points, end exclusive. Rows are independent, so repeated rows give repeated
results; an empty table gives none. Further columns pass through whatever their
names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.llm.common import unused


@dataclass(frozen=True)
class Kind:
    """How one kind is proposed and confirmed. Quantifiers are possessive where
    nothing could be given back, so that long runs neither recurse nor backtrack."""

    name: str
    pattern: str
    context: str
    score: float
    base: bool = True


#: The base kinds in the order in which they are listed in results.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "e-?mail|mail|contact|write", 0.9),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "ip|address|host|server", 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "card|visa|credit|payment", 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "phone|call|tel|mobile|fax", 0.7),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", "iban|account|bank|konto", 0.8, base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "ssn|social|security|tax", 0.3, base=False),
)
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.3
KEEP_SCORE = 0.5
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an IBAN's rearranged digits leave 1 when divided by 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return mod97(found)
    return F.lit(True)


_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _spans(text: Column, found: Column, gaps: Column, rank: int, kind: Kind) -> Column:
    """Confirmed spans of one kind, from its matches and the text between them."""
    empty = F.array().cast("array<struct<start:int,found:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def place(acc: Column, i: Column) -> Column:
        begin = acc["at"] + F.length(F.element_at(gaps, i))
        m = F.element_at(found, i)
        return F.struct((begin + F.length(m)).alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), m.alias("found")))).alias("out"))

    placed = F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(1), F.size(found)), start, place, lambda acc: acc["out"])).otherwise(empty)

    def scored(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0)) + 1, F.least(x["start"], F.lit(CONTEXT_CHARS)))
        behind = F.substring(text, x["start"] + F.length(x["found"]) + 1, F.lit(CONTEXT_CHARS))
        near = F.lower(F.concat(before, F.lit("\n"), behind)).rlike(rf"(?<!\p{{L}})(?:{kind.context})s?(?!\p{{L}})")
        score = F.round(F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0.0), 2)
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["found"])).alias("end"), F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score")).cast(_SPAN)

    return F.transform(F.filter(placed, lambda x: _confirmed(kind.name, x["found"])), scored)


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: array of struct(start, rank, end, kind, score), by start and kind.

    Every whole text is searched. Base kinds stay whatever their score; the
    added kinds need ``KEEP_SCORE``.
    """
    own = unused("__pii_text", docs.columns)
    match, gap = ([unused(f"__pii_{c}{i}", docs.columns) for i in range(len(KINDS))] for c in "mg")
    df = docs.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({match[i]: F.regexp_extract_all(own, F.lit(k.pattern), F.lit(0)) for i, k in enumerate(KINDS)})
    df = df.withColumns({gap[i]: F.when(F.size(match[i]) > 0, F.split(own, k.pattern, -1)) for i, k in enumerate(KINDS)})
    each = []
    for i, k in enumerate(KINDS):
        spans = _spans(F.col(own), F.col(match[i]), F.col(gap[i]), i, k)
        each.append(spans if k.base else F.filter(spans, lambda x: x["score"] >= KEEP_SCORE))
    df = df.withColumn(out, F.array_sort(F.concat(*each)))
    return df.drop(own, *match, *gap)


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``<KIND>``; overlapping spans by the first one's.

    Texts without findings, and null texts, stay as they are.
    """
    own = unused("__pii_found", docs.columns)
    df = find(docs, text, own)
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col(text), acc["at"] + 1, x["start"] - acc["at"])
        put = F.array(gap, F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], put)).otherwise(acc["out"]).alias("out"))

    def join(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.length(F.col(text))))

    clean = F.aggregate(own, first, step, join)
    return df.withColumn(text, F.when(F.size(own) > 0, clean).otherwise(F.col(text))).drop(own)


def report(docs: DataFrame) -> DataFrame:
    """The per-document digest: counts of base kinds, hash of base spans, all spans, scores."""
    base = [k.name for k in KINDS if k.base]
    df = find(docs.select("doc_id", "text")).drop("text")
    df = df.withColumn("base", F.filter("pii", lambda x: x["kind"].isin(base)))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    return df.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("pii")).alias("spans"),
        F.size("pii").cast("long").alias("n_spans"),
        F.array_join(F.transform("pii", lambda x: F.format_string("%.2f", x["score"])), ",").alias("scores"),
    )
