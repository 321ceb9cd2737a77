"""Personal data in texts: expressions propose spans, checks confirm them, words nearby adjust their score.

A ``Kind`` has an expression that proposes spans (leftmost, not overlapping), conditions that confirm a match (lengths, ranges,
the Luhn sum, the remainder by 97), a score of its own and the words that raise or lower it when they stand within ``NEAR``
characters (code points) of the span and no further than the next proposal of the kind. A span is reported if its score reaches ``REPORT``; spans of base kinds
are reported whenever they are confirmed. The added kinds are account numbers (IBAN), card numbers inside a longer row of
digits that fails as a whole, and local phone and tax numbers, which need a word that says so.

Where a match stands follows from splitting the text at the matches and adding up lengths. All is a projection over the input:
no shuffle, no Python. The expressions are written so that no text, however long, makes them go back over a run of characters
more than once for each character: runs are possessive and begin only where a run can begin.

Defined results: a null text is empty; a text without spans has counts of 0, the digest of the empty string and empty ``spans``;
repeated rows give repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import let

NEAR = 40
REPORT = 50
UP, DOWN = 35, 30  # what words nearby add to or take from a score

_CALL = "phone|tel|telephone|mobile|call|fax|telefon|téléphone|teléfono|handy|móvil"
_PAY = "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta"
_BANK = "iban|account|bank|konto|compte|cuenta"
_TAX = "ssn|social security|tax|taxpayer"
_MAIL = "mail|email|e-mail|contact|correo|courriel"
_NET = "ip|address|host|server|login"
_GOODS = "order|invoice|version|isbn|sku|part|serial|tracking|build"


@dataclass(frozen=True)
class Kind:
    name: str
    proposes: str
    score: int
    up: str
    confirmed: Callable[[Column, Column, Column], Column]  # of the match and the text before and after it
    base: bool = False
    down: str = _GOODS


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _long(found: Column, least: int, most: int) -> Column:
    return F.char_length(digits(found)).between(least, most)


def luhn(found: Column) -> Column:
    return F.call_function("luhn_check", digits(found))


def mod97(found: Column) -> Column:
    """Whether an account number's remainder by 97 is 1: its first four characters at the end, letters as 10 to 35."""
    plain = F.regexp_replace(found, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(rest: Column, x: Column) -> Column:
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), x) - 1
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def _octets(found: Column, *_: Column) -> Column:
    octet = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return found.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")


def _alone(before: Column, after: Column) -> Column:
    return ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")


#: The order fixes the order of spans. Base kinds are fixed by the task.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 90, _MAIL, lambda m, *_: F.lit(True), base=True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 60, _NET, _octets, base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 70, _PAY, lambda m, *_: _long(m, 13, 19) & luhn(m), base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 70, _CALL, lambda m, *_: _long(m, 9, 15), base=True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", 80, _BANK, lambda m, b, a: _alone(b, a) & F.char_length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m)),
    Kind("card_run", r"[0-9]++", 60, _PAY, lambda m, b, a: _alone(b, a) & _long(m, 13, 19) & luhn(m)),
    Kind("phone_local", r"[(0-9](?:[\x20().-]?[0-9()])++", 30, _CALL, lambda m, b, a: _alone(b, a) & ~b.rlike(r"\+$") & m.rlike(r"^(\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}$")),
    Kind("tax_id", r"[0-9](?:-?[0-9])++", 30, _TAX, lambda m, b, a: _alone(b, a) & m.rlike("^[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}$") & ~m.rlike("^(000|666)|-00-|-0000$")),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _sums(lengths: Column) -> Column:
    """Running totals of an array by doubling: n log n additions."""
    doubled = F.aggregate(
        F.sequence(F.lit(0), F.length(F.bin(F.size(lengths) - 1)) - 1), lengths,
        lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))),
    )
    return F.when(F.size(lengths) > 1, doubled).otherwise(lengths)


def spans_of(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, score>> of a kind, in order; positions in code points, the end exclusive."""

    def placed(found: Column, between: Column, ends: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            before, after = F.right(F.get(between, i), F.lit(NEAR)), F.left(F.get(between, i + 1), F.lit(NEAR))
            nearby = F.concat(before, F.lit("\n"), after)
            said = lambda words: nearby.rlike(rf"(?i)(^|[^\p{{L}}0-9])({words})([^\p{{L}}0-9]|$)")
            score = F.lit(kind.score) + F.when(said(kind.up), UP).otherwise(0) - F.when(said(kind.down), DOWN).otherwise(0)
            score = F.least(F.greatest(score, F.lit(0)), F.lit(100))
            good = kind.confirmed(m, before, after)
            if not kind.base:
                good = good & (score >= REPORT)
            return F.when(good, F.struct((F.get(ends, i) - F.char_length(m)).cast("long").alias("start"), F.get(ends, i).cast("long").alias("end"), score.cast("long").alias("score")))

        return F.filter(F.transform(found, one), lambda x: x.isNotNull())

    found = F.regexp_extract_all(text, F.lit(kind.proposes), F.lit(0))
    both = F.struct(found.alias("found"), F.split(text, kind.proposes).alias("between"))
    lengths = lambda x: F.transform(x["found"], lambda m, i: F.char_length(m) + F.char_length(F.get(x["between"], i)))
    there = let(both, lambda x: let(let(lengths(x), _sums), lambda ends: placed(x["found"], x["between"], ends)))
    # most texts propose nothing
    return F.when(text.rlike(kind.proposes), there).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,score:bigint>>"))


def detect(docs: DataFrame, id_col: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """id and ``found``: array<struct<kind, start, end, score>> by kind as listed, then start."""
    plain = docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    each = plain.select(id_col, *(spans_of(F.col("__text"), k).alias(k.name) for k in kinds))
    return each.select(id_col, F.flatten(F.array(*(_named(k.name, _wanted(k, kinds)) for k in kinds))).alias("found"))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def _wanted(kind: Kind, kinds: tuple[Kind, ...]) -> Column:
    """Spans of a kind; a card number that stands alone is a base span already."""
    if kind.name != "card_run" or not any(k.name == "card" for k in kinds):
        return F.col(kind.name)
    taken = F.transform("card", lambda x: F.concat_ws(":", x["start"], x["end"]))
    return let(F.map_from_arrays(F.array_distinct(taken), F.array_distinct(taken)), lambda known: F.filter(kind.name, lambda x: known[F.concat_ws(":", x["start"], x["end"])].isNull()))


def listed(found: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
