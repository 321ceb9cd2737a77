"""Column builders over texts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no claim, and words that deny one.
STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "by", "is", "are", "was", "were", "be", "been", "it", "its",
    "this", "that", "as", "at", "from", "has", "have", "had", "per", "within", "under",
)
NEGATIONS = ("not", "no", "never", "without", "none", "cannot", "doesn't", "don't", "isn't")
#: How answers decline.
REFUSALS = (
    "i cannot answer",
    "i can't answer",
    "i do not have",
    "i don't have",
    "no information",
    "unable to answer",
    "i don't know",
    "not found in the provided",
    "does not contain",
    "do not have the relevant information",
)

_TOKEN = r"[a-z0-9]+(?:\.[a-z0-9]+)?"


def words(names: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, names))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Tokens that can carry a claim: with a digit, or of three characters and no stopword."""
    return F.filter(tokens(text), lambda t: ~t.isin(*STOPWORDS) & ((F.length(t) > 2) | t.rlike("[0-9]")))


def entities(text: Column) -> Column:
    """Capitalised words, lower-cased, once each."""
    found = F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-zA-Z0-9-]{2,}\b"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda t: ~t.isin(*STOPWORDS)))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")


def negations(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda t: t.isin(*NEGATIONS)))


def groundedness(output: Column, context: Column) -> Column:
    """How much of an output its context supports, from 0 to 1: the mean over sentences with content.

    A token that the context lacks counts against its sentence, twice if it holds a digit or names an
    entity; a negation that the context lacks takes a quarter. Blank output or context: 0.
    """
    output, context = F.coalesce(output, F.lit("")), F.coalesce(context, F.lit(""))

    def scored(known: Column) -> Column:
        def one(s: Column) -> Column:
            # tokens and names are found once for a sentence, not wherever they are named
            return F.transform(F.array(F.struct(content_tokens(s).alias("toks"), entities(s).alias("names"), negations(s).alias("no"))), of_sentence)[0]

        def of_sentence(x: Column) -> Column:
            toks, names = x["toks"], x["names"]
            missing = F.aggregate(
                F.filter(toks, lambda t: ~F.array_contains(known["all"], t)), F.lit(0),
                lambda a, t: a + F.when(t.rlike("[0-9]") | F.array_contains(names, t), 2).otherwise(1),
            )
            size = F.greatest(F.lit(1), F.size(toks) + F.size(F.array_except(names, known["all"])))
            base = 1 - F.least(F.lit(1.0), missing / size) - 0.25 * F.size(F.array_except(x["no"], known["no"]))
            return F.when(F.size(toks) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)))

        return F.filter(F.transform(sentences(output), one), lambda x: x.isNotNull())

    known = F.struct(F.array_union(content_tokens(context), entities(context)).alias("all"), negations(context).alias("no"))
    scores = F.transform(F.array(known), scored)[0]
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(scores), F.lit(0))
    return F.when((F.trim(output) == "") | (F.trim(context) == ""), 0.0).otherwise(F.coalesce(mean, F.lit(0.0)))


def loop_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def repeated_trigrams(text: Column) -> Column:
    """How often the most frequent sequence of three tokens occurs (longer sequences never occur more often)."""
    return F.transform(F.array(loop_tokens(text)), _most_repeated)[0]  # the tokens are found once, not for each place


def _most_repeated(toks: Column) -> Column:
    grams = F.transform(toks, lambda t, i: F.when(i + 2 < F.size(toks), F.xxhash64(t, F.get(toks, i + 1), F.get(toks, i + 2))))
    ordered = F.sort_array(F.filter(grams, lambda g: g.isNotNull()))

    def longest(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda g, i: F.when(~F.get(s, i - 1).eqNullSafe(g), i)), lambda i: i.isNotNull())
        return F.transform(F.array(starts), lambda at: F.array_max(F.transform(at, lambda p, k: F.coalesce(F.get(at, k + 1), F.size(s)) - p)))[0]

    return F.coalesce(F.transform(F.array(ordered), longest)[0], F.lit(0))


def refusal(text: Column) -> Column:
    """The first refusal phrase that the text contains, or null."""
    low = F.lower(text)
    return F.get(F.filter(words(REFUSALS), lambda p: F.contains(low, p)), F.lit(0))


def mask_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"-?\d+\.\d+|-?\d+", "<n>")


def clip(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size - 1)), F.lit("…"))).otherwise(text)


def cluster_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_][a-z0-9_]{2,}"), F.lit(0))


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` occurs in ``text``, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")
