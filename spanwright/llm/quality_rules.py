"""Rule bitmask ledger: every quality rule is evaluated once per document.

``ledger`` stores the measurements and one failure bit per rule. Policies are
bit masks over the ledger, so that another policy or an ablation needs no
second look at the texts: ``apply_policy`` is one bitwise AND per row and
``ablate`` works on the counts of the at most 2**len(RULES) bit patterns.

The plan is a single map over the input: no shuffle, no Python.

Defined results: a null text counts as empty; an empty text has no words and
fails ``few_words``; repeated rows give repeated rows; an empty table gives an
empty table; other columns are ignored by ``ledger`` and kept by ``quality_filter``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import BLANK, let

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


#: The order fixes the bits; append only.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("upper_case", "100 * n_upper > 50 * word_chars"),
)
BASE = ("few_words", "repeated_words")


def mask_of(*names: str) -> int:
    bits = {r.name: 1 << k for k, r in enumerate(RULES)}
    return sum({bits[n] for n in names})


#: Versioned policies. A published version never changes.
POLICIES = {"base-1": mask_of(*BASE), "web-1": mask_of(*(r.name for r in RULES))}


def _repeat_words(words: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the array."""

    def pairwise(step: int):  # hash of 2 * step words from hashes of step words
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    def covered(windows: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twin = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
            at = F.sort_array(F.transform(twin, lambda x: x["i"]))
            own = let(at, lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
            return F.aggregate(own, F.lit(0), lambda a, x: a + x)

        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(ordered, of_sorted))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    eight = let(let(let(hashes, pairwise(1)), pairwise(2)), pairwise(4))
    windows = F.slice(eight, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(windows, covered))


def measure(text: Column | str = "text") -> dict[str, Column]:
    """The measurements as columns over ``text`` and the word array ``__words``."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    words = F.col("__words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(words).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_upper": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long"),
    }


def _measured(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    split = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BLANK), "")
    bits = F.lit(0)
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), 1 << k).otherwise(0))
    kept = [F.col(f"`{c}`") for c in keep]
    out = docs.select(*kept, *([] if text in keep else [F.col(text)]), split.alias("__words"))
    out = out.select(*kept, *(v.alias(k) for k, v in measure(text).items()))
    return out.select("*", bits.alias("fail_bits"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, the measurements and ``fail_bits`` (bit k: rule k failed)."""
    return _measured(docs, [id_col], text)


def apply_policy(ledger: DataFrame, policy: str | int = "web-1", to: str = "kept") -> DataFrame:
    """Adds ``to``: whether no rule of the policy failed."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    return ledger.withColumn(to, F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0)


def ablate(ledger: DataFrame, policy: str | int = "web-1") -> DataFrame:
    """For each rule of a policy: what it rejects, alone and along with others, and what would stay without it.

    rule, rejected, rejected_only (by this rule alone), kept_without, words_regained.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    bits = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).alias("bit")) for k, r in enumerate(RULES) if mask >> k & 1))
    out = patterns.select("bits", "n", "words", F.explode(bits).alias("r")).select("bits", "n", "words", "r.rule", "r.bit")
    hit, only = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    total = lambda when, what: F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0))
    return out.groupBy("rule").agg(
        total(hit, "n").alias("rejected"), total(only, "n").alias("rejected_only"),
        total(only | (F.col("bits") == 0), "n").alias("kept_without"), total(only, "words").alias("words_regained"),
    )


def quality_filter(docs: DataFrame, policy: str | int = "web-1", text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    out = _measured(docs.select(row, F.col(text).alias("__text")), ["__row"], "__text")
    return out.where(F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0).select("__row.*")
