"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document and leaves one bit; the measurements stay beside the bits.
Policies are masks over the bits and are applied afterwards, so a new version of a policy or an ablation
reads the ledger and never the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netseq.llm.common import WORD, let, whole_text, words

WINDOW = 3

@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds; it sees measurements as columns of the given names."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


# The position of a rule is its bit. New rules go to the end, so that older ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    Rule("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > 25 * m("n_words")),
    Rule("symbols", lambda m: 100 * m("n_symbols") > 40 * m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 60 * m("n_lines")),
)

BASE = ("few_words", "repeated_windows")

# Versioned policies: the rules that reject a document. Version 1 is the two base rules.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "short_words", "long_words", "symbols", "repeated_lines"),
}


def mask(rules: tuple[str, ...]) -> int:
    names = [r.name for r in RULES]
    return sum(1 << names.index(r) for r in rules)


def windows(w: Column, make: Callable[[Column, Column], Column]) -> Column:
    """``make(hash, place)`` of every window of three words of the array ``w``."""
    return F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW),
        lambda i: make(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), i),
    )


def repeated_words(w: Column) -> Column:
    """Words within windows of three that occur twice or more, from an array of words.

    Without an equal pair of window hashes there is none. Otherwise places are sorted by hash, neighbours
    of one hash compared word by word, and the places of equal windows laid end to end.
    """
    none = F.lit(0).cast("bigint")

    def same(s: Column, j: Column, k: Column) -> Column:
        x, y = F.get(s, j)["i"], F.get(s, k)["i"]
        words_agree = [F.get(w, x + d) == F.get(w, y + d) for d in range(WINDOW)]
        return F.coalesce((F.get(s, j)["h"] == F.get(s, k)["h"]) & reduce(Column.__and__, words_agree), F.lit(False))

    def places(s: Column) -> Column:
        marked = F.transform(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda j: F.when(same(s, j, j - 1) | same(s, j, j + 1), F.get(s, j)["i"]),
        )
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(none.alias("n"), none.alias("end")),
            lambda acc, i: F.struct(
                (acc["n"] + i + WINDOW - F.greatest(acc["end"], i.cast("bigint"))).alias("n"),
                (i + WINDOW).cast("bigint").alias("end"),
            ),
            lambda acc: acc["n"],
        )

    some = let(windows(w, lambda h, i: h), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    by_hash = F.sort_array(windows(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when((F.size(w) > WINDOW) & some, covered(let(by_hash, places))).otherwise(none)


def measurements(text: str) -> Column:
    """Struct of all measurements of a text; null counts as empty.

    A line counts where it holds a word; it is a duplicate where an earlier line is equal to it.
    """
    whole = whole_text(text)
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    of_words = let(
        words(whole),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    return F.struct(
        of_words.alias("of_words"),
        F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        let(
            lines,
            lambda x: F.struct(
                (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
                F.size(x).cast("bigint").alias("n_lines"),
            ),
        ).alias("of_lines"),
    )


# Where each measurement lies in the struct.
PATHS = {
    "n_words": "of_words.n_words",
    "word_chars": "of_words.word_chars",
    "n_symbols": "n_symbols",
    "n_dup_lines": "of_lines.n_dup_lines",
    "n_repeat_words": "of_words.n_repeat_words",
    "n_lines": "of_lines.n_lines",
}


def ledger(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with all measurements and ``failed_bits`` (bit i set where rule i fails).

    New column names start with ``prefix``; one that ``docs`` has already is an error. A null or empty text has
    zero words and fails the rule on few words. Repeated rows each get their own line, an empty table none.
    """
    held = f"{prefix}measured"
    clash = sorted({held, f"{prefix}failed_bits", *(prefix + k for k in PATHS)} & set(docs.columns))
    if clash:
        raise ValueError(f"columns {clash} are there already; give a prefix")
    measured = docs.withColumn(held, measurements(text))
    measured = measured.withColumns({prefix + k: F.col(f"{held}.{p}") for k, p in PATHS.items()}).drop(held)
    bits = [
        F.when(rule.fails(lambda k: F.col(prefix + k)), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
        for i, rule in enumerate(RULES)
    ]
    return measured.withColumn(f"{prefix}failed_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def passes(policy: str, bits: str = "failed_bits") -> Column:
    """Whether no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("bigint")) == 0


def ablation(found: DataFrame, policy: str, bits: str = "failed_bits") -> DataFrame:
    """Per rule of a policy: documents it fails, and those kept if the rule alone were dropped.

    The ledger is first reduced to counts per pattern of bits (at most two to the number of rules), so
    the rest works on a table of bounded size. Rules that reject nothing are listed with zeros.
    """
    whole = mask(POLICIES[policy])
    patterns = found.groupBy(F.col(bits).bitwiseAND(F.lit(whole).cast("bigint")).alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sums = []
    for name in POLICIES[policy]:
        bit = F.lit(mask((name,))).cast("bigint")
        sums.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.coalesce(F.sum(F.when(F.col("b").bitwiseAND(bit) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
                F.coalesce(F.sum(F.when(F.col("b") == bit, F.col("n"))), F.lit(0)).alias("n_regained"),
            )
        )
    return patterns.agg(F.array(*sums).alias("x")).select(F.inline("x"))
