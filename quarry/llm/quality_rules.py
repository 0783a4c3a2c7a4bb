"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule.
Policies are versioned masks over those bits: applying another policy, or asking what a policy would keep
without one of its rules (ablation), never looks at a text again.

All of it is built-in column expressions: no shuffle for the ledger, one row in, one row out; an ablation
aggregates to at most ``2 ** rules`` bit patterns before anything else happens.

Defined results: a NULL or blank text has no words and measures 0; it fails the word-count rule. NULL ids
and repeated rows are kept as they are (one ledger row per input row). Extra input columns are ignored
unless named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, words_column

#: Characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL condition over the measurements; bit ``bit`` of the ledger is set where it holds."""

    bit: int
    name: str
    failed: str


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules: a document is kept when none of their bits is set."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: Sequence[Rule]) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[n] for n in self.rules)


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule(4, "upper_case", "100 * n_upper > 40 * word_chars"),
    Rule(5, "short_words", "word_chars < 2 * n_words"),
    Rule(6, "long_words", "word_chars > 20 * n_words"),
)
BASE = Policy("base", 1, ("few_words", "repeated_windows"))
DEFAULT = Policy("default", 1, tuple(r.name for r in RULES))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_upper")


def _repeat_words(words: str, hashes: str) -> Column:
    """Words inside 3-word windows that occur at least twice; windows are compared by 64-bit hash.

    ``hashes`` holds one hash per window start. Texts without a repeated window stop at the distinct count.
    Otherwise (hash, start) pairs are sorted, equal neighbours kept, and their starts swept once.
    """
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        n = F.size(s)
        last = F.filter(s, lambda x, i: (
            (F.when(i > 0, F.get(s, i - 1)["h"]) == x["h"]) | (F.when(i < n - 1, F.get(s, i + 1)["h"]) == x["h"])))
        return F.sort_array(F.transform(last, lambda x: x["i"]))

    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    # transform over a one-element array binds the sorted pairs once
    starts = F.get(F.transform(F.array(pairs), repeated), F.lit(0))
    covered = F.aggregate(
        starts, start,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")),
        lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """id, ``keep`` columns and every measurement (all LONG)."""
    t = df.select(F.col(id_col), *[F.col(c) for c in keep if c != id_col], F.col(text_col).alias("__text"))
    t = t.withColumn("__w", words_column(F.col("__text")))
    t = t.withColumn("__n", F.size("__w"))
    t = t.withColumn("__h", F.transform(
        F.slice("__w", 1, F.greatest(F.col("__n") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(F.col("__w"), i + 1), F.get(F.col("__w"), i + 2))))
    t = t.withColumn("__l", F.filter(F.split(F.coalesce("__text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    text = F.coalesce(F.col("__text"), F.lit(""))
    return t.select(
        F.col(id_col), *[F.col(c) for c in keep if c != id_col],
        F.col("__n").cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        _repeat_words("__w", "__h").alias("n_repeat_words"),
        F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES,
           keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: id, ``keep`` columns, measurements, ``fail_bits``."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return measure(df, id_col, text_col, keep).withColumn("fail_bits", bits)


def passes(policy: Policy, rules: Sequence[Rule] = RULES, bits: str = "fail_bits") -> Column:
    """Whether the ledger row passes ``policy``."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def ablation(led: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of ``policy``: documents that fail it, fail only it, and would be kept without it.

    Works on the counts per bit pattern (at most ``2 ** rules`` rows), so the corpus is aggregated once.
    """
    mask = policy.mask(rules)
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    chosen = [r for r in rules if r.name in policy.rules]
    rule = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen]))
    r = patterns.select("p", "n", rule.alias("r"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    has = F.col("p").bitwiseAND(F.col("r.bit")) != 0
    return r.groupBy(F.col("r.rule").alias("rule")).agg(
        total(has).alias("n_failed"), total(F.col("p") == F.col("r.bit")).alias("n_only"),
        total((F.col("p") == 0) | (F.col("p") == F.col("r.bit"))).alias("n_kept_without"),
    ).select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "*")


def keep_good(df: DataFrame, policy: Policy = DEFAULT, id_col: str = "doc_id", text_col: str = "text",
              rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``df`` (all columns, unchanged) that pass ``policy``; computed in place, without a join."""
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(text_col).alias("__t"))
    led = ledger(row, "__row", "__t", rules)
    # a filter would be pushed below the measurements and take a copy of them along, words split anew per shingle;
    # exploding one row or none stays above them
    return led.select(F.explode(F.when(passes(policy, rules), F.array("__row"))).alias("__row")).select("__row.*")
