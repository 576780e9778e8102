"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations only read bits.

``ledger`` measures a text and stores one bit for each rule that it fails. A policy is a versioned set of rule names,
hence a mask: judging, re-judging under another version and leave-one-out ablations are bitwise operations on the
ledger and never read a text again. All of it is built-in expressions over the rows of one text, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftfield.llm.shared import packed, unpacked, words_of

WINDOW = 5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rule -> when it fails, over the measures. The bit of a rule is its place here; new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines >= 2 AND 100 * n_dup_lines > 30 * n_lines",
    "short_or_long_words": "word_chars < 2 * n_words OR word_chars > 16 * n_words",
    "stuttering": "100 * n_stutters > 30 * n_words",
}
#: Versioned policies: the rules that a text must not fail.
POLICIES: dict[str, tuple[str, ...]] = {"base": ("few_words", "repeated_windows"), "v1": tuple(RULES)}
#: Measures besides: lines with a word, and words equal to the one before.
LEDGER = [*MEASURES, "n_lines", "n_stutters", "failed_bits"]


def mask(rules: Iterable[str]) -> int:
    return sum(1 << list(RULES).index(r) for r in set(rules))


def _let(value: Column, then) -> Column:
    """``then`` over ``value`` held as a lambda variable: inside other lambdas a plain expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), then), 0)


def _repeated(keyed: Column) -> Column:
    """Positions, ascending, whose key stands more than once in an array of (k, p): equal keys are neighbours once sorted."""
    same = lambda s, i, x: F.coalesce(F.get(s, i)["k"] == x["k"], F.lit(False))
    twice = lambda s: F.transform(F.filter(s, lambda x, i: same(s, i + 1, x) | same(s, i - 1, x)), lambda x: x["p"])
    return F.sort_array(_let(F.sort_array(keyed), twice))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``__row`` (the input row) and the measures. A null text counts as empty: no words, no lines, zeros throughout."""
    t = docs.select(packed(docs), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    t = t.select("__row", "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    w, n = F.col("w"), F.size("w")
    hashes = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
    t = t.select(
        "__row", "w", hashes.alias("h"), n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(F.filter(F.transform("w", lambda x, i: (i > 0) & (F.get("w", i - 1) == x)), lambda b: b)).cast("long").alias("n_stutters"),
        F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
    )
    # Most texts repeat no window: a set of hashes tells. For others, equal hashes are confirmed on the windows' words.
    t = t.withColumn("c", F.when(F.size(F.array_distinct("h")) < F.size("h"), _repeated(F.transform("h", lambda x, i: F.struct(x.alias("k"), i.alias("p"))))))
    t = t.withColumn("p", F.when(F.col("c").isNotNull(), _repeated(F.transform("c", lambda i: F.struct(F.array_join(F.slice(w, i + 1, WINDOW), " ").alias("k"), i.alias("p"))))))
    covered = F.aggregate("p", F.struct(F.lit(0).alias("c"), F.lit(-WINDOW).alias("e")), lambda a, x: F.struct((a["c"] + F.least(F.lit(WINDOW), x - a["e"])).alias("c"), x.alias("e")), lambda a: a["c"])
    return t.select("__row", *[m for m in MEASURES if m != "n_repeat_words"], "n_lines", "n_stutters", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures and ``failed_bits`` (bit i: rule i of ``RULES`` fails).

    One row for every input row, repeated rows included; input columns named like a measure are replaced.
    """
    m = measured(docs, text)
    bits = F.lit(0).cast("long")
    for i, fails in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return unpacked(m.withColumn("failed_bits", bits), docs.columns, LEDGER)


def judged(book: DataFrame, policy: str = "v1", kept: str = "kept") -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return book.withColumn(kept, F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0)


def ablations(book: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of the policy: rows that fail it, rows that it alone removes, and rows kept without it.

    One aggregation over distinct bit patterns; an empty ledger gives a row of zeros for each rule.
    """
    whole, rules = mask(POLICIES[policy]), [r for r in RULES if r in POLICIES[policy]]
    patterns = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(whole).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    patterns = patterns.union(book.sparkSession.sql("SELECT 0L AS bits, 0L AS n"))  # an empty ledger, too, has all rules
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in rules])
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    bits, bit = F.col("bits"), F.col("r.bit")
    return patterns.select("bits", "n", F.explode(each).alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(n(bits.bitwiseAND(bit) != 0).alias("n_failed"), n(bits == bit).alias("n_only"), n((bits == bit) | (bits == 0)).alias("n_kept_without"))
