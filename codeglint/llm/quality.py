"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every feature is an expression over the text, so a scan computes all of them in one pass and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD

SYMBOLS = "#*$%&|<>"
ANY_SYMBOL, ANY_SPACE = f"[{SYMBOLS}]", r"[ \x09-\x0D]"
#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "on", "with", "was", "a", "by", "or", "are", "an", "be",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "im", "für", "auf", "ist", "ein", "eine", "nicht", "als", "sich",
    "le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "qui", "dans", "sur", "par", "est", "pour", "avec",
    "el", "los", "las", "del", "y", "una", "por", "con", "para", "se", "su", "al", "lo", "como",
)


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= feature <= high."""

    feature: str
    low: float
    high: float


#: The threshold table.  Ratios are shares of words, of characters in words or of lines.
RULES = (
    Rule("n_words", 50, 10**18),
    Rule("mean_word_length", 2.0, 20.0),
    Rule("symbol_ratio", 0.0, 0.10),
    Rule("stop_word_ratio", 0.02, 1.0),
    Rule("dup_line_ratio", 0.0, 0.50),
    Rule("repeat_word_ratio", 0.0, 0.50),
)


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def solid_characters(text: Column) -> Column:
    """Code points that aren't space."""
    return F.length(text) - F.regexp_count(text, F.lit(ANY_SPACE))


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more in the array.

    Windows are hashed to 64 bits and sorted with their positions; neighbours with equal hashes whose words agree too
    are repeats.  n log n for a document of any length; no window is compared with all others.
    """
    windows = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
        )
    )

    def positions(s: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            equal = a["h"] == b["h"]
            for k in range(3):
                equal = equal & (F.get(words, a["i"] + k) == F.get(words, b["i"] + k))
            return F.coalesce(equal, F.lit(False))

        repeats = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(repeats, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    # a one-element array binds the sorted windows once
    found = F.element_at(F.transform(F.array(windows), positions), 1)
    return F.when(F.size(words) >= 4, found).otherwise(F.lit(0)).cast("long")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")


def counts(text: Column) -> Column:
    """struct of COUNTS over a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    whole = F.struct(words.alias("w"), lines.alias("l"), solid_characters(text).alias("c"), F.regexp_count(text, F.lit(ANY_SYMBOL)).alias("s"))

    def counted(x: Column) -> Column:
        values = (
            F.size(x["w"]), x["c"], x["s"], F.size(x["l"]), F.size(x["l"]) - F.size(F.array_distinct(x["l"])),
            F.size(F.filter(x["w"], lambda w: F.lower(w).isin(*STOP_WORDS))), repeated_words(x["w"]),
        )
        return F.struct(*[v.cast("long").alias(n) for n, v in zip(COUNTS, values)])

    return F.element_at(F.transform(F.array(whole), counted), 1)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with COUNTS.  A null text counts as empty: every count is 0.  Columns of docs that have one of these names are replaced."""
    out = docs.withColumn("_counts", counts(F.col(f"`{text_col}`")))
    return out.withColumns({n: F.col("_counts")[n] for n in COUNTS}).drop("_counts")


def features(c: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """The features that rules may name; c gives a count by its name."""
    words = c("n_words").cast("double")
    return {
        "n_words": words,
        "mean_word_length": _ratio(c("word_chars"), words),
        "symbol_ratio": _ratio(c("n_symbols"), c("word_chars")),
        "stop_word_ratio": _ratio(c("n_stop_words"), words),
        "dup_line_ratio": _ratio(c("n_dup_lines"), c("n_lines")),
        "repeat_word_ratio": _ratio(c("n_repeat_words"), words),
    }


def verdict(rules: Sequence[Rule] = RULES, c: Callable[[str], Column] = F.col) -> Column:
    """True where every rule of the table holds."""
    known, passed = features(c), F.lit(True)
    for r in rules:
        passed = passed & known[r.feature].between(r.low, r.high)
    return passed


def base_failed(c: Callable[[str], Column] = F.col) -> Column:
    """Under 50 words, or over half of them repeated."""
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def with_quality(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """docs with the counts of measured(), base_failed and kept.

    base_failed: under 50 words, or over half of them repeated.  kept: not base_failed and every rule holds.  Null and
    empty texts fail; an empty table gives an empty result; other columns stay, whatever their names, unless they clash
    with a count, which replaces them.
    """
    return measured(docs, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_filter(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of docs that pass, with the columns of docs.

    The condition binds the counts once: a filter evaluates each mention of an expression anew.
    """
    passes = F.exists(F.array(counts(F.col(f"`{text_col}`"))), lambda x: ~base_failed(x.getField) & verdict(rules, x.getField))
    return docs.filter(passes)
