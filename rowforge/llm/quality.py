"""Quality rules: a table of thresholds compiled into one projection.

Every figure is a built-in expression over the text, so the whole rule set runs inside
the scan: no shuffle, no user function, no state. A document is never split or cut.

Defined cases: a null or empty text has no words and fails the base rules; equal rows get
equal verdicts, each for itself; columns other than the text are carried unread, whatever
they are called; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, words

# Frequent function words of the four languages of the documents.
STOP_WORDS = (
    # English
    "a and are as be by for from in is it of on that the this to was with "
    # French
    "au dans de des du elle en est et la le les ou par pas pour que qui sur un une "
    # German
    "als auch auf das dem den der die eine es im ist mit nicht sich und von zu "
    # Spanish
    "al como con del el las lo los no se su una y"
).split()

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Keep a document while ``low <= 100 * figure / base <= high``; None is no bound."""

    name: str
    figure: str
    base: str
    low: float | None = None
    high: float | None = None

    def passes(self, figures: Column) -> Column:
        # products instead of a quotient: exact, and defined for a base of 0
        share, base = 100 * figures[self.figure], figures[self.base]
        bounds = []
        if self.low is not None:
            bounds.append(share >= self.low * base)
        if self.high is not None:
            bounds.append(share <= self.high * base)
        return reduce(lambda a, b: a & b, bounds, F.lit(True))


#: The production thresholds, in per cent of the base.
RULES: Sequence[Rule] = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "n_words", high=20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
    Rule("stop_words", "n_stop_words", "n_words", low=4),
)

#: The base rules hold before any threshold: at least so many words, and at most half of
#: them inside repeated windows of three.
MIN_WORDS = 50
MAX_REPEATED = 50


def _with_figures(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``q``, a struct of all figures; ``row`` must hold whatever is to be kept."""
    full = F.coalesce(text, F.lit(""))
    spaces = "[\\x20\\x09-\\x0D]+"

    def window(i: Column) -> Column:
        # a number and a place instead of three words: little to hold, little to sort
        return F.struct(F.xxhash64(*[F.get("w", i + k) for k in range(3)]).alias("h"), i.alias("i"))

    def same(x: Column, y: Column) -> Column:
        # the hash only brings windows together; the words decide
        words_alike = [F.get("w", x["i"] + k) == F.get("w", y["i"] + k) for k in range(3)]
        return F.coalesce(reduce(lambda a, b: a & b, words_alike, x["h"] == y["h"]), F.lit(False))

    starts = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(
        F.array().cast("array<int>")
    )
    df = df.withColumns(
        {
            "w": words(text),
            "l": F.filter(F.split(full, "\n", -1), lambda line: line.rlike(WORD)),
            "chars": F.length(F.regexp_replace(full, spaces, "")).cast("long"),
            "symbols": (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long"),
        }
    )
    # equal windows become neighbours
    df = df.withColumn("g", F.sort_array(F.transform(starts, window)))
    repeated = F.filter(
        F.transform(
            "g",
            lambda x, k: F.when(
                same(x, F.get("g", k - 1)) | same(x, F.get("g", k + 1)), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.array_distinct(
        F.flatten(F.transform(repeated, lambda i: F.array(i, i + 1, i + 2)))
    )
    stops = F.filter("w", lambda word: F.lower(word).isin(*STOP_WORDS))
    return df.withColumn(
        "q",
        F.struct(
            F.size("w").cast("long").alias("n_words"),
            F.col("chars").alias("word_chars"),
            F.col("symbols").alias("n_symbols"),
            (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
            F.size(covered).cast("long").alias("n_repeat_words"),
            F.size("l").cast("long").alias("n_lines"),
            F.size(stops).cast("long").alias("n_stop_words"),
        ),
    ).drop("w", "l", "g", "chars", "symbols")


def quality(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``row`` (the document as it came) and ``q``: its figures, ``base_failed``, one
    boolean per rule below ``passed``, and ``kept``."""
    figures = _with_figures(docs.select(F.struct("*").alias("row")), F.col("row")[text])
    q = F.col("q")
    base_failed = (q["n_words"] < MIN_WORDS) | (
        100 * q["n_repeat_words"] > MAX_REPEATED * q["n_words"]
    )
    passed = [rule.passes(q).alias(rule.name) for rule in rules]
    verdict = reduce(lambda a, b: a & b, [rule.passes(q) for rule in rules], F.lit(True))
    judged = (
        q.withField("base_failed", base_failed)
        .withField("passed", F.struct(*passed) if passed else F.lit(None))
        .withField("kept", ~base_failed & verdict)
    )
    # explode keeps the optimiser from copying the whole projection into a filter on the result
    return figures.select("row", F.explode(F.array(judged)).alias("q"))


def drop_low_quality(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    return quality(docs, text, rules).where("q.kept").select("row.*")
