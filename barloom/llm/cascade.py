"""Quality rules as a short-circuit cascade: rules ordered by rejections per cost, both estimated on a bounded sample.

DataFrame functions only, within each row: no shuffle, no Python on the executors. A rule makes its own features from
the text and its words, inside a chain of conditions, so what a text is rejected for early spares it all later features.
Which rows are kept does not depend on the order, as each row must pass every rule; only the work does.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import free_names, words_of

#: The order of the rules comes from at most so many rows, of at most so many characters each, of the first splits.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 20_000
REPEATS = 5  # a rule runs so often over each row of the sample when it is timed
#: The symbols counted by n_symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """rejects(text, words) is a boolean column (null counts as false); text is never null, words are its words."""

    name: str
    rejects: Callable[[Column, Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value made once, and only where body's result is asked for."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def duplicates(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text, the first one included.

    Windows are compared by a 64-bit hash of their three words, sorted with their places, so a text of n words takes
    n log n steps; texts without a repeated window skip the sort.
    """
    tail = F.slice(words, F.lit(3), F.greatest(F.size(words) - 2, F.lit(0)))
    triples = F.transform(tail, lambda w, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), w))

    def starts(placed: Column) -> Column:
        def again(p: Column, i: Column) -> Column:
            return F.when((p["h"] == F.get(placed, i - 1)["h"]) | (p["h"] == F.get(placed, i + 1)["h"]), p["i"])

        return F.sort_array(F.filter(F.transform(placed, again), lambda x: x.isNotNull()))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda s, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - s, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(t: Column) -> Column:
        placed = F.array_sort(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(t)) < F.size(t), let(let(placed, starts), covered)).otherwise(F.lit(0).cast("long"))

    return let(triples, count)


def base_rules() -> list[Rule]:
    """The two rules of the base test."""
    return [
        Rule("few_words", lambda text, words: F.size(words) < 50),
        Rule("repeats", lambda text, words: n_repeat_words(words) * 100 > F.size(words) * 50),
    ]


def default_rules() -> list[Rule]:
    """Mild limits, all on the text itself; each rejects junk that ordinary prose never comes near."""

    def some(words: Column) -> Column:
        return F.greatest(F.size(words), F.lit(1))

    def letters(text: Column, kind: str) -> Column:
        return F.length(F.regexp_replace(text, rf"\P{{{kind}}}+", ""))

    return [
        Rule("symbols", lambda text, words: n_symbols(text) * 10 > some(words) * 3),
        Rule("word_length", lambda text, words: ~(word_chars(words) / some(words)).between(1.5, 40.0)),
        Rule("duplicate_lines", lambda text, words: let(lines_of(text), lambda x: duplicates(x) * 10 > F.size(x) * 4)),
        Rule("few_letters", lambda text, words: letters(text, "L") * 2 < word_chars(words)),
        Rule("shouting", lambda text, words: letters(text, "Lu") * 10 > letters(text, "L") * 6),
    ]


def cascade(text: Column, words: Column, rules: Sequence[Rule]) -> Column:
    """True if no rule rejects; rules run in the given order and stop at the first rejection."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.rejects(text, words), F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[str]:
    """At most rows texts of at most chars characters, from as few splits as have them: no shuffle, a bounded result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [r[0] for r in docs.select(text.alias("text")).where(F.length("text") <= chars).take(rows)]


def order_rules(spark: SparkSession, texts: Sequence[str], rules: Sequence[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds per text) on the sample, most rejections per second first.

    Each rule runs alone, from the words on, over raw texts; a run that only makes the words is taken off its time.
    """
    if not texts:
        return [(r, 0.0, 1.0) for r in rules]
    sample = spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1)
    sample = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def timed(test: Callable[[Column, Column], Column]) -> tuple[float, float]:
        text = F.col("text")
        job = sample.agg(F.count_if(F.coalesce(let(words_of(text), lambda w: test(text, w)), F.lit(False))))
        times = []
        for _ in range(2):
            began = time.perf_counter()
            n = job.first()[0]
            times.append(time.perf_counter() - began)
        return min(times) / REPEATS / len(texts), n / REPEATS / len(texts)

    idle, _ = timed(lambda text, words: F.size(words) < 0)
    found = []
    for rule in rules:
        seconds, share = timed(rule.rejects)
        found.append((rule, share, max(seconds - idle, 1e-7)))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def ordered(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    if len(rules) < 2:
        return list(rules)
    return [x[0] for x in order_rules(docs.sparkSession, sample_of(docs, sample_rows), rules)]


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "kept"]


def quality(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the features n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed and kept.

    base_failed is the base test; kept is false there, else the cascade's verdict. The order of the rules comes from a
    bounded sample (SAMPLE_ROWS, SAMPLE_CHARS; an empty table keeps the given order); every row is then tested in full,
    whatever its length. Null text has no words and fails the base test. Columns that docs has under the names in ADDED
    are replaced, all others stay. Repeated rows are judged each. To filter by the verdict alone, use passing(), which
    makes no feature that the rules do not ask for.
    """
    inner = ordered(docs, default_rules() if rules is None else list(rules), sample_rows)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    text = F.coalesce(F.col("text"), F.lit(""))

    def judged(words: Column) -> Column:
        count, again = n_words(words), n_repeat_words(words)
        return let(F.struct(count.alias("n"), again.alias("again")), lambda f: let(lines_of(text), lambda lines: F.struct(
            f["n"].alias("n_words"), word_chars(words).alias("word_chars"), n_symbols(text).alias("n_symbols"),
            duplicates(lines).alias("n_dup_lines"), f["again"].alias("n_repeat_words"), F.size(lines).cast("long").alias("n_lines"),
            ((f["n"] < 50) | (f["again"] * 100 > f["n"] * 50)).alias("base_failed"),
            F.when((f["n"] < 50) | (f["again"] * 100 > f["n"] * 50), F.lit(False)).otherwise(cascade(text, words, inner)).alias("kept"),
        )))

    (got,) = free_names(docs, "judged")
    return docs.withColumn(got, let(words_of(text), judged)).select(*docs.columns, *[F.col(got)[c].alias(c) for c in ADDED])


def passing(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that quality() keeps, with every column of docs as it is, whatever its name.

    The base rules take part in the order like all others: one condition over the text, which stops at the first
    rejection. Null texts go; repeated rows are judged each; an empty table gives an empty result.
    """
    every = ordered(docs, [*base_rules(), *(default_rules() if rules is None else rules)], sample_rows)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where(let(words_of(text), lambda words: cascade(text, words, every)))
