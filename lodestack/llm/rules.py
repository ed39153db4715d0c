"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition that holds where a document fails, over measures that are worked out where a
rule asks for them. Cost (seconds) and selectivity (share of rows rejected) of every rule are measured
on a sample; rules then run by rejections per cost, and a CASE stops at the first that rejects, so what
only later rules need is not worked out. The order changes the time and the name of the rule that
rejected first, never the verdict.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAKS, written

#: Rows, about, of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 1_000
#: Times the sample is evaluated in one measurement, so that a rule outweighs the job around it, and measurements of which the least counts.
SAMPLE_TIMES, MEASUREMENTS = 4, 3

_BREAKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Measures:
    """What rules are made of: counts of a text, as columns that were made before or as expressions over its words."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    lines: Column
    n_repeat_words: Column

    @classmethod
    def of(cls, text: Column, w: Column) -> Measures:
        """Expressions over a text (not null) and the list of its words."""
        symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
        return cls(text, F.size(w), F.length(F.array_join(w, "")), symbols, line_counts(text), repeated_words(w))

    @classmethod
    def made(cls, text: Column) -> Measures:
        """The columns of measured()."""
        lines = F.struct(F.col("n_lines").alias("n"), F.col("n_dup_lines").alias("dup"))
        return cls(text, F.col("n_words"), F.col("word_chars"), F.col("n_symbols"), lines, F.col("n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Measures], Column]


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though body names it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; none of a null."""
    trimmed = F.btrim(text, F.lit(_BREAKS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, WORD_BREAKS)).otherwise(F.array().cast("array<string>"))


def repeated_words(w: Column) -> Column:
    """How many words lie in a window of three that the list holds twice or more, the first included."""

    def hashes(v: Column) -> Column:
        return F.transform(F.slice(v, 1, F.greatest(F.size(v) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(v, i + 1), F.get(v, i + 2)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda e: e["i"]))

        first = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"))
        return F.aggregate(let(placed, starts), first, step, lambda acc: acc["n"])

    return let(let(w, hashes), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))


def line_counts(text: Column) -> Column:
    """(n: lines with a word, dup: those equal to an earlier line)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda v: F.struct(F.size(v).cast("long").alias("n"), (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("dup")))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts that rules use; a null text counts as an empty one.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long). Columns of these
    names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("__words", words(text))
    m = Measures.of(text, F.col("__words"))
    df = df.withColumn("__lines", m.lines)
    return (
        df.withColumn("n_words", m.n_words.cast("long"))
        .withColumn("word_chars", m.word_chars.cast("long"))
        .withColumn("n_symbols", m.n_symbols.cast("long"))
        .withColumn("n_dup_lines", F.col("__lines.dup"))
        .withColumn("n_lines", F.col("__lines.n"))
        .withColumn("n_repeat_words", m.n_repeat_words)
        .drop("__words", "__lines")
    )


#: The base that every document has to meet: 50 words or more, at most half of them in repeated windows.
BASE = [
    Rule("short", lambda m: m.n_words < 50),
    Rule("repeats", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
]


def base_failed(m: Measures) -> Column:
    return BASE[0].fails(m) | BASE[1].fails(m)


def standard_rules() -> list[Rule]:
    """Rules that hold for any language with letters; thresholds after published web-text filters."""
    letters = lambda m: F.length(F.regexp_replace(m.text, r"\P{L}+", ""))
    capitals = lambda m: F.length(F.regexp_replace(m.text, r"\P{Lu}+", ""))
    return [
        Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
        Rule("word_length", lambda m: let(m.word_chars, lambda c: (c < 2 * m.n_words) | (c > 14 * m.n_words))),
        Rule("duplicate_lines", lambda m: let(m.lines, lambda v: 10 * v["dup"] > 3 * v["n"])),
        Rule("capitals", lambda m: 10 * capitals(m) > 4 * letters(m)),
        Rule("letters", lambda m: 10 * letters(m) < 6 * m.word_chars),
    ]


def calibrate(df: DataFrame, rules: list[Rule], lazily: Callable[[Callable[[Measures], Column]], Column], rows: int, sample_rows: int = SAMPLE_ROWS, prepared: Callable[[DataFrame], DataFrame] = lambda df: df) -> list[dict]:
    """Each rule's measured cost and selectivity on a sample of df's rows, best first.

    The sample is drawn where the rows are, and then prepared. lazily: from a condition over measures to a
    column of the prepared sample. Costs count to a power of two, so that the order doesn't change with
    what a clock can't tell.
    """
    sample = written(prepared(df if rows <= sample_rows else df.sample(sample_rows / rows, 17)), "rule-sample")
    n = max(1, sample.count())
    many = sample.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(SAMPLE_TIMES))))

    def seconds(fails: Callable[[Measures], Column]) -> tuple[float, int]:
        best, hits, query = float("inf"), 0, many.agg(F.count_if(lazily(fails)))
        for _ in range(MEASUREMENTS):
            began = time.perf_counter()
            hits = query.first()[0]
            best = min(best, time.perf_counter() - began)
        return best, hits // SAMPLE_TIMES

    empty, _ = seconds(lambda m: m.n_words < 0)
    found = []
    for rule in rules:
        spent, hits = seconds(rule.fails)
        cost = 2.0 ** round(math.log2(max((spent - empty) / (n * SAMPLE_TIMES), 1e-6)))
        found.append({"name": rule.name, "cost": cost, "selectivity": hits / n, "rate": hits / n / cost})
    return sorted(found, key=lambda x: (-x["rate"], x["cost"], x["name"]))


def cascade(m: Measures, rules: list[Rule], order: list[str]) -> Column:
    """The first rule, in the given order, that rejects, or null; later ones aren't worked out.

    A rule whose value is null doesn't reject.
    """
    by = {r.name: r.fails for r in rules}
    verdict = F
    for rule in order:
        verdict = verdict.when(F.coalesce(by[rule](m), F.lit(False)), F.lit(rule))
    return verdict.otherwise(F.lit(None).cast("string")) if order else F.lit(None).cast("string")


def over_text(text_col: str) -> Callable[[Callable[[Measures], Column]], Column]:
    """From an expression over measures to a column: the words are split once, all else where it is asked for."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return lambda body: let(words(text), lambda w: body(Measures.of(text, w)))


def first_failed(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Column:
    """The name of the rule, base included, that rejects a row of docs first, or null; nothing is worked out that no rule asks for.

    Null and empty texts have no words and fail the base. Rows are judged one by one, so ties and
    repeated rows get equal verdicts; no rule sees another column than the text.
    """
    rules, lazily = [*BASE, *standard_rules()], over_text(text_col)
    order = [x["name"] for x in calibrate(docs.select(text_col), rules, lazily, docs.count(), sample_rows)]
    return lazily(lambda m: cascade(m, rules, order))


def apply_rules(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the counts, base_failed, failed_rule and kept.

    For those who want the counts of every row, so only what the rules need beyond them is worked out
    lazily. The base comes first; the cascade sees the rest. Null and empty texts have no words and fail
    the base. Rows are judged one by one, so ties and repeated rows get equal verdicts; an empty table
    stays empty; other columns pass through, but those named like the added ones are replaced.
    """
    made, rules = Measures.made(F.coalesce(F.col(text_col), F.lit(""))), standard_rules()
    found = calibrate(docs.select(text_col), rules, lambda body: body(made), docs.count(), sample_rows, lambda some: measured(some, text_col))
    order = [x["name"] for x in found]
    df = measured(docs, text_col).withColumn("base_failed", base_failed(made))
    df = df.withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(made, rules, order)))
    return df.withColumn("kept", F.col("failed_rule").isNull())
