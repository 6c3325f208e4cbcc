"""Text helpers as Columns: normal forms, tokens, line ranges, budgets, greps."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed
from .columns import any_of, empty, lookup

#: Characters that a token stands for when a prompt's size is estimated.
CHARS_PER_TOKEN = 3.2


def normal(value: Column, limit: int = 160) -> Column:
    return F.substring(F.lower(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"\s+", " ")), 1, limit)


def tokens(value: Column, least: int = 3) -> Column:
    """Distinct lower-case tokens of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def line_range(value: Column) -> Column:
    """(start, end) of ``a-b`` or ``a``, in order; nulls where there is no number to start with."""
    first = F.split(F.trim(value), "-", 2)
    number = lambda i: F.trim(F.try_element_at(first, F.lit(i))).try_cast("int")
    a, b = number(1), F.coalesce(number(2), number(1))
    return F.struct(F.least(a, b).alias("start"), F.when(a.isNotNull(), F.greatest(a, b)).alias("end"))


def ranges_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed ranges with a known start that touch."""
    known = (F.coalesce(a_start, F.lit(0)) != 0) & (F.coalesce(b_start, F.lit(0)) != 0)
    return known & (a_start <= F.coalesce(b_end, b_start)) & (b_start <= F.coalesce(a_end, a_start))


def union_ignoring_case(values: Column) -> Column:
    """Trimmed non-empty strings in order, the first spelling of each."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    lowered = F.transform(clean, lambda v: F.lower(v))
    return F.filter(clean, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)


def first_distinct(values: Column, limit: int) -> Column:
    """The first different values that are not blank, trimmed, in order."""
    clean = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    return F.slice(F.array_distinct(clean), 1, limit)


def estimate_tokens(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.floor(n / CHARS_PER_TOKEN).cast("int") + 1)


def head_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, n), "\n")


def lines_between(text: Column, start: Column, end: Column) -> Column:
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(F.split(text, "\n", -1), first, F.greatest(end - first + 1, F.lit(0))), "\n")


def preview(text: Column, n: int) -> Column:
    """(text, cut): the first characters, and whether there were more."""
    return F.struct(F.substring(text, 1, n).alias("text"), (F.length(text) > n).alias("cut"))


def to_budget(text: Column, budget: Column) -> Column:
    """Cuts a text to so many tokens, at the last line end if that keeps over four fifths."""
    chars = F.floor(budget * CHARS_PER_TOKEN).cast("int")
    cut = F.substring(text, F.lit(1), chars)
    at = F.length(cut) - F.locate("\n", F.reverse(cut))
    whole = (F.locate("\n", cut) > 0) & (at > chars * 0.8)
    return F.when(F.length(text) <= chars, text).when(whole, F.substring(cut, F.lit(1), at)).otherwise(cut)


def grep(df: DataFrame, text_col: str, pattern: str, keep: list[str], literal: bool = False, width: int = 200) -> DataFrame:
    """(keep, line, content) of the lines that match, whatever their case. A text without a match
    is not split."""
    text = F.col(text_col)
    hit = (lambda c: F.contains(F.lower(c), F.lit(pattern.lower()))) if literal else (lambda c: c.rlike("(?i)" + pattern))
    rows = df.where(hit(text)).select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("line", "content"))
    return rows.where(hit(F.col("content"))).select(*keep, (F.col("line") + 1).alias("line"), F.substring("content", 1, width).alias("content"))


def category_matches(category: Column, rule: Column, message: Column, scanner: Column) -> Column:
    """Does a scanner hit speak of a finding's category?"""
    words = lookup(F.lower(F.coalesce(category, F.lit(""))), {k: "|".join(v) for k, v in fixed.CATEGORY_WORDS.items()}, "")
    said = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (rule, message, scanner)]))
    return (words != "") & F.exists(F.split(words, r"\|"), lambda w: said.contains(w))


def categories_said(rule: Column, message: Column, scanner: Column) -> Column:
    """The categories that a scanner hit speaks of: bit i for the category i of ``CATEGORY_WORDS``."""
    said = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (rule, message, scanner)]))
    bits = [F.when(any_of([said.contains(w) for w in words]), F.lit(1 << i)).otherwise(F.lit(0)) for i, words in enumerate(fixed.CATEGORY_WORDS.values())]
    return functools.reduce(lambda p, q: p.bitwiseOR(q), bits).cast("long")


def symbol_tokens(symbol: Column) -> Column:
    """A symbol, its dotted form and its parts, in lower case, of two characters and more."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim(symbol), "^[`'\"]+|[`'\"]+$", ""), r"(?s)\(.*$", ""))
    dotted = F.regexp_replace(clean, "::|->|#", ".")
    parts = F.concat(F.array(clean, dotted), F.split(dotted, r"\."))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: F.length(p) >= 2), lambda p: F.lower(p)))


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else empty()
