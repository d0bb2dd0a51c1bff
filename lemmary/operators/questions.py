"""Questions from premises and a conclusion, as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lemmary.functions.text import join_premises


def statement(s: Column, p: Column, o: Column, pattern: Column | None = None) -> Column:
    """A pattern with {subject}, {predicate} and {object} filled in; "s p o" without one."""
    pattern = F.coalesce(pattern, F.lit("{subject} {predicate} {object}")) if pattern is not None else F.lit("{subject} {predicate} {object}")
    out = F.replace(pattern, F.lit("{subject}"), s)
    return F.replace(F.replace(out, F.lit("{predicate}"), p), F.lit("{object}"), o)


def yes_no(premises: Column, conclusion: Column) -> Column:
    return F.concat(F.lit("Given that "), join_premises(premises), F.lit(", is it true that "), conclusion, F.lit("?"))


def true_false(premises: Column, conclusion: Column) -> Column:
    word = F.when(F.size(premises) == 1, F.lit("premise")).otherwise(F.lit("premises"))
    return F.concat(F.lit("Based on the "), word, F.lit(" that "), join_premises(premises), F.lit(", is it true that "), conclusion, F.lit("?"))


def correct_position(n: Column | int, head: Column, seed: Column | None = None) -> Column:
    """Place of the right option: the seed modulo n, or the head's md5."""
    n = F.lit(n) if isinstance(n, int) else n
    hashed = F.conv(F.substring(F.md5(head.cast("binary")), 1, 8), 16, 10).cast("long")
    value = hashed if seed is None else F.coalesce(seed.cast("long"), hashed)
    return F.pmod(value, n).cast("int")


def options(distractors: Column, conclusion: Column, position: Column, n: int) -> Column:
    """The right option among n - 1 distractors; null with too few or repeated options."""
    some = F.slice(distractors, 1, n - 1)
    out = F.concat(F.slice(some, F.lit(1), position), F.array(conclusion), F.slice(some, position + 1, F.lit(n) - 1 - position))
    return F.when((F.size(some) == n - 1) & (F.size(F.array_distinct(out)) == n), out)


def multiple_choice(premises: Column, choices: Column) -> Column:
    lines = F.array_join(F.transform(choices, lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), c)), "\n")
    return F.concat(F.lit("Given that "), join_premises(premises), F.lit(", which of the following conclusions is logically valid?\n\n"), lines)


def letter(position: Column) -> Column:
    return F.char(F.lit(65) + position)


def wh_direction(functionality: Column, inverse: Column) -> Column:
    """Which side a question asks for: the object if the relation is at least as functional as its inverse."""
    return F.when(F.coalesce(functionality, F.lit(0.0)) >= F.coalesce(inverse, F.lit(0.0)), F.lit("object")).otherwise(F.lit("subject"))
