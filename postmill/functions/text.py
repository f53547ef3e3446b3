"""Text expressions: Column to Column, inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a word begins in title case: after anything that isn't a letter, or after space and apostrophe only.
AFTER_NON_LETTER, AFTER_SPACE_OR_APOSTROPHE = r"(?<=\P{L})(?=\p{L})", r"(?<=[ '])"


def title_case(c: Column, boundary: str = AFTER_NON_LETTER) -> Column:
    """Upper-case the first letter of each word and lower-case the others; of letters of ASCII and spaces by the built-in function."""
    words = F.split(c, boundary)
    return F.when(c.rlike(r"\A[A-Za-z ]*\z"), F.initcap(c)).otherwise(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), ""))


def having(c: Column, words: tuple[str, ...], then: Column, otherwise: Column) -> Column:
    """``then`` where the lower-cased text has one of the words, which is cheaper to see than whether a pattern with them matches."""
    low = F.lower(c)
    return F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), then).otherwise(otherwise)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_all(c: Column) -> Column:
    """Trim all Unicode white space, not only spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of two and more white space characters become one space."""
    return F.regexp_replace(c, r"\s{2,}", " ")


def first_present(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def split_before_capitals(c: Column) -> Column:
    """Lines of a block of which each begins with a capital letter."""
    return F.split(c, r"\n(?=[A-Z])")


def evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further columns, each computed once for a row.

    A filter or join above a plain projection makes the optimizer copy the projection's expressions
    into the condition, again at every level; long regular-expression chains are then evaluated many
    times. A generator of one row is a border that conditions don't cross; what the columns have in
    common is computed once in the projection below it.
    """
    if not columns:
        return df
    made = df.select("*", *[c.alias(f"_made_{name}") for name, c in columns.items()])
    row = F.struct(*[F.col(f"_made_{name}").alias(name) for name in columns])
    return made.select(*df.columns, F.inline_outer(F.array(row)))
