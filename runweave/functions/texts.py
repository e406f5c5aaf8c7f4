"""Small Column builders on names and hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that trimming removes (as Python's strip does for the characters that occur in exports).
BLANKS = " \t\r\n\x0b\x0c "


def strip(c: Column) -> Column:
    """c without white space at both ends; NULL stays NULL."""
    return F.btrim(c, F.lit(BLANKS))


def name_key(c: Column) -> Column:
    """The form in which names are compared: trimmed, lower case; NULL when blank."""
    k = F.lower(strip(c))
    return F.when(k != "", k)


def host_key(c: Column) -> Column:
    """Host name: trimmed, lower case, without domain; NULL when blank."""
    k = F.substring_index(F.lower(strip(c)), ".", 1)
    k = strip(k)
    return F.when(k != "", k)


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns, computed once each.

    Filters on computed columns are pushed through projections, which repeats
    the expressions; a long chain of steps then grows without bound. A
    generator that makes one row of one is not looked through, and it stays
    within generated code.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
