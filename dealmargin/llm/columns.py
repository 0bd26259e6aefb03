"""Column helpers shared by the operators of this package."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once for an expression that uses it many times.

    Inside a lambda a column expression would be evaluated again for every
    element; as the element of a one-element array it is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    only_ascii = F.octet_length(text) == F.length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def enclosed(rows: DataFrame, **added: Column) -> DataFrame:
    """Rows as the one column _own beside others computed from them, so that no names clash."""
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_own")
    return rows.select(own, *[value.alias(name) for name, value in added.items()])


def without(rows: DataFrame, *names: str) -> DataFrame:
    """Rows without the columns an operator is about to add, whatever their case."""
    added = {name.lower() for name in names}
    return rows.drop(*[c for c in rows.columns if c.lower() in added])
