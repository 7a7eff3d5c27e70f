"""Small Column helpers: strip as Python does, map literals, single evaluation."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim() takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), computed once a row."""
    return F.transform(F.array(value), use)[0]


def lookup(table: Mapping[str, str | float], key: Column) -> Column:
    """The value of a small fixed table, or null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def filled(c: Column) -> Column:
    """Null for an empty string."""
    return F.when(c != "", c)


def fill(text: str, **parts: Column) -> Column:
    """A text with its {parts} filled in; null parts are empty."""
    pieces = re.split(r"\{(\w+)\}", text)
    return F.concat(*(F.coalesce(parts[t], F.lit("")) if k % 2 else F.lit(t) for k, t in enumerate(pieces)))
