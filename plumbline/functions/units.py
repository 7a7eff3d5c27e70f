"""Numbers with units: parsing, conversion to base units, comparison keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..dims import BY_NAME, UNITS
from .common import filled, let, lookup, strip

_D = r"\d(?:_?\d)*"
#: Decimal numbers that Python's float() accepts, nan and inf apart.
FLOAT = rf"^\s*[+-]?(?:{_D}(?:\.(?:{_D})?)?|\.{_D})(?:[eE][+-]?{_D})?\s*$"
WITH_UNIT = r"^\s*([+-]?\d+(?:\.\d+)?)\s*([^\d\s].*)?\s*$"


def to_float(value: Column) -> Column:
    """A double for decimal numbers (with _ between digits allowed), null for anything else, d and f suffixes included."""
    return F.when(value.rlike(FLOAT), F.replace(strip(value), F.lit("_"), F.lit("")).try_cast("double"))


def round2(x: Column) -> Column:
    """Two places of a number from 0 to 1 as Python's round() gives them: by its binary value, exact halves to even.

    A number that prints as an odd multiple of 1 / 200 is above or below it by its binary value; all differences here are exact.
    """

    def of(x: Column, t: Column) -> Column:
        above = ((x * 128.0 - t) + x * 64.0) + x * 8.0
        up, down = (t + 1) / 200.0, (t - 1) / 200.0
        tie = (t % 2 == 1) & (F.abs(x * 200.0 - t) < 1e-9)
        even = F.when((t + 1) % 4 == 0, up).otherwise(down)
        return F.when(~tie, F.round(x, 2)).when(above > 0, up).when(above < 0, down).otherwise(even)

    return let(x, lambda x: let(F.round(x * 200.0), lambda t: of(x, t)))


def parse_numeric(value: Column, unit: Column) -> Column:
    """struct(number, unit), or null.  A plain number keeps the declared unit; else a unit in the value comes before it."""
    own = filled(strip(F.regexp_extract(value, WITH_UNIT, 2)))
    return (
        F.when(value.rlike(FLOAT), F.struct(to_float(value).alias("number"), unit.alias("unit")))
        .when(value.rlike(WITH_UNIT), F.struct(F.regexp_extract(value, WITH_UNIT, 1).try_cast("double").alias("number"), F.coalesce(own, unit).alias("unit")))
    )


def unit_key(unit: Column) -> Column:
    return F.lower(strip(unit))


def base_unit(unit: Column) -> Column:
    return lookup({u: base for u, (base, _) in UNITS.items()}, unit_key(unit))


def multiplier(unit: Column) -> Column:
    return lookup({u: m for u, (_, m) in UNITS.items()}, unit_key(unit))


def to_base(number: Column, unit: Column) -> Column:
    """struct(number, unit) in the base unit, or null for an unknown unit."""
    return F.when(base_unit(unit).isNotNull(), F.struct((number * multiplier(unit)).alias("number"), base_unit(unit).alias("unit")))


def normalized_value(attribute: Column, value: Column, unit: Column) -> Column:
    """struct(number, unit) for feeds; fields null for values that are no number or have an unknown unit.

    Without a unit the attribute's first unit is taken for stated; without that, the number stands alone.
    """
    default = {a.name: UNITS[a.units[0].lower()][0] for a in BY_NAME.values() if a.units}
    none = F.struct(F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("unit"))

    def of(p: Column) -> Column:
        stated = F.coalesce(p["unit"], F.lit("")) != ""
        return F.when(p.isNull(), none).when(stated, F.coalesce(to_base(p["number"], p["unit"]), none)).otherwise(F.struct(p["number"].alias("number"), lookup(default, attribute).alias("unit")))

    return let(parse_numeric(value, unit), of)


def comparable(value: Column, unit: Column) -> Column:
    """A string key that is equal for values that agree.  Here the declared unit comes before one in the value."""
    own = filled(strip(F.regexp_extract(value, WITH_UNIT, 2)))
    stated = F.coalesce(filled(unit), F.when(value.rlike(WITH_UNIT), own))
    number = F.when(value.rlike(WITH_UNIT), F.regexp_extract(value, WITH_UNIT, 1).try_cast("double"))
    numeric = F.when(number.isNotNull() & base_unit(stated).isNotNull(), F.concat_ws("|", F.lit("n"), base_unit(stated), F.round(number * multiplier(stated), 9).cast("string")))
    return F.coalesce(numeric, F.concat_ws("|", F.lit("s"), F.lower(strip(value)), F.lower(strip(F.coalesce(stated, F.lit(""))))))
