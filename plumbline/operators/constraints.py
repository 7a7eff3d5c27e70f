"""Constraints on JSON values, compiled from a table to Column expressions over VARIANT; every fault comes with its path.

No Python runs on executors: kinds are those of schema_of_variant, arrays are walked by transform.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..functions.common import let

STRING, NUMBER, INTEGER, BOOLEAN, ARRAY, OBJECT = "text", "a number", "a whole number", "true or false", "a list", "an object"
_TYPES = {
    STRING: "^STRING$", NUMBER: r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)", INTEGER: r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\)$)",
    BOOLEAN: "^BOOLEAN$", ARRAY: "^ARRAY<", OBJECT: "^OBJECT<",
}
_FAULTS = "array<struct<path: string, fault: string>>"


@dataclass(frozen=True)
class Constraint:
    """What the value at a path must be. `a.b[].c` is the field c of each element of the list b of a; `[]` at the end is each element itself.

    A value whose parent is missing, null or of another kind is the parent's affair. An optional value may be missing, and null
    unless `nullable` is false; a required one must be there and not be null. low and high (both included) bound numbers, `values` are the texts
    that are allowed, `filled` wants a text with something in it.
    """

    path: str
    kind: str
    required: bool = False
    nullable: bool = True
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()
    filled: bool = False


def _check(value: Column, shown: Column, c: Constraint) -> Column:
    number = F.try_variant_get(value, "$", "double")
    text = F.try_variant_get(value, "$", "string")
    fault = F.when(value.isNull(), "is missing" if c.required else None)
    fault = fault.when(F.is_variant_null(value), "is null" if c.required or not c.nullable else None)
    fault = fault.when(~F.schema_of_variant(value).rlike(_TYPES[c.kind]), f"is not {c.kind}")
    if c.low is not None:
        fault = fault.when(number < c.low, f"is below {c.low:g}")
    if c.high is not None:
        fault = fault.when(number > c.high, f"is above {c.high:g}")
    if c.values:
        fault = fault.when(~text.isin(*c.values), f"is none of {', '.join(c.values)}")
    if c.filled:
        fault = fault.when(text == "", "is empty")
    return let(fault, lambda f: F.when(f.isNotNull(), F.array(F.struct(shown.alias("path"), f.alias("fault")))).otherwise(F.array().cast(_FAULTS)))


def _walk(value: Column, steps: list[str], shown: Column, c: Constraint, is_object: bool = False) -> Column:
    if not steps:
        return _check(value, shown, c)
    step, rest = steps[0], steps[1:]
    if step == "[]":
        elements = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        return F.flatten(F.transform(elements, lambda x, i: _walk(x, rest, F.concat(shown, F.lit("["), i.cast("string"), F.lit("]")), c)))
    child = F.try_variant_get(value, f"$['{step}']", "variant")
    named = F.when(shown == "", F.lit(step)).otherwise(F.concat(shown, F.lit("."), F.lit(step)))
    inner = let(child, lambda x: _walk(x, rest, named, c))
    if is_object:
        return inner
    # a parent that is no object has no fields to be at fault
    return F.when(F.coalesce(F.schema_of_variant(value).rlike(_TYPES[OBJECT]), F.lit(False)), inner).otherwise(F.array().cast(_FAULTS))


def faults(value: Column, constraints: Iterable[Constraint]) -> Column:
    """array<struct<path, fault>> of a variant's faults, in the order of the constraints; a null value is one fault at the path ''."""
    found = []
    for c in constraints:
        steps = [s for part in c.path.split(".") for s in re.split(r"(\[\])", part) if s]
        found.append(_walk(value, steps, F.lit(""), c, is_object=steps[0] != "[]"))  # as `faults` asks before it looks further
    none = F.array(F.struct(F.lit("").alias("path"), F.lit("is not JSON").alias("fault")))
    root = F.array(F.struct(F.lit("").alias("path"), F.lit("is not an object").alias("fault")))
    whole = F.concat(*found) if found else F.array().cast(_FAULTS)
    return F.when(value.isNull(), none).when(~F.schema_of_variant(value).rlike(_TYPES[OBJECT]), root).otherwise(whole)


def told(found: Column) -> Column:
    """Faults as one line: `path fault; path fault`; null without any."""
    each = F.transform(found, lambda f: F.trim(F.concat_ws(" ", f["path"], f["fault"])))
    return F.when(F.size(found) > 0, F.array_join(each, "; "))


def _specification(at: str) -> list[Constraint]:
    return [
        Constraint(f"{at}[]", OBJECT, nullable=False),
        Constraint(f"{at}[].attribute", STRING, required=True),
        Constraint(f"{at}[].value", STRING, required=True),
        Constraint(f"{at}[].unit", STRING),
        Constraint(f"{at}[].confidence", NUMBER, nullable=False, low=0, high=1),
        Constraint(f"{at}[].status", STRING, nullable=False, values=("extracted", "inferred", "needs_review")),
        Constraint(f"{at}[].source", OBJECT),
        Constraint(f"{at}[].source.type", STRING, required=True, values=("document", "website")),
        Constraint(f"{at}[].source.reference", STRING, required=True),
        Constraint(f"{at}[].source.snippet", STRING),
    ]


#: A product record as a provider may give it: only the name is required, and parts that are there must be whole.
RECORD = [
    Constraint("schema_version", STRING, nullable=False),
    Constraint("product_id", STRING),
    Constraint("product_name", STRING, required=True),
    Constraint("brand", STRING),
    Constraint("category", OBJECT, nullable=False),
    Constraint("category.predicted", STRING, nullable=False),
    Constraint("category.confidence", NUMBER, nullable=False, low=0, high=1),
    Constraint("description", STRING, nullable=False),
    Constraint("identifiers", OBJECT, nullable=False),
    *(Constraint(f"identifiers.{k}", STRING) for k in ("sku", "gtin", "mpn")),
    Constraint("media", OBJECT, nullable=False),
    Constraint("media.images", ARRAY, nullable=False),
    Constraint("media.images[]", STRING, nullable=False),
    Constraint("commercial", OBJECT, nullable=False),
    Constraint("commercial.price", OBJECT),
    Constraint("commercial.price.value", NUMBER),
    Constraint("commercial.price.currency", STRING),
    Constraint("commercial.availability", STRING),
    Constraint("compliance", ARRAY, nullable=False),
    Constraint("compliance[]", STRING, nullable=False),
    Constraint("specifications", ARRAY, nullable=False),
    *_specification("specifications"),
    Constraint("provenance", OBJECT, nullable=False),
    Constraint("provenance.sources_used", ARRAY, nullable=False),
    Constraint("provenance.sources_used[]", OBJECT, nullable=False),
    Constraint("provenance.sources_used[].id", STRING, required=True),
    Constraint("provenance.sources_used[].type", STRING, required=True, values=("document", "website")),
    Constraint("provenance.sources_used[].reference", STRING, required=True),
    Constraint("provenance.sources_used[].page", INTEGER),
    Constraint("validation", OBJECT, nullable=False),
    Constraint("validation.overall_confidence", NUMBER, nullable=False, low=0, high=1),
    Constraint("validation.conflicts", ARRAY, nullable=False),
    Constraint("validation.conflicts[].attribute", STRING, required=True),
    Constraint("validation.conflicts[].values[]", STRING, nullable=False),
    Constraint("validation.conflicts[].sources[]", STRING, nullable=False),
]
