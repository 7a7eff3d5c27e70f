"""Specifications: attribute resolution, rule checks, groundedness, scores, classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import dims
from ..dims import ALIASES, ATTRIBUTES, BY_NAME
from .common import fill, filled, let, lookup, strip
from .text import significant_words
from .units import base_unit, multiplier, parse_numeric


def resolve_attribute(name: Column) -> Column:
    """The dictionary's name of an attribute: as is, with spaces as underscores, or the other way; null if unknown."""
    key = F.lower(strip(name))
    return F.coalesce(lookup(ALIASES, key), lookup(ALIASES, F.replace(key, F.lit(" "), F.lit("_"))), lookup(ALIASES, F.replace(key, F.lit("_"), F.lit(" "))))


def _of_kind(check: str) -> list[str]:
    return [a.name for a in ATTRIBUTES if a.check == check]


def shown(x: Column) -> Column:
    """A double as Python writes it, without an exponent from 1e7 to 1e16, where Spark has one."""
    large = (F.abs(x) >= 1e7) & (F.abs(x) < 1e16) & (x == F.floor(x))
    return F.when(large, F.concat(x.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(x.cast("string"))


def said(reason: str, **parts: Column) -> Column:
    """A reason of dims.REASONS with its parts filled in; null parts are empty."""
    return F.trim(fill(dims.REASONS[reason], **parts))


def check_spec(attribute: Column, value: Column, unit: Column) -> Column:
    """struct(outcome, reason): pass, fail or unverifiable.

    Ranges take a number without a unit as in base units, and do not ask whether the unit suits the attribute.
    """

    def outcome(name: str | Column, reason: Column) -> Column:
        return F.struct((F.lit(name) if isinstance(name, str) else name).alias("outcome"), reason.alias("reason"))

    def ranged(a: Column) -> Column:
        low = lookup({x.name: x.low for x in ATTRIBUTES if x.low is not None}, a)
        high = lookup({x.name: x.high for x in ATTRIBUTES if x.high is not None}, a)
        open_ = a.isin([x.name for x in ATTRIBUTES if x.low_open])
        hint = F.coalesce(lookup(dims.HINTS, a), F.lit(""))

        def of(p: Column) -> Column:
            stated = F.coalesce(p["unit"], F.lit("")) != ""
            number = F.when(stated, p["number"] * multiplier(p["unit"])).otherwise(p["number"])

            def against(x: Column) -> Column:
                below = F.coalesce(F.when(open_, x <= low).otherwise(x < low), F.lit(False)) & ~F.isnan(x)
                above = F.coalesce(x > high, F.lit(False)) & ~F.isnan(x)
                return (
                    F.when(below, outcome("fail", said("below", number=shown(x), bound=shown(low), hint=hint)))
                    .when(above, outcome("fail", said("above", number=shown(x), bound=shown(high), hint=hint)))
                    .otherwise(outcome("pass", said("within", number=shown(x), low=F.coalesce(shown(low), F.lit("None")), high=F.coalesce(shown(high), F.lit("None")))))
                )

            return (
                F.when(p.isNull(), outcome("unverifiable", said("no_number", value=value)))
                .when(stated & base_unit(p["unit"]).isNull(), outcome("unverifiable", said("no_unit", unit=p["unit"], attribute=a)))
                .otherwise(let(number, against))
            )

        return let(parse_numeric(value, unit), of)

    def patterned(a: Column) -> Column:
        text = F.when(a == "thread_size", F.regexp_replace(strip(value), r"(?iU)\s*[×x]\s*", "x")).otherwise(strip(value))
        matches = F.coalesce(*(F.when(a == x.name, text.rlike(x.pattern)) for x in ATTRIBUTES if x.pattern))
        return F.when(matches, outcome("pass", said("format", value=value))).otherwise(outcome("fail", said("no_format", value=value, attribute=a)))

    def listed(a: Column) -> Column:
        text = F.lower(strip(value))
        member = F.coalesce(*(F.when(a == x.name, text.isin(list(x.values))) for x in ATTRIBUTES if x.values))
        return F.when(member, outcome("pass", said("listed", value=value, attribute=a))).otherwise(outcome("fail", said("not_listed", value=value, attribute=a)))

    def of(a: Column) -> Column:
        return (
            F.when(a.isin(_of_kind("range")), ranged(a)).when(a.isin(_of_kind("pattern")), patterned(a)).when(a.isin(_of_kind("enum")), listed(a))
            .otherwise(outcome("unverifiable", said("no_rule", attribute=attribute)))
        )

    return let(resolve_attribute(attribute), of)


def grounded(value: Column, text: Column) -> Column:
    """Whether a value's significant words are (six tenths of them) in a text; flags and wordless values are."""
    flag = F.lower(strip(value)).isin(list(dims.BOOLEANS))
    own = significant_words(value)
    share = F.size(F.array_intersect(own, significant_words(text))) / F.when(F.size(own) > 0, F.size(own))
    return flag | (F.size(own) == 0) | F.coalesce(share >= dims.OVERLAP, F.lit(False))


def score_spec(status: Column, source_type: Column, outcome: Column, ungrounded: Column | None = None) -> Column:
    """Confidence from status, source and check, less a penalty where a cited block is missing or does not hold the value."""
    base = F.coalesce(lookup(dims.BASE_BY_STATUS, status), F.lit(dims.OTHER_BASE)) * F.coalesce(lookup(dims.SOURCE_TRUST, source_type), F.lit(dims.OTHER_TRUST))
    moved = base + F.when(outcome == "pass", dims.PASS_BOOST).when(outcome == "fail", -dims.FAIL_PENALTY).otherwise(-dims.UNVERIFIABLE_PENALTY)
    if ungrounded is not None:
        moved = moved - F.when(ungrounded, dims.UNGROUNDED_PENALTY).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved))


def reviewed_status(status: Column, attribute: Column, outcome: Column, ungrounded: Column | None = None) -> Column:
    """needs_review for unknown attributes, failed checks and ungrounded values; the score uses the status before."""
    doubt = resolve_attribute(attribute).isNull() | (outcome == "fail")
    if ungrounded is not None:
        doubt = doubt | ungrounded
    return F.when(doubt, "needs_review").otherwise(status)


def confidence_bucket(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def normalize_currency(code: Column) -> Column:
    return F.upper(strip(filled(code)))


def is_known_currency(code: Column) -> Column:
    return F.coalesce(normalize_currency(code).isin(list(dims.CURRENCIES)), F.lit(False))


def match_availability(raw: Column) -> Column:
    """The feed's word for a free text: that of the first keyword it contains, else null."""
    text = F.replace(F.lower(strip(raw)), F.lit("_"), F.lit(" "))
    out = F.lit(None).cast("string")
    for word, value in reversed(dims.AVAILABILITY):
        out = F.when(text.contains(word), value).otherwise(out)
    return out


def parse_price(raw: Column) -> Column:
    """A double without thousands separators and leading dollar signs, or null."""
    from .units import to_float

    return to_float(F.regexp_replace(F.replace(strip(raw), F.lit(","), F.lit("")), r"^\$+", ""))


def classify_spec(status: Column, conflicting: Column) -> Column:
    return F.when(conflicting, "conflict").when(status.isin("needs_review", "inferred"), "unverified").otherwise("grounded")


def issue_severity(issue: Column) -> Column:
    return F.when(issue.startswith("required:"), "required").when(issue.startswith("warning:"), "warning").otherwise("recommended")


def expects_unit(feature: Column) -> Column:
    return F.coalesce(resolve_attribute(feature).isin([a.name for a in BY_NAME.values() if a.units]), F.lit(False))
