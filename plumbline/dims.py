"""Dimension tables of the product domain: plain data that operators look up as map literals or broadcast rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Attribute:
    """A rule row.  check is range, pattern or enum; the first unit is the base of an unstated one."""

    name: str
    category: str
    check: str
    low: float | None = None
    low_open: bool = False
    high: float | None = None
    pattern: str | None = None
    values: tuple[str, ...] = ()
    units: tuple[str, ...] = ()
    aliases: tuple[str, ...] = field(default=())


# The attribute dictionary.
ATTRIBUTES = (
    Attribute("voltage_rating", "Electrical", "range", 1.0, False, 1000.0, units=("V", "kV", "mV"), aliases=("voltage", "rated voltage", "rated volts", "rated_voltage", "voltage rating")),
    Attribute("current_rating", "Electrical", "range", 0.1, False, 100.0, units=("A", "mA"), aliases=("current", "rated current", "rated_current", "amperage")),
    Attribute("ip_rating", "Electrical", "pattern", pattern=r"^IP[0-6][0-9K]$", aliases=("ingress protection", "ip", "protection rating")),
    Attribute("operating_temp", "Electrical", "range", -40.0, False, 150.0, units=("°C", "C", "degC"), aliases=("operating temperature", "operating_temperature", "temperature range", "temp range")),
    Attribute("thread_size", "Fasteners", "pattern", pattern=r"^(M\d+(\.\d+)?(x\d+(\.\d+)?)?|#\d+|\d+(\.\d+)?/\d+in|\d+(\.\d+)?in)$", aliases=("thread", "thread size", "thread diameter", "size")),
    Attribute("tensile_strength", "Fasteners", "range", 200.0, False, 2000.0, units=("MPa", "psi", "ksi", "N/mm²"), aliases=("tensile", "tensile strength", "ultimate tensile strength", "uts")),
    Attribute("material", "Fasteners", "enum", values=("steel", "stainless steel", "carbon steel", "alloy steel", "brass", "aluminum", "titanium", "nylon", "plastic"), aliases=("material type", "body material", "construction")),
    Attribute("coating", "Fasteners", "enum", values=("none", "zinc", "zinc plated", "black oxide", "galvanized", "chrome", "nickel", "phosphate"), aliases=("finish", "plating", "surface finish", "surface treatment")),
    Attribute("length", "Both", "range", 0.0, True, None, units=("mm", "cm", "m", "in", "ft"), aliases=("overall length", "len", "size length")),
    Attribute("weight", "Both", "range", 0.0, True, None, units=("g", "kg", "mg", "lb", "oz"), aliases=("mass", "net weight", "unit weight")),
)
BY_NAME = {a.name: a for a in ATTRIBUTES}
#: Lower-cased name or alias -> name.
ALIASES = {key.lower(): a.name for a in ATTRIBUTES for key in (a.name, *a.aliases)}

# The units that reasons name for an attribute.
HINTS = {"voltage_rating": "V", "current_rating": "A", "operating_temp": "°C", "tensile_strength": "MPa or psi", "length": "mm or in", "weight": "g or kg"}

# Reasons of checks.
REASONS = {
    "no_number": "could not parse '{value}' as a number",
    "no_unit": "unrecognized unit '{unit}' for {attribute}",
    "below": "{number} is below minimum {bound} {hint}",
    "above": "{number} is above maximum {bound} {hint}",
    "within": "{number} within [{low}, {high}]",
    "format": "'{value}' matches expected format",
    "no_format": "'{value}' does not match expected format for {attribute}",
    "listed": "'{value}' is a known {attribute} value",
    "not_listed": "'{value}' is not a recognized {attribute} value",
    "no_rule": "'{attribute}' is not in the attribute dictionary",
}

# Issues of feeds.
ISSUES = {
    "property": "required: additionalProperty entry missing name or value",
    "name": "required: name is missing",
    "image": "recommended: image is missing (Google Merchant Center requires it)",
    "offers": "recommended: offers is missing (no price/availability data)",
    "price_currency": "required: offers.priceCurrency is missing while offers.price is present",
    "identifier": "recommended: at least one of sku/gtin/mpn should be present",
    "id": "required: id is missing",
    "title": "required: title is missing",
    "description": "required: description is missing",
    "link": "required: link is missing (no website-sourced URL available)",
    "image_link": "required: image_link is missing",
    "availability": "required: availability is missing or unrecognized",
    "price": "required: price is missing (no price, no currency, or unrecognized currency)",
    "brand": "required: at least one of brand+mpn, or gtin, must identify the product",
    "condition": "recommended: condition is not set (no condition signal)",
    "category": "recommended: google_product_category is not set (no taxonomy match implemented)",
    "class_name": "recommended: class_name is missing (no predicted category)",
    "class_code": "warning: class_code is set but no code table was available to validate it against",
    "known_currency": "warning: offers.priceCurrency '{code}' is not a recognized ISO 4217 code",
    "known_availability": "required: availability '{value}' is not a recognized value",
    "feature_value": "required: feature '{name}' has no value",
    "feature_unit": "recommended: feature '{name}' has a numeric value but no resolvable unit",
}

# Warnings of catalogue rows.
WARNINGS = {"no_name": "row {row}: no product name (and no sku/mpn fallback), skipped", "no_price": "row {row}: could not parse price '{price}'"}

# Unit -> (base unit, multiplier).
UNITS = {
    "v": ("v", 1.0), "kv": ("v", 1000.0), "mv": ("v", 0.001), "a": ("a", 1.0), "ma": ("a", 0.001),
    "°c": ("°c", 1.0), "c": ("°c", 1.0), "degc": ("°c", 1.0),
    "mm": ("mm", 1.0), "cm": ("mm", 10.0), "m": ("mm", 1000.0), "in": ("mm", 25.4), "ft": ("mm", 304.8),
    "g": ("g", 1.0), "kg": ("g", 1000.0), "mg": ("g", 0.001), "lb": ("g", 453.59237), "oz": ("g", 28.349523),
    "mpa": ("mpa", 1.0), "n/mm²": ("mpa", 1.0), "psi": ("mpa", 0.00689476), "ksi": ("mpa", 6.89476),
}

# Catalogue header -> record field.
CORE_COLUMNS = {
    "product_name": "product_name", "name": "product_name", "product name": "product_name", "item": "product_name", "item name": "product_name",
    "item description": "product_name", "product description": "product_name", "title": "product_name",
    "brand": "brand", "manufacturer": "brand", "mfr": "brand", "make": "brand", "description": "description", "category": "category",
    "sku": "sku", "item code": "sku", "product code": "sku", "part code": "sku", "model number": "mpn", "gtin": "gtin", "upc": "gtin", "ean": "gtin",
    "mpn": "mpn", "part number": "mpn", "part_number": "mpn", "price": "price", "unit cost": "price", "currency": "currency",
    "availability": "availability", "stock status": "availability", "stock_status": "availability",
}

# First keyword contained wins.
AVAILABILITY = (
    ("preorder", "preorder"), ("pre-order", "preorder"), ("backorder", "backorder"), ("back order", "backorder"), ("out of stock", "out_of_stock"),
    ("unavailable", "out_of_stock"), ("sold out", "out_of_stock"), ("discontinued", "out_of_stock"), ("in stock", "in_stock"), ("available", "in_stock"), ("ships", "in_stock"),
)
AVAILABILITY_IRI = {"in_stock": "https://schema.org/InStock", "out_of_stock": "https://schema.org/OutOfStock", "preorder": "https://schema.org/PreOrder", "backorder": "https://schema.org/BackOrder"}
CURRENCIES = ("USD", "EUR", "GBP", "INR", "JPY", "CNY", "CAD", "AUD", "CHF", "SGD")
STOPWORDS = ("a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "was", "were", "be", "as", "at", "by", "this", "that")
BOOLEANS = ("yes", "no", "true", "false", "n/a", "na", "none", "present", "absent")

# Scoring.
BASE_BY_STATUS, OTHER_BASE = {"extracted": 0.85, "inferred": 0.6, "needs_review": 0.3}, 0.5
SOURCE_TRUST, OTHER_TRUST = {"document": 1.0, "website": 0.85}, 1.0
PASS_BOOST, FAIL_PENALTY, UNVERIFIABLE_PENALTY, UNGROUNDED_PENALTY = 0.10, 0.45, 0.05, 0.45
OVERLAP = 0.6


def attribute_table(spark: SparkSession) -> DataFrame:
    """The dictionary as rows (fixed size), for joins that are clearer than map literals."""
    rows = [(a.name, a.category, a.check, a.low, a.low_open, a.high, a.pattern, list(a.values), list(a.units), list(a.aliases)) for a in ATTRIBUTES]
    return spark.createDataFrame(rows, "attribute string, category string, check string, low double, low_open boolean, high double, pattern string, values array<string>, units array<string>, aliases array<string>")
