"""Text functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..dims import STOPWORDS
from .common import filled, let, strip

WORD = r"[a-z]+|[0-9]+(?:\.[0-9]+)?"


def normalize_whitespace(t: Column) -> Column:
    """Runs of spaces and tabs become one space, three newlines or more become two; stripped."""
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def block_id(index: Column) -> Column:
    return F.format_string("b%04d", index)


def table_to_text(table: Column) -> Column:
    """Cells stripped and joined by ' | ', rows by newline; null cells are empty."""
    return F.array_join(F.transform(table, lambda row: F.array_join(F.transform(row, lambda cell: F.coalesce(strip(cell), F.lit(""))), " | ")), "\n")


def normalize_header(h: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(h), r"[^a-z0-9]+", " "))


def custom_name(h: Column) -> Column:
    """The attribute name of a header without a known one."""
    return F.replace(normalize_header(h), F.lit(" "), F.lit("_"))


def significant_words(t: Column) -> Column:
    """The distinct words and numbers of a text, without stopwords."""
    return F.array_except(F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0)), F.array(*map(F.lit, STOPWORDS)))


def block_text(text: Column, table: Column) -> Column:
    cells = F.filter(F.flatten(table), lambda c: F.coalesce(c, F.lit("")) != "")
    return F.when(table.isNotNull(), F.array_join(cells, " ")).otherwise(F.coalesce(text, F.lit("")))


def snippet(text: Column, section: Column, needle: Column, most: int = 200) -> Column:
    """One line of at most `most` characters: the section in brackets, then the text around the needle.

    A cut begins about a third before the needle; the right ellipsis shows only where
    trailing white space left room for it.
    """
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    whole = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("["), section, F.lit("] "), flat)).otherwise(flat)

    def cut(t: Column) -> Column:
        at = F.when(F.coalesce(needle, F.lit("")) != "", F.instr(F.lower(t), F.lower(needle)) - 1).otherwise(F.lit(-1))

        def around(at: Column) -> Column:
            start = F.greatest(F.lit(0), at - most // 3)
            body = F.substring(t, start + 1, F.lit(most))
            body = F.when(start > 0, F.concat(F.lit("…"), F.substring(body, F.lit(2), F.length(body)))).otherwise(body)
            body = F.when(start + most < F.length(t), F.concat(F.rtrim(body), F.lit("…"))).otherwise(body)
            return F.when(at >= 0, F.substring(body, F.lit(1), F.lit(most))).otherwise(F.concat(F.rtrim(F.substring(t, F.lit(1), F.lit(most - 1))), F.lit("…")))

        return F.when(F.length(t) <= most, t).otherwise(let(at, around))

    return let(whole, cut)


def strip_code_fences(t: Column) -> Column:
    return F.regexp_replace(strip(t), r"(?m)^```(?:json)?\s*|\s*```$", "")


def split_on_match(text: Column, needle: Column) -> Column:
    """struct(before, match, after) of the first match, in any case; everything before without one."""
    at = F.when(F.coalesce(needle, F.lit("")) != "", F.instr(F.lower(text), F.lower(needle))).otherwise(0)
    n = F.length(needle)
    hit = F.struct(F.substring(text, F.lit(1), at - 1).alias("before"), F.substring(text, at, n).alias("match"), F.substring(text, at + n, F.length(text)).alias("after"))
    return F.when(at > 0, hit).otherwise(F.struct(text.alias("before"), F.lit("").alias("match"), F.lit("").alias("after")))


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def iso8601(ts: Column) -> Column:
    """In UTC, microseconds only where there are any."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    micros = F.date_format(utc, "SSSSSS")
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def display_name(attribute: Column) -> Column:
    return F.replace(attribute, F.lit("_"), F.lit(" "))


def display_value(value: Column, unit: Column) -> Column:
    """A value with its unit behind it, if it has one."""
    return F.concat_ws(" ", value, filled(unit))


def render_block(block: Column) -> Column:
    """A prompt line of struct(block_id, type, text, table, page, section)."""
    where = F.concat_ws(", ", F.when(block["page"].isNotNull(), F.concat(F.lit("page "), block["page"].cast("string"))), F.when(F.coalesce(block["section"], F.lit("")) != "", F.concat(F.lit("section '"), block["section"], F.lit("'"))))
    place = F.when(where != "", F.concat(F.lit(" ("), where, F.lit(")"))).otherwise("")
    rows = F.array_join(F.transform(block["table"], lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")
    return (
        F.when((block["type"] == "table") & (F.coalesce(F.size(block["table"]), F.lit(0)) > 0), F.concat(F.lit("["), block["block_id"], F.lit("] TABLE"), place, F.lit(":\n"), rows))
        .when(F.coalesce(block["text"], F.lit("")) != "", F.concat(F.lit("["), block["block_id"], F.lit("] "), F.upper(block["type"]), place, F.lit(": "), block["text"]))
    )
