"""Columns about contents: lengths, escapes, numbers, truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contextlake import constants as C


def utf16_length(text: Column) -> Column:
    """UTF-16 code units, in which limits are given; an emoji counts two."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def count_lines(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n")) + 1


def estimate_tokens(chars: Column) -> Column:
    return F.when(chars > 0, F.ceil(chars / C.CHARS_PER_TOKEN)).otherwise(F.lit(0)).cast("bigint")


def number_lines(text: Column) -> Column:
    """``%4d: `` before every line; an empty text is one empty line."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.concat(F.format_string(C.LINE_NUMBER_FORMAT, i + 1), line)), "\n")


def add_line_numbers(text: Column) -> Column:
    """number_lines() as outputs have it: an empty text stays empty."""
    return F.when(text == "", text).otherwise(number_lines(text))


def truncate_string(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def sanitize_comment(text: Column) -> Column:
    for a, b in (("--", "—"), ("<", "‹"), (">", "›")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(text)


def sanitize_xml(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def escape_xml_text(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_xml_attribute(text: Column) -> Column:
    return F.replace(F.replace(escape_xml_text(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;"))


def escape_cdata(text: Column) -> Column:
    """Without control characters that XML forbids, and with no end of the section inside."""
    return F.replace(sanitize_xml(text), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))


def quote_scalar(text: Column) -> Column:
    """A YAML scalar or marker attribute: quotes escaped and put around; null is null."""
    return F.coalesce(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))


def choose_fence(text: Column) -> Column:
    """Three backticks, or one more than the longest run of three or more in the text, four at least."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(`{3,})"), 1), F.length)), F.lit(0))
    return F.when(longest == 0, F.lit("```")).otherwise(F.repeat(F.lit("`"), F.greatest(F.lit(4), longest + 1)))


def marker(kind: str, **attributes: Column) -> Column:
    """``<!-- ctx:kind a="x" -->``; null and empty attributes are left out."""
    parts = [F.when(v != "", F.concat(F.lit(f"{k}="), quote_scalar(v))) for k, v in attributes.items()]
    return F.concat(F.lit(f"<!-- ctx:{kind} "), F.concat_ws(" ", *parts), F.lit(" -->"))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def one_line_base64(raw: Column) -> Column:
    return F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))


def truncate_at_line(content: Column, budget: Column) -> Column:
    """struct<content, dropped_lines, total_lines>: at most budget UTF-16 units with a marker, by whole lines if one fits; null if none does.

    Without a line that fits, the text is cut by code points whose UTF-16 length fits, so a pair is never split.
    """
    lines = F.split(content, "\n")
    total = F.size(lines)
    digits = F.length(total.cast("string"))
    usable = budget - (utf16_length(F.lit("\n… [truncated mid-line,  of  lines omitted]")) + 2 * digits)
    step = lambda acc, line: F.struct(
        F.when(acc["open"] & (acc["used"] + F.when(acc["kept"] == 0, 0).otherwise(1) + utf16_length(line) <= usable), acc["used"] + F.when(acc["kept"] == 0, 0).otherwise(1) + utf16_length(line)).otherwise(acc["used"]).alias("used"),
        F.when(acc["open"] & (acc["used"] + F.when(acc["kept"] == 0, 0).otherwise(1) + utf16_length(line) <= usable), acc["kept"] + 1).otherwise(acc["kept"]).alias("kept"),
        (acc["open"] & (acc["used"] + F.when(acc["kept"] == 0, 0).otherwise(1) + utf16_length(line) <= usable)).alias("open"),
    )
    kept = F.aggregate(lines, F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("open")), step)["kept"]
    # code points outside the basic plane count two, so a cut at `usable` units keeps usable minus their number or a few more
    head = F.substring(content, F.lit(1), F.greatest(usable, F.lit(0)).cast("int"))
    marked = F.regexp_replace(head, "([\\x{10000}-\\x{10FFFF}])", "$1\u0001")
    hard = F.replace(F.regexp_replace(F.substring(marked, F.lit(1), F.greatest(usable, F.lit(0)).cast("int")), "[\\x{10000}-\\x{10FFFF}]$", ""), F.lit("\u0001"), F.lit(""))
    whole = F.array_join(F.slice(lines, F.lit(1), F.greatest(kept, F.lit(1))), "\n")
    by_line = F.concat(whole, F.lit("\n… [truncated "), (total - kept).cast("string"), F.lit(" of "), total.cast("string"), F.lit(" lines]"))
    mid_line = F.concat(hard, F.lit("\n… [truncated mid-line, "), total.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" lines omitted]"))
    return F.when(
        (budget > 0) & (usable > 0),
        F.struct(F.when(kept > 0, by_line).otherwise(mid_line).alias("content"), F.when(kept > 0, total - kept).otherwise(total).alias("dropped_lines"), total.alias("total_lines")),
    )
