"""Column functions for display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linescope.functions.paths import file_name

NO_VALUE = "—"


def split_patterns(text: Column) -> Column:
    """Pattern list from a text field: lines and commas separate, blanks go."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n,]"), lambda p: F.btrim(p, F.lit(" \t\r\n")))
    return F.filter(parts, lambda p: p != "")


def format_thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def signed_text(number: Column) -> Column:
    return F.concat(F.when(number > 0, "+").otherwise(""), number.cast("string"))


def delta_sign(number: Column) -> Column:
    return F.when(number > 0, "pos").when(number < 0, "neg").when(number == 0, "zero").otherwise("na")


def change_text(current: Column, previous: Column) -> Column:
    return F.coalesce(signed_text(current - previous), F.lit(NO_VALUE))


def code_ratio_pct(code: Column, comment: Column, blank: Column) -> Column:
    """Whole percent of code lines; 0 when there are no lines."""
    total = code + comment + blank
    return F.when(total == 0, F.lit(0)).otherwise((code * 100 - F.pmod(code * 100, total)) / total).cast("bigint")


def project_label(root: Column) -> Column:
    """File name of a root as a label of lower-case letters, digits and dashes."""
    name = file_name(F.rtrim(root, F.lit("/")))
    label = F.btrim(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "-")), F.lit("-"))
    return F.coalesce(F.nullif(label, F.lit("")), F.lit("project"))


def truncate_text(text: Column, width: int) -> Column:
    """Text longer than `width` bytes keeps its first width - 1 bytes and an
    ellipsis."""
    head = F.substring(F.encode(text, "UTF-8"), 1, max(width - 1, 0))
    return F.when(F.octet_length(text) <= width, text).otherwise(
        F.concat(F.make_valid_utf8(head.cast("string")), F.lit("…"))
    )


def csv_quote(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.rlike(text, F.lit('[,"\n]')), quoted).otherwise(text)


def html_escape(text: Column) -> Column:
    # The five escaped characters, ampersand first.
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def fixed_offset_time(timestamp: Column, seconds: bool = True) -> Column:
    """UTC time shown eight hours earlier, with seconds or with a zone name."""
    local = timestamp - F.expr("interval 8 hours")
    return F.date_format(local, "yyyy-MM-dd HH:mm:ss" if seconds else "yyyy-MM-dd HH:mm 'PST'")


def utc_time_text(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss 'UTC'")


def rfc3339(timestamp: Column) -> Column:
    fraction = F.date_format(timestamp, "SSSSSS")
    shown = (
        F.when(fraction == "000000", "")
        .when(F.endswith(fraction, F.lit("000")), F.concat(F.lit("."), F.substring(fraction, 1, 3)))
        .otherwise(F.concat(F.lit("."), fraction))
    )
    return F.concat(F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss"), shown, F.lit("+00:00"))


def epoch_minute_text(seconds: Column) -> Column:
    """Whole seconds since 1970 as minutes; a dash for earlier times."""
    return F.when(seconds < 0, "-").otherwise(
        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")
    )


def short_run_id(run_id: Column) -> Column:
    return F.substring_index(run_id, "-", -1)


def text_search(needle: str, *columns: Column) -> Column:
    """Case-insensitive substring over everything a table row shows."""
    shown = F.lower(F.concat_ws("\t", *columns))
    return F.contains(shown, F.lit(needle.lower()))


def run_id(timestamp: Column, unique: Column) -> Column:
    """Run id: minute of the run and a unique part without dashes."""
    return F.concat_ws(
        "-", F.date_format(timestamp, "yyyyMMdd-HHmm"), F.replace(unique, F.lit("-"), F.lit(""))
    )
