"""JSON text, base64 and service messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def error_message(c: Column | str) -> Column:
    """The ``message`` of the JSON body between ``Error:`` and ``Headers:`` in a service error.

    Without ``Headers:`` the body runs to the end. No JSON body gives NULL; a body without
    ``message`` gives an empty text.
    """
    body = F.regexp_extract(c, r"(?s)Error:\s*(\{.*?\})\s*(?:Headers:|\z)", 1)
    message = F.get_json_object(body, "$.message")
    return F.when(F.get_json_object(body, "$").isNotNull(), F.coalesce(message, F.lit("")))


def has_key(c: Column | str, path: str) -> Column:
    """True where the JSON path is present with a value other than null."""
    return F.get_json_object(c, path).isNotNull()


def schema_enabled(properties: Column | str) -> Column:
    """A store keeps its tables in schemas when its properties name a default one."""
    return has_key(properties, "$.defaultSchema")


def encoded(c: Column | str) -> Column:
    """Base64 of the UTF-8 text on one line."""
    return F.replace(F.base64(c), F.lit("\r\n"), F.lit(""))


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def clock_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
