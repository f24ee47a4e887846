"""Reading loosely typed recorded payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_seconds(text: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(text))


def iso_millis(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def number(text: Column) -> Column:
    """Double, or null when the text is not a number."""
    return text.try_cast("double")


def first_filled(*texts: Column) -> Column:
    """First value that is neither missing, empty nor zero (how ``a or b`` reads text fields)."""
    usable = [F.when((t != "") & (t != "0") & (t != "false"), t) for t in texts]
    return F.coalesce(*usable)


def field(payload: Column, path: str) -> Column:
    """Text of a JSON field, e.g. ``msg.price``."""
    return F.get_json_object(payload, f"$.{path}")
