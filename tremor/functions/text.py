"""Text helpers: labels, edge lines, names, times."""

from pyspark.sql import Column
from pyspark.sql import functions as F

VIRTUAL, STATIC = "Virtual", "Static"


def kind_rank(kind: Column) -> Column:
    """Static before Virtual."""
    return F.when(kind == VIRTUAL, 1).otherwise(0)


def escape_label(text: Column) -> Column:
    """HTML entities for a quoted diagram label; the ampersand first."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def edge_line(source: Column, target: Column, boundary: Column, kind: Column) -> Column:
    """One diagram arrow; a boundary outranks dynamic dispatch."""
    arrow = F.when(boundary, " ==>|boundary| ").when(kind == VIRTUAL, " -.->|dyn| ").otherwise(" --> ")
    return F.concat(source, arrow, target)


def crate_of(path: Column) -> Column:
    """The part of a path before its first '::'."""
    return F.split_part(path, F.lit("::"), F.lit(1))


def contains_name(path: Column, query: str) -> Column:
    """Case-insensitive literal containment; the empty query matches nothing."""
    return F.contains(F.lower(path), F.lower(F.lit(query))) & F.lit(query != "")


def rfc3339(seconds: Column) -> Column:
    """UTC time to the second, whatever the session's time zone."""
    shifted = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def last_part(path: Column) -> Column:
    """What follows the last '/', such as a toolchain's name."""
    return F.element_at(F.split(path, "/"), -1)
