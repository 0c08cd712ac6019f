"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Image extensions, and words that mark a wet room.
IMAGES = ["jpg", "jpeg", "png", "heic", "heif"]
WET_ROOMS = ["bath", "kitchen", "toilet", "wc", "shower", "laundry", "utility", "ensuite", "washroom"]


def slug(text: Column) -> Column:
    """Letters and digits lower-cased, all else `_`, outer `_` stripped; `room` if nothing is left."""
    s = F.trim(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9]", "_")), F.lit("_"))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit("room")).otherwise(s)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def is_image(path: Column) -> Column:
    return extension(path).isin(IMAGES)


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))


def numbered(prefix: Column, n: Column) -> Column:
    """prefix.0001"""
    return F.format_string("%s.%04d", prefix, n.cast("int"))
