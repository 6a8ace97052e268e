"""Keys as they are compared: upper-case, without outer white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every kind at either end (Java's ``\s`` alone knows ASCII only).
_OUTER = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def clean_key(c: Column) -> Column:
    """Upper-case key without outer white space; null stays null and an empty key becomes null."""
    return F.nullif(F.upper(F.regexp_replace(c.cast("string"), _OUTER, "")), F.lit(""))
