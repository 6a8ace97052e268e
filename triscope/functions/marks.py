"""Marks of ventilation systems: ranges, lists and misread digits in one token become single marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triscope.functions.text import to_russian

#: Kinds of systems, two letters before one; letters that are read for digits.
KINDS = "ПЕ|ВЕ|ПД|ДУ|П|В"
READ_AS_DIGITS = ("ОOЗZБIL|Т", "003261117")


def parse_marks(c: Column) -> Column:
    """The marks in a text, as an array in order: ``В2.7,8`` is В2.7 and В2.8, ``В2.4-В2.6`` three marks, ``П2/ВЕ`` two.

    A range of more than twenty is no range. Bare П and В, sizes, numbers with leading zeros and anything else are left out.
    """
    s = F.regexp_replace(to_russian(F.upper(c)), r"\s*([,–-])\s*", "$1")
    parts = F.flatten(F.transform(F.split(s, r"\s+"), lambda w: F.split(w, r"[/\\]")))
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"^[ .:;,\]|\[()]+|[ .:;,\]|\[()]+$", ""))

    def expand(p: Column) -> Column:
        g = lambda rx, i: F.regexp_extract(p, rx, i)
        span = rf"^({KINDS})(\d{{1,2}})\.(\d{{1,2}})[–-](?:\1\2\.)?(\d{{1,2}})$"
        listed = rf"^({KINDS})(\d{{1,2}})\.(\d{{1,2}}(?:,\d{{1,2}})+)$"
        low, high = g(span, 3).try_cast("int"), g(span, 4).try_cast("int")
        head = F.concat(g(span, 1), g(span, 2), F.lit("."))
        kind = g(rf"^({KINDS})", 1)
        tail = F.translate(F.substring(p, F.length(kind) + 1, F.length(p)), *READ_AS_DIGITS)
        fixed = F.concat(kind, F.when(p.rlike(rf"^({KINDS})[0-9{READ_AS_DIGITS[0]}]"), tail).otherwise(F.substring(p, F.length(kind) + 1, F.length(p))))
        single = fixed.rlike(rf"^({KINDS})\d{{1,2}}(\.\d{{1,2}})?$") & ~fixed.rlike(r"^\D+0\d") | fixed.isin("ВЕ", "ПЕ")
        numbers = F.split(g(listed, 3), ",")
        return (
            F.when(p.rlike(span) & (high > low) & (high - low <= 20), F.transform(F.sequence(low, high), lambda i: F.concat(head, i.cast("string"))))
            .when(p.rlike(listed), F.transform(numbers, lambda n: F.concat(g(listed, 1), g(listed, 2), F.lit("."), n.cast("int").cast("string"))))
            .when(single, F.array(fixed))
            .otherwise(F.array().cast("array<string>"))
        )

    return F.flatten(F.transform(bare, expand))


def system_of(mark: Column) -> Column:
    """The system that a mark belongs to: ВЕ and ПЕ whatever the number, else the kind and the number before the point."""
    fans = F.regexp_extract(mark, r"^(ВЕ|ПЕ)", 1)
    return F.when(fans != "", fans).otherwise(F.regexp_replace(mark, r"\..*$", ""))
