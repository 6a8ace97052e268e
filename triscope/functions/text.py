"""Column functions over text: look-alike repair, normal forms of places and names, numbers with decimal commas.

Everything here is a JVM expression. Java's ``\\s``, ``\\d`` and ``\\w`` are ASCII unless a pattern says ``(?U)``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from triscope.functions.lookalikes import LATIN_LOWER, LATIN_UPPER, RUSSIAN_LOWER, RUSSIAN_UPPER

_LATIN, _RUSSIAN = LATIN_UPPER + "Y" + LATIN_LOWER, RUSSIAN_UPPER + "У" + RUSSIAN_LOWER

#: Marks of a section in a file name, in the order in which they are tried.
SECTION_MARKS = (
    ("KR", "КР|КЖ|КМ"),
    ("OV", "ОВ|ОВиК|ИТП"),
    ("AR", "АР"),
    ("VK", "ВК|НВК"),
    ("EOM", "ЭОМ|ЭМ|ЭО|ЭН|ЭС"),
    ("SS", "СС"),
    ("GP", "ГП|ПЗУ"),
    ("PB", "ПБ|ППМ|МОПБ"),
    ("POS", "ПОС"),
)


def squeeze(c: Column) -> Column:
    """White space of any kind as single spaces, none outside; ё as е."""
    return F.trim(F.regexp_replace(F.translate(c, "ёЁ", "еЕ"), r"[\s\p{Z}]+", " "))


def to_russian(c: Column) -> Column:
    """Latin letters that look Russian as Russian ones."""
    return F.translate(c, _LATIN, _RUSSIAN)


def repair_lookalikes(c: Column) -> Column:
    """Latin look-alikes as Russian letters: in words that have a Russian letter, and in words of look-alikes alone on lines
    with more Russian letters than Latin ones. Words with digits and no Russian letter stay. Null stays null."""

    def line(text: Column) -> Column:
        russian = F.length(F.regexp_replace(text, "[^А-Яа-яЁё]", "")) > F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
        words = F.split(text, r"(?<=\s)|(?=\s)")
        alike = F.lit(f"^[.,;:()«»\"']*[{_LATIN}]+[.,;:()«»\"']*$")
        word = lambda w: F.when(w.rlike("[А-Яа-яЁё]") | (russian & F.regexp_like(w, alike)), to_russian(w)).otherwise(w)
        return F.array_join(F.transform(words, word), "")

    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def place_key(c: Column) -> Column:
    """A place in normal form: rooms by their number with three digits or more, systems by their mark, else lower case."""
    s = F.lower(squeeze(c))
    room = F.regexp_extract(s, r"^(?:помещение|пом\.?|№) *([0-9]+) *[а-яa-z]?$", 1)
    suffix = F.regexp_extract(s, r"^(?:помещение|пом\.?|№) *[0-9]+ *([а-яa-z]?)$", 1)
    number = F.when(F.length(room) < 3, F.lpad(room, 3, "0")).otherwise(room)
    mark = F.regexp_extract(F.upper(squeeze(c)), r"^СИСТЕМА +([A-ZА-Я]{1,5} ?[0-9.]*)$", 1)
    return F.when(room != "", F.concat(number, to_russian(suffix))).when(mark != "", F.replace(to_russian(mark), F.lit(" "), F.lit(""))).otherwise(s)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\.[^.]*$", ""), r"\s*\([0-9]+\)\s*$", "")


REVISION = r"[\s._()\[-]*(?:изм|кор+|ред)[\s._-]*([0-9]+)"


def cipher(name: Column) -> Column:
    """A file's name without extension, copy number and revision: letters and digits only."""
    return F.regexp_replace(F.regexp_replace(_stem(name), REVISION, ""), "[^0-9a-zа-яё]", "")


def revision_number(name: Column) -> Column:
    """The first revision number of a name, 0 without one; a number that no bigint holds is none."""
    found = F.regexp_extract(_stem(name), REVISION, 1)
    return F.coalesce(found.try_cast("bigint"), F.lit(0).cast("bigint"))


def path_date(path: Column) -> Column:
    """The latest valid dd.mm.yyyy of a path as yyyymmdd, 0 without one."""
    dates = F.regexp_extract_all(path, F.lit(r"([0-3][0-9]\.[01][0-9]\.20[0-9]{2})"), F.lit(1))
    numbers = F.transform(dates, lambda d: F.try_to_date(d, "dd.MM.yyyy"))
    return F.coalesce(F.date_format(F.array_max(numbers), "yyyyMMdd").cast("int"), F.lit(0))


def section_of(name: Column) -> Column:
    """The section that a file's name speaks of; the first mark that stands alone, else OTHER."""
    upper = F.upper(name)
    out = F.lit(None).cast("string")
    for section, marks in reversed(SECTION_MARKS):
        out = F.when(upper.rlike(f"(^|[^А-ЯA-Z])({marks})[0-9.]*([^А-ЯA-Z]|$)"), section).otherwise(out)
    return F.coalesce(out, F.lit("OTHER"))


def comma_number(c: Column) -> Column:
    """The first number of a text, with decimal comma and thousands apart by spaces, as double; null without one."""
    found = F.regexp_extract(c, r"[-+]?[0-9]+(?: [0-9]{3})*(?:,[0-9]+)?", 0)
    return F.when(found != "", F.replace(F.replace(F.replace(found, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")), F.lit("+"), F.lit("")).try_cast("double"))


def decimals(c: Column) -> Column:
    """Number of decimals of the first number of a text."""
    return F.length(F.regexp_extract(c, r"[-+]?[0-9]+(?: [0-9]{3})*,([0-9]+)", 1))


def natural_key(c: Column) -> Column:
    """Sort key under which numbers within text sort by value, however long: before each number stands its length."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def part(p: Column) -> Column:
        number = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(number).cast("string"), 10, "0"), number)).otherwise(p)

    return F.array_join(F.transform(parts, part), "")


def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def composed(c: Column) -> Column:
    """Text in composed form (NFC). Only text with marks, or with characters that have another form, goes to Python."""
    odd = c.rlike(r"[\p{M}\u1100-\u11ff\u0374\u037e\u0387\u1f71-\u1ffd\u2000\u2001\u2126\u212a\u212b\u2329\u232a\uf900-\ufaff]|[\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]")
    return F.coalesce(F.pandas_udf(_nfc, "string")(F.when(odd, c)), c)
