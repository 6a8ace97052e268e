"""Several values packed in one field: one row per value, with its place.

A value is cut at its delimiters: separators that can stand between values, and quotes. Masking what stands between two of them with
one sign (``a``, or a blank where nothing is seen there) and each separator with another gives the skeleton of the value. Decimal
commas, the slash in units and in set codes are ordinary characters, so a skeleton tells the number of places and quotes only, not
words or numbers, and few skeletons cover most values. The splitting rule - between which delimiters items lie - is resolved once per
distinct skeleton. The rules of the most frequent skeletons are broadcast: at most ``BROADCAST_RULES`` skeletons of at most
``LONGEST`` signs, a bound that no data exceeds. A value of any other skeleton has its rule resolved where it stands, once per task.
No value moves between tasks.

Separators are ``; | ,``, line ends, tabs, a slash, and the word "и" between blanks. A comma between digits is a decimal
comma; a slash within a unit (number, unit, slash, unit) or a set code (``17-05/24-КР1``) belongs to the value. An item that
starts with a quote and has the closing quote right before a separator or the end is quoted: separators inside do not count,
the quotes are taken off and doubled ones become single. Quotes elsewhere are ordinary characters.

Cases: null and empty values, and values of one item, give no row. Empty places take no position. A quote that isn't closed is
ordinary. Invisible characters are kept in items but separate nothing. Repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triscope.functions.lookalikes import LOOSE

#: Bounds of what is broadcast: rules, and signs of a skeleton.
BROADCAST_RULES, LONGEST = 10_000, 400

#: Words of units, in which a slash is no separator. Compared after look-alike folding.
UNITS = ("вт", "квт", "мвт", "м", "м²", "м³", "м2", "м3", "мм", "см", "км", "л", "кг", "г", "т", "ч", "с", "мин", "сут", "шт", "гкал", "дж", "кдж", "па", "кпа", "мпа", "а", "в", "об", "чел", "руб", "°с")

#: A value without any of these holds one item.
_ANY_SEPARATOR = r"[;|,/\n\r\t]|[иИ]"
_BLANK = r"[^\S\n\r\t]"
_DELIMITER = re.compile(rf"[;|\n\r\t\"'«»]|,(?!\d)|(?<!\d),|/|(?<={_BLANK})[иИ](?={_BLANK})")
_LETTERS = r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*+"
_NUMBER_UNIT = re.compile(rf"\d{_BLANK}*({_LETTERS})$")
_UNIT = re.compile(rf"({_LETTERS})(?![\d-])")
_CODE = re.compile(r"\d+-\d+$")
_CODE_END = re.compile(r"\d+-[^\W\d_]")
#: Characters on either side of a slash that are looked at.
_NEAR = 100
_QUOTES = "\"'«»"


@cache
def _invisible() -> re.Pattern:
    import sys
    import unicodedata

    return re.compile("[" + "".join(re.escape(chr(c)) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf") + "]")


@cache
def _folding() -> dict[int, str]:
    return str.maketrans(LOOSE)


def _is_unit(word: str) -> bool:
    return word.lower().translate(_folding()) in UNITS


def _part_of_value(v: str, at: int) -> bool:
    """Whether the slash at a place belongs to a set code or a unit."""
    before, after = v[max(0, at - _NEAR) : at], v[at + 1 : at + 1 + _NEAR]
    if _CODE.search(before) and _CODE_END.match(after):
        return True
    a, b = _NUMBER_UNIT.search(before), _UNIT.match(after)
    return bool(a and b and _is_unit(a[1]) and _is_unit(b[1]))


def delimiters(value: str) -> tuple[str, list[int]]:
    """The skeleton of a value, and the places of its delimiters, which the signs other than ``a`` and blank stand for."""
    seen, places = value, None
    if not value.isascii() and _invisible().search(value):
        places = [i for i, c in enumerate(value) if not _invisible().match(c)]
        seen = "".join(value[i] for i in places)
    signs, at, upto = [], [], 0
    for m in _DELIMITER.finditer(seen):
        i, c = m.start(), m[0]
        if c == "/" and _part_of_value(seen, i):
            continue
        if i > upto:
            signs.append(" " if seen[upto:i].isspace() else "a")
        signs.append(c if c in _QUOTES else ";")
        at.append(i)
        upto = i + 1
    if upto < len(seen):
        signs.append(" " if seen[upto:].isspace() else "a")
    return "".join(signs), at if places is None else [places[i] for i in at]


def resolve(skeleton: str) -> list[tuple[int, int, str]]:
    """(delimiter before, delimiter after, quote or '') of each item; -1 is the start, the number of delimiters the end."""
    m = len(skeleton)
    number, n = [], 0  # of delimiters before each sign
    for c in skeleton:
        number.append(n)
        n += c not in "a "
    number.append(n)

    def past_blank(i: int) -> int:
        return i + (i < m and skeleton[i] == " ")

    def closing(start: int) -> int | None:
        """Place of the quote that closes the one at start, if a separator or the end follows it."""
        q = skeleton[start]
        close, i = "»" if q == "«" else q, start + 1
        while i < m:
            if skeleton[i] == close:
                if close == q and skeleton[i + 1 : i + 2] == q:
                    i += 2
                    continue
                after = past_blank(i + 1)
                if after == m or skeleton[after] == ";":
                    return i
            i += 1
        return None

    items, i = [], 0
    while i < m:
        start = past_blank(i)
        if start < m and skeleton[start] in "\"'«" and (end := closing(start)) is not None:
            if skeleton[start + 1 : end].strip():
                items.append((number[start], number[end], skeleton[start]))
            i = past_blank(end + 1) + 1
            continue
        end = start
        while end < m and skeleton[end] != ";":
            end += 1
        if skeleton[start:end].strip():
            items.append((number[i] - 1, number[end], ""))
        i = end + 1
    return items


def extract(value: str, at: list[int], rule: list[tuple[int, int, str]]) -> list[str]:
    """The items that a rule finds in a value with delimiters at the given places."""
    out = []
    for a, b, quote in rule:
        item = value[at[a] + 1 if a >= 0 else 0 : at[b] if b < len(at) else None].strip()
        out.append(item.replace(quote * 2, quote) if quote in ("\"", "'") else item)
    return out


def skeletons(df: DataFrame, value: str) -> DataFrame:
    """skeleton, n: how many values have each skeleton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            seen.update(delimiters(v)[0] for v in b.column(0).to_pylist())
            if len(seen) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["skeleton", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["skeleton", "n"])

    may = F.col(f"`{value}`").rlike(_ANY_SEPARATOR)
    return df.where(may).select(F.col(f"`{value}`").alias("v")).mapInArrow(run, "skeleton string, n bigint").groupBy("skeleton").agg(F.sum("n").alias("n"))


def split_packed(df: DataFrame, value: str, rules: int = BROADCAST_RULES, singles: bool = False) -> DataFrame:
    """``df`` with ``pos`` and ``item``: one row per item of each value that holds two or more; other rows fall away.

    With ``singles`` other values that aren't null stay as they are, as the only item of their row. The columns of ``df`` are kept
    but for ``value``; a column of ``df`` named pos or item is replaced.
    """
    kept = [c for c in df.columns if c not in (value, "pos", "item")]
    frequent = skeletons(df, value).where(F.length("skeleton") <= LONGEST).orderBy(F.desc("n"), "skeleton").limit(rules)
    known = {r[0]: resolve(r[0]) for r in frequent.collect()}  # bounded by number and length
    sent = df.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = sent.value, {}
        for b in batches:
            rows: list[int] = []
            places: list[int] = []
            items: list[str] = []
            size = 0

            def made(b: pa.RecordBatch = b) -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[:-1]), pa.array(places, pa.int64()), pa.array(items, pa.string())], [*kept, "pos", "item"])

            for i, v in enumerate(b.column(b.num_columns - 1).to_pylist()):
                skeleton, at = delimiters(v)
                rule = known.get(skeleton)
                if rule is None and (rule := own.get(skeleton)) is None:
                    if len(own) > 10_000:
                        own.clear()
                    rule = own[skeleton] = resolve(skeleton)
                if len(rule) > 1:
                    found = extract(v, at, rule)
                elif singles:
                    found = [v]
                else:
                    continue
                rows += [i] * len(found)
                places += range(len(found))
                items += found
                size += len(v)
                if len(rows) > 50_000 or size > 16_000_000:
                    yield made()
                    rows, places, items, size = [], [], [], 0
            yield made()

    may = F.col(f"`{value}`").isNotNull() if singles else F.col(f"`{value}`").rlike(_ANY_SEPARATOR)
    fields = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "pos bigint, item string"])
    return df.where(may).select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{value}`").alias("__value")).mapInArrow(run, fields)
