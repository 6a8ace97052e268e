"""Letters that look alike in the Latin, Russian and Greek alphabets, and a loose fold over them.

The pairs are fixed values; everything else is derived from them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters and the Russian ones of the same case that look like them.
LATIN_UPPER, RUSSIAN_UPPER = "ABCEHKMOPTX", "АВСЕНКМОРТХ"
LATIN_LOWER, RUSSIAN_LOWER = "aceopxy", "асеорху"
#: Greek letters and the Latin ones they look like.
GREEK, GREEK_AS_LATIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEZHIKMNOPTYXo"
#: Cyrillic letters that Russian doesn't have, and the Latin ones they look like.
CYRILLIC, CYRILLIC_AS_LATIN = "ЅІЈԚԜѕіјһԁԛԝ", "SIJQWsijhdqw"
#: Small Greek letters that are also signs of their own, and the Latin ones they look like within a word.
GREEK_SMALL, GREEK_SMALL_AS_LATIN = "αικνρυχ", "aikvpux"

TO_RUSSIAN = dict(zip(LATIN_UPPER + LATIN_LOWER, RUSSIAN_UPPER + RUSSIAN_LOWER))
TO_LATIN = {b: a for a, b in TO_RUSSIAN.items()}
FROM_GREEK = dict(zip(GREEK, GREEK_AS_LATIN))
FROM_CYRILLIC = dict(zip(CYRILLIC, CYRILLIC_AS_LATIN))
FROM_GREEK_SMALL = dict(zip(GREEK_SMALL, GREEK_SMALL_AS_LATIN))


def _loose() -> dict[str, str]:
    """Lower-case letter -> the one Russian letter that stands for all that look like it in either case."""
    pairs = {a.lower(): b.lower() for a, b in TO_RUSSIAN.items()}
    greek = {a.lower(): pairs.get(b.lower(), b.lower()) for a, b in (FROM_GREEK | FROM_CYRILLIC | FROM_GREEK_SMALL).items()}
    wide = {chr(ord(c) - 0x21 + 0xFF01): pairs.get(c, c) for c in map(chr, range(0x21, 0x7F))}
    return pairs | greek | wide


LOOSE = _loose()


def loose_fold(c: Column) -> Column:
    """Lower-case text in which letters that look alike in any case are one; for comparing known words only."""
    return F.translate(F.lower(c), "".join(LOOSE), "".join(LOOSE.values()))
