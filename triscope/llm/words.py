"""Words as they read: case, look-alike letters, marks, invisible and styled characters make no difference."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

from triscope.functions.lookalikes import LOOSE

_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"(?<=\w)(?:-|‐|‑|\xad)[^\S\n]*\r?\n\s*(?=\w)")


@cache
def table() -> dict[int, str | None]:
    """Translation of lower-case text; built by rule from the character database."""
    out: dict[int, str | None] = {ord(a): b for a, b in LOOSE.items()}
    for cp in [*range(0x80, 0x590), *range(0x1E00, 0x2070), *range(0x2070, 0x2100), *range(0xF900, 0xFB07), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cf", "Mn"):
            out[cp] = None
        elif kind[0] in "LN":
            base = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if unicodedata.category(x) not in ("Cf", "Mn"))
            base = "".join(LOOSE.get(x, x) for x in base)
            if base != c and base.isalnum():
                out[cp] = base
    return out


@cache
def odd() -> re.Pattern:
    """Characters that a text must lose, or put together, before its words can be told."""
    return re.compile("[\u1100-\u11ff" + "".join(re.escape(chr(c)) for c, to in table().items() if to is None) + "]")


class Forms(dict):
    """Lower-case word -> its form; filled as words come up."""

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        form = self[word] = word.translate(table())
        return form


_FORMS = Forms()


def words(text: str) -> list[str]:
    """Runs of letters and digits of a text, each in the one form of all that read the same."""
    text = text.lower()
    if odd().search(text):
        text = unicodedata.normalize("NFC", text).lower().translate(table())
    return list(map(_FORMS.__getitem__, _WORD.findall(text)))


def readings(text: str, window: int, most: int = 6) -> Iterator[list[str]]:
    """The words of a text in so many readings that each run of ``window`` words is met with every choice of its broken words joined
    or apart. Beyond ``most`` breaks within one window, that many neighbouring ones are chosen freely and the others as those."""
    parts = _BREAK.split(text) if "\n" in text else [text]
    if len(parts) == 1:
        yield words(text)
        return
    inner = [len(words(p)) for p in parts[1:-1]]
    free, first, held = 1, 0, 0
    for last, n in enumerate(inner, 1):  # breaks first..last share a window if so few words lie between them
        held += n
        while first < last and 2 + held - (last - first + 1) > window:
            held -= inner[first]
            first += 1
        free = max(free, last - first + 1)
    free = min(free, most)
    for choice in range(1 << free):
        yield words(parts[0] + "".join(("" if choice >> (i % free) & 1 else " ") + p for i, p in enumerate(parts[1:])))


def joined_words(text: str) -> list[str] | None:
    """The words with words broken at a line end joined; None where no word is broken."""
    if "\n" not in text:
        return None
    joined, n = _BREAK.subn("", text)
    return words(joined) if n else None
