"""Garbled text from a wrong character encoding: expectation-maximisation over latent encoding chains.

A chain says how a text was spoilt: it was written in one encoding and read in another, or that happened twice: UTF-8 through any
two, or the same step again. UTF-8 read as cp1252 may have lost the bytes that have no meaning there. Undoing a
chain either fails (then the chain is impossible) or gives a candidate for the original text. The model: a record's field
draws a chain from the prior of its source and field; each part of the text (parts are what stands between slashes) is spoilt
by that chain or left as it is; the original part follows a character model shared by all records. EM estimates the priors and
the character model from all records at once, so that weak evidence in single records is pooled; each part is then repaired
by the chain of highest posterior. A part with replacement characters, or with question marks
in a row, is spoilt beyond repair, whatever the rest.

Only masked patterns (runs of digits as one 0) with their counts take part in the iterations: equal shapes count once, and
what the driver gathers in an iteration is bounded by alphabet and number of chains, not by the records. The first character
model is taken from parts of ASCII and Russian letters only.

Cases: null fields give no row; empty and other pure ASCII text is kept as it is, with no chain; a null source is a source of its
own; text of any length is read whole; repeated records give repeated rows.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triscope.sources.scratch import written

SEEN_AS = ("cp1251", "cp1252", "latin_1", "cp866", "cp437", "koi8_r", "mac_cyrillic", "iso8859_5", "cp850")
WRITTEN_IN = ("utf_8", "cp1251", "cp866", "koi8_r", "mac_cyrillic", "cp1252")
LOST = "lost"
#: What a lossy decoding leaves of letters; a single question mark may be one.
_LOST_LETTERS = re.compile(r"\ufffd|\?{2,}")
SAME = ""
#: The fit ends once no prior moves by more than ``SETTLED``, after so many iterations at the latest.
ITERATIONS, SETTLED = 8, 1e-3
#: So many pairs of source and field have priors of their own, the most frequent ones; the others share one for each field.
OWN_PRIORS = 2000
#: Share of the parts of a spoilt field that are left as they were. Held fixed: folders of ASCII letters can't show it.
KEPT = 0.2
#: No name holds these, so no chain leads to one that does.
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f]")
#: Of a name of which bytes were dropped on the way so much may be lost.
_DROPPED, _MOST_DROPPED = "utf_8>cp1252 with bytes dropped", 0.2
FIRST_PRIOR = 0.9
PRIOR_FLOOR = 1e-4

_RUSSIAN = "".join(map(chr, [*range(0x410, 0x450), 0x401, 0x451]))
_PLAIN = frozenset(map(chr, range(0x20, 0x7F))) | frozenset(_RUSSIAN) | frozenset("№«»–—")
#: Weights of the mixture: seen pairs of characters, then classes of characters.
_BACKOFF = 0.1
_FLOOR = {"A": 1e-3, "S": 3e-4, "M": 1e-3, "O": 2e-5, "X": 1e-6}
_SIZE = {"L": 26, "l": 26, "C": 33, "c": 33, "A": 120, "O": 400, "S": 60, "M": 4, "X": 200, "0": 1, " ": 1, "_": 1, "p": 30, "$": 1, "^": 1}
_LOW = 1e-5
#: Characters beyond the plain ones count by class; a class stands as a private-use character.
_CLASS = {chr(0xE000 + i): c for i, c in enumerate("AMOSX")}
_SYMBOL = {c: s for s, c in _CLASS.items()}


@cache
def _tables(codec: str) -> tuple[str, object]:
    """Decoding table of a one-byte encoding, bytes without a meaning as control characters, and its inverse."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    table = "".join(chars)
    return table, codecs.charmap_build(table)


def undo(text: str, seen_as: str, written_in: str) -> str | None:
    """``text``, which was written in one encoding and read in another, as it was; None where that cannot be."""
    try:
        raw = codecs.charmap_encode(text, "strict", _tables(seen_as)[1])[0]
        return raw.decode("utf_8") if written_in == "utf_8" else codecs.charmap_decode(raw, "strict", _tables(written_in)[0])[0]
    except UnicodeError:
        return None


def undo_dropping(text: str) -> str | None:
    """``text``, which was UTF-8 read as cp1252 by a reader that drops bytes without a meaning there, with the letters hit as U+FFFD."""
    try:
        t = codecs.charmap_encode(text, "strict", _tables("cp1252")[1])[0].decode("utf_8", "replace")
    except UnicodeError:
        return None
    return t if 0 < t.count("\ufffd") <= _MOST_DROPPED * len(t) and not t.replace("\ufffd", "").isascii() else None


def undo_chain(text: str, chain: str) -> str | None:
    """Undo each step of a chain such as ``utf_8>cp1252`` (written in > seen as), the last step first."""
    if chain == _DROPPED:
        return undo_dropping(text)
    for step in reversed(chain.split("|")) if chain else ():
        written_in, seen_as = step.split(">")
        text = undo(text, seen_as, written_in)
        if text is None:
            return None
    return text


def candidates(part: str) -> dict[str, str]:
    """Chain -> original, for the chains that may have given this part: one step, UTF-8 twice, or the same step twice."""
    if part.isascii():
        return {}
    out: dict[str, str] = {}

    def keep(chain: str, t: str | None, before: str) -> None:
        if t is not None and t != before and not _CONTROL.search(t):
            out[chain] = t

    for e in SEEN_AS:
        for d in WRITTEN_IN:
            if d == e or (t := undo(part, e, d)) is None or t == part:
                continue
            keep(f"{d}>{e}", t, part)
            if t.isascii():
                continue
            if d == "utf_8":
                for e2 in SEEN_AS:
                    keep(f"{d}>{e2}|{d}>{e}", undo(t, e2, d), t)
            elif (t2 := undo(t, e, d)) != part:
                keep(f"{d}>{e}|{d}>{e}", t2, t)
    if "utf_8>cp1252" not in out:
        keep(_DROPPED, undo_dropping(part), part)
    return out


@cache
def symbol(c: str) -> str:
    """The character itself if it is plain or a mark of the model, else its class."""
    return c if c in _PLAIN or c == "$" else _SYMBOL[k] if (k := char_class(c)) in _SYMBOL else c


@cache
def char_class(c: str) -> str:
    if c in _CLASS:
        return _CLASS[c]
    if c in _RUSSIAN:
        return "C" if c.isupper() else "c"
    if c < "\x80":
        return "L" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else c if c in "0 _^$" else "p" if c >= " " else "X"
    o = ord(c)
    if o < 0xA0 or o == 0xFFFD:
        return "X"
    if 0x300 <= o < 0x370:
        return "M"
    if c.isalpha():
        return "A" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "O"
    return "X" if 0x2500 <= o < 0x25A0 else "S"


class CharModel:
    """Pairs of characters with a class model behind them; its shares don't depend on the amount of data."""

    def __init__(self, pairs: dict[tuple[str, str], float]):
        self.before: dict[str, float] = defaultdict(float)
        single: dict[str, float] = defaultdict(float)
        by_class: dict[str, float] = defaultdict(float)
        steps: dict[tuple[str, str], float] = defaultdict(float)
        for (a, b), n in pairs.items():
            self.before[a] += n
            single[b] += n
            by_class[char_class(b)] += n
            steps[char_class(a), char_class(b)] += n
        self.pairs, self.known = pairs, {}
        from_class: dict[str, float] = defaultdict(float)
        for (a, _), n in steps.items():
            from_class[a] += n
        self.within = {b: 0.9 * n / by_class[char_class(b)] for b, n in single.items()}
        self.steps = {(a, b): n / from_class[a] for (a, b), n in steps.items()}

    def _step(self, a: str, b: str) -> float:
        x, y = char_class(a), char_class(b)
        if x in "AMO":
            rest = 0.25 if y in "AMO" and x == y else 0.3 if y in "LlcC" and x != "O" else 0.05 if y not in "XO" else 1e-4
        else:
            rest = _FLOOR.get(y, _LOW)
        step = max(self.steps.get((x, y), 0.0), rest)
        return step if b in _CLASS else step * (self.within.get(b, 0.0) + 0.1 / _SIZE[y])

    def log(self, text: str) -> float:
        total, a = 0.0, "^"
        for c in [*text, "$"]:
            b = symbol(c)
            p = self.known.get((a, b))
            if p is None:
                n = self.before.get(a, 0.0)
                back = self._step(a, b)
                p = (1 - _BACKOFF) * self.pairs.get((a, b), 0.0) / n + _BACKOFF * back if n >= 1 else back
                p = self.known[a, b] = math.log(p / _SIZE[_CLASS[b]] if b in _CLASS else p)
            total += p
            a = b
        return total


def _add(pairs: dict, text: str, weight: float) -> None:
    a = "^"
    for b in map(symbol, [*text, "$"]):
        pairs[a, b] += weight
        a = b


_DIGITS = re.compile(r"\d+")


def mask(text: str) -> str:
    return _DIGITS.sub("0", text)


def _log_mix(gain: float) -> float:
    """log of kept + spoilt, where being spoilt is likelier by ``gain``."""
    low, high = math.log(KEPT), math.log(1 - KEPT) + gain
    return max(low, high) + math.log1p(math.exp(-abs(high - low)))


class Judge:
    """Posteriors of a text under given priors and character model."""

    def __init__(self, model: CharModel, priors: dict[tuple[str, str], dict[str, float]]):
        self.model, self.priors = model, priors
        self.parts: dict[str, tuple[float, dict[str, tuple[float, str]]]] = {}
        self.texts: dict[tuple[str, str, str], tuple[dict[str, float], list[tuple[str, float]]]] = {}

    def part(self, part: str) -> tuple[float, dict[str, tuple[float, str]]]:
        if part not in self.parts:
            if len(self.parts) > 20_000:
                self.parts.clear()
            self.parts[part] = self.model.log(part), {z: (self.model.log(t), t) for z, t in candidates(part).items()}
        return self.parts[part]

    def text(self, source: str, field: str, pattern: str) -> tuple[dict[str, float], list[tuple[str, float]]]:
        """Posterior of each chain for the field, and of each part its best chain with the posterior of being spoilt."""
        key = (source, field, pattern)
        if key in self.texts:
            return self.texts[key]
        prior = self.priors.get((source, field)) or self.priors.get((None, field)) or {}
        parts = [self.part(p) for p in pattern.split("/")]
        chains = {z for _, c in parts for z in c}
        score = {SAME: math.log(prior.get(SAME, FIRST_PRIOR))}
        for z in chains:
            gain = sum(_log_mix(c[z][0] - same) if z in c else (math.log(KEPT) if c else 0.0) for same, c in parts)
            score[z] = math.log(max(prior.get(z, 0.0), PRIOR_FLOOR)) + gain
        top = max(score.values())
        total = sum(math.exp(v - top) for v in score.values())
        post = {z: p for z, v in score.items() if (p := math.exp(v - top) / total) > 1e-6}
        best: list[tuple[str, float]] = []
        for same, c in parts:
            spoilt: dict[str, float] = {}
            for z, p in post.items():
                if z in c:
                    odds = (1 - KEPT) / KEPT * math.exp(min(500.0, c[z][0] - same))
                    spoilt[z] = p * odds / (1 + odds)
            z = max(spoilt, key=spoilt.get) if spoilt else SAME
            best.append((z, sum(spoilt.values())))
        if len(self.texts) > 20_000:
            self.texts.clear()
        self.texts[key] = post, best
        return self.texts[key]


def _patterns(fields: DataFrame) -> DataFrame:
    """source, field, pattern, n of the texts that aren't pure ASCII or hold replacement characters only."""
    masked = F.regexp_replace("text", r"\d+", "0")
    return fields.select("source", "field", masked.alias("pattern")).groupBy("source", "field", "pattern").agg(F.count("*").alias("n"))


def _statistics(patterns: DataFrame, judge: Judge | None) -> tuple[dict, dict]:
    """One step: expected pairs of characters, and chains by source and field; the first step counts the plain parts only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[tuple[str, str], float] = defaultdict(float)
        chains: dict[tuple[str | None, str, str], float] = defaultdict(float)
        for b in batches:
            for source, field, pattern, n in zip(*(c.to_pylist() for c in b.columns)):
                if _LOST_LETTERS.search(pattern):
                    pattern = "/".join(p for p in pattern.split("/") if not _LOST_LETTERS.search(p))
                if judge is None:
                    for p in pattern.split("/"):
                        if _PLAIN.issuperset(p):
                            _add(pairs, p, n)
                    continue
                post, best = judge.text(source, field, pattern)
                for z, p in post.items():
                    chains[source, field, z] += n * p
                for part, (z, p) in zip(pattern.split("/"), best):
                    if p < 0.999:
                        _add(pairs, part, n * (1 - p))
                    if z and p > 0.001:
                        _add(pairs, judge.part(part)[1][z][1], n * p)
        rows = [("pair", "", a, b, n) for (a, b), n in pairs.items()] + [("chain", s, f, z, n) for (s, f, z), n in chains.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((*[pa.string()] * 4, pa.float64()))], ["kind", "source", "a", "b", "n"])

    found = patterns.select("source", "field", "pattern", "n").mapInArrow(run, "kind string, source string, a string, b string, n double")
    rows = found.groupBy("kind", "source", "a", "b").agg(F.sum("n").alias("n")).collect()  # bounded by alphabet, priors and chains
    pairs, chains = {}, defaultdict(dict)
    for kind, source, a, b, n in rows:
        if kind == "chain":
            chains[source, a][b] = n
        else:
            pairs[a, b] = n
    return pairs, chains


def _with_priors(fields: DataFrame, priors: int) -> DataFrame:
    """``fields`` with ``source`` null where source and field aren't among the most frequent ones."""
    counts = fields.groupBy("source", "field").agg(F.count("*").alias("n"))
    own = counts.orderBy(F.desc("n"), "source", "field").limit(priors).select(F.col("source").alias("__s"), F.col("field").alias("__f"))
    kept = fields.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("__s")) & F.col("field").eqNullSafe(F.col("__f")), "left")
    return kept.withColumn("source", F.when(F.col("__f").isNotNull(), F.coalesce("source", F.lit("")))).drop("__s", "__f")


def fit(fields: DataFrame, iterations: int = ITERATIONS) -> Judge:
    """The judge fitted to all texts of ``fields`` (source, field, text)."""
    patterns = written(_patterns(fields), "patterns")
    judge = Judge(CharModel(_statistics(patterns, None)[0]), {})
    for _ in range(iterations):
        pairs, chains = _statistics(patterns, judge)
        priors = {k: {z: n / sum(c.values()) for z, n in c.items()} for k, c in chains.items()}
        moved = max((abs(p.get(z, 0.0) - judge.priors.get(k, {}).get(z, 0.0)) for k, p in priors.items() for z in p.keys() | judge.priors.get(k, {}).keys()), default=0.0)
        judge = Judge(CharModel(pairs), priors)
        if moved <= SETTLED:
            break
    return judge


REPAIRED = "repaired string, chain string, spoilt double"


def repair(fields: DataFrame, key: str, iterations: int = ITERATIONS, priors: int = OWN_PRIORS) -> DataFrame:
    """key, field, text, the repaired text, the chains of its parts and the posterior that some part is spoilt.

    ``fields`` has the columns key, source, field and text.
    """
    fields = _with_priors(fields.where("text is not null"), priors)
    judge = fit(fields, iterations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for source, field, text in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                if text.isascii() and "??" not in text:
                    out.append((text, SAME, 0.0))
                    continue
                _, best = judge.text(source, field, "/".join("" if _LOST_LETTERS.search(p) else p for p in mask(text).split("/")))
                parts, chains, same = [], [], 1.0
                for part, (z, p) in zip(text.split("/"), best):
                    if _LOST_LETTERS.search(part):
                        chains.append(LOST)
                        same = 0.0
                    elif z and p >= 0.5 and (t := undo_chain(part, z)) is not None:
                        part, chains[len(chains) :] = t, [z]
                    parts.append(part)
                    same *= 1 - p
                out.append(("/".join(parts), ", ".join(dict.fromkeys(chains)), 1 - same))
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *columns], [key, "field", "text", "repaired", "chain", "spoilt"])

    kind = fields.schema[key].dataType.simpleString()
    return fields.select(key, "source", "field", "text").mapInArrow(run, f"{key} {kind}, field string, text string, {REPAIRED}")
