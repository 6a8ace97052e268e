"""Visually identical text with different characters, brought to one plain form.

Texts are exploded to positioned code points and joined to a broadcast table of decompositions (canonical ones, full-width
and styled letters, spaces, invisible characters, Greek look-alikes); combining marks are ordered by class within their
starter; the text is put together again, recomposed, and each word is written in one alphabet: Russian if it has a letter
that only Russian has or if all its letters look like Russian ones of the same case, else Latin.

Text of plain characters without Latin or Greek letters is plain already: it isn't exploded and doesn't move. Every other text goes by
the number of its row, not by what it says, so that no text is hot however often it occurs; rows are partitioned by their number
before they are exploded, and the code points of a text never move.

Cases: null gives no row; the empty text is plain; text of any length is treated whole; marks that don't compose stay behind
their letter; ``² ³ ° № – « »`` and carriage returns stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from triscope.functions.lookalikes import FROM_CYRILLIC, FROM_GREEK, FROM_GREEK_SMALL, TO_LATIN, TO_RUSSIAN
from triscope.sources.scratch import written

_INVISIBLE = frozenset([0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)])
_LINE_ENDS = frozenset([0x0B, 0x0C, 0x85, 0x2028, 0x2029])
_STYLED = ("<wide>", "<narrow>", "<font>", "<noBreak>")
#: Text of these characters alone is plain.
_SETTLED = r"^[\x09\x0A\x0D\x20-\x40\x5B-\x60\x7B-\x7E°²³«»–№А-Яа-яЁё]*$"


@cache
def mapping() -> list[tuple[str, list[tuple[str, int]]]]:
    """Code point -> what it becomes, each with its combining class; only code points that change or combine."""
    out = []
    for cp in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0200)]:
        c = chr(cp)
        kind = unicodedata.category(c)
        if cp in _LINE_ENDS:
            to = "\n"
        elif kind == "Cf" or cp in _INVISIBLE:
            to = ""
        elif kind == "Zs":
            to = " "
        elif c in FROM_GREEK:
            to = FROM_GREEK[c]
        else:
            d = unicodedata.decomposition(c)
            ligature = d.startswith("<compat>") and kind[0] == "L"
            to = unicodedata.normalize("NFKD" if d.startswith(_STYLED) or ligature else "NFD", c)
            to = "".join(FROM_GREEK.get(x, x) for x in to)
        if to != c or unicodedata.combining(c):
            out.append((c, [(x, unicodedata.combining(x)) for x in to]))
    out += [(chr(cp), [("\n", 0)]) for cp in (0x0B, 0x0C)]
    return out


def mapping_table(spark: SparkSession) -> DataFrame:
    """The mapping as a table; bounded by Unicode."""
    kind = T.StructType([T.StructField("c", T.StringType()), T.StructField("ccc", T.IntegerType())])
    return spark.createDataFrame(mapping(), T.StructType([T.StructField("c", T.StringType()), T.StructField("to", T.ArrayType(kind))]))


_WORD = re.compile(r"[^\W_](?:[^\W_]|[\u0300-\u036f])*")


_ONLY_RUSSIAN = frozenset(map(chr, [*range(0x410, 0x450), 0x401, 0x451])) - TO_LATIN.keys()
_OTHERS_AS_LATIN = TO_LATIN | FROM_CYRILLIC | FROM_GREEK_SMALL


def one_alphabet(match: re.Match) -> str:
    """A word in one alphabet. Small Greek letters are signs of their own unless the word has other letters."""
    word = match[0]
    letters = [c for c in word if c.isalpha()]
    if any(c in _ONLY_RUSSIAN for c in letters) or all(c in TO_LATIN or c in TO_RUSSIAN for c in letters):
        return "".join(TO_RUSSIAN.get(c, c) for c in word)
    if all(c in FROM_GREEK_SMALL for c in letters):
        return word
    return "".join(_OTHERS_AS_LATIN.get(c, c) for c in word)


def _compose(ordered: pd.Series) -> pd.Series:
    return ordered.map(lambda t: _WORD.sub(one_alphabet, t if t.isascii() else unicodedata.normalize("NFC", t)))


def _restored(dirty: DataFrame) -> DataFrame:
    """own, texts, plains of the rows (id, own, texts) that aren't plain as they stand; ``id`` tells the rows apart.

    Rows move once, by their id, before their texts are exploded; what else a row holds travels with its first code point only.
    """
    first = (F.col("place") == 0) & F.coalesce(F.col("pos") == 0, F.lit(True))
    chars = F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))
    rows = dirty.repartition("id").select("id", "own", "texts", F.posexplode("texts").alias("place", "text"))
    points = rows.select("id", "own", "texts", "place", "text", F.posexplode_outer(chars).alias("pos", "c"))
    points = points.select("id", "place", "pos", "c", *(F.when(first, F.col(x)).alias(x) for x in ("own", "texts")), F.col("text").isNull().alias("none"))
    mapped = points.join(F.broadcast(mapping_table(dirty.sparkSession)), "c", "left")
    own = F.array(F.struct(F.col("c"), F.lit(0).alias("ccc")))
    parts = mapped.select("id", "place", "pos", "own", "texts", "none", F.posexplode_outer(F.coalesce("to", own)).alias("sub", "x")).select("id", "place", "pos", "own", "texts", "none", "sub", "x.c", "x.ccc")
    starter = F.count(F.when(F.col("ccc") == 0, 1)).over(W.partitionBy("id", "place").orderBy("pos", "sub"))
    order = F.when(F.col("c").isNotNull(), F.struct(F.col("starter"), F.col("ccc"), F.col("pos"), F.col("sub"), F.col("c")))  # invisible characters leave nothing
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["c"]), "")
    kept = [F.max_by(x, F.col(x).isNotNull()).alias(x) for x in ("own", "texts")]
    joined = parts.withColumn("starter", starter).groupBy("id", "place").agg(ordered.alias("ordered"), F.first("none").alias("none"), *kept)
    plain = joined.withColumn("plain", F.pandas_udf(_compose, "string")("ordered"))
    both = F.array_sort(F.collect_list(F.struct("place", F.when(~F.col("none"), F.col("plain")).alias("plain"))))
    return plain.groupBy("id").agg(*kept, F.transform(both, lambda x: x["plain"]).alias("plains")).drop("id")


def _settled(c: Column) -> Column:
    return c.isNull() | c.rlike(_SETTLED)


def _dirty(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of which some column isn't settled, numbered; written, so that the numbers stay what they are."""
    settled = F.forall(F.array(*(F.col(f"`{c}`") for c in columns)), _settled)
    own = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return written(rows.where(~settled).select(F.monotonically_increasing_id().alias("id"), own.alias("own"), F.array(*(F.col(f"`{c}`") for c in columns)).alias("texts")), "texts")


def changed(rows: DataFrame, column: str, name: str = "plain") -> DataFrame:
    """The rows whose ``column`` isn't in plain form, with the plain form as ``name``. Each row is treated by itself."""
    out = _restored(_dirty(rows, [column])).where(F.get("plains", F.lit(0)) != F.get("texts", F.lit(0)))
    return out.select(*(F.col("own")[c].alias(c) for c in rows.columns if c != name or c == column), *([F.get("plains", F.lit(0)).alias(name)] if name != column else []))


def plain_forms(texts: DataFrame, column: str = "text") -> DataFrame:
    """text, plain: each distinct text of ``column`` whose plain form differs from it."""
    distinct = texts.select(F.col(f"`{column}`").alias("text")).where(~_settled(F.col("text"))).distinct()
    return changed(distinct, "text").select("text", "plain")


def with_plain(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``rows`` with the plain form of each of ``columns`` under its new name; null stays null. A column that has a new name already
    is replaced. Nothing is joined: rows that are plain stay where they are, the others are treated each by itself."""
    kept = [c for c in rows.columns if c not in columns.values()]
    settled = F.forall(F.array(*(F.col(f"`{c}`") for c in columns)), _settled)
    clean = rows.where(settled).select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"`{c}`").alias(n) for c, n in columns.items()))
    out = _restored(_dirty(rows, list(columns)))
    return clean.unionByName(out.select(*(F.col("own")[c].alias(c) for c in kept), *(F.get("plains", F.lit(i)).alias(n) for i, n in enumerate(columns.values()))))
