"""Values in texts and what names them: on lines under a header, on earlier lines, in the same sentence, first on a page, in the title.

The operators look at the array of a text's lines or sentences within one row: no shuffle, no window, all expressions. Patterns and
tables of names are the caller's; patterns are Java's, a value is group 1 of its pattern (the whole match without a group).

Cases: null texts give no row; nothing that names a value gives null (``under_headers`` leaves such values out). Names are tried in the
order of their table. Columns of the input that clash with the result's names are left behind.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A blank line, which ends a paragraph.
GAP = r"^\s*$"


def name_of(text: Column, names: Mapping[str, str]) -> Column:
    """The first name of the table whose pattern the text shows."""
    return F.coalesce(*(F.when(F.regexp_like(text, F.lit(p)), F.lit(n)) for n, p in names.items()), F.lit(None).cast("string"))


def _valued_lines(df: DataFrame, key: str, text: str, value: str, more: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """key, line_no, value and what ``more`` gives (of the place of a line in ``ls``), a row for each value of each line."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key), F.split(text, "\n").alias("ls"))
    here = lambda x, i: F.struct(i.alias("line_no"), F.regexp_extract_all(x, F.lit(value)).alias("values"), *(c.alias(n) for n, c in more(i).items()))
    held = F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.regexp_like(s["x"], F.lit(value)))
    lines = rows.select(key, "ls", F.explode(held).alias("s")).select(key, here(F.col("s.x"), F.col("s.i")).alias("h"))
    names = [n for n in more(F.lit(0))]
    return lines.select(key, "h.line_no", *(F.col("h")[n].alias(n) for n in names), F.posexplode("h.values").alias("place", "value"))


def under_headers(df: DataFrame, key: str, text: str, header: str, value: str, reach: int) -> DataFrame:
    """key, line_no, header_no, header, place, value: values on the ``reach`` lines after a line that is a header; the last one counts."""

    def armed(i: Column) -> dict[str, Column]:
        before = F.filter(F.sequence(F.lit(1), F.lit(reach)), lambda d: (d <= i) & F.coalesce(F.regexp_like(F.get("ls", i - d), F.lit(header)), F.lit(False)))
        at = (i - F.get(before, F.lit(0))).cast("int")
        return {"header_no": at, "header": F.get("ls", at)}

    return _valued_lines(df, key, text, value, armed).where("header_no is not null")


def looking_back(df: DataFrame, key: str, text: str, value: str, names: Mapping[str, str], reach: int, gap: str = GAP, title: bool = False) -> DataFrame:
    """key, line_no, name, back, place, value: each value with what the nearest of its own and the ``reach`` lines before names.

    The search ends at a gap. With ``title`` a value that finds nothing takes what the first line of the text names, ``back`` null.
    """

    def search(i: Column) -> dict[str, Column]:
        none = F.struct(F.lit(True).alias("open"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("back"))

        def step(a: Column, d: Column) -> Column:
            line = F.get("ls", i - d)
            going = a["open"] & (d <= i) & ~F.regexp_like(line, F.lit(gap))
            found = name_of(line, names)
            return F.when(going, F.struct(found.isNull().alias("open"), found.alias("name"), F.when(found.isNotNull(), d).alias("back"))).otherwise(F.struct(F.lit(False).alias("open"), a["name"].alias("name"), a["back"].alias("back")))

        best = F.aggregate(F.sequence(F.lit(0), F.lit(reach)), none, step)
        return {"name": F.coalesce(best["name"], name_of(F.get("ls", F.lit(0)), names)) if title else best["name"], "back": best["back"]}

    return _valued_lines(df, key, text, value, search)


def nearest_in_sentence(df: DataFrame, key: str, text: str, value: str, names: Mapping[str, str], ended: str = r"(?<=[.;!?])\s+") -> DataFrame:
    """key, sentence_no, place, value, name, side: each value with the name that stands nearest before it in its sentence, else
    nearest after it."""
    every = "|".join(f"(?:{p})" for p in names.values())
    rows = df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(text, ended)).alias("sentence_no", "sentence"))
    rows = rows.where(F.regexp_like("sentence", F.lit(value)))
    rows = rows.select(key, "sentence_no", F.split("sentence", value).alias("between"), F.posexplode(F.regexp_extract_all("sentence", F.lit(value))).alias("place", "value"))
    words = lambda part: F.regexp_extract_all(F.array_join(part, "  "), F.lit(every), F.lit(0))
    before = F.try_element_at(words(F.slice("between", 1, F.col("place") + 1)), F.lit(-1))
    after = F.get(words(F.slice("between", F.col("place") + 2, F.size("between"))), F.lit(0))
    side = F.when(before.isNotNull(), "before").when(after.isNotNull(), "after")
    return rows.select(key, "sentence_no", "place", "value", name_of(F.coalesce(before, after), names).alias("name"), side.alias("side"))


def first_of_page(df: DataFrame, key: str, text: str, value: str, page: str = "\f") -> DataFrame:
    """key, page, value: the first value of each page of a text that has one."""
    pages = df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(text, page)).alias("page", "t"))
    return pages.select(key, "page", F.get(F.regexp_extract_all("t", F.lit(value)), F.lit(0)).alias("value")).where("value is not null")
