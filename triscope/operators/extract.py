"""Facts from lines of text by tables of rules: a value's pattern, what rules it out, and the element that it belongs to.

All rules run in one pass: the matches of every rule on a line are gathered as an array and exploded once. The element is the
first whose pattern is found on the value's own line, else in the lines around it. Patterns are Java's, so that the whole pass
stays in the JVM.

Cases: null texts give no row; a line gives one row per rule and match; a match that occurs twice on a line is judged by its first
place; no element found gives null. Columns of the input that clash with the result's names are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``pattern`` has the value as group 1. ``unless`` is looked for in the ``left`` characters before the match."""

    name: str
    pattern: str
    elements: tuple[tuple[str, str], ...] = ()
    unless: str | None = None
    left: int = 90


#: Series of grades.
CONCRETE = "7,5|10|12,5|15|20|22,5|25|27,5|30|35|40|45|50|55|60|70|80|90|100"
REBAR = "240|300|400|500|600|800|1000"
DOOR_MINUTES = "15|30|45|60|90|120|150|180"
#: Attributes of cables in the order in which they are named, and what shows them.
CABLE_ATTRIBUTES = (("нг(А)", r"нг\((А|A)\)"), ("FR", "FR"), ("LS", "LS"), ("HF", "HF"), ("LTx", "LTx"))
#: Kinds of lights, and those that count as old.
LIGHTS = (("LED", "LED|светодиод"), ("люминесцентный", "люминесцент"), ("накаливания", "накаливан"), ("разрядный", "разрядн|ДРЛ|ДНаТ"))
OLD_LIGHTS = ("люминесцентный", "накаливания")
#: Materials of pipes in order; the first two are the better ones.
PIPES = (("чугун", "чугун|ЧК|SML"), ("шумопоглощающие", "шумопоглощ|малошумн"), ("ПВХ", "ПВХ|НПВХ|PVC"), ("ПП", r"(^|[^А-Я])ПП([^А-Я]|$)|PPR"), ("ПЭ", r"(^|[^А-Я])ПЭ([^А-Я]|$)"), ("сталь", "сталь|стальн"))
BETTER_PIPES = ("чугун", "шумопоглощающие")

STRUCTURES = (("стена в грунте", "стен[аы] в грунте"), ("фундамент", "фундаментн|ростверк|сва[йи]"), ("перекрытие", "перекрыти|плит[аы]"), ("вертикаль", "колонн|пилон|диафрагм|стен"))
RULES = (
    Rule("concrete", rf"(?<![А-Яа-яA-Za-z])[BВ]({CONCRETE})(?![0-9]|,[0-9])", STRUCTURES, "кроме"),
    Rule("rebar", rf"(?<![А-Яа-яA-Za-z])[AА]({REBAR})[СC]?(?![0-9])", STRUCTURES),
    Rule("thickness", r"(?<![0-9.,])([0-9]{2,4}) ?мм", STRUCTURES, "диаметр"),
    Rule("door", rf"(?<![A-Za-zА-Яа-я])EI[WS]* ?({DOOR_MINUTES})(?![0-9])"),
    Rule("power", r"(?<![0-9])([0-9]+(?:,[0-9]+)?) ?кВт"),
)


def matches_of(line: Column, context: Column, rule: Rule) -> Column:
    """array<struct<rule, place, value, element, element_from>> of one rule on one line."""
    first = lambda text: F.coalesce(*(F.when(F.regexp_like(text, F.lit(f"(?iu){p}")), F.lit(n)) for n, p in rule.elements)) if rule.elements else F.lit(None).cast("string")
    own, around = first(line), first(context)
    of = lambda m, i: F.struct(F.lit(rule.name).alias("rule"), i.alias("place"), F.regexp_extract(m, rule.pattern, 1).alias("value"), F.coalesce(own, around).alias("element"), F.when(own.isNotNull(), "line").when(around.isNotNull(), "context").alias("element_from"))
    found = F.regexp_extract_all(line, F.lit(rule.pattern), F.lit(0))
    if rule.unless:
        before = lambda m: _left_of(line, m, rule.left)
        found = F.filter(found, lambda m: ~F.regexp_like(before(m), F.lit(f"(?iu){rule.unless}")))
    return F.transform(found, of)


def _left_of(line: Column, match: Column, n: int) -> Column:
    at = F.instr(line, match)
    start = F.greatest(F.lit(1), at - n)
    return F.substring(line, start, at - start)


def extract(df: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES, radius: int = 1) -> DataFrame:
    """key, line_no, rule, place, value, element, element_from: the facts of each text."""
    split = F.split(text, "\n")
    rows = df.where(F.col(text).isNotNull()).select(key, split.alias("ls"))
    around = lambda i: F.concat_ws(" | ", *(F.get("ls", i + d) for d in [*range(-radius, 0), *range(1, radius + 1)]))
    lines = rows.select(key, F.inline(F.transform("ls", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), around(i).alias("context"))))).where(F.col("line").rlike("[0-9]"))
    every = F.concat(*(matches_of(F.col("line"), F.col("context"), r) for r in rules))
    return lines.select(key, "line_no", F.inline(every))


def named(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """The names of a table whose patterns a text shows, in the table's order; empty for null."""
    return F.filter(F.array(*(F.when(F.regexp_like(text, F.lit(p)), F.lit(n)) for n, p in table)), lambda x: x.isNotNull())
