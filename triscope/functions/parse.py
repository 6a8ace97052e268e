"""Column functions that read values out of short texts: dates, degrees, grades, sizes, floors, names.

Word lists and series are fixed values; null and text without the value give null or an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triscope.functions.text import to_russian

#: Stems of the months in order.
MONTHS = ("январ", "феврал", "март", "апрел", "ма", "июн", "июл", "август", "сентябр", "октябр", "ноябр", "декабр")
#: Yield strength in MPa of plain steels by number, carbon steels by number, and alloys.
PLAIN_STEEL = {0: 185, 1: 195, 2: 225, 3: 245, 4: 265, 5: 285, 6: 315}
CARBON_STEEL = {10: 205, 15: 225, 20: 245, 25: 275, 30: 295, 35: 315, 40: 335, 45: 355}
ALLOYS = {"09Г2С": 345, "10Г2С1": 345, "10ХСНД": 390, "15ХСНД": 345, "14Г2АФ": 390}
#: Numbers of rolled steels and of European ones, and of carbon steels that are named.
ROLLED, EURO, CARBON_NAMED = "235|245|255|275|285|345|355|375|390|440|590", "235|275|355|420|460", (10, 15, 20, 25, 30, 35, 40, 45)
ROMAN = {"I": 1, "II": 2, "III": 3, "IV": 4, "V": 5}
#: Floors by how their word begins, and endings of ordinal numbers.
FLOORS = {"антресол": "антресоль", "антесол": "антресоль", "подвал": "подвал", "цокол": "цоколь", "техническ": "техэтаж", "типов": "типовой этаж", "мансард": "мансарда", "чердак": "чердак", "кровл": "кровля"}
ORDINALS = "го|ого|й|ый|ой|х|ых|я|ем|м"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _lookup(key: Column, table: dict) -> Column:
    out = F.lit(None).cast("int")
    for k, v in table.items():
        out = F.when(key == str(k), v).otherwise(out)
    return out


def _at(words: Column, i: Column) -> Column:
    """The word at a place; empty outside."""
    return F.coalesce(F.get(words, i), F.lit(""))


def text_date(c: Column) -> Column:
    """The first date written with the month's name, such as «17» апреля 2026; impossible dates are null."""
    words = F.regexp_extract_all(F.lower(c), F.lit("([0-9]+|[а-яё]+)"), F.lit(1))

    def of(w: Column, i: Column) -> Column:
        named, year = _at(words, i + 1), _at(words, i + 2)
        month = F.coalesce(*(F.when(named.startswith(m), k) for k, m in sorted(enumerate(MONTHS, 1), key=lambda x: -len(x[1]))))
        whole = w.rlike("^[0-9]{1,2}$") & year.rlike("^20[0-9]{2}$") & month.isNotNull()
        return F.when(whole, F.concat_ws("-", year, month.cast("string"), w))

    return F.try_to_date(F.get(F.filter(F.transform(words, of), lambda d: d.isNotNull()), 0), "yyyy-M-d")


def short_date(c: Column) -> Column:
    """The first valid dd.mm.yyyy after the word "от", else anywhere."""
    one = lambda p: F.try_to_date(_found(c, p), "dd.MM.yyyy")
    return F.coalesce(one(r"от\s+([0-9]{2}\.[0-9]{2}\.[0-9]{4})"), one(r"([0-9]{2}\.[0-9]{2}\.[0-9]{4})"))


def degree(c: Column) -> Column:
    """A degree from one to five in Roman or Arabic figures, look-alikes allowed."""
    s = F.replace(F.translate(F.upper(F.trim(c)), "LІ1", "III"), F.lit(" "), F.lit(""))
    return F.coalesce(_lookup(s, ROMAN), F.when(F.trim(c).rlike("^[1-5]$"), F.trim(c).cast("int")))


def steel_grade(c: Column) -> Column:
    """struct<grade, strength> of the first steel grade of a text: С245, Ст3сп5, сталь 20, 09Г2С, S355.

    The text is read word by word. A number below 7 after Ст is a grade only with a mark of deoxidation or after the word "сталь",
    so that articles of laws (ст. 6) are none.
    """
    words = F.regexp_extract_all(c, F.lit(r"([0-9A-Za-zА-Яа-яё]+\.?(?:-[0-9]+)?)"), F.lit(1))
    bare = lambda w: F.regexp_replace(to_russian(F.upper(w)), r"\.$", "")
    of = lambda name, strength: F.struct(name.alias("grade"), strength.cast("int").alias("strength"))

    def grade(w: Column, i: Column) -> Column:
        head, following = bare(w), _at(words, i + 1)
        apart = head.isin("С", "СТ", "ВСТ", "S") & following.rlike("^[0-9]") & (~w.endswith(".") | F.lit(False))
        x = F.when(apart, F.concat(head, bare(following))).otherwise(head)
        marked = F.when(bare(_at(words, i - 1)) == "МАРКИ", bare(_at(words, i - 2))).otherwise(bare(_at(words, i - 1))).isin("СТАЛЬ", "СТАЛИ")
        great = w.rlike("^[СCВS0-9]")  # a small letter begins no mark
        g = lambda rx, k=1: F.nullif(F.regexp_extract(x, rx, k), F.lit(""))
        rolled, euro = g(f"^С({ROLLED})(?:К|-[0-9])?$"), g(f"^S({EURO})$")
        number, deoxidised = g("^В?СТ([0-6])(?:СП|ПС|КП)?[0-9]?$"), g("^В?СТ[0-6](СП|ПС|КП)[0-9]?$")
        plain = F.when(deoxidised.isNotNull() | (marked & x.rlike("^В?СТ[0-6]$")), number)
        carbon = F.when(x.rlike("^СТ") | marked, g(f"^(?:СТ)?({'|'.join(map(str, CARBON_NAMED))})$"))
        return F.when(great, F.coalesce(
            F.when(x.isin(*ALLOYS), of(x, _lookup(x, ALLOYS))),
            F.when(rolled.isNotNull(), of(F.concat(F.lit("С"), rolled), rolled)),
            F.when(euro.isNotNull(), of(F.concat(F.lit("S"), euro), euro)),
            F.when(plain.isNotNull(), of(F.concat(F.lit("Ст"), plain, F.coalesce(F.lower(deoxidised), F.lit(""))), _lookup(plain, PLAIN_STEEL))),
            F.when(carbon.isNotNull(), of(F.concat(F.lit("сталь "), carbon), _lookup(carbon, CARBON_STEEL))),
        ))

    return F.get(F.filter(F.transform(words, grade), lambda g: g.isNotNull()), 0)


def sections(c: Column) -> Column:
    """array<struct<label, area>> of sizes in a text, in order: 2100 х 300 as 300×2100 with its area, D500 as a circle. Sides from 100 to 3000."""
    words = F.regexp_extract_all(c, F.lit(r"([0-9]+(?:[.,][0-9]+)?|[A-Za-zА-Яа-я×]+)"), F.lit(1))
    side = lambda w: F.when(w.rlike("^[0-9]{3,4}$") & w.try_cast("int").between(100, 3000), w.try_cast("int"))
    kind = "struct<label:string,area:bigint>"

    def size(w: Column, i: Column) -> Column:
        a, b, d = side(w), side(_at(words, i + 2)), F.when(_at(words, i + 1).rlike("^[0-9]{3,4}$"), _at(words, i + 1).try_cast("int"))
        box = F.when(_at(words, i + 1).isin("х", "x", "Х", "X", "×") & a.isNotNull() & b.isNotNull(), F.struct(F.concat_ws("×", F.least(a, b).cast("string"), F.greatest(a, b).cast("string")).alias("label"), (a * b).cast("bigint").alias("area")).cast(kind))
        disc = F.when(w.isin("D", "d", "Д") & d.isNotNull(), F.struct(F.concat(F.lit("D"), d.cast("string")).alias("label"), F.round(F.lit(3.14159) * d * d / 4).cast("bigint").alias("area")).cast(kind))
        return F.coalesce(box, disc)

    return F.filter(F.transform(words, size), lambda x: x.isNotNull())


def clause_of(c: Column, match: Column) -> Column:
    """The part between commas and semicolons that holds the first occurrence of ``match``."""
    return F.get(F.filter(F.split(c, "[,;]"), lambda p: F.contains(p, match)), 0)


def undoubled(c: Column) -> Column:
    """A title whose words were printed twice for bold type, once."""
    words = F.split(F.trim(c), r"\s+")
    kept = F.aggregate(
        words,
        F.array().cast("array<string>"),
        lambda acc, w: F.when((F.size(acc) > 0) & F.startswith(w, F.element_at(acc, -1)), F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(w)))
        .when((F.size(acc) > 0) & F.endswith(F.element_at(acc, -1), w) & (F.length(w) < F.length(F.element_at(acc, -1))), acc)
        .otherwise(F.concat(acc, F.array(w))),
    )
    return F.array_join(kept, " ")


def floor_of(c: Column) -> Column:
    """The floors and sections that a title speaks of, in order, each once: ``3-14 этаж, секция 2``; empty without any."""
    s = F.regexp_replace(F.lower(undoubled(c)), r"([0-9])\s*[–-]\s*(?=[0-9])", "$1-")
    s = F.regexp_replace(s, f"([0-9])\\s*-?\\s*(?:{ORDINALS})(?![а-яё])", "$1")
    words = F.regexp_extract_all(s, F.lit("(-?[0-9]+(?:-[0-9]+)?|[а-яё]+)"), F.lit(1))
    number = lambda w: w.rlike("[0-9]")
    section = lambda w: w.startswith("секци")

    def part(w: Column, i: Column) -> Column:
        before, after = _at(words, i - 1), _at(words, i + 1)
        named = F.coalesce(*(F.when(w.startswith(k), v) for k, v in FLOORS.items()))
        return (
            F.when(number(w) & (after.startswith("этаж") | (after == "эт")), F.concat(w, F.lit(" этаж")))
            .when(number(w) & section(after), F.concat(F.lit("секция "), w))
            .when(section(w) & number(after) & ~number(before), F.concat(F.lit("секция "), after))
            .otherwise(named)
        )

    return F.array_join(F.array_distinct(F.filter(F.transform(words, part), lambda x: x.isNotNull())), ", ")


def floor_numbers(c: Column) -> Column:
    """The numbers of a floor's text, ``3-5 этаж`` as 3, 4, 5; null without a number."""
    head = F.when(c.contains(" этаж"), F.substring_index(c, " этаж", 1))
    ends = F.transform(F.split(head, "(?<=[0-9])-"), lambda x: F.trim(x).try_cast("int"))
    whole = F.forall(ends, lambda x: x.isNotNull())
    return F.when(whole, F.sequence(F.array_min(ends), F.array_max(ends)))


def room_group(c: Column) -> Column:
    """What the rooms of a unit have in common in their numbers: 1.109 gives 1, 2.4.1 gives 2.4, 135 gives 1, 23 nothing."""
    bare = F.substring_index(c, "#", 1)
    return F.when(bare.contains("."), F.regexp_replace(bare, r"\.[^.]*$", "")).when(bare.rlike("^[0-9]{3}[^0-9]*$"), F.substring(bare, 1, 1)).otherwise(F.lit(""))


def after_label(c: Column, label: str) -> Column:
    """``Раздел 5. ИОС1`` without the label and its number: ИОС1; other text as it is, null as empty."""
    rest = F.trim(F.substr(c, F.instr(c, F.lit(".")) + 1))
    return F.coalesce(F.when(c.startswith(label + " ") & (F.instr(c, F.lit(".")) > 0) & (rest != ""), rest), c, F.lit(""))


def group_id(prefix: str, *parts: Column) -> Column:
    """A short identifier of a group: prefix and the first twelve digits of a digest over its parts; nulls count as empty."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("\x00", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 12))


def safe_name(c: Column, longest: int = 180) -> Column:
    """A file name without characters that file systems refuse, cut to length."""
    return F.substring(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), 1, longest)


def upload_name(c: Column) -> Column:
    """A name whose UTF-8 bytes were read as Latin letters, put right if that gives Russian text; else as it is."""
    bytes_of = F.when(c.rlike(r"^[\x00-\xff]*$"), F.encode(c, "ISO-8859-1"))
    text = F.when(F.is_valid_utf8(bytes_of.cast("string")), bytes_of.cast("string"))
    return F.when(text.rlike(r"[Ѐ-ӿ]"), text).otherwise(c)


def dash(c: Column) -> Column:
    """Text for a report: a dash for nothing."""
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit("—"))


def percent(part: Column, whole: Column) -> Column:
    """A share with one decimal and a decimal comma; a dash of nothing."""
    share = F.try_divide(part.cast("double"), whole)
    return F.when(share.isNull(), F.lit("—")).otherwise(F.concat(F.replace(F.format_string("%.1f", F.round(share * 100, 1)), F.lit("."), F.lit(",")), F.lit("%")))


def missing_stages(note: Column) -> Column:
    """Stages that a note says are without something: ``в РД нет``."""
    found = F.regexp_extract_all(note, F.lit(r"(?iu)в (ПД|РД|ИД) нет"), F.lit(1))
    return F.coalesce(F.array_distinct(F.transform(found, lambda s: F.upper(s))), F.array().cast("array<string>"))


def form_fields(c: Column) -> Column:
    """map<int, string>: the fields of a form by their numbers. A field begins under a line ``n. heading`` and goes on to the
    explanation in brackets or the next heading; its lines are joined by blanks. Fields without lines are left out, the first of a
    number counts."""
    ls = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    head = lambda x: F.regexp_extract(x, r"^([0-9]+)\.(?: |$)", 1).try_cast("int")
    marks = F.filter(F.transform(ls, lambda x, i: F.when(head(x).isNotNull() | x.startswith("("), i)), lambda i: i.isNotNull())

    def field(i: Column) -> Column:
        end = F.coalesce(F.array_min(F.filter(marks, lambda j: j > i)), F.size(ls))
        return F.struct(head(F.get(ls, i)).alias("n"), F.trim(F.array_join(F.filter(F.slice(ls, i + 2, end - i - 1), lambda x: x != ""), " ")).alias("t"))

    fields = F.filter(F.transform(F.filter(marks, lambda i: head(F.get(ls, i)).isNotNull()), field), lambda f: f["t"] != "")
    first = F.filter(F.transform(fields, lambda f, k: F.when(~F.exists(F.slice(fields, 1, k), lambda g: g["n"] == f["n"]), f)), lambda f: f.isNotNull())
    return F.map_from_entries(first)


def form_field(c: Column, n: int) -> Column:
    """The text of a form's field ``n``; null without it."""
    return F.try_element_at(form_fields(c), F.lit(n))
