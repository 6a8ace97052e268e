from datetime import date

from pyspark.sql import functions as F

from triscope.functions import parse as p
from triscope.operators import layout
from triscope.operators.boxes import cell_of


def values(spark, f, *texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_dates(spark):
    assert values(spark, p.text_date, "«17» апреля 2026 г.", "5 мая 2024", "1 марта 2023", "31 февраля 2024", "нет", None, "09 ДЕКАБРЯ 2025") == [date(2026, 4, 17), date(2024, 5, 5), date(2023, 3, 1), None, None, None, date(2025, 12, 9)]
    assert values(spark, p.short_date, "акт 01.01.2020 от 05.06.2024", "31.02.2024", None) == [date(2024, 6, 5), None, None]


def test_degrees_and_grades(spark):
    assert values(spark, p.degree, "II", "ІІІ", "lV", "3", "9", "", None) == [2, 3, 4, 3, None, None, None]
    got = values(spark, p.steel_grade, "лист С245", "Ст3сп", "сталь 20", "09Г2C", "S 355", "бетон", "сталь марки 45", None)
    assert [g and tuple(g) for g in got] == [("С245", 245), ("Ст3сп", 245), ("сталь 20", 245), ("09Г2С", 345), ("S355", 355), None, ("сталь 45", 355), None]


def test_articles_of_laws_are_no_steel(spark):
    """The number of an article is no grade; marks of deoxidation may have a digit; 275 is a grade."""
    got = values(spark, p.steel_grade, "согласно ст. 6 закона", "ст.4 ФЗ", "Ст3сп5 по ГОСТ", "С275", "Ст 6", "стали марки Ст3", "ВСт3пс", "Ст20", "C345-3", "С2451", "сталь 10Г2С1 и С245", "из С 255", "арт. 20, ст20")
    assert [g and tuple(g) for g in got] == [None, None, ("Ст3сп", 245), ("С275", 275), None, ("Ст3", 245), ("Ст3пс", 245), ("сталь 20", 245), ("С345", 345), None, ("10Г2С1", 345), ("С255", 255), None]


def test_floors_without_numbers(spark):
    titles = ["цокольный этаж", "типовой этаж", "план технического этажа", "мансарда", "2 эт.", "антесольного этажа", "1 секция 2 этаж", "подвал, 1-й этаж, подвал", "-1 – 3 этажа", "этажерка", None]
    assert values(spark, p.floor_of, *titles) == ["цоколь", "типовой этаж", "техэтаж", "мансарда", "2 этаж", "антресоль", "секция 1, 2 этаж", "подвал, 1 этаж", "-1-3 этаж", "", None]


def test_sections(spark):
    got = values(spark, p.sections, "сечением 2100 х 300, 400х400 и D500", "50х50", "550х1200, 600х1300", None)
    assert [g if g is None else [tuple(x) for x in g] for g in got] == [[("300×2100", 630000), ("400×400", 160000), ("D500", 196349)], [], [("550×1200", 660000), ("600×1300", 780000)], None]


def test_titles_and_floors(spark):
    assert values(spark, p.undoubled, "2 2го го этажа этажа. . Секция Секция 1. 1.", "План", "") == ["2го этажа. Секция 1.", "План", ""]
    assert values(spark, p.floor_of, "Экспликация 1-го этажа", "План 3–14 этажа, секция 2", "антресольного этажа", "(2 секция)", "план") == ["1 этаж", "3-14 этаж, секция 2", "антресоль", "секция 2", ""]
    assert values(spark, p.floor_numbers, "3-5 этаж", "1 этаж", "подвал", None) == [[3, 4, 5], [1], None, None]
    assert values(spark, p.room_group, "1.109", "2.4.1", "135", "23", "135#2") == ["1", "2.4", "1", "", "1"]


def test_short_texts(spark):
    assert values(spark, lambda c: p.after_label(c, "Раздел"), "Раздел 5. ИОС1", "КР", None, "Раздел 5.") == ["ИОС1", "КР", "", "Раздел 5."]
    assert values(spark, p.safe_name, 'a/b:c*"', "x" * 200) == ["a_b_c__", "x" * 180]
    assert values(spark, p.upload_name, "Акт".encode().decode("latin_1"), "Ñandú", "Акт", "plain", None) == ["Акт", "Ñandú", "Акт", "plain", None]
    assert values(spark, p.missing_stages, "в РД нет; в ИД нет, в РД нет", "есть", None) == [["РД", "ИД"], [], []]
    assert values(spark, lambda c: p.form_field(c, 2), "1. Работы\nодно\n(что)\n2. Проект\n лист 5,\n лист 6\n(шифр)\n2. Ещё\nдругое", "1. нет", None) == ["лист 5, лист 6", None, None]
    assert values(spark, p.form_fields, "0\n1. А\nодно\n3. Б\nдва\nтри\n(что)\nчетыре\n4.\n") == [{1: "одно", 3: "два три"}]
    assert values(spark, lambda c: p.clause_of(c, F.lit("А400")), "рабочая А400, прочая А240", "нет") == ["рабочая А400", None]
    assert values(spark, p.dash, "x", " ", None) == ["x", "—", "—"]
    row = spark.range(1).select(p.percent(F.lit(1), F.lit(3)), p.percent(F.lit(1), F.lit(0)), p.group_id("EG-", F.lit("a"), F.lit("b"), F.lit(None)))
    a, b, c = row.first()
    import hashlib

    assert (a, b, c) == ("33,3%", "—", "EG-" + hashlib.sha1(b"a\x00b\x00").hexdigest()[:12])


TOKENS = "page int, key string, x0 double, y0 double, x1 double, y1 double, score double"


def test_tokens_of_two_readings(spark):
    base = spark.createDataFrame([(1, "t1", 0.0, 0.0, 1.0, 1.0, 1.0)], TOKENS)
    extra = spark.createDataFrame([(1, "o1", 0.1, 0.0, 1.1, 1.0, 0.5), (1, "o2", 5.0, 5.0, 6.0, 6.0, 0.5), (2, "o3", 0.0, 0.0, 1.0, 1.0, 0.5)], TOKENS)
    assert {r.key for r in layout.with_new_tokens(base, extra, ["page"], "key").collect()} == {"t1", "o2", "o3"}
    points = spark.createDataFrame([(1, f"w{i}", 60.0 * i, 700.0, 60.0 * i + 50, 712.0, 1.0) for i in range(9)], TOKENS)  # boxes in points
    again = spark.createDataFrame([(1, "n1", 5.0, 701.0, 52.0, 711.0, 0.5), (1, "n2", 5.0, 800.0, 55.0, 812.0, 0.5)], TOKENS)
    assert sorted(r.key for r in layout.with_new_tokens(points, again, ["page"], "key").collect())[:2] == ["n2", "w0"]
    assert 40 < cell_of(points) < 60 and cell_of(points.limit(0)) == 1.0 and cell_of(base) == 1.0
    both = base.unionByName(extra)
    assert {r.key for r in layout.strongest(both, ["page"], "key", "score").collect()} == {"t1", "o2", "o3"}


def test_rows_and_lines(spark):
    t = spark.createDataFrame([(1, "a", 0.0, 0.0, 1.0, 1.0), (1, "b", 1.5, 0.2, 2.5, 1.2), (1, "c", 9.0, 0.1, 9.5, 1.1), (1, "d", 0.0, 3.0, 1.0, 4.0)], "page int, t string, x0 double, y0 double, x1 double, y1 double")
    assert [r.line for r in layout.reading_rows(t, ["page"], "t").orderBy("row").collect()] == ["a b", "c", "d"]
    s = spark.createDataFrame([(1, 0.0, 5.0, 10.0, 5.1), (1, 12.0, 5.0, 20.0, 5.0), (1, 40.0, 5.0, 30.0, 5.0), (1, 0.0, 9.0, 3.0, 9.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.level, r.start, r.end, r.n) for r in layout.merged_level(s, ["page"]).collect()) == [(5, 0.0, 20.0, 2), (5, 30.0, 40.0, 1), (9, 0.0, 3.0, 1)]
    g = layout.grouped_lines(t.withColumn("o", F.col("x0")).withColumn("s", F.lit(0.5)), ["page"], "o", "t", "s").first()
    assert (g.x0, g.y1, g.score) == (0.0, 4.0, 0.5) and set(g.line.split()) == set("abcd")


def test_columns_and_walks(spark):
    labels = spark.createDataFrame([(1, x) for x in (10.0, 10.5, 11.0, 11.5, 50.0, 52.0)], "page int, x double")
    assert sorted(r.x for r in layout.outside_columns(labels, ["page"], "x").collect()) == [50.0, 52.0]
    points = spark.createDataFrame([(1, "p", 0.0, 0.0), (1, "q", 500.0, 500.0)], "page int, k string, x double, y double")
    segments = spark.createDataFrame([(1, 1, 1.0, 0.0, 30.0, 0.0), (1, 2, 60.0, 1.0, 31.0, 0.0), (1, 3, 60.0, 90.0, 61.0, 1.0)], "page int, id int, x0 double, y0 double, x1 double, y1 double")
    walk = lambda n: {r.key: (r.x, r.y, r.hops) for r in layout.follow(points, segments, ["page"], "k", n, 5.0).collect()}
    assert walk(2) == {"p": (60.0, 1.0, 2), "q": (500.0, 500.0, 0)} and walk(5)["p"] == (60.0, 90.0, 3)


def test_seen_boxes(spark):
    df = spark.createDataFrame([([10.0, 20.0, 30.0, 40.0], r) for r in (0, 90, 180, 270)], "b array<double>, r int")
    got = [r[0] for r in df.orderBy("r").select(layout.visible_box(F.col("b"), F.lit(100.0), F.lit(200.0), F.col("r"))).collect()]
    assert got == [[0.1, 0.1, 0.3, 0.2], [0.8, 0.1, 0.9, 0.3], [0.7, 0.8, 0.9, 0.9], [0.1, 0.7, 0.2, 0.9]]
