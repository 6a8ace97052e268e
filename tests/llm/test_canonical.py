import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triscope.llm.canonical import changed, mapping, plain_forms, with_plain
from triscope.llm.words import joined_words, words

CASES = {
    "кBт": "кВт", "２３,８ м": "23,8 м", "П​В­6": "ПВ6", "мaссa 4x2": "масса 4х2", "LЕD IР31": "LED IP31", "ЕΙ 30": "EI 30", "йод ё": "йод ё",
    "ёлка": "ёлка", "a\xa0b": "а b", "B25": "В25", "W8": "W8", "м² № – «x» °C": "м² № – «х» °С", "ＬＥＤ": "LED", "⁠": "", "а́": "а́",
    "q̣̇": "q̣̇", "q̣̇": "q̣̇", "a b": "а\nb", "ﬁx": "fix", "план": "план", "план\tэтажа\r\n": "план\tэтажа\r\n", "": "", "𝐀𝐁𝐂W": "ABCW", "😀 AB": "😀 АВ",
    "ѕteel": "steel", "ѕсаle і": "scale i", "α = 5": "α = 5", "ρressure": "pressure", "Їжак": "Їжак",
}


def test_forms(spark):
    df = spark.createDataFrame([(k, 1, "x") for k in CASES] * 2 + [(None, 1, "x")], "t string, id int, plain string")
    rows = with_plain(df, {"t": "plain"}).collect()
    assert len(rows) == 2 * len(CASES) + 1
    assert {r.t: r.plain for r in rows} == CASES | {None: None}
    changed = {r.text: r.plain for r in plain_forms(df, "t").collect()}
    assert changed == {k: v for k, v in CASES.items() if k != v}


def test_several_columns_and_other_columns(spark):
    df = spark.createDataFrame([(1, "LЕD", None, "x"), (2, None, "кBт", "y"), (3, "план", "​", "z"), (4, None, None, None)], "id int, a string, b string, own string")
    rows = with_plain(df, {"a": "pa", "b": "b"}).collect()
    assert sorted((r.id, r.a, r.own, r.pa, r.b) for r in rows) == [(1, "LЕD", "x", "LED", None), (2, None, "y", None, "кВт"), (3, "план", "z", "план", ""), (4, None, None, None, None)]


def test_a_text_on_a_third_of_the_rows_is_spread(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'LЕD' ELSE concat('план ', id) END AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = changed(df, "text")
        assert out.count() == 1000 and max(r.n for r in out.selectExpr("spark_partition_id() AS p").groupBy("p").agg(F.count("*").alias("n")).collect()) < 500
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_plain_form_is_stable_and_long_texts_are_whole(spark):
    texts = [v for v in CASES.values()] + ["Пoл " * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.plain for r in plain_forms(df).collect()} == {"Пол " * 20_000}
    assert plain_forms(spark.createDataFrame([], "text string")).collect() == []


def test_mapping_is_bounded_and_keeps_plain_signs():
    table = dict(mapping())
    assert len(table) < 20_000 and not set("²³°№–«»\rАяё") - {"ё"} & set(table)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_words_do_not_depend_on_form(text):
    for form in ("NFC", "NFD"):
        assert words(unicodedata.normalize(form, text)) == words(unicodedata.normalize("NFC", text))


def test_words():
    assert words("Ёлка, Тoлщина ２５ мм") == words("елка толщина 25 мм") and words("  ,.") == []
    assert joined_words("пере-\nгородка и") == words("перегородка и") and joined_words("без переноса") is None and joined_words("a\nb") is None


def test_values_of_the_test_tables_against_brute_force(spark, data):
    import re

    from triscope.functions.lookalikes import FROM_GREEK, TO_LATIN, TO_RUSSIAN
    from triscope.llm.queries import _fragments

    def one(m):
        letters = [c for c in m[0] if c.isalpha()]
        russian = all(c in TO_LATIN or c in TO_RUSSIAN for c in letters) or any("а" <= c.lower() <= "ё" and c not in TO_LATIN for c in letters)
        return "".join((TO_RUSSIAN if russian else TO_LATIN).get(c, c) for c in m[0])

    def brute(t):
        t = "".join(" " if unicodedata.category(c) == "Zs" else "" if unicodedata.category(c) == "Cf" else c for c in t)
        t = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else FROM_GREEK.get(c, c) for c in t)
        return re.sub(r"[^\W_]+", one, unicodedata.normalize("NFC", t))

    rows = _fragments(spark, data)
    want = {r.text: brute(r.text) for r in rows.collect()}
    got = {r.text: r.plain for r in plain_forms(rows).collect()}
    assert got and got == {k: v for k, v in want.items() if k != v}
