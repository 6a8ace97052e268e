from hypothesis import given, settings
from hypothesis import strategies as st

from triscope.operators.packed import delimiters, extract, resolve, skeletons, split_packed

CASES = {
    "П1, В2": ["П1", "В2"],
    "4 370,4 м²; 12 мм": ["4 370,4 м²", "12 мм"],
    "1,5": None,
    "В22,5 W6": None,
    "6 Вт/м²": None,
    "6,11 Вт/м²/7 Вт/м²": ["6,11 Вт/м²", "7 Вт/м²"],
    "48,73 м/37,04 м": ["48,73 м", "37,04 м"],
    "17-05/24-КР1": None,
    "17-05/24-КР1/18-05/24-КР2": ["17-05/24-КР1", "18-05/24-КР2"],
    "150/80": ["150", "80"],
    "«Офис, пом. 4»/\"Холл; тамбур\"": ["Офис, пом. 4", "Холл; тамбур"],
    'ЩР-2, "Щит ""Этажный 6"""': ["ЩР-2", 'Щит "Этажный 6"'],
    'Щит "Этажный 13"': None,
    "a и b и c": ["a", "b", "c"],
    "один;; ;два|": ["один", "два"],
    "один;": None,
    " x\r\ny\tz ": ["x", "y", "z"],
    '"открыта; кавычка': ['"открыта', "кавычка"],
    "3,3⁠8 л/​с": None,
    "-1,5,+2,5": ["-1,5", "+2,5"],
    "": None,
    ";,|": None,
}


def test_values(spark):
    df = spark.createDataFrame([(i, v, "c") for i, v in enumerate(CASES)] + [(99, None, "c")], "id int, value string, item string")
    rows = split_packed(df, "value").collect()
    got: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.id, r.pos)):
        assert r.pos == len(got.setdefault(r.id, []))
        got[r.id].append(r.item)
    assert {v: got.get(i) for i, v in enumerate(CASES)} == CASES and 99 not in got


def test_no_rows_and_other_columns(spark):
    assert split_packed(spark.createDataFrame([], "value string, x int"), "value").columns == ["x", "pos", "item"]
    long = "; ".join(["П1"] * 20_000)
    rows = split_packed(spark.createDataFrame([(long, 1), ("a;b", 1), ("a;b", 1)], "value string, x int"), "value").collect()
    assert len(rows) == 20_004


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0a u;|,/\n\"'«»и+-.\u200b", max_size=20))
def test_items_of_any_value_are_in_order_and_apart(value):
    skeleton, at = delimiters(value)
    assert len(at) == sum(c not in "a " for c in skeleton) and all(value[i] in ";|,/\n\t\r\"'«»иИ" for i in at)
    upto = -1
    for a, b, _ in resolve(skeleton):
        assert upto <= a < b <= len(at)
        upto = b
    for item, (_, _, quote) in zip(extract(value, at, resolve(skeleton)), resolve(skeleton)):
        assert item and item in (value.replace(quote * 2, quote) if quote in "\"'" and quote else value)


def test_skeletons_tell_neither_words_nor_numbers(spark):
    values = ["П1; В2", "4 370,4 м²; 12,5 мм и более", "6,11 Вт/м²/7 Вт/м²", "17-05/24-КР1|18-05/24-КР2", "слово\nдва слова, ещё три"]
    rows = skeletons(spark.createDataFrame([(v,) for v in values], "value string"), "value").collect()
    assert {r.skeleton: r.n for r in rows} == {"a;a": 3, "a;a;a": 2}


def test_rules_that_are_not_broadcast_give_the_same(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(CASES)], "id int, value string")
    few, all_rules = (sorted(map(tuple, split_packed(df, "value", rules=n).collect())) for n in (1, 1000))
    assert few == all_rules


def test_single_values_on_demand(spark):
    df = spark.createDataFrame([(1, "a;b"), (2, "один"), (3, "4,5"), (4, None), (5, "")], "id int, value string")
    assert sorted(map(tuple, split_packed(df, "value", singles=True).collect())) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "один"), (3, 0, "4,5"), (5, 0, "")]


def test_a_dash_or_number_after_a_unit_parts_values():
    for value, n in (("5 м/мм-5", 2), ("5 м/мм", 0), ("5 м/мм 6", 0), ("5 м/м7", 2), ("12 кг/м³", 0), ("12 kг/м", 0)):
        assert len(resolve(delimiters(value)[0])) == max(n, 1), value


ITEMS = ["4 370,4 м²", "12 мм", "В22,5 W6", "6,11 Вт/м²", "7550 м³/ч", "1,24 л/с", "17-05/24-КР1", "К7-22", "150", "+36,075", "-2,815", "06.12.2025", "ППГнг(А)-HF 2х2,5", "Офис, пом. 4", "Холл; тамбур", 'Щит "Этажный 6"', "EI 60", "светодиодный IP65", "Ст.29", "П1|П2", "туда и сюда", "48 °С", "чугун 100", "3,3⁠8 л/​с"]
SEPARATORS = ["; ", ", ", ";", "/", " / ", "|", " | ", "\n", "\r\n", "\t", " и ", ",", ";;", "; ;", " ; "]


def pack(items, separators, quotes):
    out = ""
    for i, (item, sep, q) in enumerate(zip(items, separators, quotes)):
        holds = any(x in item.replace("/м", "").replace("/ч", "").replace("/с", "").replace("/​с", "") for x in (";", "|", ", ", " и "))
        if holds or q:
            opening, closing = [('"', '"'), ("«", "»"), ("'", "'")][q % 3]
            if opening == '"' or opening not in item:
                item = opening + (item.replace('"', '""') if opening == '"' else item) + closing
        if i and sep == "," and out[-1:].isdigit() and item[0].isdigit():
            sep = ", "
        out += (sep if i else "") + item
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(ITEMS), st.sampled_from(SEPARATORS), st.integers(0, 5).map(lambda x: max(0, x - 2))), min_size=2, max_size=7), min_size=20, max_size=40))
def test_round_trip(spark, lists):
    packed = [(i, pack(*zip(*x))) for i, x in enumerate(lists)]
    got: dict[int, dict] = {}
    for r in split_packed(spark.createDataFrame(packed, "id int, value string"), "value").collect():
        got.setdefault(r.id, {})[r.pos] = r.item
    for (i, value), x in zip(packed, lists):
        assert [got[i][k] for k in range(len(got[i]))] == [item for item, _, _ in x], value
