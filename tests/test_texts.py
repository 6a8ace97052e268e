from pyspark.sql import functions as F

from triscope.functions import text as t
from triscope.functions.fuzzy import kinds_by_words, near, phrase_at, ratio
from triscope.functions.marks import parse_marks, system_of
from triscope.operators.boxes import nearest, overlaps, rows_of
from triscope.operators.compare import align, apart, disjoint_below, higher_rank, lost, lower_minimum, scores


def values(spark, f, *texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_lookalikes(spark):
    got = values(spark, t.repair_lookalikes, "CMEСИ", "Бетoн B25", "ось 2/B это AKT", "the AKT of A", None, "A500C сталь", "два\nAKT one")
    assert got == ["СМЕСИ", "Бетон B25", "ось 2/B это АКТ", "the AKT of A", None, "A500C сталь", "два\nAKT one"]


def test_places(spark):
    got = values(spark, t.place_key, "пом. 12", "№012", "Помещение 7а", "помещение 1234", "система П 2.1", "Кровля ", "подвал  ёлка", None)
    assert got == ["012", "012", "007а", "1234", "П2.1", "кровля", "подвал елка", None]


def test_names(spark):
    assert values(spark, t.cipher, "12-05-24-КР1 изм.2.pdf", "ПБ1 (5).pdf", "том_кор.3.PDF", None) == ["120524кр1", "пб1", "том", None]
    assert values(spark, t.revision_number, "КР изм.2.pdf", "КР_кор 3_изм.1.pdf", "КР.pdf", "КР ред-12 (4).pdf") == [2, 3, 0, 12]
    assert values(spark, t.path_date, "а/25.04.2024/б 01.12.2023.pdf", "31.02.2024", "нет") == [20240425, 0, 0]
    assert values(spark, t.section_of, "Лист ЭМ2.pdf", "КРОВЛЯ.pdf", "12-АР1", "план", "ОВ.pdf") == ["EOM", "OTHER", "AR", "OTHER", "OV"]
    names = ["п9", "п10", "п010", "п" + "9" * 30, "п1" + "0" * 30, "п2б", "п2а10", "п2а9", "", None]
    keys = dict(zip(names, values(spark, t.natural_key, *names)))
    assert keys["п10"] == keys["п010"] and sorted((n for n in names if n and n != "п010"), key=keys.get) == ["п2а9", "п2а10", "п2б", "п9", "п10", "п" + "9" * 30, "п1" + "0" * 30]
    assert values(spark, t.revision_number, "КР изм.12345678901.pdf", "КР изм.99999999999999999999.pdf") == [12345678901, 0]
    assert values(spark, t.composed, "и\u0306ог", "йог", "plain", "", None, "가") == ["йог", "йог", "plain", "", None, "가"]


def test_numbers(spark):
    assert values(spark, t.comma_number, "4 370,4 м²", "-13,020", "+5", "нет", None, "В22,5") == [4370.4, -13.02, 5.0, None, None, 22.5]
    assert values(spark, t.decimals, "4 370,4", "7", "1,250") == [1, 0, 3]


def test_marks(spark):
    got = values(spark, parse_marks, "B2.7,8,9", "В2.4-В2.6", "П2/ВЕ", "В1О:", "П03.162", "ВЕ13", "П300*300", "П", "В2.3, 4", "ДУ5 ПД1О", "В1.1-40", None, "")
    assert got == [["В2.7", "В2.8", "В2.9"], ["В2.4", "В2.5", "В2.6"], ["П2", "ВЕ"], ["В10"], [], ["ВЕ13"], [], [], ["В2.3", "В2.4"], ["ДУ5", "ПД10"], [], None, []]
    assert values(spark, system_of, "В2.7", "ВЕ13", "П2") == ["В2", "ВЕ", "П2"]


def test_near_words(spark):
    df = spark.createDataFrame([("выполнсны",), ("выполнены",), ("окно",), (None,), ("выполнсны",)], "word string")
    got = {(r.word, r.target) for r in near(df, ["выполнены"]).collect()}
    assert got == {("выполнсны", "выполнены"), ("выполнены", "выполнены")} and ratio("выполнсны", "выполнены") >= 0.78
    words = ["акт", "освидетельствованил", "скрытых", "работ"]
    assert phrase_at(words, ["освидетельствования", "работ"]) and not phrase_at(words, ["работ", "освидетельствования"]) and not phrase_at([], ["работ"])
    assert phrase_at("работ один два три четыре работ начало".split(), ["работ", "начало"], gap=0)  # not the first occurrence


def test_kinds_by_words(spark):
    df = spark.createDataFrame([(1, "AKT освидетельствованил работ"), (2, "Реестр"), (3, "план и реестр"), (4, None), (5, "кот")], "id int, t string")
    rules = [("act", [["освидетельствования", "работ"]]), ("register", [["реестр"], ["журнал", "учёта"]])]
    assert {r.id: r.kind for r in kinds_by_words(df, "t", rules).collect()} == {1: "act", 2: "register", 3: "register", 4: "other", 5: "other"}


def test_rules(spark):
    facts = [("v", "PD", 40), ("v", "RD", 30), ("n", "PD", 30), ("n", "RD", 40), ("n", "RD", 60), ("c", "PD", 1), ("x", "RD", 1), ("o", "PD", 2), ("o", "PD", 5), ("o", "RD", 1), ("o", "RD", 3), ("i", "ID", 3)]
    a = align(spark.createDataFrame(facts, "k string, s string, v int"), ["k"], "s", "v")
    label = lambda rule: {r.k: r.label for r in a.select("k", rule).collect()}
    assert label(lower_minimum()) == {"v": "V", "n": "N", "c": "C", "x": "C", "o": "V"}
    assert label(disjoint_below()) == {"v": "V", "n": "N", "c": "C", "x": "C", "o": "C"}
    assert label(higher_rank()) == {"v": "N", "n": "V", "c": "C", "x": "C", "o": "C"}
    assert label(apart(10)) == {"v": "N", "n": "N", "c": "C", "x": "C", "o": "N"}
    sets = spark.createDataFrame([(["FR", "LS"], ["LS"])], "a array<string>, b array<string>")
    assert sets.select(lost(F.col("a"), F.col("b")), lost(F.col("a"), F.col("b"), ["LS", "FR"])).first()[0] == ["FR"]
    s = scores(spark.createDataFrame([("V", "V"), ("V", None), ("N", "V"), (None, "N")], "g string, o string"), "g", "o", "V").first()
    assert (s.tp, s.fp, s.fn, s.tn, s.precision, s.recall, s.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5)


def test_boxes(spark):
    import random

    random.seed(5)
    data = []
    for i in range(60):
        x, y = random.uniform(0, 0.9), random.uniform(0, 0.9)
        data.append((i % 2, f"k{i:02d}", x, y, x + random.uniform(0.01, 0.3), y + random.uniform(0.01, 0.1)))
    df = spark.createDataFrame(data, "page int, key string, x0 double, y0 double, x1 double, y1 double")
    area = lambda b: (b[4] - b[2]) * (b[5] - b[3])
    want_pairs, want_near = set(), {}
    for a in data:
        for b in data:
            if a[0] == b[0] and a[1] != b[1]:
                i = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
                if a[1] < b[1] and i / (area(a) + area(b) - i) >= 0.05:
                    want_pairs.add((a[1], b[1]))
                d = (((a[2] + a[4] - b[2] - b[4]) / 2) ** 2 + ((a[3] + a[5] - b[3] - b[5]) / 2) ** 2) ** 0.5
                if d <= 0.2:
                    want_near[a[1]] = min(want_near.get(a[1], (9, "")), (d, b[1]))
    got = [(r.key_a, r.key_b) for r in overlaps(df, ["page"], "key", 0.05).collect()]
    assert len(got) == len(set(got)) and set(got) == want_pairs
    assert {r.key: r.nearest for r in nearest(df, ["page"], "key", 0.2).collect()} == {k: v[1] for k, v in want_near.items()}
    bands = rows_of(df.limit(0).unionByName(spark.createDataFrame([(0, "b", 0.5, 0.10, 0.6, 0.12), (0, "a", 0.1, 0.11, 0.2, 0.13), (0, "c", 0.1, 0.9, 0.2, 0.95)], df.schema)), ["page"], "key", 0.05)
    assert {r.line for r in bands.collect()} == {"a b", "c"}
