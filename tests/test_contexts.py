from triscope.operators.contexts import first_of_page, looking_back, nearest_in_sentence, under_headers

MM = r"([0-9]+) мм"
NAMES = {"plate": "плит", "wall": "стен"}


def texts(spark, *ts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ts)], "doc int, t string, value string")


def test_under_headers(spark):
    df = texts(spark, "Толщины:\nплиты 200 мм, 250 мм\nстены 300 мм\nещё 400 мм", "плиты 200 мм", "Толщины: 5 мм\nОсобо:\n7 мм", None, "")
    rows = under_headers(df, "doc", "t", r":\s*$", MM, 2).collect()
    assert sorted((r.doc, r.line_no, r.header_no, r.header, r.place, r.value) for r in rows) == [(0, 1, 0, "Толщины:", 0, "200"), (0, 1, 0, "Толщины:", 1, "250"), (0, 2, 0, "Толщины:", 0, "300"), (2, 2, 1, "Особо:", 0, "7")]


def test_looking_back(spark):
    df = texts(spark, "плита\nслой\n200 мм\n\n300 мм", "стена 1 мм, плита\n2 мм", "a\nb\nc\nплита\nd\ne\nf\n5 мм", None)
    back = lambda **more: sorted((r.doc, r.line_no, r.value, r.name, r.back) for r in looking_back(df, "doc", "t", MM, NAMES, 3, **more).collect())
    assert back() == [(0, 2, "200", "plate", 2), (0, 4, "300", None, None), (1, 0, "1", "plate", 0), (1, 1, "2", "plate", 1), (2, 7, "5", None, None)]
    assert back(title=True)[1] == (0, 4, "300", "plate", None)


def test_nearest_in_sentence(spark):
    df = texts(spark, "Стена и плита 20 мм, 30 мм до стены. Потом 40 мм у плиты! 50 мм.", None, "60 мм")
    rows = sorted((r.doc, r.sentence_no, r.place, r.value, r.name, r.side) for r in nearest_in_sentence(df, "doc", "t", MM, NAMES).collect())
    assert rows == [(0, 0, 0, "20", "plate", "before"), (0, 0, 1, "30", "plate", "before"), (0, 1, 0, "40", "plate", "after"), (0, 2, 0, "50", None, None), (2, 0, 0, "60", None, None)]


def test_first_of_page(spark):
    rows = first_of_page(texts(spark, "1 мм 2 мм\fнет\f3 мм", None, ""), "doc", "t", MM).collect()
    assert sorted((r.doc, r.page, r.value) for r in rows) == [(0, 0, "1"), (0, 2, "3")]


def test_no_rows(spark):
    none = texts(spark).limit(0)
    assert under_headers(none, "doc", "t", ":", MM, 2).collect() == looking_back(none, "doc", "t", MM, NAMES, 2).collect() == nearest_in_sentence(none, "doc", "t", MM, NAMES).collect() == []
