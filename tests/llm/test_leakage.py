import random

from triscope.llm.leakage import leaks
from triscope.llm.words import words


def brute(docs, items, window):
    out = set()
    for d, t in docs:
        s = " " + " ".join(words(t or "")) + " "
        for i, x in items:
            w = words(x or "")
            if any(" " + " ".join(w[k : k + window]) + " " in s for k in range(len(w) - window + 1)):
                out.add((d, i))
    return out


def run(spark, docs, items, **sizes):
    d = spark.createDataFrame([(a, b, 7) for a, b in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(a, b, "ru") for a, b in items], "item_id long, text string, words string")
    return {tuple(r) for r in leaks(d, i, **sizes).select("doc_id", "item_id").distinct().collect()}


def test_against_brute_force(spark):
    random.seed(6)
    vocabulary = [f"слово{i}" for i in range(40)]
    say = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, say(random.randrange(5, 40))) for i in range(25)] + [(99, None), (98, ""), (97, "коротко")]
    docs = []
    for d in range(120):
        text = say(random.randrange(0, 50))
        if d % 3 == 0:
            w = items[d % 25][1].split()
            k = random.randrange(len(w))
            text += ". " + " ".join(w[k : k + random.randrange(8, 20)]) + ", " + say(5)
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, items[3][1] * 300), docs[0]]
    for window in (12, 7):
        want = brute(docs, items, window)
        assert want and run(spark, docs, items, window=window) == want


def test_reading_alike(spark):
    item = "Сколько раз анкерный болт встречается между отметками и маркой повторена дважды возле оси"
    spoilt = ["СКОЛЬКО раз aнкepный болт,\nвстре-\nчается между отмет​ками и маркой — повторена дважды возле оси", "сколько\xa0раз анкерный болт встречается; между отметками и маркой повторена дважды возле"]
    docs = list(enumerate(spoilt)) + [(9, "сколько раз анкерный болт встречается между отметками и маркой повторена возле оси")]
    assert run(spark, docs, [(1, item), (2, item)]) == {(0, 1), (0, 2), (1, 1), (1, 2)}


def test_empty_sides(spark):
    assert run(spark, [], [(1, "a " * 20)]) == set() and run(spark, [(1, "a " * 20)], []) == set()
    assert run(spark, [(1, "a " * 20)], [(1, "a " * 20)]) == {(1, 1)}


def test_breaks_on_either_side_and_of_both_kinds(spark):
    plain = "сколько раз анкерный болт встречается между отметками и маркой северо западной дважды"
    broken = plain.replace("анкерный", "анкер-\nный")
    both = plain.replace("анкерный", "анкер-\nный").replace("северо западной", "северо-\nзападной")
    far = "раз-\nмер " + "и так " * 20 + both
    assert run(spark, [(1, plain), (2, broken), (3, both), (4, far)], [(1, plain), (2, broken), (3, both)]) == {(d, i) for d in (1, 2, 3, 4) for i in (1, 2, 3)}


def test_hot_passages_are_split_and_a_full_map_changes_nothing(spark, monkeypatch):
    import triscope.llm.leakage as leakage

    hot = " ".join(f"общее{i}" for i in range(14))
    items = [(i, hot + f" своё{i} " + " ".join(f"и{i}с{k}" for k in range(13))) for i in range(4)]
    docs = [(d, (hot if d % 3 == 0 else f"документ {d}") + " прочее " + (items[d % 4][1][-200:] if d % 5 == 0 else "")) for d in range(150)]
    want = brute(docs, items, 12)
    assert run(spark, docs, items) == run(spark, docs, items, part_places=5) == want and len(want) > 200
    monkeypatch.setattr(leakage, "shingle_map", lambda windows: __import__("numpy").full(1 << (leakage.MAP_BITS - 3), 255, "uint8"))
    assert run(spark, docs, items) == want
