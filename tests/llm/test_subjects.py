import random
import textwrap

from triscope.llm.subjects import LONGEST, OTHER, _summed, assign_subjects, passages, stem, term_table, unwrapped, windows

TERMS = {
    "KR": ["ростверк", "арматурный каркас", "анкерный болт", "свайное поле", "закладная деталь"],
    "AR": ["витраж фасада", "дверной блок", "подвесной потолок", "парапет", "отделка пола"],
    "OV": ["калорифер", "фанкойл", "тёплый пол", "тепловой узел", "шумоглушитель"],
    OTHER: ["сопроводительное письмо", "опись вложений", "входящий номер", "подтверждение получения", "группа выпуска"],
}
TITLES = [("KR", "Конструкции", "Structures"), ("AR", "Архитектура", "Architecture"), ("OV", "Отопление", "Heating"), (OTHER, "Прочее", "Other")]
FRAMES = ["Для {} принято значение {}.", "На отметке {1} указан {0}.", "Согласно тому {1}, {0} имеет показатель.", "Учтено {1} позиций: {0}.", "По узлу {0} снято замечание {1}."]


def passage(subject, n=5, mention=None):
    said = [random.choice(FRAMES).format(random.choice(TERMS[subject]), random.randrange(900)) for _ in range(n)]
    if mention:
        said[0] = said[0][:-1] + f", без учёта {random.choice(TERMS[mention])}."
    return " ".join(said)


def corpus(n=400):
    random.seed(7)
    docs, truth = [], {}
    for d in range(n):
        of = random.sample(["KR", "AR", "OV"], random.choice([1, 1, 2])) if d % 8 else [OTHER]
        other = random.choice([s for s in ("KR", "AR", "OV") if s not in of] or ["KR"])
        docs.append((d, "Заголовок\n" + "\n".join(passage(s, mention=None if s == OTHER else other) for s in of), 1))
        truth[d] = set(of)
    labels = [(d, random.choice(sorted(truth[d]))) for d in range(0, n, 5)]
    labels += [(0, "KR"), (0, "KR"), (99999, "KR"), (1, "UNKNOWN"), (None, "KR"), (2, None)]  # wrong, repeated and strange ones
    return docs, truth, labels


def run(spark, docs, labels, subjects=TITLES):
    d = spark.createDataFrame(docs, "doc_id long, text string, subject_code int")
    s = spark.createDataFrame(subjects, "subject_code string, title_ru string, title_en string")
    got: dict[int, set] = {}
    for r in assign_subjects(d, s, spark.createDataFrame(labels, "doc_id long, subject_code string")).collect():
        got.setdefault(r.doc_id, set()).add(r.subject_code)
    return got


def test_held_out_accuracy(spark):
    docs, truth, labels = corpus()
    got = run(spark, docs + docs[:3], labels)
    unlabelled = [d for d in truth if d % 5]
    assert sum(got[d] == truth[d] for d in unlabelled) / len(unlabelled) >= 0.95


def test_odd_texts(spark):
    docs, truth, labels = corpus(120)
    odd = [(1000, None, 1), (1001, "", 1), (1002, " \n\t ", 1), (1003, "12 34", 1), (1004, passage("KR", 1), 1), (1005, passage("KR", 3000), 1), (1006, passage("KR", 20) + " " + passage("OV", 20), 1)]
    got = run(spark, docs + odd, labels)
    assert not {1000, 1001, 1002} & set(got)
    assert got[1003] == got[1004] == {OTHER} and got[1005] == {"KR"} and got[1006] == {"KR", "OV"}


def test_no_labels_no_documents_no_subjects(spark):
    docs, _, labels = corpus(40)
    assert set(run(spark, docs, [])) == {d for d, _, _ in docs}
    assert run(spark, [], labels) == {}
    assert set(run(spark, docs, labels, subjects=[])) == {d for d, _, _ in docs}


def test_long_lines_are_cut_into_whole_windows():
    text = " ".join(f"Предложение {i}." for i in range(50))
    parts = list(passages(text))
    assert "".join(p for _, p in parts) == text and sum(n for n, _ in parts) == 50 and all(LONGEST // 2 <= n <= LONGEST for n, _ in parts)
    assert list(passages("")) == [] and [n for n, _ in passages("один\nдва. три.")] == [0, 2]


def test_held_out_labels_of_the_test_tables(spark):
    """Labels of one half of the labelled documents are among the subjects found with the other half's labels; a few are wrong."""
    d = "/root/testdata/sf0.01"
    read = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    labels = read("subject_labels")
    found = assign_subjects(read("documents"), read("subjects"), labels.where("doc_id % 2 = 0"))
    held = labels.where("doc_id % 2 = 1").select("doc_id", "subject_code").distinct()
    assert held.join(found, ["doc_id", "subject_code"]).count() / held.count() >= 0.85


def test_wrapped_passages_and_passages_within_a_line(spark):
    docs, truth, labels = corpus()
    wrap = lambda t: "\n".join(textwrap.wrap(t, 40))
    odd = [(2000, wrap(passage("KR", 8)), 1), (2001, wrap(passage("KR", 6)) + "\n\n" + wrap(passage("OV", 6)), 1), (2002, passage("KR", 5) + " " + passage("OV", 5), 1), (2003, passage("AR", 5) + " " + passage("OV", 4) + " " + passage("AR", 5), 1), (2004, passage("KR", 13), 1)]
    got = run(spark, docs + odd, labels)
    assert [got[i] for i, *_ in odd] == [{"KR"}, {"KR", "OV"}, {"KR", "OV"}, {"AR", "OV"}, {"KR"}]


def test_unwrapping_and_windows():
    assert unwrapped("a b\nc d.\ne f\n\ng\r\nпере-\nнос; ") == "a b c d. e f\ng перенос; " and unwrapped("") == ""
    assert unwrapped("a. b. c.\nd. e. f.\ng.") == "a. b. c.\nd. e. f.\ng." and unwrapped("Заголовок\na. b. c.\nd.") == "Заголовок a. b. c.\nd."
    text = " ".join(f"Предложение {i}." for i in range(9))
    parts = list(windows(text))
    assert list(windows("Раз. Два. Три. Четыре. Пять.")) == [] and all(any(" ".join(f"Предложение {j}." for j in range(i, i + 4)) in p for p in parts) for i in range(6))


def test_sums_of_many_tasks_are_added_as_a_tree(spark):
    """Ten thousand pieces, five at a time: no task holds them all."""
    import numpy as np

    rows = [(slot, part, np.array([part, slot, 1.0]).tobytes()) for slot in (0, 1) for part in range(10_000)]
    total = _summed(spark.createDataFrame(rows, "slot int, part int, data binary"), 10_000, fan=500)
    assert total.tolist() == [sum(range(10_000)), 0, 10_000, sum(range(10_000)), 10_000, 10_000]
    assert len(_summed(spark.createDataFrame([], "slot int, part int, data binary"), 1)) == 0


def test_inflected_forms_meet_and_other_words_do_not():
    from triscope.llm.words import table

    fold = lambda w: stem(w.translate(table()))
    for forms in ("фундамент фундамента фундаментами фундаментов", "вентиляция вентиляции вентиляцию", "кабельный кабельная кабельные кабельного", "прокладывается прокладывают", "heating heated heats", "pipe pipes"):
        assert len({fold(w) for w in forms.split()}) == 1, forms
    assert len({fold(w) for w in "фундамент фунт фонтан вентиль вентиляция электрод электрощит".split()}) == 7


def test_a_term_counts_as_often_as_it_stands(spark):
    rows = term_table(spark.createDataFrame([(1, "кабель " * 1000 + "проложен.")], "doc_id long, text string")).collect()
    assert max(max(r.counts) for r in rows) == 1000
