import random

from pyspark.sql import functions as F

from triscope.operators.boxes import visible_nearest
from triscope.operators.compare import align, better_lost, evidence_met, old_kinds_new, over_limit, third_stage
from triscope.operators.extract import BETTER_PIPES, CABLE_ATTRIBUTES, OLD_LIGHTS, PIPES, extract, named
from triscope.operators.findings import compact, findings
from triscope.operators.matching import best_group, by_path, contiguous_portions, diff_lists, greedy_areas, once_printed, same_stems, seeded_sample, set_overlap, similar_sets, with_pieces


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_extraction(spark):
    text = "Фундаментная плита\nбетон В25, кроме В30\nтолщина 200 мм и 250 мм диаметр 12 мм\nдверь EI 60, 12,5 кВт\nпусто"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "id int, t string, rule string")
    got = {(r.line_no, r.rule, r.value, r.element, r.element_from) for r in extract(df, "id", "t").collect()}
    assert got == {(1, "concrete", "25", "фундамент", "context"), (2, "thickness", "200", None, None), (2, "thickness", "250", None, None), (3, "door", "60", None, None), (3, "power", "12,5", None, None)}


def test_named_kinds(spark):
    df = spark.createDataFrame([("ВВГнг(А)-FRLS 3х6",), ("чугун и ПП 20х4",), (None,)], "t string")
    assert [r[0] for r in df.select(named(F.col("t"), CABLE_ATTRIBUTES)).collect()] == [["нг(А)", "FR", "LS"], [], []]
    assert [r[0] for r in df.select(named(F.col("t"), PIPES)).collect()] == [[], ["чугун", "ПП"], []]


def test_set_rules(spark):
    df = spark.createDataFrame([(["чугун"], ["ПВХ"], False), (["чугун"], ["ПВХ"], True), (["чугун"], ["чугун"], False), (["ПП"], ["ПВХ"], False), ([], ["ПВХ"], False)], "p array<string>, r array<string>, x boolean")
    assert [r[0] for r in df.select(better_lost(F.col("p"), F.col("r"), BETTER_PIPES, "ПВХ", F.col("x"))).collect()] == ["V", "C", "N", "C", "C"]
    lights = spark.createDataFrame([(["LED"], ["люминесцентный"]), (["LED"], ["LED"]), (["LED"], ["LED", "накаливания"]), ([], ["LED"])], "p array<string>, r array<string>")
    assert [r[0] for r in lights.select(old_kinds_new(F.col("p"), F.col("r"), "LED", OLD_LIGHTS)).collect()] == ["V", "N", "C", "C"]


def test_limits_and_third_stage(spark):
    facts = spark.createDataFrame([(k, s, v) for k, p, r in (("over", 10, 30), ("under", 10, 20), ("no limit", 10, 30), ("bad limit", 10, 30)) for s, v in (("PD", p), ("RD", r))], "k string, s string, v int")
    limits = spark.createDataFrame([("over", 25), ("under", 25), ("no limit", None), ("bad limit", 5)], "k string, lim int")
    assert {r.k: r.label for r in align(facts, ["k"], "s", "v").join(limits, "k").select("k", over_limit(F.col("lim"))).collect()} == {"over": "V", "under": "N", "no limit": "C", "bad limit": "C"}
    three = spark.createDataFrame([("N", 5, 4, 2), ("N", 5, 4, 1), ("N", 5, 5, 3), ("V", 5, 9, 3), ("C", 5, None, 0)], "l string, r int, i int, n int")
    assert [r[0] for r in three.select(third_stage(F.col("l"), F.col("r"), F.col("i"), F.col("n"))).collect()] == ["V", "N", "N", "V", "C"]
    maps = spark.createDataFrame([({"PD": [1, 2]}, {"PD": [2]}), ({"PD": [1], "RD": [3]}, {"PD": [1]}), ({}, {})], "a map<string,array<int>>, b map<string,array<int>>")
    assert [r[0] for r in maps.select(evidence_met(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_paths(spark):
    registry = spark.createDataFrame([(1, "a/B.pdf"), (2, "a/c d.pdf"), (3, "A/x.pdf"), (4, None)], "id int, p string")
    members = spark.createDataFrame([("a/B.pdf",), ("a/cd.PDF",), ("a/x.pdf",), ("a/X.pdf",)], "p string")
    got = {r.id: (r.member, r.found) for r in by_path(registry, members, "p", F.lower(F.replace("p", F.lit(" "), F.lit("")))).collect()}
    assert got == {1: ("a/B.pdf", "exact"), 2: ("a/cd.PDF", "loose"), 3: (None, "none"), 4: (None, "none")}


def test_groups_and_overlap(spark):
    hits = spark.createDataFrame([("i", "b"), ("i", "a"), ("i", "a"), ("j", "z"), ("j", "y")], "i string, g string")
    assert rows(best_group(hits, "i", "g")) == [("i", "a", 2), ("j", "y", 1)]
    random.seed(8)
    a = {k: set(random.choices(range(25), k=random.randrange(9))) | {99} for k in range(30)}
    b = {k: set(random.choices(range(25), k=random.randrange(9))) | {99} for k in range(30)}
    df = lambda s: spark.createDataFrame([(k, m) for k, ms in s.items() for m in ms] * 2, "k int, m int")
    for least in (1, 3):
        want = {(x, y, len(a[x] & b[y])) for x in a for y in b if len(a[x] & b[y]) >= least}
        assert {(r.left, r.right, r.common) for r in set_overlap(df(a), df(b), "k", "m", least).collect()} == want


def test_greedy_takes_the_nearest_free(spark):
    a = spark.createDataFrame([("g", "a1", 10.0, 1), ("g", "a2", 10.1, 2), ("g", "a3", 50.0, 3), ("g", "a4", None, 4), ("h", "a5", 1.0, 5)], "g string, k string, area double, o int")
    b = spark.createDataFrame([("g", "b1", 10.1, 1), ("g", "b2", 9.9, 2), ("g", "b3", 60.0, 3)], "g string, k string, area double, o int")
    assert rows(greedy_areas(a, b, ["g"], "k", "area", "o")) == [("g", "a1", "b1"), ("g", "a2", "b2")]
    assert rows(greedy_areas(a.orderBy(F.desc("o")), b.orderBy(F.desc("o")), ["g"], "k", "area", "o")) == [("g", "a1", "b1"), ("g", "a2", "b2")]


def test_names(spark):
    df = spark.createDataFrame([("Учебный кабинет", "учебный кабинет (1"), ("Санузел", "Тамбур"), ("", "Тамбур"), (None, "x"), ("Комната отдыха персонала", "Комната персонала")], "a string, b string")
    assert [r[0] for r in df.select(same_stems(F.col("a"), F.col("b"))).collect()] == [True, False, True, True, True]


def test_overprint_and_portions_and_samples(spark):
    words = spark.createDataFrame([(1, i, t, x, 0.0) for i, (t, x) in enumerate([("A", 1.0), ("A", 2.0), ("A", 9.0), ("B", 1.0), ("A", 1.5)])], "p int, o int, t string, x0 double, y0 double")
    assert [r.o for r in once_printed(words, ["p"], "o", "t").orderBy("o").collect()] == [0, 2, 3]
    done = spark.createDataFrame([(i, i in (4, 5, 9)) for i in range(12)], "i int, d boolean")
    assert rows(contiguous_portions(done, "i", "d", 3)) == [(0, 2), (10, 11), (3, 3), (6, 8)]
    df = spark.createDataFrame([("g" if i % 3 else "h", i) for i in range(30)], "g string, i int")
    one, two = rows(seeded_sample(df, "g", "i", 4)), rows(seeded_sample(df.orderBy(F.desc("i")), "g", "i", 4))
    assert one == two and len(one) == 8 and one != rows(seeded_sample(df, "g", "i", 4, seed=1))


def test_visibility(spark):
    points = spark.createDataFrame([(1, "p", 0.0, 0.0), (1, "q", 100.0, 0.0), (2, "r", 0.0, 0.0)], "page int, k string, x double, y double")
    labels = spark.createDataFrame([(1, "near", 10.0, 0.0), (1, "far", 0.0, 50.0), (2, "only", 30.0, 0.0)], "page int, l string, x double, y double")
    walls = spark.createDataFrame([(1, 5.0, -5.0, 5.0, 5.0), (2, 5.0, -5.0, 5.0, 5.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    got = {r.key: (r.label, r.seen) for r in visible_nearest(points, labels, walls, ["page"], "k", "l", 90.0, 40.0).collect()}
    assert got == {"p": ("far", True), "q": ("near", True), "r": ("only", False)}


def test_findings(spark):
    files = spark.createDataFrame([("f1", "o1", "PD", "a.pdf", "x/a.pdf", 1, "s"), ("f2", "o1", "PD", "b.pdf", "x/c.pdf", 0, "s"), ("f3", "o2", "RD", "~$a.docx", "y/~$a.docx", 5, None), ("f4", None, "RD", "z", "z", 0, "s")], "fid string, oid string, stage string, original_name string, relative_path string, size_bytes long, sha256 string")
    staged = spark.createDataFrame([("o1", "KR", "PD"), ("o1", "AR", "PD"), ("o1", "AR", "RD"), ("o2", None, "RD")], "oid string, section string, s string")
    got = {(r.oid, r.type, r.detail, r.n) for r in findings(files, staged).collect()}
    assert got == {("o1", "EMPTY_OR_UNREADABLE", "PD", 1), ("o2", "TEMPORARY_ARTIFACT", "", 1), ("o1", "NAME_DIFFERS_FROM_PATH", "", 1), ("o1", "EXACT_DUPLICATES", "within", 2), ("o1", "STAGE_MISSING", "ID", 1), ("o2", "STAGE_MISSING", "PD", 1), ("o2", "STAGE_MISSING", "ID", 1), ("o1", "DISCIPLINE_MISSING_IN_RD", "KR", 1)}
    assert spark.range(1).select(compact(F.sequence(F.lit(1), F.lit(30)))).first()[0] == list(range(1, 21))
    assert len(spark.range(1).select(compact(F.sequence(F.lit(1), F.lit(30)), None)).first()[0]) == 30


def greedy(a, b, tolerance):
    free, out = sorted(b, key=lambda r: (r[2], r[0])), []
    for key, size, _ in sorted(a, key=lambda r: (r[2], r[0])):
        best = min(free, key=lambda r: abs(r[1] - size), default=None)
        if best and abs(best[1] - size) / size <= tolerance:
            out.append((key, best[0]))
            free.remove(best)
    return sorted(out)


def test_sizes_around_a_power_of_two_meet(spark):
    files = [("p1", "O", "PD", "s", 1000), ("r1", "O", "RD", "s", 1030), ("p2", "O", "PD", "s", 4100), ("r2", "O", "RD", "s", 4090)]
    a, b = ([(k, n, k) for k, _, stage, _, n in files if stage == s] for s in ("PD", "RD"))
    df = lambda rows: spark.createDataFrame([("O", *r) for r in rows], "g string, k string, size bigint, o string")
    assert rows(greedy_areas(df(a), df(b), ["g"], "k", "size", "o", tolerance=0.25)) == [("O", "p1", "r1"), ("O", "p2", "r2")]


def test_pieces_lose_no_pair(spark):
    random.seed(11)
    for tolerance in (0.03, 0.25, 1.5):
        sizes = lambda: random.choice([random.randrange(1, 40), 2 ** random.randrange(4, 40) + random.randrange(-9, 10), random.randrange(900, 1200), 75, 100, 125, 3 * 2**40])
        a, b = ({g: [(f"{p}{i}", sizes(), random.randrange(50)) for i in range(120)] for g in ("g", None)} for p in "ab")
        df = lambda s: spark.createDataFrame([(g, *r) for g, rs in s.items() for r in rs], "g string, k string, size bigint, o int")
        want = sorted(((g, *m) for g in a for m in greedy(a[g], b[g], tolerance)), key=repr)
        assert rows(greedy_areas(df(a), df(b), ["g"], "k", "size", "o", tolerance)) == want
        pieces = [r for r in with_pieces(df(a).unionByName(df(b)), ["g"], "size", tolerance).where("g = 'g'").collect()]
        assert len(pieces) == 240 and (len({r["__piece"] for r in pieces}) > 1) == (tolerance < 1)
        assert all(x["__piece"] == y["__piece"] for x in pieces for y in pieces if abs(x.size - y.size) <= tolerance * max(x.size, y.size))


def test_query_of_sizes_by_brute_force(spark, data):
    from triscope.plans.matching_queries import q_size_matches
    from triscope.plans.views import files_now

    sides: dict = {}
    for r in files_now(spark, data, "stage", "section", "size_bytes").where("oid is not null and section is not null and size_bytes > 0").collect():
        sides.setdefault((r.oid, r.section), {}).setdefault(r.stage, []).append((r.fid, r.size_bytes, r.fid))
    want = sorted(m for s in sides.values() for m in greedy(s.get("PD", []), s.get("RD", []), 0.25))
    assert sorted((r.left_key, r.right_key) for r in q_size_matches(spark, data).collect()) == want


def test_lists_that_should_agree(spark):
    """Keys first, then areas with names preferred, by brute force."""
    random.seed(11)
    lists = [[(g, random.choice(["1", "2", "3", None]), random.choice("xyz"), random.choice([10.0, 10.2, 10.4, 30.0, 31.0, 0.0, None]), i) for i, g in enumerate(random.choices("ab", k=25))] for _ in range(2)]
    lists[1] = [(g, k, n, a, 100 + i) for g, k, n, a, i in lists[1]]
    want = set()
    for g in "ab":
        left, right = ([r[1:] for r in x if r[0] == g] for x in lists)
        for x in list(left):
            y = next((y for y in right if x[0] is not None and y[0] == x[0]), None)
            if y:
                left.remove(x), right.remove(y)
                want.add((g, x[3], y[3], "key"))
        for x in list(left):
            near = [y for y in right if x[2] and y[2] and abs(y[2] - x[2]) <= 0.03 * max(x[2], y[2])]
            if near:
                y = min(near, key=lambda y: (y[1] != x[1], abs(y[2] - x[2]), y[3]))
                left.remove(x), right.remove(y)
                want.add((g, x[3], y[3], "area"))
        want |= {(g, x[3], None, "removed") for x in left} | {(g, None, y[3], "added") for y in right}
    kind = "g string, k string, name string, area double, i int"
    got = diff_lists(spark.createDataFrame(lists[0], kind), spark.createDataFrame(lists[1], kind), ["g"], "k", "name", "area", "i").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and {r.how for r in got} == {"key", "area", "removed", "added"}


def test_similar_sets(spark):
    random.seed(12)
    a = {k: set(random.choices(range(12), k=random.randrange(1, 7))) for k in range(25)}
    b = {k: set(random.choices(range(12), k=random.randrange(1, 7))) for k in range(25)}
    df = lambda s: spark.createDataFrame([(k, m) for k, ms in s.items() for m in ms] * 2, "k int, m int")
    for least, veto in ((0.5, None), (0.8, F.col("left") == F.col("right"))):
        want = set()
        for k, x in a.items():
            shares = {j: len(x & y) / min(len(x), len(y)) for j, y in b.items() if veto is None or j != k}
            want |= {(k, j, len(x & b[j])) for j, s in shares.items() if s >= least and s == max(shares.values())}
        assert {(r.left, r.right, r.common) for r in similar_sets(df(a), df(b), "k", "m", least, veto).collect()} == want and want
