from pyspark.sql import functions as F

from triscope.operators.records import carried, content_hash, current, duplicates, first_of_content, multiset_difference, newest_revision, overlay, revision_conflicts


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_current_takes_the_last_row(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("a", None, "n"), (None, 9, "q")], "k string, t int, v string")
    assert rows(current(df, F.col("k"), [F.col("t")])) == [("a", "a", 3, "z")]


def test_revisions(spark):
    df = spark.createDataFrame([("g", 1, "f1", "s1"), ("g", 2, "f2", "s2"), ("g", 2, "f3", "s3"), ("h", 0, "f4", "s4"), ("h", 0, "f5", "s4")], "g string, rev int, fid string, sha string")
    assert rows(newest_revision(df, ["g"], [F.col("rev"), F.col("fid")], "fid")) == [("g", "f3", 3), ("h", "f5", 2)]
    assert rows(revision_conflicts(df, ["g"], "rev", "sha")) == [("g", 2, 2, 2)]


def test_duplicates(spark):
    df = spark.createDataFrame([("s1", "o1", "PD"), ("s1", "o2", "PD"), ("s2", "o1", "PD"), ("s2", "o1", "RD"), ("s3", "o1", "PD"), ("s3", "o1", "PD"), ("s4", "o1", "PD"), (None, "o1", "PD"), (None, "o1", "PD")], "sha string, objects string, stages string")
    assert {r.sha: r.kind for r in duplicates(df, "sha", "objects", "stages").collect()} == {"s1": "across_objects", "s2": "across_stages", "s3": "within"}


def test_first_of_content_matches_null_groups(spark):
    df = spark.createDataFrame([(None, "s", 1), (None, "s", 2), ("o", "s", 3)], "o string, sha string, id int")
    assert rows(first_of_content(df, ["o", "sha"], [F.col("id")], "id").select("id", "accepted")) == [(1, True), (2, False), (3, True)]


def test_hash_depends_on_order_of_keys_only(spark):
    data = [("o", "PD", f"F{i:06d}", f"s{i}") for i in range(30)]
    make = lambda d: rows(content_hash(spark.createDataFrame(d, "o string, stage string, id string, sha string"), "o", ["stage", "id"], F.concat_ws(":", "id", "sha"), F.substring("id", 1, 6)))
    assert make(data) == make(data[::-1]) != make(data[1:])


def test_overlay_twice_is_once(spark):
    base = spark.createDataFrame([("A", "1", True, "old"), ("A", "2", True, "bare"), ("A", "3", False, "kept"), ("B", "1", True, "other"), ("B", None, False, "nowhere")], "code string, place string, bare boolean, v string")
    new = spark.createDataFrame([("A", "1", False, "new"), ("B", None, False, "placed")], "code string, place string, bare boolean, v string")
    once = overlay(base, new, "code", "place", F.col("bare"))
    assert {r.v for r in once.collect()} == {"new", "kept", "placed"}
    assert rows(overlay(once, new, "code", "place", F.col("bare"))) == rows(once)


def test_carried_compares_nulls(spark):
    df = spark.createDataFrame([("k", 1, None, "a"), ("k", 2, None, "a"), ("k", 3, "V", "a"), ("k", 4, "V", None)], "k string, t int, label string, v string")
    assert [r.outcome for r in carried(df, ["k"], ["t"], ["label", "v"]).orderBy("t").collect()] == ["first", "carried", "reset", "reset"]


def test_multisets(spark):
    make = lambda s: spark.createDataFrame([("g", x) for x in s], "g string, v string")
    assert rows(multiset_difference(make("aab"), make("abbc"), ["g"], "v")) == [("g", "a", 1, 1, 0), ("g", "b", 1, 0, 1), ("g", "c", 0, 0, 1)]
