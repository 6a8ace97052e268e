from datetime import datetime, timedelta

from pyspark.sql import functions as F

from triscope.operators.references import orphans, parents, references, with_period

T = datetime(2024, 5, 1)
OBJECTS = [("a", T, None), (" A ", T + timedelta(1), None), ("b", T, T + timedelta(2)), ("c", T + timedelta(9), None), (None, T, None), ("d", None, None)]


def run(spark, refs, objects=OBJECTS, **sizes):
    o = spark.createDataFrame(objects, "k string, made timestamp, gone timestamp")
    r = spark.createDataFrame(refs, "id string, k string, at timestamp, block int, lo string")
    found = orphans(references(r, "t", F.col("id"), F.col("k"), F.col("at")), parents(o, F.col("k"), F.col("made"), F.col("gone")), **sizes)
    return {(x.ref_key, x.missing_key, x.reason, x.period) for x in with_period(found).collect()}


def brute(refs):
    made, gone = {"A": T, "B": T, "C": T + timedelta(9)}, {"B": T + timedelta(2)}
    out = set()
    for i, k, at, *_ in refs:
        k = (k or "").strip().upper()
        if k and (i or "").strip():
            why = "missing" if k not in ("A", "B", "C", "D") else "later" if k in made and at and made[k] > at else "deleted" if k in gone and at and gone[k] <= at else None
            if why:
                out.add((i.strip().upper(), k, why, at and f"{at:%Y-%m}"))
    return out


REFS = [(str(i), k, at, 0, "x") for i, (k, at) in enumerate([(k, at) for k in ("a", "A", "b ", "c", "d", "x", None, " ", "zz", "") for at in (T - timedelta(5), T, T + timedelta(2), T + timedelta(20), None)])]


def test_against_brute_force(spark):
    for sizes in ({}, {"block_keys": 1, "group_refs": 2}):
        assert run(spark, REFS + REFS[:3], **sizes) == brute(REFS)


def test_empty_sides(spark):
    assert run(spark, []) == set()
    assert {r[2] for r in run(spark, REFS, objects=[])} == {"missing"}


def test_hot_key_is_spread(spark):
    hot = [(str(i), "zzz", T, 0, "x") for i in range(3000)]
    assert len(run(spark, hot, block_keys=2, group_refs=100)) == 3000
