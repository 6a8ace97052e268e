import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triscope.operators.graph import components
from triscope.operators.sequences import expand_ranges, fold_states, islands, line_context, line_continued, merge_intervals, quantile_by_rank, range_text, segments, trailing_count
from triscope.streaming.states import step


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_islands_and_their_text(spark):
    df = spark.createDataFrame([("k", x) for x in (17, 18, 20, 19, 19, 22, None)], "k string, v int")
    runs = islands(df, ["k"], "v")
    assert rows(runs) == [("k", 17, 20, 4), ("k", 22, 22, 1)]
    assert rows(range_text(runs, ["k"])) == [("k", "17-20,22")]
    texts = spark.createDataFrame([("17-20, 22",), ("x,3",), ("5-2",), ("",)], "t string")
    assert [r[0] for r in texts.select(expand_ranges(F.col("t"))).collect()] == [[17, 18, 19, 20, 22], [3], [], []]


def test_intervals_over_chunks(spark):
    random.seed(1)
    data = [(random.choice("ab"), x := random.uniform(0, 400), x + random.uniform(0, 6)) for _ in range(300)]
    want = []
    for k in "ab":
        now = None
        for _, s, e in sorted(d for d in data if d[0] == k):
            if now and s <= now[2] + 1:
                now[2], now[3] = max(now[2], e), now[3] + 1
            else:
                now = [k, s, e, 1]
                want.append(now)
    df = spark.createDataFrame(data + [("a", None, 1.0), ("a", 5.0, 1.0)], "k string, s double, e double")
    for chunk in (3.0, 50.0, 1e9):
        assert rows(merge_intervals(df, "k", "s", "e", 1.0, chunk)) == sorted(map(tuple, want), key=repr)


def test_trailing_count_over_chunks(spark):
    random.seed(2)
    data = [("u", random.randrange(0, 5000) * 1_000_000, i) for i in range(400)]
    df = spark.createDataFrame(data, "u string, at long, i int")
    want = {i: sum(t - 60_000_000 <= x <= t for _, x, _ in data) for _, t, i in data}
    for chunk in (60, 100, 10_000):
        assert {r.i: r.n_trailing for r in trailing_count(df, "u", "at", 60, chunk).collect()} == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6) | st.none(), max_size=40))
def test_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    there = sorted(v for v in values if v is not None)
    want = {q: there[min(len(there) - 1, int(q * len(there)))] for q in (0.0, 0.5, 0.9, 1.0)} if there else {}
    assert {r.share: r.value for r in quantile_by_rank(df, "v", [0.0, 0.5, 0.9, 1.0], bins=7, small=3).collect()} == want


def test_lines(spark):
    df = spark.createDataFrame([(1, "a:\nb\nc."), (2, None), (3, "")], "id int, t string")
    assert [r.context for r in line_context(df.where("id = 1"), "id", "t").orderBy("line_no").collect()] == ["a: | b", "b | a: | c.", "c. | b"]
    assert [r.joined for r in line_continued(df.where("id = 1"), "id", "t").orderBy("line_no").collect()] == ["a:", "b c.", "c."]
    assert rows(segments(df, "id", "t", lambda x: x == "b").select("id", "line", "segment")) == [(1, "a:", 0), (1, "b", 1), (1, "c.", 1), (3, "", 0)]


def test_fold_equals_the_steps(spark):
    random.seed(3)
    data = [(random.choice("abcdef"), i // 2, i, random.choice(["progress", "failed", "done", "failed"])) for i in range(60)]
    df = spark.createDataFrame(data, "p string, at int, i int, kind string")
    for retries in (0, 1, 2):
        want = {}
        for p, _, _, kind in data:
            want[p] = step(*want.get(p, ("PENDING", 0)), kind, retries)
        assert {r.p: r.state for r in fold_states(df, "p", "at", "i", "kind", retries).collect()} == {p: s for p, (s, _) in want.items()}


def test_components(spark):
    random.seed(4)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200), (None, 5)]
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for u, v in edges:
        if u is not None:
            a, b = find(u), find(v)
            of[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {x: find(x) for x in of}
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "u int, v int"), hub=3).collect()} == got  # nodes of more edges as hubs
    assert components(spark.createDataFrame([], "u int, v int")).collect() == []


def test_components_are_finished_or_refused(spark):
    chain = spark.range(60).selectExpr("id AS u", "id + 1 AS v")
    assert {r.component for r in components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(chain, rounds=1)
