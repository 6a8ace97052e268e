from triscope.plans.text_queries import q_character_errors


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_character_errors_against_brute_force(spark, tmp_path):
    rows = [(1, "NO", "планка", "палка"), (2, "NO", "100 м²", "100 м²"), (3, "YES", "", "да"), (4, None, "В22,5", None), (5, None, "кот", "ток"), (5, None, "кот", "ток")]
    kind = "check_id long, violation_label string, pd_value string, rd_value string, object_id string, received_at timestamp_ntz"
    spark.createDataFrame([(*r, "o", None) for r in rows], kind).coalesce(1).write.parquet(str(tmp_path / "checks.parquet"))
    got = {(r.overall, r.violation_label): (r.edits, r.chars, r.n_exact, r.n) for r in q_character_errors(spark, str(tmp_path)).collect()}
    want: dict = {}
    for _, label, a, b in dict.fromkeys(rows):
        for key in ((0, label), (1, None)) if b is not None else ():
            e, c, x, n = want.get(key, (0, 0, 0, 0))
            d = edits(a, b)
            want[key] = e + d, c + len(a), x + (d == 0), n + 1
    assert got == want
