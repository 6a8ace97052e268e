import json

from pyspark.sql import functions as F

from triscope.operators.nested import LIST_FIELDS, emit_tagged, links, read_rows, read_table, registry_object, source, tag_of, write_tables

ROOT = {"schema_version": "0.1", "revisions": [{"rev": 1, "reason": {"code": "C"}, "sheets": [{"code": "a"}, None, {"code": "b", "stamps": {"role": "x"}}]}, None], "pages": [1, 2], "archive": {"members": [{"name": "m", "members": {"name": "n"}}]}, "plain": {"a": {"b": 1}}}
PLACES = {("revisions", "", 0), ("revisions.sheets", "0", 0), ("revisions.sheets", "0", 2), ("revisions.sheets.stamps", "0.2", 0), ("archive.members", "", 0), ("archive.members.members", "0", 0)}


def emitted(spark, *texts, key="k", list_fields=LIST_FIELDS, root="schema_version"):
    df = spark.createDataFrame([(key, t, "clash") for t in texts], "key string, manifest string, list_path string")
    return emit_tagged(source(df, "files", F.col("key"), F.col("manifest")), {"files": root}, list_fields)


def places(spark, *texts):
    return emitted(spark, *texts).where("list_path <> ''").select("list_path", "parent_pos", "pos").collect()


def payloads(spark, record, **options):
    return {(r.list_path, r.parent_pos, r.pos): json.loads(r.payload) for r in emitted(spark, json.dumps({"schema_version": "1", **record}), **options).collect()}


def test_all_forms_give_the_same_places(spark):
    text = json.dumps(ROOT)
    for form in (text, "﻿" + text, json.dumps({"row": ROOT}), json.dumps({"source": {"batch": 1, "record": ROOT}}), json.dumps(text), json.dumps([ROOT])):
        assert set(map(tuple, places(spark, form))) == PLACES, form[:30]


def test_broken_null_and_empty_text_give_no_row(spark):
    assert emitted(spark, None, "", "[", json.dumps(ROOT)[:-5], "{}", "[]", '"[x"', json.dumps({"sheets": [{}]})).collect() == []


def test_no_rows(spark):
    assert emitted(spark).collect() == []


def test_deep_nesting_is_walked_without_recursion(spark, tmp_path):
    x: dict = {"name": "leaf"}
    for _ in range(300):
        x = {"members": [x]}
    tagged = emitted(spark, json.dumps({"schema_version": "1", **x}))
    write_tables(tagged, str(tmp_path / "t"))  # a folder's name can't hold 300 names
    assert read_rows(spark, str(tmp_path / "t")).count() == 301
    assert {(r.n_rows, r.n_linked) for r in links(read_rows(spark, str(tmp_path / "t"))).where("list_path <> ''").collect()} == {(1, 1)}
    plain = {"schema_version": "1"}
    for _ in range(600):
        plain = {"schema_version": "1", "x": plain}
    assert emitted(spark, json.dumps(plain)).count() == 1
    assert registry_object("[" * 100_000) is None


def test_repeated_rows_repeat_and_null_keys_stay(spark):
    rows = emitted(spark, json.dumps(ROOT), json.dumps(ROOT), key=None).collect()
    assert len(rows) == 2 * (len(PLACES) + 1) and rows[0].record_key is None
    assert len({r.row_key for r in rows}) == len(PLACES) + 1


def test_records_of_one_key_or_none_do_not_mix(spark, tmp_path):
    for key in ("k", None):
        a, b = ({"schema_version": "1", "sheets": [{"code": c, "stamps": [{"role": c}]}]} for c in "ab")
        path = str(tmp_path / f"t{key}")
        write_tables(emitted(spark, json.dumps(a), json.dumps(b), key=key), path)
        sheets = {r.row_key: r.code for r in read_table(spark, path, "files", "sheets", "code string").collect()}
        assert [sheets[r.parent_key] == r.role for r in read_table(spark, path, "files", "sheets.stamps", "role string").collect()] == [True, True]


def test_tables_keep_their_links(spark, tmp_path):
    write_tables(emitted(spark, json.dumps(ROOT), json.dumps(ROOT)), str(tmp_path / "t"))
    read = lambda p, s: read_table(spark, str(tmp_path / "t"), "files", p, s).collect()
    record = read("", "schema_version string, pages array<int>, plain struct<a struct<b int>>")
    assert [(r.schema_version, r.pages, r.plain_a_b, r.parent_key) for r in record] == [("0.1", [1, 2], 1, None)]
    revisions = read("revisions", "rev int, reason struct<code string>")
    assert [(r.rev, r.reason_code, r.parent_key) for r in revisions] == [(1, "C", record[0].row_key)]
    sheets = {r.row_key: r.code for r in read("revisions.sheets", "code string")}
    stamps = read("revisions.sheets.stamps", "role string")
    assert [sheets[r.parent_key] for r in stamps] == ["b"]
    assert read("no.such", "role string") == []


def test_odd_records_lose_no_row_link_or_field(spark, tmp_path):
    """Every scalar of the record is in one payload, and every row hangs on a row."""
    record = {"a": [[{"x": 1}, 5], [[{"y": [{"z": 2}]}]]], "mix": [1, {"a": 2}], "m": [[1, 2], [3]], "n": [[None, {"q": [7]}]], "o": {"p": {"s": [], "t": None}, "": 3}, "r": [None], "a.b": 4}
    got = payloads(spark, record)
    assert got == {
        ("", "", None): {"schema_version": "1", "a": [[None, 5], [[None]]], "mix": [1, None], "m": [[1, 2], [3]], "o": {"p": {"s": [], "t": None}, "": 3}, "r": [None], "a.b": 4},
        ("a", "0", 0): {"x": 1},
        ("a", "1.0", 0): {},
        ("a.y", "1.0.0", 0): {"z": 2},
        ("mix", "", 1): {"a": 2},
        ("n", "0", 1): {"q": [7]},
    }
    write_tables(emitted(spark, json.dumps({"schema_version": "1", **record})), str(tmp_path / "t"))
    assert all(r.n_linked == (r.n_rows if r.list_path else 0) for r in links(read_rows(spark, str(tmp_path / "t"))).collect())


def test_list_fields_are_the_callers(spark):
    record = {"sheets": {"code": 1}, "stamps": {"role": 2}}
    assert payloads(spark, record, list_fields=("stamps",)) == {("", "", None): {"schema_version": "1", "sheets": {"code": 1}}, ("stamps", "", 0): {"role": 2}}
    assert len(payloads(spark, record)) == 3


def test_half_surrogates_and_odd_names(spark, tmp_path):
    text = '{"schema_version": "\\ud800", "a/b=\\udfff": [{"v": "\\udc00"}]}'
    write_tables(emitted(spark, text), str(tmp_path / "t"))
    assert read_rows(spark, str(tmp_path / "t")).count() == 2
    assert tag_of("files", "x" * 200) != tag_of("files", "x" * 201)


def test_typed_columns(spark):
    kind = "id bigint, evidence array<struct<file:string,parts:array<struct<n:int>>,box:array<double>>>, pos string"
    df = spark.createDataFrame([(1, [("a", [(1,), None, (3,)], [1.0]), None, ("b", None, None)], "x"), (2, None, None), (3, [], None)], kind)
    rows = emit_tagged(source(df, "c", F.col("id"), F.struct("evidence")), {"c": None}).collect()
    got = {(r.record_key, r.list_path, r.parent_pos, r.pos): json.loads(r.payload) for r in rows if r.list_path}
    assert got == {("1", "evidence", "", 0): {"file": "a", "box": [1.0]}, ("1", "evidence", "", 2): {"file": "b", "parts": None, "box": None}, ("1", "evidence.parts", "0", 0): {"n": 1}, ("1", "evidence.parts", "0", 2): {"n": 3}}
