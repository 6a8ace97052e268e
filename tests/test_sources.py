import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from triscope.sources import readers, sinks


def test_json_lines_and_registries(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "x"}\n\n{"id": 2}\n{"id": 3, "v": ', "utf-8")
    assert [tuple(r) for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), "id int, v string").orderBy("id").collect()] == [(1, "x"), (2, None)]
    assert readers.json_lines(spark, str(tmp_path / "a.jsonl"), "id int, v string", keep_broken=True).count() == 3
    (tmp_path / "b.json").write_text('[\n{"id": 1},\n{"id": 2}\n]', "utf-8")
    assert readers.whole_json(spark, str(tmp_path / "b.json"), "id int").count() == 2
    for n in "cd":
        (tmp_path / f"{n}.csv").write_text("code;path\nK1;а/б.pdf\n", "utf-8")
    assert readers.registry_csv(spark, [str(tmp_path / "c.csv"), str(tmp_path / "d.csv")], "code string, path string").select("registry").distinct().count() == 2


def test_binary_files_and_archives(spark, tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    old = io.BytesIO()
    with zipfile.ZipFile(old, "w") as z:
        z.writestr("план.pdf".encode("cp866").decode("cp437"), b"12345")
        z.writestr("dir/", b"")
    raw = old.getvalue()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        flagged = bool(z.infolist()[0].flag_bits & 0x800)
    (d / "a.zip").write_bytes(raw)
    (d / "b.zip").write_bytes(b"PK broken")
    (d / "c.pdf").write_bytes(b"%PDF-1.4 text %%EOF\n")
    (d / "e.xml").write_bytes(b"\xef\xbb\xbf <a/>")
    (d / "f.txt").write_bytes(b"")
    files = readers.binary_files(spark, str(d))
    kinds = {r.path.rsplit("/", 1)[-1]: (r.kind, r.sha256) for r in readers.digests(files).collect()}
    assert {k: v[0] for k, v in kinds.items()} == {"a.zip": "zip", "b.zip": "unknown", "c.pdf": "pdf", "e.xml": "xml"}
    assert kinds["a.zip"][1] == hashlib.sha256(raw).hexdigest()
    members = readers.archive_members(files.where("path like '%.zip'")).collect()
    assert {(r.path.rsplit("/", 1)[-1], r.readable) for r in members} == {("a.zip", True), ("b.zip", False)}
    name = next(r.member for r in members if r.readable)
    assert name == ("план.pdf".encode("cp866").decode("cp437") if flagged else "план.pdf")


def test_compare_and_take_new(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "member string, size bigint")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("w", 1), ("z", None)], "member string, size bigint")
    assert {r.member: r.state for r in readers.compare_members(a, b).collect()} == {"x": "ok", "y": "size", "w": "extra", "z": "ok"}
    assert [tuple(r) for r in readers.new_rows(a, b.unionByName(spark.createDataFrame([("w", 5)], b.schema)), ["member"], [F.col("size")]).collect()] == [("w", 5)]


def test_versions_and_reports(spark, tmp_path):
    p = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, p)
    one = spark.createDataFrame([("o1", 1), ("o2", 2)], "object_id string, x int")
    assert sinks.write_version(one, p) == 1
    (tmp_path / "v" / "v=2").mkdir()  # a broken write
    assert sinks.write_version(one.limit(1), p) == 3 and sinks.versions(spark, p) == [1, 3]
    assert sinks.read_version(spark, p).count() == 1 and sinks.read_version(spark, p, 1).count() == 2
    sinks.by_object(one, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).where("object_id = 'o2'").count() == 1
    sinks.report(one, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text("utf-8").count("object_id") == 2


def test_archives_that_are_not_supported_are_not_broken(spark):
    contents = {"a.7z": b"7z\xbc\xaf\x27\x1c\x00\x04", "b.rar": b"Rar!\x1a\x07\x01\x00", "c.zip": b"PK broken", "d.zip": b"", "e.zip": None}
    files = spark.createDataFrame([(k, v) for k, v in contents.items()], "path string, content binary")
    assert {r.path: (r.member, r.readable) for r in readers.archive_members(files).collect()} == {"a.7z": (None, None), "b.rar": (None, None), "c.zip": (None, False), "d.zip": (None, False), "e.zip": (None, False)}


def test_large_objects_are_written_in_several_files(spark, tmp_path):
    from triscope.sources.sinks import by_object

    df = spark.range(1000).selectExpr("CASE WHEN id % 3 > 0 THEN 'hot' WHEN id % 2 = 0 THEN 'a b' END AS object_id", "id")
    by_object(df, str(tmp_path / "o"), rows_per_file=100)
    files = lambda name: list((tmp_path / "o" / f"object_id={name}").glob("*.parquet"))
    assert 4 <= len(files("hot")) <= 12 and 1 <= len(files("a b")) <= 3
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1000
