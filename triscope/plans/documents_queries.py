"""Queries over the registry of files: selection, revisions, duplicates, completeness, hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triscope.functions.keys import clean_key
from triscope.functions.text import SECTION_MARKS, cipher, path_date, revision_number, section_of
from triscope.operators.graph import components
from triscope.operators.records import content_hash, duplicates, first_of_content, multiset_difference, newest_revision, revision_conflicts
from triscope.plans.tables_sql import FILES_NOW
from triscope.plans.views import files_now
from triscope.sources.scratch import written
from triscope.sources.tables import table



def _stages(c: str):
    """A mixed stage counts as both of its parts."""
    return F.explode(F.when(F.col(c) == "RD_ID_MIXED", F.array(F.lit("RD"), F.lit("ID"))).otherwise(F.array(F.col(c))))


_SQL_STAGES = "unnest(CASE WHEN stage = 'RD_ID_MIXED' THEN ['RD', 'ID'] ELSE [stage] END)"
_SQL_SECTION = "CASE " + " ".join(f"WHEN regexp_matches(upper(original_name), '(^|[^А-ЯA-Z])({m})[0-9.]*([^А-ЯA-Z]|$)') THEN '{s}'" for s, m in SECTION_MARKS) + " ELSE 'OTHER' END"
_SQL_STEM = r"regexp_replace(regexp_replace(lower(original_name), '\.[^.]*$', ''), '\s*\([0-9]+\)\s*$', '')"
_SQL_CIPHER = rf"regexp_replace(regexp_replace({_SQL_STEM}, '[\s._()\[-]*(?:изм|кор+|ред)[\s._-]*([0-9]+)', '', 'g'), '[^0-9a-zа-яё]', '', 'g')"
_SQL_REVISION = rf"coalesce(try_cast(regexp_extract({_SQL_STEM}, '[\s._()\[-]*(?:изм|кор+|ред)[\s._-]*([0-9]+)', 1) AS BIGINT), 0)"
_SQL_DATE = r"coalesce(list_max(list_transform(regexp_extract_all(relative_path, '([0-3][0-9]\.[01][0-9]\.20[0-9]{2})', 1), lambda x: CAST(strftime(try_strptime(x, '%d.%m.%Y'), '%Y%m%d') AS INT))), 0)"


def q_files_current(spark: SparkSession, d: str) -> DataFrame:
    """The last received row of each file."""
    return files_now(spark, d, "stage", "section", "sha256").select("fid", "oid", "stage", "section", "sha256", "received_at")


def q_file_selection(spark: SparkSession, d: str) -> DataFrame:
    """Structural PDF files by section or name, one row per stage they count for."""
    f = files_now(spark, d, "stage", "section", "extension", "original_name").where((F.lower("extension") == ".pdf") & (F.col("section").isin("KR", "AR") | F.col("original_name").rlike("КР|КЖ|АР")))
    return f.select("fid", "oid", _stages("stage").alias("stage_counted"), "section")


def q_section_guess(spark: SparkSession, d: str) -> DataFrame:
    """The section that file names speak of, against the one registered."""
    f = files_now(spark, d, "section", "original_name").where("original_name is not null")
    return f.groupBy("section", section_of(F.col("original_name")).alias("guessed")).agg(F.count("*").alias("n_files"))


def q_stage_presence(spark: SparkSession, d: str) -> DataFrame:
    """The stages that each object has files for."""
    f = files_now(spark, d, "stage").where("oid is not null").select("oid", _stages("stage").alias("s"))
    return f.groupBy("oid").agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("stages"), F.countDistinct("s").alias("n_stages"))


def _revisions(spark: SparkSession, d: str) -> DataFrame:
    f = files_now(spark, d, "stage", "original_name", "relative_path", "sha256", "uploaded_at").where("original_name is not null and oid is not null")
    return f.select("fid", "oid", "stage", "sha256", "uploaded_at", cipher(F.col("original_name")).alias("cipher"), revision_number(F.col("original_name")).alias("revision"), F.coalesce(path_date(F.col("relative_path")), F.lit(0)).alias("dated"))


def q_revision_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest revision of each cipher of a stage; as-built files have no revisions and are all kept."""
    f = _revisions(spark, d).withColumn("own", F.when(F.col("stage") == "ID", F.col("fid")))
    order = [F.col(c) for c in ("revision", "dated", "uploaded_at", "fid")]
    return newest_revision(f.where("stage is not null"), ["oid", "stage", "cipher", "own"], order, "fid").drop("own")


def q_revision_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Ciphers whose highest revision stands on files of different content."""
    return revision_conflicts(_revisions(spark, d).where("stage <> 'ID'"), ["oid", "stage", "cipher"], "revision", "sha256")


def q_path_rank(spark: SparkSession, d: str) -> DataFrame:
    """Per object and section the freshest file by revision number and date in its path."""
    f = files_now(spark, d, "section", "original_name", "relative_path").where("relative_path is not null and original_name is not null and oid is not null and section is not null")
    rank = F.struct(revision_number(F.col("original_name")).alias("revision"), path_date(F.col("relative_path")).alias("dated"), F.col("fid"))
    return f.groupBy("oid", "section").agg(F.max(rank).alias("m")).select("oid", "section", "m.revision", "m.dated", "m.fid")


def q_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Equal contents under several file ids: across objects, across stages of one, or within a stage."""
    f = files_now(spark, d, "stage", "sha256").withColumnsRenamed({"oid": "objects", "stage": "stages"})
    return duplicates(f, "sha256", "objects", "stages").select("sha256", "n_rows", "n_wide", "n_narrow", "kind")


def q_missing_discipline(spark: SparkSession, d: str) -> DataFrame:
    """Sections that an object has design files for but no working ones."""
    f = files_now(spark, d, "stage", "section").where("oid is not null and section is not null and section <> 'OTHER'").select("oid", "section", _stages("stage").alias("s"))
    return f.where("s = 'PD'").select("oid", "section").distinct().join(f.where("s = 'RD'").select("oid", "section").distinct(), ["oid", "section"], "left_anti")


def q_section_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sections of design and working stage as sets: lost, kept and added."""
    f = files_now(spark, d, "stage", "section").where("oid is not null and section is not null").select("oid", "section", _stages("stage").alias("s"))
    of = lambda s: F.array_sort(F.collect_set(F.when(F.col("s") == s, F.col("section"))))
    sets = f.groupBy("oid").agg(of("PD").alias("p"), of("RD").alias("r"))
    return sets.select("oid", *(F.array_join(e, ",").alias(n) for n, e in (("lost", F.array_except("p", "r")), ("kept", F.array_intersect("p", "r")), ("added", F.array_except("r", "p")))))


def q_snapshot_hash(spark: SparkSession, d: str) -> DataFrame:
    """A hash of each object's files in order of stage and id."""
    f = files_now(spark, d, "stage", "sha256").where("oid is not null")
    line = F.concat_ws(":", "fid", F.coalesce("sha256", F.lit("")))
    return content_hash(f, "oid", ["stage", "fid"], line, F.concat_ws("/", "stage", F.substring("fid", 1, 6)))


def q_upload_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Uploads accepted, and refused as repeats of a content that the object has already."""
    f = files_now(spark, d, "source", "sha256", "uploaded_at").where("source = 'upload' and sha256 is not null")
    rows = first_of_content(f.select("oid", "sha256", "uploaded_at", "fid"), ["oid", "sha256"], [F.col("uploaded_at"), F.col("fid")], "fid")
    return rows.groupBy("oid").agg(F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_repeated"))


def q_registry_check(spark: SparkSession, d: str) -> DataFrame:
    """The registry's size of each file against the file's own."""
    f = files_now(spark, d, "size_bytes", "manifest_row").where("manifest_row is not null")
    v = F.try_parse_json("manifest_row")
    size = F.try_variant_get(v, "$.size_bytes", "bigint")
    outcome = F.when(v.isNull(), "unreadable").when(size.isNull(), "absent").when(F.col("size_bytes").isNull(), "missing").when(size == F.col("size_bytes"), "ok").otherwise("differs")
    return f.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n_files"))


def q_name_multiset(spark: SparkSession, d: str) -> DataFrame:
    """Ciphers of design and working files of an object, matched one to one: how many are common, lost and added."""
    f = _revisions(spark, d).where("cipher <> ''")
    diff = multiset_difference(f.where("stage = 'PD'"), f.where("stage = 'RD'"), ["oid"], "cipher")
    return diff.groupBy("oid").agg(*(F.sum(c).alias(c) for c in ("common", "lost", "added")))


def q_file_families(spark: SparkSession, d: str) -> DataFrame:
    """Files connected by equal content or, within an object, by equal name: each family of two or more."""
    f = written(files_now(spark, d, "sha256", "original_name").select("fid", "oid", "sha256", "original_name"), "files")
    by_sha = f.where("sha256 is not null").groupBy("sha256").agg(F.min("fid").alias("v"))
    by_name = f.where("original_name is not null and oid is not null").groupBy("oid", "original_name").agg(F.min("fid").alias("v"))
    edges = f.join(by_sha, "sha256").select(F.col("fid").alias("u"), "v").unionByName(f.join(by_name, ["oid", "original_name"]).select(F.col("fid").alias("u"), "v"))
    families = components(edges)
    return families.groupBy("component").agg(F.count("*").alias("n_files")).where("n_files > 1")


def q_registry_fields(spark: SparkSession, d: str) -> DataFrame:
    """Registry rows read with a fixed schema, broken ones as such: how many by corpus and split."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("schema_version", "corpus", "split")])
    f = table(spark, d, "files", "file_id", "manifest_row").select(clean_key(F.col("file_id")).alias("fid"), "manifest_row").distinct().where("manifest_row is not null")
    readable = F.try_parse_json("manifest_row").isNotNull()
    r = F.when(readable, F.from_json("manifest_row", schema))
    return f.groupBy(readable.alias("readable"), r["corpus"].alias("corpus"), r["split"].alias("split")).agg(F.count("*").alias("n_rows"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("q_")}


_REV = f"""WITH {FILES_NOW}, r AS (SELECT fid, oid, stage, sha256, uploaded_at, {_SQL_CIPHER} AS cipher, {_SQL_REVISION} AS revision, coalesce({_SQL_DATE}, 0) AS dated FROM f WHERE original_name IS NOT NULL AND oid IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    f = f"WITH {FILES_NOW}"
    staged = f"{f}, s AS (SELECT oid, section, {_SQL_STAGES} AS s FROM f WHERE oid IS NOT NULL AND section IS NOT NULL"
    return {
        "q_files_current": f + " SELECT fid, oid, stage, section, sha256, received_at FROM f",
        "q_file_selection": f + f" SELECT fid, oid, {_SQL_STAGES} AS stage_counted, section FROM f WHERE lower(extension) = '.pdf' AND (section IN ('KR', 'AR') OR regexp_matches(original_name, 'КР|КЖ|АР'))",
        "q_section_guess": f + f" SELECT section, {_SQL_SECTION} AS guessed, count(*) AS n_files FROM f WHERE original_name IS NOT NULL GROUP BY ALL",
        "q_stage_presence": f + f", s AS (SELECT oid, {_SQL_STAGES} AS s FROM f WHERE oid IS NOT NULL) SELECT oid, string_agg(DISTINCT s, ',' ORDER BY s) AS stages, count(DISTINCT s) AS n_stages FROM s GROUP BY oid",
        "q_revision_latest": _REV + " SELECT oid, stage, cipher, fid, n_rows FROM (SELECT *, count(*) OVER (PARTITION BY oid, stage, cipher) AS n_rows, row_number() OVER (PARTITION BY oid, stage, cipher ORDER BY revision DESC, dated DESC, uploaded_at DESC NULLS LAST, fid DESC) AS k FROM r WHERE stage <> 'ID') WHERE k = 1 UNION ALL SELECT oid, stage, cipher, fid, 1 FROM r WHERE stage = 'ID'",
        "q_revision_conflict": _REV + ", t AS (SELECT *, max(revision) OVER (PARTITION BY oid, stage, cipher) AS top FROM r WHERE stage <> 'ID') SELECT oid, stage, cipher, revision, count(*) AS n_rows, count(DISTINCT sha256) AS n_contents FROM t WHERE revision = top GROUP BY oid, stage, cipher, revision HAVING count(*) > 1 AND count(DISTINCT sha256) > 1",
        "q_path_rank": f + f", r AS (SELECT oid, section, {_SQL_REVISION} AS revision, {_SQL_DATE} AS dated, fid FROM f WHERE relative_path IS NOT NULL AND original_name IS NOT NULL AND oid IS NOT NULL AND section IS NOT NULL) SELECT oid, section, revision, dated, fid FROM (SELECT *, row_number() OVER (PARTITION BY oid, section ORDER BY revision DESC, dated DESC, fid DESC) AS k FROM r) WHERE k = 1",
        "q_duplicates": f + " SELECT sha256, count(*) AS n_rows, count(DISTINCT oid) AS n_wide, count(DISTINCT stage) AS n_narrow, CASE WHEN count(DISTINCT oid) > 1 THEN 'across_objects' WHEN count(DISTINCT stage) > 1 THEN 'across_stages' ELSE 'within' END AS kind FROM f WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1",
        "q_missing_discipline": staged + " AND section <> 'OTHER') SELECT oid, section FROM s WHERE s = 'PD' EXCEPT SELECT oid, section FROM s WHERE s = 'RD'",
        "q_section_sets": staged + "), g AS (SELECT oid, section, bool_or(s = 'PD') AS p, bool_or(s = 'RD') AS r FROM s GROUP BY oid, section) SELECT oid, coalesce(string_agg(section, ',' ORDER BY section) FILTER (p AND NOT r), '') AS lost, coalesce(string_agg(section, ',' ORDER BY section) FILTER (p AND r), '') AS kept, coalesce(string_agg(section, ',' ORDER BY section) FILTER (r AND NOT p), '') AS added FROM g GROUP BY oid",
        "q_snapshot_hash": f + ", b AS (SELECT oid, concat_ws('/', stage, substr(fid, 1, 6)) AS b, sha256(string_agg(fid || ':' || coalesce(sha256, ''), chr(10) ORDER BY stage, fid)) AS h, count(*) AS n FROM f WHERE oid IS NOT NULL GROUP BY 1, 2) SELECT oid, sha256(string_agg(h, chr(10) ORDER BY b, h)) AS content_hash, CAST(sum(n) AS BIGINT) AS n_rows FROM b GROUP BY oid",
        "q_upload_outcome": f + ", u AS (SELECT oid, row_number() OVER (PARTITION BY oid, sha256 ORDER BY uploaded_at NULLS FIRST, fid) AS k FROM f WHERE source = 'upload' AND sha256 IS NOT NULL) SELECT oid, count(*) FILTER (k = 1) AS n_accepted, count(*) FILTER (k > 1) AS n_repeated FROM u GROUP BY oid",
        "q_registry_check": f + ", r AS (SELECT size_bytes, json_valid(manifest_row) AS ok, CASE WHEN json_valid(manifest_row) THEN try_cast(json_extract_string(manifest_row, '$.size_bytes') AS BIGINT) END AS size FROM f WHERE manifest_row IS NOT NULL) SELECT CASE WHEN NOT ok THEN 'unreadable' WHEN size IS NULL THEN 'absent' WHEN size_bytes IS NULL THEN 'missing' WHEN size = size_bytes THEN 'ok' ELSE 'differs' END AS outcome, count(*) AS n_files FROM r GROUP BY 1",
        "q_name_multiset": _REV + ", g AS (SELECT oid, cipher, count(*) FILTER (stage = 'PD') AS l, count(*) FILTER (stage = 'RD') AS r FROM r WHERE cipher <> '' AND stage IN ('PD', 'RD') GROUP BY 1, 2) SELECT oid, CAST(sum(least(l, r)) AS BIGINT) AS common, CAST(sum(greatest(l - r, 0)) AS BIGINT) AS lost, CAST(sum(greatest(r - l, 0)) AS BIGINT) AS added FROM g GROUP BY oid",
        "q_file_families": f"WITH RECURSIVE {FILES_NOW}, a AS (SELECT fid AS u, min(fid) OVER (PARTITION BY sha256) AS v FROM f WHERE sha256 IS NOT NULL UNION SELECT fid, min(fid) OVER (PARTITION BY oid, original_name) FROM f WHERE original_name IS NOT NULL AND oid IS NOT NULL), e AS (SELECT u, v FROM a UNION SELECT v, u FROM a), r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u), m AS (SELECT u, min(v) AS component FROM r GROUP BY u) SELECT component, count(*) AS n_files FROM m GROUP BY component HAVING count(*) > 1",
        "q_registry_fields": "WITH d AS (SELECT DISTINCT nullif(upper(trim(file_id)), '') AS fid, manifest_row FROM files WHERE manifest_row IS NOT NULL), r AS (SELECT json_valid(manifest_row) AS readable, CASE WHEN json_valid(manifest_row) THEN json_extract_string(manifest_row, '$.corpus') END AS corpus, CASE WHEN json_valid(manifest_row) THEN json_extract_string(manifest_row, '$.split') END AS split FROM d) SELECT readable, corpus, split, count(*) AS n_rows FROM r GROUP BY ALL",
    }
