"""Queries that write and read again: readers, sinks, versions, archives of names, the cache, lists that should agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triscope.functions.parse import form_field, missing_stages, safe_name, text_date, upload_name
from triscope.operators.matching import diff_lists, same_stems, similar_sets
from triscope.operators.records import current
from triscope.plans.documents_queries import _REV, _revisions
from triscope.plans.tables_sql import CHECKS_NOW, FILES_NOW
from triscope.plans.views import checks_now, files_now
from triscope.sources.cache import cached
from triscope.sources.readers import compare_members, digests, json_lines, new_rows, registry_csv, whole_json
from triscope.sources.scratch import shared_path
from triscope.sources.sinks import by_object, read_version, report, versions, write_version
from triscope.sources.tables import table
from triscope.streaming.states import progress_lines


#: Months as they are written in dates.
MONTHS_OF = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")


def q_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """The registry as JSON lines, a broken one for each file without a section, read again: rows by stage, and broken ones."""
    path = shared_path(spark, "lines")
    f = files_now(spark, d, "stage", "section", "size_bytes")
    good = F.to_json(F.struct("fid", "stage", "section", "size_bytes"))
    f.select(F.when(F.col("section").isNotNull(), good).otherwise(F.substring(good, 1, 12)).alias("value")).write.text(path)
    back = json_lines(spark, path, "fid string, stage string, section string, size_bytes bigint", keep_broken=True)
    return back.groupBy(F.col("broken").isNotNull().alias("broken"), F.when(F.col("broken").isNull(), F.col("stage")).alias("stage")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("broken").isNull(), F.col("size_bytes"))).alias("bytes"))


def q_whole_json(spark: SparkSession, d: str) -> DataFrame:
    """The parameters as one JSON document with a list, read again as rows; the catalogue is a fixed list."""
    path = shared_path(spark, "documents")
    table(spark, d, "param_catalog", "parameter_code", "unit").agg(F.to_json(F.collect_list(F.struct("parameter_code", "unit"))).alias("value")).write.text(path)
    return whole_json(spark, path, "parameter_code string, unit string").select("parameter_code", "unit")


def q_report(spark: SparkSession, d: str) -> DataFrame:
    """Labels of checks counted, written as a small report and read again."""
    path = shared_path(spark, "report") + ".json"
    report(checks_now(spark, d, "violation_label").groupBy("violation_label").agg(F.count("*").alias("n")), path)
    return whole_json(spark, path, "violation_label string, n bigint").select("violation_label", "n")


def q_form_fields(spark: SparkSession, d: str) -> DataFrame:
    """Places of checks written into forms of three fields over several lines and read again."""
    c = checks_now(spark, d, "location", "parameter_code").where("location is not null")
    form = F.concat(F.lit("Акт\n1. Показатель\n"), F.coalesce("parameter_code", F.lit("")), F.lit("\n(код)\n 2. Место\n  "), F.col("location"), F.lit("\n и рядом \n(где)\n3. Итог\n"))
    return c.groupBy(form_field(form, 2).alias("place"), form_field(form, 3).alias("outcome")).agg(F.count("*").alias("n"))


def q_registry_csv(spark: SparkSession, d: str) -> DataFrame:
    """The registry as CSV with a header, separators and quotes within fields, read again."""
    path = shared_path(spark, "csv")
    f = files_now(spark, d, "stage", "original_name").where("original_name is not null").select("fid", "stage", F.translate("original_name", '\\\r\n', "///").alias("name"))
    f.write.option("header", True).option("sep", ";").option("quote", '"').option("escape", '"').csv(path)
    back = registry_csv(spark, path, "fid string, stage string, name string").select("fid", "stage", "name")
    return back.groupBy("stage").agg(F.count("*").alias("n"), F.countDistinct("fid").alias("n_files"), F.sum(F.length("name")).alias("chars"))


def q_versions(spark: SparkSession, d: str) -> DataFrame:
    """The files of two stages as two versions of one table: what the first and the last hold."""
    path = shared_path(spark, "versions")
    f = files_now(spark, d, "stage").select("fid", "stage")
    for stage in ("PD", "RD"):
        write_version(f.where(F.col("stage") == stage), path)
    rows = [read_version(spark, path, n).withColumn("version", F.lit(n)) for n in versions(spark, path)]
    return rows[0].unionByName(rows[1]).groupBy("version", "stage").agg(F.count("*").alias("n"))


def q_by_object(spark: SparkSession, d: str) -> DataFrame:
    """Checks written into a folder for each object and read again by folder."""
    path = shared_path(spark, "objects")
    by_object(checks_now(spark, d, "parameter_code").where("oid is not null").select("oid", "check_id", "parameter_code"), path, key="oid", rows_per_file=1000)
    return spark.read.parquet(path).groupBy("oid").agg(F.count("*").alias("n"), F.countDistinct("parameter_code").alias("n_parameters"))


def q_digests(spark: SparkSession, d: str) -> DataFrame:
    """Documents as contents: their length in bytes, digest and kind."""
    t = table(spark, d, "documents", "doc_id", "text").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return digests(t.withColumn("length", F.octet_length("content").cast("bigint")))


def q_cache(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents by a cache that knows some already: rows, and how many contents each of three runs computed."""
    path = shared_path(spark, "cache")
    t = table(spark, d, "documents", "doc_id", "text", "stage")
    compute = lambda c: c.select("cache_key", F.size(F.split("content", r"\s+")).alias("n_words"))
    _, first = cached(t.where("stage = 'PD'"), "text", "1", compute, path)
    all_rows, second = cached(t, "text", "1", compute, path)
    _, third = cached(t, "text", "1", compute, path)
    return all_rows.agg(F.count("*").alias("n"), F.count("n_words").alias("n_counted"), F.sum("n_words").alias("n_words")).select("*", F.lit(first).alias("first"), F.lit(second).alias("second"), F.lit(third).alias("third"))


def q_new_rows(spark: SparkSession, d: str) -> DataFrame:
    """Checks received from a day on that weren't there before it, by month of their creation."""
    c = table(spark, d, "checks", "check_id", "received_at", "created_at", "violation_label")
    old, new = c.where("received_at < timestamp_ntz'2025-06-01'"), c.where("received_at >= timestamp_ntz'2025-06-01'")
    rows = new_rows(old, new, ["check_id"], [F.col("received_at"), F.coalesce("violation_label", F.lit(""))])
    return rows.groupBy(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def q_compare_members(spark: SparkSession, d: str) -> DataFrame:
    """The registry's paths and sizes against those of the files: ok, another size, missing, extra."""
    f = files_now(spark, d, "relative_path", "size_bytes", "manifest_row")
    v = F.try_parse_json("manifest_row")
    expected = f.select(F.try_variant_get(v, "$.relative_path", "string").alias("member"), F.try_variant_get(v, "$.size_bytes", "bigint").alias("size")).where("member is not null")
    once = lambda df: df.groupBy("member").agg(F.min("size").alias("size"))
    there = f.where("relative_path is not null").select(F.col("relative_path").alias("member"), F.col("size_bytes").alias("size"))
    return compare_members(once(expected), once(there)).groupBy("state").agg(F.count("*").alias("n"))


def q_last_write(spark: SparkSession, d: str) -> DataFrame:
    """Findings of which the last report counts: by type, with the counts they state."""
    i = current(table(spark, d, "integrity", "finding_id", "type", "count", "reported_at", "received_at"), F.col("finding_id"), [F.col("received_at"), F.col("reported_at"), F.col("count")], "id")
    return i.groupBy("type").agg(F.count("*").alias("n"), F.sum("count").alias("stated"))


def q_progress_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of a worker's output, errors as broken ones: what they are read as."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    good = F.to_json(F.struct(F.lit("progress").alias("type"), F.col("user_id").cast("string").alias("process_id"), (F.col("value") / 100).alias("progress")))
    lines = e.select(F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), F.col("event_id").cast("string"))).otherwise(good).alias("value"))
    p = progress_lines(lines)
    return p.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("process_id").alias("n_processes"), F.count_if(F.col("progress") == 1).alias("n_full"), F.count("message").alias("n_messages"))


def q_diff_files(spark: SparkSession, d: str) -> DataFrame:
    """Design and working files of an object: matched by cipher, else by size with the same section first, or alone."""
    f = _revisions(spark, d).where("cipher <> ''").join(files_now(spark, d, "section", "size_bytes").select("fid", "section", "size_bytes"), "fid")
    of = lambda s: f.where(F.col("stage") == s).select("oid", "cipher", "section", "size_bytes", "fid")
    return diff_lists(of("PD"), of("RD"), ["oid"], "cipher", "section", "size_bytes", "fid", 0.03).groupBy("oid", "how").agg(F.count("*").alias("n"))


def q_similar_objects(spark: SparkSession, d: str) -> DataFrame:
    """For the parameters with violations in each object the objects whose proven cases cover half of them or more, the best ones."""
    c = checks_now(spark, d, "parameter_code", "violation_label").where("oid is not null and parameter_code is not null")
    a, b = (c.where(F.col("violation_label") == v) for v in ("VIOLATION_PRESENT", "NO_VIOLATION"))
    return similar_sets(a, b, "oid", "parameter_code", 0.5, F.col("left") == F.col("right")).select("left", "right", "common", F.round("share", 9).alias("share"))


def q_same_stems(spark: SparkSession, d: str) -> DataFrame:
    """Whether design and working value say the same by stems of their words, by label."""
    c = checks_now(spark, d, "violation_label", "pd_value", "rd_value")
    return c.groupBy("violation_label", same_stems(F.col("pd_value"), F.col("rd_value")).alias("same")).agg(F.count("*").alias("n"))


def q_safe_names(spark: SparkSession, d: str) -> DataFrame:
    """Paths as names that any file system takes, where that changes them."""
    f = files_now(spark, d, "relative_path").where("relative_path is not null").select("fid", "relative_path", safe_name(F.col("relative_path"), 40).alias("name"))
    return f.where("name <> relative_path").select("fid", "name")


def q_upload_names(spark: SparkSession, d: str) -> DataFrame:
    """Names whose UTF-8 was read as Latin letters, put right: how many are again what they were."""
    f = files_now(spark, d, "original_name").where("original_name is not null").select("original_name", F.decode(F.encode("original_name", "UTF-8"), "ISO-8859-1").alias("seen"))
    return f.groupBy((upload_name(F.col("seen")) == F.col("original_name")).alias("right")).agg(F.count("*").alias("n"))


def q_missing_stages(spark: SparkSession, d: str) -> DataFrame:
    """Stages that the titles of findings and notes of checks say are without something."""
    t = table(spark, d, "integrity", "title").unionByName(checks_now(spark, d, "note").select(F.col("note").alias("title")))
    return t.groupBy(F.array_join(missing_stages(F.col("title")), ",").alias("stages")).agg(F.count("*").alias("n"))


def q_dates_in_words(spark: SparkSession, d: str) -> DataFrame:
    """Days on which documents were created, written out in words and read again."""
    t = table(spark, d, "documents", "created_at").where("created_at is not null").select(F.to_date("created_at").alias("on"))
    month = F.element_at(F.array(*map(F.lit, MONTHS_OF)), F.month("on"))
    text = F.concat(F.lit("Акт от «"), F.dayofmonth("on").cast("string"), F.lit("» "), month, F.lit(" "), F.year("on").cast("string"), F.lit(" г."))
    return t.groupBy(text_date(text).alias("dated")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("q_")}


_STEMS = "list_distinct(list_transform(regexp_extract_all(replace(lower(coalesce({0}, '')), 'ё', 'е'), '[а-яa-z]{{2,}}'), lambda w: substr(w, 1, 6)))"
_SETS = "a AS (SELECT DISTINCT oid AS k, parameter_code AS m FROM c WHERE violation_label = 'VIOLATION_PRESENT' AND oid IS NOT NULL AND parameter_code IS NOT NULL), b AS (SELECT DISTINCT oid AS k, parameter_code AS m FROM c WHERE violation_label = 'NO_VIOLATION' AND oid IS NOT NULL AND parameter_code IS NOT NULL), x AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM a), y AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM b)"


def oracle_sql() -> dict[str, str]:
    c, f = f"WITH {CHECKS_NOW}", f"WITH {FILES_NOW}"
    return {
        "q_json_lines": f + " SELECT section IS NULL AS broken, CASE WHEN section IS NOT NULL THEN stage END AS stage, count(*) AS n, CAST(sum(CASE WHEN section IS NOT NULL THEN size_bytes END) AS BIGINT) AS bytes FROM f GROUP BY 1, 2",
        "q_whole_json": "SELECT parameter_code, unit FROM param_catalog",
        "q_report": c + " SELECT violation_label, count(*) AS n FROM c GROUP BY 1",
        "q_form_fields": c + " SELECT trim(regexp_replace(location, '\\s+', ' ', 'g')) || ' и рядом' AS place, CAST(NULL AS VARCHAR) AS outcome, count(*) AS n FROM c WHERE location IS NOT NULL GROUP BY 1",
        "q_registry_csv": f + " SELECT stage, count(*) AS n, count(DISTINCT fid) AS n_files, CAST(sum(length(original_name)) AS BIGINT) AS chars FROM f WHERE original_name IS NOT NULL GROUP BY stage",
        "q_versions": f + " SELECT CASE stage WHEN 'PD' THEN 1 ELSE 2 END AS version, stage, count(*) AS n FROM f WHERE stage IN ('PD', 'RD') GROUP BY stage",
        "q_by_object": c + " SELECT oid, count(*) AS n, count(DISTINCT parameter_code) AS n_parameters FROM c WHERE oid IS NOT NULL GROUP BY oid",
        "q_digests": "SELECT CAST(doc_id AS VARCHAR) AS path, strlen(text) AS length, sha256(text) AS sha256, CASE WHEN text = '' THEN 'empty' WHEN starts_with(ltrim(text), '<') THEN 'xml' ELSE 'unknown' END AS kind FROM documents WHERE text IS NOT NULL",
        "q_cache": "WITH t AS (SELECT text, stage, len(string_split_regex(text, '\\s+')) AS w FROM documents) SELECT count(*) AS n, count(w) AS n_counted, CAST(sum(w) AS BIGINT) AS n_words, CAST(count(DISTINCT text) FILTER (stage = 'PD') AS INT) AS first, CAST(count(DISTINCT text) - count(DISTINCT text) FILTER (stage = 'PD') AS INT) AS second, 0 AS third FROM t",
        "q_new_rows": "WITH n AS (SELECT check_id, max_by(strftime(created_at, '%Y-%m'), {'a': received_at, 'b': coalesce(violation_label, '')}) AS month FROM checks WHERE received_at >= '2025-06-01' GROUP BY 1) SELECT month, count(*) AS n FROM n WHERE check_id NOT IN (SELECT check_id FROM checks WHERE received_at < '2025-06-01') GROUP BY month",
        "q_compare_members": f + ", e AS (SELECT p AS member, min(z) AS z FROM (SELECT CASE WHEN json_valid(manifest_row) THEN json_extract_string(manifest_row, '$.relative_path') END AS p, CASE WHEN json_valid(manifest_row) THEN try_cast(json_extract_string(manifest_row, '$.size_bytes') AS BIGINT) END AS z FROM f) WHERE p IS NOT NULL GROUP BY 1), t AS (SELECT relative_path AS member, min(size_bytes) AS z FROM f WHERE relative_path IS NOT NULL GROUP BY 1) SELECT CASE WHEN t.member IS NULL THEN 'missing' WHEN e.member IS NULL THEN 'extra' WHEN e.z IS NOT DISTINCT FROM t.z THEN 'ok' ELSE 'size' END AS state, count(*) AS n FROM e FULL JOIN t ON e.member = t.member GROUP BY 1",
        "q_last_write": "WITH k AS (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY received_at DESC NULLS LAST, reported_at DESC NULLS LAST, count DESC NULLS LAST) AS k FROM integrity WHERE finding_id IS NOT NULL) SELECT type, count(*) AS n, CAST(sum(count) AS BIGINT) AS stated FROM k WHERE k = 1 GROUP BY type",
        # a design file at a time for all objects at once
        "q_diff_files": _REV.replace("WITH ", "WITH RECURSIVE ", 1) + """, s AS (SELECT r.oid, r.stage, r.cipher, f.section, f.size_bytes AS z, r.fid, row_number() OVER (PARTITION BY r.oid, r.stage, r.cipher ORDER BY r.fid) AS k FROM r JOIN f ON f.fid = r.fid WHERE r.cipher <> '' AND r.stage IN ('PD', 'RD')),
p AS (SELECT a.oid, a.fid AS l, b.fid AS r FROM s a JOIN s b ON a.oid = b.oid AND a.cipher = b.cipher AND a.k = b.k AND a.stage = 'PD' AND b.stage = 'RD'), t AS (SELECT * FROM s WHERE fid NOT IN (SELECT l FROM p UNION ALL SELECT r FROM p)),
g AS (SELECT oid, list({'k': fid, 'n': section, 'z': z} ORDER BY fid) FILTER (stage = 'PD' AND z > 0) AS l, list({'k': fid, 'n': section, 'z': z} ORDER BY fid) FILTER (stage = 'RD' AND z > 0) AS r FROM t GROUP BY oid),
w AS (SELECT oid, l, r, 0 AS i, CAST(NULL AS VARCHAR) AS hit FROM g WHERE l IS NOT NULL AND r IS NOT NULL UNION ALL SELECT oid, l, CASE WHEN b IS NULL THEN r ELSE list_filter(r, lambda y: y.k <> b.k) END, i + 1, b.k FROM (SELECT *, list_sort(list_transform(list_filter(r, lambda y: abs(y.z - l[i + 1].z) <= 0.03 * greatest(y.z, l[i + 1].z)), lambda y: {'a': coalesce(y.n <> l[i + 1].n, true), 'd': abs(y.z - l[i + 1].z), 'k': y.k}))[1] AS b FROM w WHERE i < len(l))),
m AS (SELECT oid, count(*) AS n FROM w WHERE hit IS NOT NULL GROUP BY oid), u AS (SELECT oid, 'key' AS how, count(*) AS n FROM p GROUP BY oid UNION ALL SELECT oid, 'area', n FROM m UNION ALL SELECT t.oid, CASE stage WHEN 'PD' THEN 'removed' ELSE 'added' END, count(*) - coalesce(any_value(m.n), 0) FROM t LEFT JOIN m ON m.oid = t.oid GROUP BY t.oid, stage) SELECT oid, how, n FROM u WHERE n > 0""",
        "q_progress_lines": "SELECT CASE WHEN event_type = 'error' THEN 'log' ELSE 'progress' END AS type, count(*) AS n, count(DISTINCT user_id) FILTER (event_type <> 'error') AS n_processes, count(*) FILTER (event_type <> 'error' AND value / 100 >= 1) AS n_full, count(*) FILTER (event_type = 'error') AS n_messages FROM events GROUP BY 1",
        "q_similar_objects": c + f", {_SETS}, p AS (SELECT x.k AS l, y.k AS r, count(*) AS common, count(*) / least(any_value(x.n), any_value(y.n)) AS share FROM x JOIN y USING (m) WHERE x.k <> y.k GROUP BY 1, 2), q AS (SELECT *, max(share) OVER (PARTITION BY l) AS best FROM p WHERE share >= 0.5) SELECT l AS \"left\", r AS \"right\", common, round(share, 9) AS share FROM q WHERE share = best",
        "q_same_stems": c + f", s AS (SELECT violation_label, {_STEMS.format('pd_value')} AS x, {_STEMS.format('rd_value')} AS y FROM c) SELECT violation_label, len(list_intersect(x, y)) = least(len(x), len(y)) OR len(list_intersect(x, y)) / greatest(1, len(list_distinct(x || y))) >= 0.6 AS same, count(*) AS n FROM s GROUP BY 1, 2",
        "q_safe_names": f + r""", n AS (SELECT fid, relative_path, substr(regexp_replace(relative_path, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), 1, 40) AS name FROM f WHERE relative_path IS NOT NULL) SELECT fid, name FROM n WHERE name <> relative_path""",
        "q_upload_names": f + " SELECT regexp_matches(original_name, '[Ѐ-ӿ]') OR regexp_full_match(original_name, '[ -~]*') AS \"right\", count(*) AS n FROM f WHERE original_name IS NOT NULL GROUP BY 1",
        "q_dates_in_words": "SELECT CAST(created_at AS DATE) AS dated, count(*) AS n FROM documents WHERE created_at IS NOT NULL GROUP BY 1",
        "q_missing_stages": c + ", t AS (SELECT title FROM integrity UNION ALL SELECT note FROM c) SELECT array_to_string(coalesce(list_distinct(list_transform(regexp_extract_all(lower(title), 'в (пд|рд|ид) нет', 1), lambda s: upper(s))), []), ',') AS stages, count(*) AS n FROM t GROUP BY 1",
    }
