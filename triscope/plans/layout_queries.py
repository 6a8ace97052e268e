"""Queries of small parsers, nested answers and the layout of evidence on pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triscope.functions.fuzzy import kinds_by_words
from triscope.functions.parse import after_label, dash, group_id, percent, short_date
from triscope.operators.layout import outside_columns, reading_rows, strongest
from triscope.plans.checks_queries import _SQL_BOXES, _boxes
from triscope.plans.documents_queries import _SQL_STAGES, _stages
from triscope.plans.tables_sql import CHECKS_NOW, EVIDENCE, FILES_NOW
from triscope.plans.views import checks_now, evidence_rows, files_now
from triscope.sources.tables import table

#: Sections by the mark that the catalogue gives.
MARKS = (("КР", "KR"), ("АР", "AR"), ("ОВ", "OV"), ("ВК", "VK"), ("ЭОМ", "EOM"), ("СС", "SS"), ("ГП", "GP"), ("ПБ", "PB"), ("ПОС", "POS"))


#: Kinds of files by words of their names.
KINDS = [("answers", [["ответы", "замечания"]]), ("scheme", [["исполнительная", "схема"]]), ("protocol", [["протокол", "испытаний"]]), ("list", [["ведомость"], ["спецификация"]]), ("plan", [["план"]])]


def _section_of_mark(c):
    mark = F.regexp_extract(c, "(" + "|".join(m for m, _ in MARKS) + ")$", 1)
    out = F.lit(None).cast("string")
    for m, s in MARKS:
        out = F.when(mark == m, s).otherwise(out)
    return out


def q_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of the catalogue by short section and criticality."""
    return table(spark, d, "param_catalog").groupBy(after_label(F.col("pd_section"), "Раздел").alias("section"), dash(F.col("unit")).alias("unit")).agg(F.count("*").alias("n"))


def q_missing_sets(spark: SparkSession, d: str) -> DataFrame:
    """How many parameters of each object need a working set that the object doesn't have."""
    needed = table(spark, d, "param_catalog", "parameter_code", "source_rd").select(_section_of_mark(F.col("source_rd")).alias("section")).where("section is not null").groupBy("section").agg(F.count("*").alias("n_parameters"))
    there = files_now(spark, d, "stage", "section").where("oid is not null").select("oid", "section", _stages("stage").alias("s"))
    objects = there.select("oid").distinct()
    sections = F.array(*(F.lit(s) for _, s in MARKS))
    wanted = objects.withColumn("section", F.explode(sections)).join(F.broadcast(needed), "section")
    return wanted.join(there.where("s = 'RD'").select("oid", "section").distinct(), ["oid", "section"], "left_anti").groupBy("oid").agg(F.sum("n_parameters").alias("n_parameters"))


def q_group_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of the groups of object, parameter and place, with their checks."""
    c = checks_now(spark, d, "parameter_code", "location")
    return c.groupBy(group_id("EG-", F.col("oid"), F.col("parameter_code"), F.col("location")).alias("group_id")).agg(F.count("*").alias("n"))


def q_answers(spark: SparkSession, d: str) -> DataFrame:
    """Checks with their evidence in order, as one line of text."""
    e = evidence_rows(spark, d).select("check_id", "ord", F.concat_ws(":", F.coalesce("stage", F.lit("-")), F.coalesce("fid", F.lit("-")), F.coalesce(F.col("page").cast("string"), F.lit("-"))).alias("e"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "e")))
    return e.groupBy("check_id").agg(F.array_join(F.transform(parts, lambda p: p["e"]), " ").alias("evidence"))


def q_busy_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with two or more pieces of evidence."""
    e = evidence_rows(spark, d).where("fid is not null and page is not null")
    return e.groupBy("fid", "page").agg(F.count("*").alias("n"), F.countDistinct("check_id").alias("n_checks")).where("n >= 2")


def q_grades(spark: SparkSession, d: str) -> DataFrame:
    """Rebar classes that each object's design values name, joined in their order."""
    c = checks_now(spark, d, "pd_value").where("oid is not null").select("oid", F.explode(F.regexp_extract_all("pd_value", F.lit("[AА](240|300|400|500|600|800|1000)"), F.lit(1))).alias("g"))
    return c.groupBy("oid").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.col("g").cast("int"))), lambda g: F.concat(F.lit("А"), g.cast("string"))), "/").alias("grades"))


def q_numbered_places(spark: SparkSession, d: str) -> DataFrame:
    """Places of an object that occur more than once, told apart by a number."""
    c = checks_now(spark, d, "location").where("oid is not null and location is not null")
    w = W.partitionBy("oid", "location").orderBy("check_id")
    k = F.row_number().over(w)
    return c.select("check_id", F.when(k > 1, F.concat("location", F.lit("#"), k)).otherwise(F.col("location")).alias("place"))


def q_shares(spark: SparkSession, d: str) -> DataFrame:
    """Labels with their share of all checks, as text."""
    n = checks_now(spark, d, "violation_label").groupBy("violation_label").agg(F.count("*").alias("n"))
    return n.select("violation_label", percent(F.col("n"), F.sum("n").over(W.partitionBy())).alias("share"))


def q_named_dates(spark: SparkSession, d: str) -> DataFrame:
    """Files by the date that their names tell."""
    f = files_now(spark, d, "original_name")
    return f.groupBy(short_date(F.col("original_name")).alias("named")).agg(F.count("*").alias("n")).where("named is not null")


def q_page_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Names of files by the kind of document that they speak of, words nearly equal."""
    f = files_now(spark, d, "original_name")
    return kinds_by_words(f, "original_name", KINDS).groupBy("kind").agg(F.count("*").alias("n"))


def q_reading_rows(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a page as rows of reading."""
    return reading_rows(_boxes(spark, d), ["fid", "page"], "fragment").groupBy("fid", "page").agg(F.count("*").alias("n_rows"))


def q_strongest_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a page left when wider ones suppress those they overlap."""
    return strongest(_boxes(spark, d).withColumn("score", F.col("x1") - F.col("x0")), ["fid", "page"], "key", "score", 0.1)


def q_outside_columns(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of evidence that don't stand below others of their file."""
    return outside_columns(_boxes(spark, d).withColumn("x", F.col("x0") * 1000), ["fid"], "x").groupBy("fid").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    c, e, f = f"WITH {CHECKS_NOW}", f"WITH {EVIDENCE}", f"WITH {FILES_NOW}"
    marks = "|".join(m for m, _ in MARKS)
    section = f"CASE regexp_extract(source_rd, '({marks})$', 1) " + " ".join(f"WHEN '{m}' THEN '{s}'" for m, s in MARKS) + " END"
    return {
        "q_catalogue": r"SELECT coalesce(nullif(regexp_extract(pd_section, '^Раздел\s+[0-9]+\.\s*(.+)$', 1), ''), pd_section, '') AS section, coalesce(nullif(trim(unit), ''), '—') AS unit, count(*) AS n FROM param_catalog GROUP BY 1, 2",
        "q_missing_sets": f + f", n AS (SELECT {section} AS section, count(*) AS n FROM param_catalog GROUP BY 1), s AS (SELECT oid, section, {_SQL_STAGES} AS s FROM f WHERE oid IS NOT NULL), w AS (SELECT oid, section, n FROM (SELECT DISTINCT oid FROM s), n WHERE section IS NOT NULL) SELECT oid, CAST(sum(n) AS BIGINT) AS n_parameters FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.oid = w.oid AND s.section = w.section AND s.s = 'RD') GROUP BY oid",
        "q_group_ids": c + " SELECT 'EG-' || substr(sha1(coalesce(oid, '') || chr(0) || coalesce(parameter_code, '') || chr(0) || coalesce(location, '')), 1, 12) AS group_id, count(*) AS n FROM c GROUP BY 1",
        "q_answers": e + " SELECT check_id, string_agg(coalesce(stage, '-') || ':' || coalesce(fid, '-') || ':' || coalesce(page::VARCHAR, '-'), ' ' ORDER BY ord) AS evidence FROM e GROUP BY check_id",
        "q_busy_pages": e + " SELECT fid, page, count(*) AS n, count(DISTINCT check_id) AS n_checks FROM e WHERE fid IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2",
        "q_grades": c + ", g AS (SELECT DISTINCT oid, CAST(unnest(regexp_extract_all(pd_value, '[AА](240|300|400|500|600|800|1000)', 1)) AS INT) AS g FROM c WHERE oid IS NOT NULL) SELECT oid, string_agg('А' || g, '/' ORDER BY g) AS grades FROM g GROUP BY oid",
        "q_numbered_places": c + ", k AS (SELECT check_id, location, row_number() OVER (PARTITION BY oid, location ORDER BY check_id) AS k FROM c WHERE oid IS NOT NULL AND location IS NOT NULL) SELECT check_id, CASE WHEN k > 1 THEN location || '#' || k ELSE location END AS place FROM k",
        "q_shares": c + " SELECT violation_label, replace(printf('%.1f', round(100.0 * count(*) / sum(count(*)) OVER (), 1)), '.', ',') || '%' AS share FROM c GROUP BY 1",
        "q_outside_columns": f"WITH {_SQL_BOXES}, n AS (SELECT fid, count(*) OVER (PARTITION BY fid ORDER BY CAST(round(x0 * 1000 * 1000) AS BIGINT) RANGE BETWEEN 2000 PRECEDING AND 2000 FOLLOWING) AS n FROM b) SELECT fid, count(*) AS n FROM n WHERE n < 4 GROUP BY fid",
        # one box of each page at a time, the widest first
        "q_strongest_boxes": f"WITH RECURSIVE {_SQL_BOXES}, g AS (SELECT fid, page, list({{'s': -(x1 - x0), 'key': key, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY -(x1 - x0), key) AS r FROM b GROUP BY 1, 2), w AS (SELECT fid, page, r, CAST(NULL AS VARCHAR) AS key FROM g UNION ALL SELECT fid, page, list_filter(r[2:], lambda x: NOT coalesce(least(r[1].x1, x.x1) > greatest(r[1].x0, x.x0) AND least(r[1].y1, x.y1) > greatest(r[1].y0, x.y0) AND (least(r[1].x1, x.x1) - greatest(r[1].x0, x.x0)) * (least(r[1].y1, x.y1) - greatest(r[1].y0, x.y0)) / ((r[1].x1 - r[1].x0) * (r[1].y1 - r[1].y0) + (x.x1 - x.x0) * (x.y1 - x.y0) - (least(r[1].x1, x.x1) - greatest(r[1].x0, x.x0)) * (least(r[1].y1, x.y1) - greatest(r[1].y0, x.y0))) >= 0.1, false)), r[1].key FROM w WHERE len(r) > 0) SELECT fid, page, key FROM w WHERE key IS NOT NULL",
        "q_named_dates": f + r", n AS (SELECT coalesce(CAST(try_strptime(nullif(regexp_extract(original_name, 'от\s+([0-9]{2}\.[0-9]{2}\.[0-9]{4})', 1), ''), '%d.%m.%Y') AS DATE), CAST(try_strptime(nullif(regexp_extract(original_name, '([0-9]{2}\.[0-9]{2}\.[0-9]{4})', 1), ''), '%d.%m.%Y') AS DATE)) AS named FROM f) SELECT named, count(*) AS n FROM n WHERE named IS NOT NULL GROUP BY named",
    }
