"""Queries over checks and their evidence: comparison, evidence, versions, listings, boxes, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triscope.functions.text import _LATIN, _RUSSIAN, comma_number, decimals, natural_key, place_key, repair_lookalikes
from triscope.operators.boxes import box_fields, nearest, overlaps, rows_of
from triscope.operators.compare import align, apart, disjoint_below, half_unit, higher_rank, lower_minimum, scores
from triscope.operators.records import carried, overlay
from triscope.operators.sequences import expand_ranges, islands, numbered, range_text
from triscope.plans.tables_sql import CHECKS_NOW, EVIDENCE
from triscope.plans.views import checks_now, evidence_rows
from triscope.sources.scratch import written
from triscope.sources.tables import table

_VALUES = ("parameter_code", "violation_label", "pd_value", "rd_value")


def _facts(spark: SparkSession, d: str, value: str) -> DataFrame:
    """Order lines read as facts of stages: supplier as object, flags as parameter, part group as place, year as stage."""
    rows = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate", value)
    year = F.year("l_shipdate")
    stage = F.when(year <= 1997, "PD").when(year <= 1999, "RD").otherwise("ID")
    return rows.select(F.col("l_suppkey").alias("object_id"), F.concat("l_returnflag", "l_linestatus").alias("parameter_code"), (F.col("l_partkey") % 10).alias("location"), stage.alias("stage"), F.col(value).alias("value"))


_KEY = ["object_id", "parameter_code", "location"]


def q_stage_minimum(spark: SparkSession, d: str) -> DataFrame:
    """Whether the working stage falls below the least value of the design stage."""
    return align(_facts(spark, d, "l_quantity"), _KEY, "stage", "value").select(*_KEY, "p_min", "r_min", lower_minimum())


def q_stage_disjoint(spark: SparkSession, d: str) -> DataFrame:
    """Whether the working values lie wholly below the design values."""
    return align(_facts(spark, d, "l_quantity"), _KEY, "stage", "value").select(*_KEY, disjoint_below())


def q_stage_rank(spark: SparkSession, d: str) -> DataFrame:
    """The same for ranks of which lower is better."""
    return align(_facts(spark, d, "l_linenumber"), _KEY, "stage", "value").select(*_KEY, higher_rank())


def q_stage_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Whether the least values of the stages differ by more than a tolerance."""
    return align(_facts(spark, d, "l_tax"), _KEY, "stage", "value").groupBy(apart(0.001)).agg(F.count("*").alias("n"))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    c = checks_now(spark, d, *_VALUES)
    return c.select("check_id", "parameter_code", "violation_label", comma_number(F.col("pd_value")).alias("p"), comma_number(F.col("rd_value")).alias("r"), decimals(F.col("pd_value")).alias("dp"), decimals(F.col("rd_value")).alias("dr"))


def q_value_compare(spark: SparkSession, d: str) -> DataFrame:
    """First numbers of design and working value, compared within half a unit of the coarser one."""
    equal = half_unit(F.col("p"), F.col("r"), F.col("dp"), F.col("dr"))
    outcome = F.when(F.col("p").isNull() | F.col("r").isNull(), "open").when(equal, "equal").when(F.col("r") < F.col("p"), "lower").otherwise("higher")
    return _numbers(spark, d).groupBy("violation_label", outcome.alias("outcome")).agg(F.count("*").alias("n"))


def q_largest_changes(spark: SparkSession, d: str) -> DataFrame:
    """The twelve largest relative changes of each parameter."""
    rows = _numbers(spark, d).where("p > 0 and r is not null").withColumn("change", F.round(F.abs(F.col("r") - F.col("p")) / F.col("p"), 9))
    w = W.partitionBy("parameter_code").orderBy(F.desc("change"), "check_id")
    return rows.withColumn("place", F.row_number().over(w)).where("place <= 12").select("parameter_code", "check_id", "change", "place")


def q_labels_by_status(spark: SparkSession, d: str) -> DataFrame:
    """Labels against statuses, as a table."""
    c = checks_now(spark, d, "violation_label", "protocol_status")
    return c.groupBy("violation_label").pivot("protocol_status", ["OK", "WARNING", "CRITICAL", "ID_MISSING", "RD_MISSING", "PD_MISSING"]).agg(F.count(F.lit(1))).fillna(0)


def q_rule_scores(spark: SparkSession, d: str) -> DataFrame:
    """How well equality of the stored values foretells the label."""
    c = checks_now(spark, d, *_VALUES)
    ours = F.when(F.col("pd_value").isNull() | F.col("rd_value").isNull(), None).when(F.col("pd_value") == F.col("rd_value"), "NO_VIOLATION").otherwise("VIOLATION_PRESENT")
    return scores(c.withColumn("ours", ours), "violation_label", "ours", "VIOLATION_PRESENT")


def q_place_keys(spark: SparkSession, d: str) -> DataFrame:
    """Places in normal form, with their checks."""
    c = checks_now(spark, d, "location").where("location is not null")
    return c.groupBy(place_key(F.col("location")).alias("place")).agg(F.count("*").alias("n_checks"))


def q_repaired_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments in which look-alike letters are put right."""
    e = evidence_rows(spark, d).where("fragment is not null")
    return e.withColumn("repaired", repair_lookalikes(F.col("fragment"))).where("repaired <> fragment").select("check_id", "ord", "repaired")


def q_evidence_pick(spark: SparkSession, d: str) -> DataFrame:
    """One piece of evidence per check and stage: with a box before without, then the least page, file and place."""
    e = evidence_rows(spark, d)
    key = F.struct(F.col("box").isNull().alias("a"), F.coalesce("page", F.lit(2**31 - 1)).alias("b"), F.coalesce("fid", F.lit("")).alias("c"), F.col("ord").alias("d"))
    return e.groupBy("check_id", "stage").agg(F.min_by(F.struct("fid", "page", "ord"), key).alias("m"), F.count("*").alias("n_evidence")).select("check_id", "stage", F.col("m.fid").alias("fid"), F.col("m.page").alias("page"), F.col("m.ord").alias("ord"), "n_evidence")


def q_evidence_top_pages(spark: SparkSession, d: str) -> DataFrame:
    """The three pages of each object and stage with the most evidence."""
    pages = evidence_rows(spark, d).where("fid is not null and page is not null and oid is not null").groupBy("oid", "stage", "fid", "page").agg(F.count("*").alias("n"))
    w = W.partitionBy("oid", "stage").orderBy(F.desc("n"), "fid", "page")
    return pages.withColumn("place", F.row_number().over(w)).where("place <= 3")


def q_page_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive pages of each file that evidence points to."""
    return islands(evidence_rows(spark, d).where("fid is not null"), ["fid"], "page").select("fid", "first", "last", "n")


def q_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Those runs as text, and the number of pages read back from it."""
    text = range_text(islands(evidence_rows(spark, d).where("fid is not null"), ["fid"], "page"), ["fid"])
    return text.select("fid", "ranges", F.size(expand_ranges(F.col("ranges"))).alias("n_pages"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    e = evidence_rows(spark, d).where("fid is not null and page is not null and box is not null and size(box) = 4")
    return e.select("fid", "page", F.concat_ws("/", "check_id", "ord").alias("key"), "fragment", *box_fields(F.col("box")))


def q_box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of evidence on one page whose boxes overlap by a hundredth or more."""
    o = overlaps(_boxes(spark, d), ["fid", "page"], "key", 0.01, cell=0.1)  # boxes are shares of the page
    return o.select("fid", "page", "key_a", "key_b", F.round("iou", 9).alias("iou"))


def q_box_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The nearest other piece of evidence on the page, within a quarter of it."""
    n = nearest(_boxes(spark, d), ["fid", "page"], "key", 0.25)
    return n.select("fid", "page", "key", "nearest", F.round("distance", 9).alias("distance"))


def q_box_rows(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a file's pages banded into rows."""
    return rows_of(_boxes(spark, d).withColumn("fragment", F.coalesce("fragment", F.lit("-"))), ["fid", "page"], "fragment", 0.05).where("n > 1").select("fid", "page", "band", "x0", "y0", "x1", "y1", "n")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return checks_now(spark, d, *_VALUES, "location", "created_at").where("oid is not null and parameter_code is not null and location is not null")


def q_carried(spark: SparkSession, d: str) -> DataFrame:
    """Versions of a check (object, parameter): carried over where label and values stay, else reset."""
    v = carried(_versions(spark, d), ["oid", "parameter_code"], ["created_at", "check_id"], ["violation_label", "pd_value", "rd_value"])
    return v.select("oid", "parameter_code", "check_id", "version", "outcome")


def q_latest_versions(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the latest check of each object and parameter."""
    latest = _versions(spark, d).groupBy("oid", "parameter_code").agg(F.max_by("violation_label", F.struct("created_at", "check_id")).alias("label"))
    return latest.groupBy("label").agg(F.count("*").alias("n"))


def q_unanswered(spark: SparkSession, d: str) -> DataFrame:
    """How many parameters of the catalogue each living object has no check for."""
    codes = F.array(*(F.lit(r[0]) for r in table(spark, d, "param_catalog", "parameter_code").distinct().orderBy("parameter_code").collect()))  # the catalogue, a fixed list
    objects = table(spark, d, "objects", "object_id", "deleted_at").where("deleted_at is null").select(F.upper(F.trim("object_id")).alias("oid")).distinct()
    wanted = objects.withColumn("parameter_code", F.explode(codes))
    return wanted.join(checks_now(spark, d, "parameter_code").select("oid", "parameter_code").distinct(), ["oid", "parameter_code"], "left_anti").groupBy("oid").agg(F.count("*").alias("n_unanswered"))


def q_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Upgraded checks laid over the others of an object: same place gives way, as do checks of touched codes without evidence."""
    c = checks_now(spark, d, "parameter_code", "location", "violation_label", "evidence").select("check_id", F.concat_ws("/", "oid", "parameter_code").alias("code"), "location", "violation_label", (F.coalesce(F.size("evidence"), F.lit(0)) <= 0).alias("bare"))
    c = written(c, "checks")  # read by both sides and their keys
    new, base = c.where("violation_label = 'VIOLATION_PRESENT'"), c.where("violation_label is null or violation_label <> 'VIOLATION_PRESENT'")
    return overlay(base, new, "code", "location", F.col("bare")).select("check_id", "code", "location")


def q_validate(spark: SparkSession, d: str) -> DataFrame:
    """Rows that break a rule: repeated keys, violations without evidence, unknown parameters."""
    c = checks_now(spark, d, "parameter_code", "location", "violation_label", "evidence")
    c = written(c.select("oid", "parameter_code", "location", "violation_label", (F.coalesce(F.size("evidence"), F.lit(0)) <= 0).alias("bare")), "checks")
    bare = F.col("bare")
    repeated = c.groupBy("oid", "parameter_code", "location").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated key").alias("rule"))
    unproven = c.where((F.col("violation_label") == "VIOLATION_PRESENT") & bare).select(F.lit("no evidence").alias("rule"))
    unknown = c.join(F.broadcast(table(spark, d, "param_catalog", "parameter_code")), "parameter_code", "left_anti").select(F.lit("unknown parameter").alias("rule"))
    return repeated.unionByName(unproven).unionByName(unknown).groupBy("rule").agg(F.count("*").alias("n_rows"))


def q_listing(spark: SparkSession, d: str) -> DataFrame:
    """A page of the checks that match filters and a substring, in natural order of their places."""
    c = checks_now(spark, d, "parameter_code", "location", "violation_label", "criticality", "note").where("oid is not null")
    hit = c.where(F.col("violation_label").isin("VIOLATION_PRESENT", "NO_VIOLATION") & F.lower(F.concat_ws(" ", "parameter_code", "location", "note")).contains("система"))
    return hit.orderBy(F.col("criticality").eqNullSafe("приостановка").cast("int").desc(), "parameter_code", natural_key(F.col("location")), "check_id").offset(20).limit(50).select("check_id", "parameter_code", "location")


def q_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Running numbers of the violations of an object, grave ones first."""
    c = checks_now(spark, d, "parameter_code", "violation_label", "criticality").where("violation_label = 'VIOLATION_PRESENT' and oid is not null")
    first = F.when(F.col("criticality").eqNullSafe("приостановка"), 0).otherwise(1)
    return numbered(c, ["oid"], F.struct(first.alias("first"), "parameter_code"), ["check_id"]).select("oid", "check_id", "no")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("q_")}


def _align_sql(value: str) -> str:
    return f"""WITH facts AS (SELECT l_suppkey AS object_id, l_returnflag || l_linestatus AS parameter_code, l_partkey % 10 AS location, CASE WHEN year(l_shipdate) <= 1997 THEN 'PD' WHEN year(l_shipdate) <= 1999 THEN 'RD' ELSE 'ID' END AS stage, {value} AS value FROM lineitem),
p AS (SELECT object_id, parameter_code, location, min(value) AS p_min, max(value) AS p_max FROM facts WHERE stage = 'PD' GROUP BY ALL), r AS (SELECT object_id, parameter_code, location, min(value) AS r_min, max(value) AS r_max FROM facts WHERE stage = 'RD' GROUP BY ALL),
j AS (SELECT * FROM p FULL OUTER JOIN r USING (object_id, parameter_code, location)) """


_NUMBER = r"""try_cast(replace(replace(replace(nullif(regexp_extract({0}, '[-+]?[0-9]+(?: [0-9]{{3}})*(?:,[0-9]+)?'), ''), ' ', ''), ',', '.'), '+', '') AS DOUBLE)"""
_DECIMALS = r"length(regexp_extract({0}, '[-+]?[0-9]+(?: [0-9]{{3}})*,([0-9]+)', 1))"
_SQL_NUMBERS = f"n AS (SELECT check_id, parameter_code, violation_label, {_NUMBER.format('pd_value')} AS p, {_NUMBER.format('rd_value')} AS r, {_DECIMALS.format('pd_value')} AS dp, {_DECIMALS.format('rd_value')} AS dr FROM c)"
_SQL_PLACE = """CASE WHEN regexp_matches(s, '^(помещение|пом\\.?|№) *[0-9]+ *[а-яa-z]?$') THEN (SELECT CASE WHEN length(k) < 3 THEN lpad(k, 3, '0') ELSE k END FROM (SELECT regexp_extract(s, '([0-9]+)', 1) AS k)) || translate(regexp_extract(s, '([а-яa-z]?)$', 1), 'aceopxy', 'асеорху')
  WHEN regexp_matches(upper(s), '^СИСТЕМА +[A-ZА-Я]{1,5} ?[0-9.]*$') THEN translate(replace(regexp_extract(upper(s), '^СИСТЕМА +(.*)$', 1), ' ', ''), 'ABCEHKMOPTXY', 'АВСЕНКМОРТХУ') ELSE s END"""
_SQL_BOXES = EVIDENCE + """, b AS (SELECT fid, page, check_id || '/' || ord AS key, box[1] AS x0, box[2] AS y0, box[3] AS x1, box[4] AS y1 FROM e WHERE fid IS NOT NULL AND page IS NOT NULL AND len(box) = 4)"""
_SQL_RUNS = EVIDENCE + ", p AS (SELECT DISTINCT fid, page FROM e WHERE fid IS NOT NULL AND page IS NOT NULL), g AS (SELECT fid, page, page - row_number() OVER (PARTITION BY fid ORDER BY page) AS i FROM p), runs AS (SELECT fid, min(page) AS first, max(page) AS last, count(*) AS n FROM g GROUP BY fid, i)"


def oracle_sql() -> dict[str, str]:
    c, e = f"WITH {CHECKS_NOW}", f"WITH {EVIDENCE}"
    versions = c + ", v AS (SELECT *, row_number() OVER w AS version, lag(violation_label) OVER w AS l0, lag(pd_value) OVER w AS p0, lag(rd_value) OVER w AS r0 FROM c WHERE oid IS NOT NULL AND parameter_code IS NOT NULL AND location IS NOT NULL WINDOW w AS (PARTITION BY oid, parameter_code ORDER BY created_at, check_id))"
    return {
        "q_stage_minimum": _align_sql("l_quantity") + "SELECT object_id, parameter_code, location, p_min, r_min, CASE WHEN p_min IS NULL OR r_min IS NULL THEN 'C' WHEN r_min < p_min THEN 'V' ELSE 'N' END AS label FROM j",
        "q_stage_disjoint": _align_sql("l_quantity") + "SELECT object_id, parameter_code, location, CASE WHEN p_min IS NULL OR r_min IS NULL THEN 'C' WHEN r_max < p_min THEN 'V' WHEN r_min >= p_min THEN 'N' ELSE 'C' END AS label FROM j",
        "q_stage_rank": _align_sql("l_linenumber") + "SELECT object_id, parameter_code, location, CASE WHEN p_min IS NULL OR r_min IS NULL THEN 'C' WHEN r_min > p_max THEN 'V' WHEN r_max <= p_min THEN 'N' ELSE 'C' END AS label FROM j",
        "q_stage_tolerance": _align_sql("l_tax") + "SELECT CASE WHEN p_min IS NULL OR r_min IS NULL THEN 'C' WHEN abs(p_min - r_min) > 0.001 THEN 'V' ELSE 'N' END AS label, count(*) AS n FROM j GROUP BY 1",
        "q_value_compare": c + f", {_SQL_NUMBERS} SELECT violation_label, CASE WHEN p IS NULL OR r IS NULL THEN 'open' WHEN abs(p - r) <= pow(10.0, -least(dp, dr)) / 2 + 1e-9 THEN 'equal' WHEN r < p THEN 'lower' ELSE 'higher' END AS outcome, count(*) AS n FROM n GROUP BY ALL",
        "q_largest_changes": c + f", {_SQL_NUMBERS}, k AS (SELECT parameter_code, check_id, round(abs(r - p) / p, 9) AS change FROM n WHERE p > 0 AND r IS NOT NULL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parameter_code ORDER BY change DESC, check_id) AS place FROM k) WHERE place <= 12",
        "q_labels_by_status": c + " SELECT violation_label, " + ", ".join(f"count(*) FILTER (protocol_status = '{s}') AS \"{s}\"" for s in ("OK", "WARNING", "CRITICAL", "ID_MISSING", "RD_MISSING", "PD_MISSING")) + " FROM c GROUP BY violation_label",
        "q_rule_scores": c + ", m AS (SELECT coalesce(violation_label = 'VIOLATION_PRESENT', false) AS g, coalesce(pd_value <> rd_value, false) AS o FROM c), s AS (SELECT count(*) FILTER (g AND o) AS tp, count(*) FILTER (NOT g AND o) AS fp, count(*) FILTER (g AND NOT o) AS fn, count(*) FILTER (NOT g AND NOT o) AS tn FROM m) SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM s",
        "q_place_keys": c + r", k AS (SELECT lower(trim(regexp_replace(translate(location, 'ёЁ', 'еЕ'), '[\s\p{Z}]+', ' ', 'g'))) AS s FROM c WHERE location IS NOT NULL) SELECT " + _SQL_PLACE + " AS place, count(*) AS n_checks FROM k GROUP BY 1",
        "q_repaired_fragments": e + f", r AS (SELECT check_id, ord, fragment, array_to_string(list_transform(string_split(fragment, chr(10)), lambda l: array_to_string(list_transform(regexp_extract_all(l, '\\s|[^\\s]+'), lambda w: CASE WHEN regexp_matches(w, '[А-Яа-яЁё]') OR (length(regexp_replace(l, '[^А-Яа-яЁё]', '', 'g')) > length(regexp_replace(l, '[^A-Za-z]', '', 'g')) AND regexp_matches(w, '^[.,;:()«»\"'']*[{_LATIN}]+[.,;:()«»\"'']*$')) THEN translate(w, '{_LATIN}', '{_RUSSIAN}') ELSE w END), '')), chr(10)) AS repaired FROM e WHERE fragment IS NOT NULL) SELECT check_id, ord, repaired FROM r WHERE repaired <> fragment",
        "q_evidence_pick": e + " SELECT check_id, stage, fid, page, ord, n_evidence FROM (SELECT *, count(*) OVER (PARTITION BY check_id, stage) AS n_evidence, row_number() OVER (PARTITION BY check_id, stage ORDER BY box IS NULL, coalesce(page, 2147483647), coalesce(fid, ''), ord) AS k FROM e) WHERE k = 1",
        "q_evidence_top_pages": e + ", p AS (SELECT oid, stage, fid, page, count(*) AS n FROM e WHERE fid IS NOT NULL AND page IS NOT NULL AND oid IS NOT NULL GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY oid, stage ORDER BY n DESC, fid, page) AS place FROM p) WHERE place <= 3",
        "q_page_runs": f"WITH {_SQL_RUNS} SELECT fid, first, last, n FROM runs",
        "q_page_ranges": f"WITH {_SQL_RUNS} SELECT fid, string_agg(CASE WHEN first = last THEN first::VARCHAR ELSE first || '-' || last END, ',' ORDER BY first) AS ranges, CAST(sum(n) AS INT) AS n_pages FROM runs GROUP BY fid",
        "q_box_overlaps": f"WITH {_SQL_BOXES}, o AS (SELECT a.fid, a.page, a.key AS key_a, b.key AS key_b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM b a JOIN b ON a.fid = b.fid AND a.page = b.page AND a.key < b.key) SELECT fid, page, key_a, key_b, round(i / (s - i), 9) AS iou FROM o WHERE i / (s - i) >= 0.01",
        "q_box_nearest": f"WITH {_SQL_BOXES}, m AS (SELECT *, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM b), o AS (SELECT a.fid, a.page, a.key, m.key AS nearest, sqrt((a.x - m.x) * (a.x - m.x) + (a.y - m.y) * (a.y - m.y)) AS distance FROM m a JOIN m ON a.fid = m.fid AND a.page = m.page AND a.key <> m.key) SELECT fid, page, key, nearest, round(distance, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY fid, page, key ORDER BY distance, nearest) AS k FROM o WHERE distance <= 0.25) WHERE k = 1",
        "q_box_rows": f"WITH {_SQL_BOXES} SELECT fid, page, CAST(round_even(y0 / 0.05, 0) AS BIGINT) AS band, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM b GROUP BY 1, 2, 3 HAVING count(*) > 1",
        "q_carried": versions + " SELECT oid, parameter_code, check_id, version, CASE WHEN version = 1 THEN 'first' WHEN violation_label IS NOT DISTINCT FROM l0 AND pd_value IS NOT DISTINCT FROM p0 AND rd_value IS NOT DISTINCT FROM r0 THEN 'carried' ELSE 'reset' END AS outcome FROM v",
        "q_latest_versions": versions + ", l AS (SELECT violation_label AS label, row_number() OVER (PARTITION BY oid, parameter_code ORDER BY version DESC) AS k FROM v) SELECT label, count(*) AS n FROM l WHERE k = 1 GROUP BY label",
        "q_unanswered": c + ", o AS (SELECT DISTINCT upper(trim(object_id)) AS oid FROM objects WHERE deleted_at IS NULL), w AS (SELECT oid, parameter_code FROM o, (SELECT DISTINCT parameter_code FROM param_catalog) EXCEPT SELECT oid, parameter_code FROM c) SELECT oid, count(*) AS n_unanswered FROM w GROUP BY oid",
        "q_overlay": c + ", k AS (SELECT check_id, concat_ws('/', oid, parameter_code) AS code, location, violation_label, coalesce(len(evidence), 0) = 0 AS bare FROM c), n AS (SELECT * FROM k WHERE violation_label = 'VIOLATION_PRESENT') SELECT check_id, code, location FROM n UNION ALL SELECT check_id, code, location FROM k WHERE violation_label IS DISTINCT FROM 'VIOLATION_PRESENT' AND NOT EXISTS (SELECT 1 FROM n WHERE n.code = k.code AND n.location IS NOT DISTINCT FROM k.location) AND NOT (bare AND EXISTS (SELECT 1 FROM n WHERE n.code = k.code))",
        "q_validate": c + ", v AS (SELECT 'repeated key' AS rule FROM c GROUP BY oid, parameter_code, location HAVING count(*) > 1 UNION ALL SELECT 'no evidence' FROM c WHERE violation_label = 'VIOLATION_PRESENT' AND coalesce(len(evidence), 0) = 0 UNION ALL SELECT 'unknown parameter' FROM c WHERE NOT EXISTS (SELECT 1 FROM param_catalog p WHERE p.parameter_code = c.parameter_code)) SELECT rule, count(*) AS n_rows FROM v GROUP BY rule",
        "q_listing": c + " SELECT check_id, parameter_code, location FROM c WHERE oid IS NOT NULL AND violation_label IN ('VIOLATION_PRESENT', 'NO_VIOLATION') AND contains(lower(concat_ws(' ', parameter_code, location, note)), 'система') ORDER BY coalesce(criticality = 'приостановка', false) DESC, parameter_code NULLS FIRST, array_to_string(list_transform(regexp_extract_all(lower(location), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(CAST(length(regexp_replace(x, '^0+([0-9])', '\\1')) AS VARCHAR), 10, '0') || regexp_replace(x, '^0+([0-9])', '\\1') ELSE x END), '') NULLS FIRST, check_id LIMIT 50 OFFSET 20",
        "q_numbering": c + " SELECT oid, check_id, row_number() OVER (PARTITION BY oid ORDER BY coalesce(criticality = 'приостановка', false) DESC, parameter_code NULLS FIRST, check_id) AS no FROM c WHERE violation_label = 'VIOLATION_PRESENT' AND oid IS NOT NULL",
    }
