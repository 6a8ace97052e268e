"""Queries of extraction, matching, findings and the remaining rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triscope.operators.compare import align, better_lost, lost, old_kinds_new, over_limit, third_stage
from triscope.operators.extract import BETTER_PIPES, CABLE_ATTRIBUTES, LIGHTS, OLD_LIGHTS, PIPES, RULES, Rule, extract, named
from triscope.operators.findings import STAGES, TEMPORARY, findings
from triscope.operators.matching import best_group, by_path, contiguous_portions, greedy_areas, seeded_sample, set_overlap
from triscope.plans.checks_queries import _KEY, _facts
from triscope.plans.documents_queries import _SQL_STAGES, _stages
from triscope.plans.tables_sql import CHECKS_NOW, FILES_NOW
from triscope.plans.views import checks_now, files_now
from triscope.sources.scratch import written
from triscope.sources.tables import table

_POWER = tuple(r for r in RULES if r.name == "power")


def q_extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of all rules in the documents by rule, element and where the element was found."""
    f = extract(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return f.groupBy("rule", "element", "element_from").agg(F.count("*").alias("n_facts"), F.countDistinct("doc_id").alias("n_docs"))


def q_power_facts(spark: SparkSession, d: str) -> DataFrame:
    """Power values of each line."""
    f = extract(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", _POWER)
    return f.groupBy("doc_id", "line_no").agg(F.count("*").alias("n"), F.max(F.replace("value", F.lit(","), F.lit(".")).cast("double")).alias("most"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return checks_now(spark, d, "pd_value", "rd_value").where("pd_value is not null and rd_value is not null")


def q_cable_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of cables that the working value lost against the design value."""
    c = _pairs(spark, d).select(named(F.col("pd_value"), CABLE_ATTRIBUTES).alias("p"), named(F.col("rd_value"), CABLE_ATTRIBUTES).alias("r")).where("size(p) > 0 and size(r) > 0")
    gone = lost(F.col("p"), F.col("r"), [n for n, _ in CABLE_ATTRIBUTES])
    return c.groupBy(F.array_join(gone, ", ").alias("lost")).agg(F.count("*").alias("n"))


def q_light_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the working value replaces the wanted kind of lights by old ones."""
    c = _pairs(spark, d).select(named(F.col("pd_value"), LIGHTS).alias("p"), named(F.col("rd_value"), LIGHTS).alias("r")).where("size(p) > 0 or size(r) > 0")
    return c.groupBy(old_kinds_new(F.col("p"), F.col("r"), "LED", OLD_LIGHTS).alias("label")).agg(F.count("*").alias("n"))


def q_pipe_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the working value gives up the better kinds of pipes for plastic ones."""
    c = _pairs(spark, d).select(named(F.col("pd_value"), PIPES).alias("p"), named(F.col("rd_value"), PIPES).alias("r")).where("size(p) > 0 or size(r) > 0")
    return c.groupBy(better_lost(F.col("p"), F.col("r"), BETTER_PIPES, "ПВХ", F.lit(False)).alias("label")).agg(F.count("*").alias("n"))


def q_cable_fire(spark: SparkSession, d: str) -> DataFrame:
    """Whether the working value keeps the mark of cables that work in fire: open without it in the design value."""
    of = lambda c: F.array_contains(named(F.col(c), CABLE_ATTRIBUTES), "FR")
    any_of = lambda c: F.size(named(F.col(c), CABLE_ATTRIBUTES)) > 0
    c = _pairs(spark, d).where(any_of("pd_value") | any_of("rd_value"))
    return c.groupBy(F.when(~of("pd_value") | ~any_of("rd_value"), "C").when(of("rd_value"), "N").otherwise("V").alias("label")).agg(F.count("*").alias("n"))


def q_stage_limit(spark: SparkSession, d: str) -> DataFrame:
    """Whether the greatest working value is over the object's limit."""
    limits = table(spark, d, "supplier", "s_suppkey", "s_acctbal").select(F.col("s_suppkey").alias("object_id"), (F.col("s_acctbal") * 10).alias("limit"))
    return align(_facts(spark, d, "l_extendedprice"), _KEY, "stage", "value").join(limits, "object_id", "left").groupBy(over_limit(F.col("limit"))).agg(F.count("*").alias("n"))


def q_third_stage(spark: SparkSession, d: str) -> DataFrame:
    """Labels after the as-built stage, which can only turn them to violations."""
    facts = _facts(spark, d, "l_quantity")
    a = align(facts, _KEY, "stage", "value")
    built = facts.where("stage = 'ID'").groupBy(*_KEY).agg(F.min("value").alias("i_min"), F.count("*").alias("i_n"))
    label = F.when((F.col("p_n") == 0) | (F.col("r_n") == 0), "C").when(F.col("r_min") < F.col("p_min"), "V").otherwise("N")
    return a.join(built, _KEY, "left").groupBy(third_stage(label, F.col("r_min"), F.col("i_min"), F.col("i_n")).alias("label")).agg(F.count("*").alias("n"))


def q_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings about the registry, by type and detail."""
    wanted = ("stage", "section", "original_name", "relative_path", "size_bytes", "sha256")
    f = written(files_now(spark, d, *wanted).select("fid", "oid", *wanted), "files")  # read by several aggregations
    staged = f.where("oid is not null").select("oid", "section", _stages("stage").alias("s"))
    return findings(f, staged)


def q_registry_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the registry matched with those of the files, exactly or but for case and spaces."""
    f = files_now(spark, d, "relative_path", "manifest_row")
    path = F.try_variant_get(F.try_parse_json("manifest_row"), "$.relative_path", "string")
    registry = f.select("fid", path.alias("relative_path")).where("relative_path is not null")
    members = f.where("relative_path is not null").select("relative_path")
    return by_path(registry, members, "relative_path", F.lower(F.replace("relative_path", F.lit(" "), F.lit("")))).groupBy("found").agg(F.count("*").alias("n"), F.countDistinct("member").alias("n_members"))


def q_section_home(spark: SparkSession, d: str) -> DataFrame:
    """The object with the most files of each section."""
    return best_group(files_now(spark, d, "section").where("section is not null and oid is not null"), "section", "oid")


def q_parameter_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of which the violations of one and the proven cases of another share three objects or more."""
    c = checks_now(spark, d, "parameter_code", "violation_label").where("oid is not null and parameter_code is not null")
    o = set_overlap(c.where("violation_label = 'VIOLATION_PRESENT'"), c.where("violation_label = 'NO_VIOLATION'"), "parameter_code", "oid", 3)
    return o.select("left", "right", "common", F.round("ratio", 9).alias("ratio"))


def q_size_matches(spark: SparkSession, d: str) -> DataFrame:
    """Design files matched one to one with working files of a size within a quarter, by object and section."""
    f = files_now(spark, d, "stage", "section", "size_bytes").where("oid is not null and section is not null and size_bytes > 0")
    f = written(f.select("fid", "oid", "section", "stage", "size_bytes").where("stage in ('PD', 'RD')"), "sizes")  # read by the cuts and by the match
    return greedy_areas(f.where("stage = 'PD'"), f.where("stage = 'RD'"), ["oid", "section"], "fid", "size_bytes", "fid", tolerance=0.25)


def q_undone_portions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of checks without a note, in portions of ten."""
    return contiguous_portions(checks_now(spark, d, "note").select("check_id", F.col("note").isNotNull().alias("done")), "check_id", "done", 10)


def q_sample(spark: SparkSession, d: str) -> DataFrame:
    """Ten checks of each parameter, the same at every run."""
    return seeded_sample(checks_now(spark, d, "parameter_code"), "parameter_code", "check_id", 10, seed=20260924).select("parameter_code", "check_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("q_")}


def _named_sql(column: str, entries: tuple[tuple[str, str], ...]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({column}, '{p}') THEN '{n}' END" for n, p in entries) + "], lambda x: x IS NOT NULL)"


_SQL_FACTS = """WITH facts AS (SELECT l_suppkey AS object_id, l_returnflag || l_linestatus AS parameter_code, l_partkey % 10 AS location, CASE WHEN year(l_shipdate) <= 1997 THEN 'PD' WHEN year(l_shipdate) <= 1999 THEN 'RD' ELSE 'ID' END AS stage, {0} AS value FROM lineitem),
p AS (SELECT object_id, parameter_code, location, min(value) AS p_min, max(value) AS p_max FROM facts WHERE stage = 'PD' GROUP BY ALL), r AS (SELECT object_id, parameter_code, location, min(value) AS r_min, max(value) AS r_max FROM facts WHERE stage = 'RD' GROUP BY ALL), i AS (SELECT object_id, parameter_code, location, min(value) AS i_min, count(*) AS i_n FROM facts WHERE stage = 'ID' GROUP BY ALL),
j AS (SELECT * FROM p FULL OUTER JOIN r USING (object_id, parameter_code, location) LEFT JOIN i USING (object_id, parameter_code, location)) """


def _rule_sql(r: Rule) -> str:
    """The facts of one rule; a look at what stands before a match is a group of its own here."""
    pattern, before = r.pattern, ""
    if pattern.startswith("(?<!["):
        before, pattern = pattern[4:].split(")", 1)
        before = f"(?:^|[^{before[1:]})"
    pattern, after = pattern.split("(?!", 1) if "(?!" in pattern else (pattern, "")
    ends = {"": "", "[0-9])": "(?:$|[^0-9])", "[0-9]|,[0-9])": "(?:$|[^0-9,]|,(?:$|[^0-9]))"}[after]
    element = lambda c: "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}', 'i') THEN '{n}'" for n, p in r.elements) + " END" if r.elements else "NULL"
    found = f"SELECT doc_id, line, around, unnest(regexp_extract_all(line, '{before}{pattern}{ends}', 0)) AS m FROM w WHERE regexp_matches(line, '[0-9]')"
    unless = f" WHERE NOT regexp_matches(substr(line, greatest(1, instr(line, m) - {r.left}), least({r.left}, instr(line, m) - 1)), '{r.unless}', 'i')" if r.unless else ""
    return f"SELECT '{r.name}' AS rule, doc_id, {element('line')} AS own, {element('around')} AS near FROM ({found}){unless}"


def oracle_sql() -> dict[str, str]:
    lines = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL), w AS (SELECT *, concat_ws(' | ', lag(line) OVER k, lead(line) OVER k) AS around FROM l WINDOW k AS (PARTITION BY doc_id ORDER BY line_no)), m AS ("
    c, f = f"WITH {CHECKS_NOW}", f"WITH {FILES_NOW}"
    pairs = lambda t: c + f", n AS (SELECT {_named_sql('pd_value', t)} AS p, {_named_sql('rd_value', t)} AS r FROM c WHERE pd_value IS NOT NULL AND rd_value IS NOT NULL)"
    old = "[" + ", ".join(f"'{x}'" for x in OLD_LIGHTS) + "]"
    better = "[" + ", ".join(f"'{x}'" for x in BETTER_PIPES) + "]"
    new_old = f"list_filter(r, lambda x: list_contains({old}, x) AND NOT list_contains(p, x))"
    stages = ", ".join(f"'{s}'" for s in STAGES)
    return {
        "q_extracted_facts": lines + " UNION ALL ".join(map(_rule_sql, RULES)) + ") SELECT rule, coalesce(own, near) AS element, CASE WHEN own IS NOT NULL THEN 'line' WHEN near IS NOT NULL THEN 'context' END AS element_from, count(*) AS n_facts, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY 1, 2, 3",
        "q_power_facts": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '([0-9]+(?:,[0-9]+)?) ?кВт', 1)) AS v FROM l) SELECT doc_id, line_no, count(*) AS n, max(CAST(replace(v, ',', '.') AS DOUBLE)) AS most FROM m GROUP BY 1, 2",
        "q_cable_attributes": pairs(CABLE_ATTRIBUTES) + " SELECT array_to_string(list_filter(p, lambda x: NOT list_contains(r, x)), ', ') AS lost, count(*) AS n FROM n WHERE len(p) > 0 AND len(r) > 0 GROUP BY 1",
        "q_light_kinds": pairs(LIGHTS) + f" SELECT CASE WHEN len(p) = 0 OR len(r) = 0 THEN 'C' WHEN list_contains(p, 'LED') AND NOT list_contains(r, 'LED') AND len({new_old}) > 0 THEN 'V' WHEN len({new_old}) = 0 THEN 'N' ELSE 'C' END AS label, count(*) AS n FROM n WHERE len(p) > 0 OR len(r) > 0 GROUP BY 1",
        "q_pipe_kinds": pairs(PIPES) + f" SELECT CASE WHEN len(p) = 0 OR len(r) = 0 THEN 'C' WHEN len(list_intersect(p, {better})) > 0 AND list_contains(r, 'ПВХ') AND len(list_intersect(r, {better})) = 0 THEN 'V' WHEN len(list_filter(p, lambda x: list_contains({better}, x) AND NOT list_contains(r, x))) = 0 AND NOT (list_contains(r, 'ПВХ') AND NOT list_contains(p, 'ПВХ')) THEN 'N' ELSE 'C' END AS label, count(*) AS n FROM n WHERE len(p) > 0 OR len(r) > 0 GROUP BY 1",
        "q_cable_fire": pairs(CABLE_ATTRIBUTES) + " SELECT CASE WHEN NOT list_contains(p, 'FR') OR len(r) = 0 THEN 'C' WHEN list_contains(r, 'FR') THEN 'N' ELSE 'V' END AS label, count(*) AS n FROM n WHERE len(p) > 0 OR len(r) > 0 GROUP BY 1",
        "q_stage_limit": _SQL_FACTS.format("l_extendedprice") + ", k AS (SELECT j.*, s_acctbal * 10 AS lim FROM j LEFT JOIN supplier ON s_suppkey = object_id) SELECT CASE WHEN p_min IS NULL OR r_min IS NULL THEN 'C' WHEN r_max <= CASE WHEN lim >= p_max THEN lim ELSE p_max END THEN 'N' WHEN lim >= p_max THEN 'V' ELSE 'C' END AS label, count(*) AS n FROM k GROUP BY 1",
        "q_third_stage": _SQL_FACTS.format("l_quantity") + " SELECT CASE WHEN i_min < r_min AND i_n >= 2 THEN 'V' WHEN p_min IS NULL OR r_min IS NULL THEN 'C' WHEN r_min < p_min THEN 'V' ELSE 'N' END AS label, count(*) AS n FROM j GROUP BY 1",
        "q_findings": f
        + f""", o AS (SELECT * FROM f WHERE oid IS NOT NULL), s AS (SELECT oid, section, {_SQL_STAGES} AS s FROM o),
k AS (SELECT sha256, CASE WHEN count(DISTINCT oid) > 1 THEN 'across_objects' WHEN count(DISTINCT stage) > 1 THEN 'across_stages' ELSE 'within' END AS kind FROM o WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT oid, 'EMPTY_OR_UNREADABLE' AS type, coalesce(stage, '') AS detail, count(*) AS n FROM o WHERE coalesce(size_bytes, 0) = 0 GROUP BY ALL
UNION ALL SELECT oid, 'TEMPORARY_ARTIFACT', '', count(*) FROM o WHERE regexp_matches(relative_path, '{TEMPORARY}') GROUP BY 1
UNION ALL SELECT oid, 'NAME_DIFFERS_FROM_PATH', '', count(*) FROM o WHERE string_split(relative_path, '/')[-1] <> original_name GROUP BY 1
UNION ALL SELECT oid, 'EXACT_DUPLICATES', kind, count(*) FROM o JOIN k USING (sha256) GROUP BY 1, 3
UNION ALL SELECT oid, 'STAGE_MISSING', t, 1 FROM (SELECT DISTINCT oid, unnest([{stages}]) AS t FROM o) x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.oid = x.oid AND s.s = t)
UNION ALL SELECT oid, 'DISCIPLINE_MISSING_IN_RD', section, count(*) FILTER (s = 'PD') FROM s WHERE section IS NOT NULL AND section <> 'OTHER' GROUP BY 1, 3 HAVING count(*) FILTER (s = 'PD') > 0 AND count(*) FILTER (s = 'RD') = 0""",
        "q_registry_paths": f + ", r AS (SELECT fid, CASE WHEN json_valid(manifest_row) THEN json_extract_string(manifest_row, '$.relative_path') END AS p FROM f), k AS (SELECT lower(replace(relative_path, ' ', '')) AS l, count(*) AS n, min(relative_path) AS one_path FROM f WHERE relative_path IS NOT NULL GROUP BY 1), m AS (SELECT DISTINCT relative_path AS m FROM f), j AS (SELECT m, CASE WHEN n = 1 THEN one_path END AS o FROM r LEFT JOIN m ON m = p LEFT JOIN k ON l = lower(replace(p, ' ', '')) WHERE p IS NOT NULL) SELECT CASE WHEN m IS NOT NULL THEN 'exact' WHEN o IS NOT NULL THEN 'loose' ELSE 'none' END AS found, count(*) AS n, count(DISTINCT coalesce(m, o)) AS n_members FROM j GROUP BY 1",
        "q_section_home": f + ", n AS (SELECT section, oid, count(*) AS n_hits FROM f WHERE section IS NOT NULL AND oid IS NOT NULL GROUP BY 1, 2) SELECT section, oid, n_hits FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n_hits DESC, oid) AS k FROM n) WHERE k = 1",
        "q_parameter_overlap": c + ", k AS (SELECT DISTINCT parameter_code AS p, oid, violation_label AS v FROM c WHERE oid IS NOT NULL AND parameter_code IS NOT NULL), a AS (SELECT p, oid, count(*) OVER (PARTITION BY p) AS n FROM k WHERE v = 'VIOLATION_PRESENT'), b AS (SELECT p, oid, count(*) OVER (PARTITION BY p) AS n FROM k WHERE v = 'NO_VIOLATION') SELECT a.p AS \"left\", b.p AS \"right\", count(*) AS common, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 9) AS ratio FROM a JOIN b USING (oid) GROUP BY 1, 2 HAVING count(*) >= 3",
        "q_sample": c + ", k AS (SELECT parameter_code, check_id, row_number() OVER (PARTITION BY parameter_code ORDER BY md5('20260924|' || check_id), check_id) AS n FROM c) SELECT parameter_code, check_id FROM k WHERE n <= 10",
        # the greedy match, a left file at a time for all groups at once
        "q_size_matches": f"WITH RECURSIVE {FILES_NOW}, s AS (SELECT fid, oid, section, stage, size_bytes AS z FROM f WHERE oid IS NOT NULL AND section IS NOT NULL AND size_bytes > 0 AND stage IN ('PD', 'RD')), g AS (SELECT oid, section, list({{'k': fid, 'z': z}} ORDER BY fid) FILTER (stage = 'PD') AS l, list({{'k': fid, 'z': z}} ORDER BY fid) FILTER (stage = 'RD') AS r FROM s GROUP BY 1, 2 HAVING count(DISTINCT stage) = 2), w AS (SELECT oid, section, l, r, 0 AS i, CAST(NULL AS VARCHAR) AS left_key, CAST(NULL AS VARCHAR) AS right_key FROM g UNION ALL SELECT oid, section, l, CASE WHEN ok THEN list_filter(r, lambda x: x.k <> b.k) ELSE r END, i + 1, CASE WHEN ok THEN l[i + 1].k END, CASE WHEN ok THEN b.k END FROM (SELECT *, abs(b.z - l[i + 1].z) / l[i + 1].z <= 0.25 AS ok FROM (SELECT *, list_sort(list_transform(r, lambda x: {{'d': abs(x.z - l[i + 1].z), 'k': x.k, 'z': x.z}}))[1] AS b FROM w WHERE i < len(l) AND len(r) > 0))) SELECT oid, section, left_key, right_key FROM w WHERE left_key IS NOT NULL",
        "q_undone_portions": c + ", u AS (SELECT check_id, check_id - row_number() OVER (ORDER BY check_id) AS g FROM c WHERE note IS NULL), r AS (SELECT min(check_id) AS a, max(check_id) AS z FROM u GROUP BY g) SELECT p AS first, least(p + 9, z) AS last FROM (SELECT unnest(range(a, z + 1, 10)) AS p, z FROM r)",
    }
