"""Queries p1, p2 and p5 over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triscope.functions.keys import clean_key
from triscope.functions.lookalikes import LOOSE
from triscope.operators.nested import ROOT_FIELD, emit_tagged, links, read_rows, read_table, source, write_tables
from triscope.operators.packed import UNITS, split_packed
from triscope.operators.references import orphans, parents, references, with_period
from triscope.sources.scratch import shared_path
from triscope.sources.tables import table


#: The typed fields of the flat tables; a struct is an object within the object.
MANIFEST = {
    "": "schema_version string, file_id string, object_id string, corpus string, stage string, section string, archive struct<format string>",
    "revisions": "rev string, issued string, reason struct<code string, text string>",
    "revisions.sheets": "code string, no bigint, title string, pages array<bigint>",
    "revisions.sheets.stamps": "role string, signed boolean, date string",
    "page_kinds": "kind string, `from` bigint, `to` bigint",
    "archive.members": "path string, size_bytes bigint",
}
EVIDENCE_FIELDS = "stage string, file_id string, pdf_page_number int, bbox_norm array<double>, bbox_source string, fragment string"


def _tables(spark: SparkSession, d: str, *names: str) -> str:
    """The folder of the flat tables of files.manifest_row, checks.evidence or both, written in one pass."""
    of = {
        "files": lambda: source(table(spark, d, "files", "file_id", "manifest_row"), "files", clean_key(F.col("file_id")), F.col("manifest_row")),
        "checks": lambda: source(table(spark, d, "checks", "check_id", "evidence").where("evidence is not null"), "checks", F.col("check_id"), F.struct("evidence")),
    }
    sources = [of[n]() for n in names]
    path = shared_path(spark, "nested")
    write_tables(emit_tagged(sources[0] if len(sources) == 1 else sources[0].unionByName(sources[1]), {"files": ROOT_FIELD, "checks": None}), path)
    return path


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per non-null object in a list of files.manifest_row or checks.evidence; read from the tables written."""
    return read_rows(spark, _tables(spark, d, "files", "checks")).where("list_path <> ''").select("src", "record_key", "list_path", "parent_pos", "pos").distinct()


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables: how many rows, records, and rows whose holder is a row of its own table."""
    return links(read_rows(spark, _tables(spark, d, "files", "checks")))


def p1_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The evidence of all checks as a flat table, its fields typed."""
    e = read_table(spark, _tables(spark, d, "checks"), "checks", "evidence", EVIDENCE_FIELDS)
    return e.select(F.col("record_key").cast("bigint").alias("check_id"), "pos", "stage", "file_id", "pdf_page_number", F.array_join(F.transform("bbox_norm", lambda x: F.coalesce(F.round(x * 1_000_000).cast("bigint"), F.lit(-1)).cast("string")), ",").alias("bbox_millionths"), "bbox_source", "fragment").distinct()


def p1_stamps(spark: SparkSession, d: str) -> DataFrame:
    """The stamps of all sheets as a flat table, joined by the holders' keys to their sheets, revisions and files."""
    path = _tables(spark, d, "files")
    of = lambda at: read_table(spark, path, "files", at, MANIFEST[at])
    sheets = of("revisions.sheets").select(F.col("row_key").alias("sheet"), F.col("parent_key").alias("revision"), F.col("code").alias("sheet_code"), F.col("no").alias("sheet_no"))
    revisions = of("revisions").select(F.col("row_key").alias("revision"), F.col("parent_key").alias("file"), "rev")
    files = of("").select(F.col("row_key").alias("file"), F.col("stage").alias("stage"))
    stamps = of("revisions.sheets.stamps").join(sheets, F.col("parent_key") == F.col("sheet")).join(revisions, "revision").join(files, "file")
    return stamps.select("record_key", "parent_pos", "pos", "stage", "rev", "sheet_code", "sheet_no", "role", "signed", "date").distinct()


def _values(spark: SparkSession, d: str) -> DataFrame:
    checks = table(spark, d, "checks", "check_id", "pd_value", "rd_value")
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("pd_value", "rd_value")))
    return checks.select("check_id", F.inline(pairs)).where("value is not null")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of each pd_value and rd_value that lists two or more."""
    return split_packed(_values(spark, d), "value").select("check_id", "field", "pos", "item").distinct()


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many fields list how many values."""
    items = p2_found(spark, d).groupBy("check_id", "field").agg((F.max("pos") + 1).alias("n_items"))
    return items.groupBy("field", "n_items").agg(F.count("*").alias("n_fields"))


def _misses(spark: SparkSession, d: str) -> DataFrame:
    objects, files = table(spark, d, "objects"), table(spark, d, "files")
    checks = table(spark, d, "checks").select("check_id", "created_at", F.explode("evidence.file_id").alias("file_id"))
    integrity = table(spark, d, "integrity").select("finding_id", "reported_at", F.explode("file_ids").alias("file_id"))
    to_files = references(checks, "evidence", F.col("check_id"), F.col("file_id"), F.col("created_at")).unionByName(references(integrity, "integrity", F.col("finding_id"), F.col("file_id"), F.col("reported_at")))
    to_objects = references(files, "files", F.col("file_id"), F.col("object_id"), F.col("uploaded_at"))
    a = orphans(to_objects, parents(objects, F.col("object_id"), F.col("created_at"), F.col("deleted_at")))
    b = orphans(to_files, parents(files, F.col("file_id"), F.col("uploaded_at"), F.col("deleted_at")))
    return with_period(a.unionByName(b))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References to objects and files that are missing, later or deleted at the row's time."""
    return _misses(spark, d)


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """The references of p5_found counted per referring table, month and reason."""
    return _misses(spark, d).groupBy("ref_table", "period", "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("missing_key").alias("n_keys"))


_P5 = """
WITH o AS (SELECT nullif(upper(trim(object_id)), '') AS k, min(created_at) AS created, CASE WHEN count(*) = count(deleted_at) THEN max(deleted_at) END AS deleted FROM objects GROUP BY 1),
f AS (SELECT nullif(upper(trim(file_id)), '') AS k, min(uploaded_at) AS created, CASE WHEN count(*) = count(deleted_at) THEN max(deleted_at) END AS deleted FROM files GROUP BY 1),
refs AS (
  SELECT 'files' AS ref_table, nullif(upper(trim(file_id)), '') AS ref_key, nullif(upper(trim(object_id)), '') AS k, uploaded_at AS t FROM files
  UNION ALL SELECT 'evidence', CAST(check_id AS VARCHAR), nullif(upper(trim(e.file_id)), ''), created_at FROM (SELECT check_id, created_at, unnest(evidence) AS e FROM checks)
  UNION ALL SELECT 'integrity', CAST(finding_id AS VARCHAR), nullif(upper(trim(x)), ''), reported_at FROM (SELECT finding_id, reported_at, unnest(file_ids) AS x FROM integrity)),
p AS (SELECT 'o' AS side, * FROM o UNION ALL SELECT 'f', * FROM f),
found AS (SELECT DISTINCT ref_table, ref_key, refs.k AS missing_key,
  CASE WHEN p.k IS NULL THEN 'missing' WHEN created > t THEN 'later' WHEN deleted <= t THEN 'deleted' END AS reason, strftime(t, '%Y-%m') AS period
  FROM refs LEFT JOIN p ON refs.k = p.k AND p.side = CASE WHEN ref_table = 'files' THEN 'o' ELSE 'f' END WHERE refs.k IS NOT NULL)
"""


#: Objects of the registry JSON by their paths. An object in place of a list gets the place 0; the replacement runs once per
#: list field, and for nested archives once per level.
_P1 = r"""
WITH s AS (SELECT DISTINCT nullif(upper(trim(file_id)), '') AS k, ltrim(manifest_row, chr(65279)) AS m FROM files WHERE manifest_row IS NOT NULL),
v AS (SELECT k, CASE WHEN json_type(m) = 'VARCHAR' THEN m ->> '$' ELSE m END AS m FROM s WHERE json_valid(m)),
t AS (SELECT v.k, j.key, j.type, j.fullkey, j.path, j.value FROM v, json_tree(v.m) AS j WHERE json_valid(v.m)),
r AS (SELECT k, path AS root FROM t WHERE key = 'schema_version'),
o AS (SELECT DISTINCT t.k, substr(fullkey, length(root) + 1) || '.' AS p, CAST(value AS VARCHAR) AS value FROM t JOIN r ON t.k = r.k WHERE type = 'OBJECT' AND starts_with(fullkey, root)),
l AS (SELECT k, {0} AS p, value FROM o),
e AS (SELECT DISTINCT check_id, e.*, i - 1 AS pos FROM (SELECT check_id, unnest(evidence) AS e, generate_subscripts(evidence, 1) AS i FROM checks) WHERE e IS NOT NULL),
n AS (SELECT *, ltrim(rtrim(regexp_replace(p, '\[[0-9]+\]', '', 'g'), '.'), '.') AS list_path, regexp_extract_all(p, '\[([0-9]+)\]', 1) AS places FROM l WHERE p = '.' OR regexp_matches(p, '\[[0-9]+\]\.$'))
"""
_P1_FOUND = "SELECT 'files' AS src, k AS record_key, list_path, array_to_string(places[:-2], '.') AS parent_pos, CAST(places[-1] AS BIGINT) AS pos FROM n WHERE p <> '.' UNION SELECT 'checks', CAST(check_id AS VARCHAR), 'evidence', '', pos FROM e"
_P1_TABLES = r"""SELECT 'files' AS src, list_path, count(*) AS n_rows, count(DISTINCT k) AS n_records, count(*) FILTER (p <> '.' AND EXISTS (SELECT 1 FROM n h WHERE h.k = n.k AND h.p = regexp_replace(n.p, '(^|\])\.[^\[\]]*\[[0-9]+\]\.$', '\1.'))) AS n_linked FROM n GROUP BY list_path
UNION ALL SELECT 'checks', 'evidence', count(*), count(DISTINCT check_id), count(*) FROM e UNION ALL SELECT 'checks', '', count(DISTINCT check_id), count(DISTINCT check_id), 0 FROM checks WHERE evidence IS NOT NULL"""
_P1_EVIDENCE = "SELECT check_id, pos, stage, file_id, pdf_page_number, array_to_string(list_transform(bbox_norm, lambda x: coalesce(CAST(round(x * 1000000) AS BIGINT), -1)), ',') AS bbox_millionths, bbox_source, fragment FROM e"
_P1_STAMPS = r"""SELECT n.k AS record_key, array_to_string(n.places[:-2], '.') AS parent_pos, CAST(n.places[-1] AS BIGINT) AS pos, f.value ->> '$.stage' AS stage, v.value ->> '$.rev' AS rev, h.value ->> '$.code' AS sheet_code, CAST(h.value ->> '$.no' AS BIGINT) AS sheet_no,
n.value ->> '$.role' AS role, CAST(n.value ->> '$.signed' AS BOOLEAN) AS signed, n.value ->> '$.date' AS date FROM n JOIN n h ON h.k = n.k AND h.p = regexp_replace(n.p, 'stamps\[[0-9]+\]\.$', '') JOIN n v ON v.k = n.k AND v.p = regexp_replace(n.p, 'sheets\[[0-9]+\]\..*$', '') JOIN n f ON f.k = n.k AND f.p = '.' WHERE n.list_path = 'revisions.sheets.stamps'"""


def _p1_sql() -> str:
    p = "p"
    for name in ("revisions", "sheets", "stamps", "page_kinds", *["members"] * 6):
        p = f"replace({p}, '.{name}.', '.{name}[0].')"
    return _P1.format(p)


def _p2_sql() -> str:
    """Commas and slashes that part nothing are set aside, each item is then what stands before a separator, quoted ones first."""
    like: dict[str, str] = {}
    for c, to in LOOSE.items():
        like[to] = like.get(to, to) + c
    z, blank, sep = r"\p{Cf}*", r"[ \x0b\x0c\p{Z}]", r";|,/\n\r\t\x03"
    unit = "(?:" + "|".join(z.join(f"[{like.get(LOOSE.get(c, c), c)}{c}]" for c in u) for u in sorted(UNITS, key=len, reverse=True)) + ")"
    put = lambda x, pattern, to: f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    x = "v"
    d = r"\p{Nd}"
    for _ in range(2):  # neighbours share a digit
        x = put(x, f"({d}{z}),({z}{d})", r"\1{1}\2")
        x = put(x, f"({d}{z}-{z}{d}[\\p{{Nd}}\\p{{Cf}}]*)/({z}{d}[\\p{{Nd}}\\p{{Cf}}]*-{z}\\p{{L}})", r"\1{2}\2")
        x = put(x, f"(?i)({d}(?:{blank}|\\p{{Cf}})*{unit}{z})/({z}{unit}{z})($|[^\\p{{L}}\\p{{Nd}}\\p{{Cf}}-])", r"\1{2}\2\3")
        x = put(x, f"({blank})[иИ]({blank})", r"\1{3}\2")
    for n in (1, 2, 3):
        x = x.replace(f"{{{n}}}", chr(n))
    piece = f'{blank}*(?:"(?:[^"]|"")*"|\'\'(?:[^\'\']|\'\'\'\')*\'\'|«[^»]*»|[^{sep}]*){blank}*[{sep}]'
    trim = lambda c: f"regexp_replace({c}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    bare = trim("p[:-2]")
    inner = trim("b[2:-2]")
    item = f"""CASE WHEN len(b) > 1 AND b[1] = '"' AND b[-1] = '"' THEN replace({inner}, '""', '"') WHEN len(b) > 1 AND b[1] = chr(39) AND b[-1] = chr(39) THEN replace({inner}, chr(39) || chr(39), chr(39)) WHEN len(b) > 1 AND b[1] = '«' AND b[-1] = '»' THEN {inner} ELSE b END"""
    back = f"translate({item}, chr(1) || chr(2) || chr(3), ',/и')"
    return f"""WITH c AS (SELECT DISTINCT check_id, unnest(['pd_value', 'rd_value']) AS field, unnest([pd_value, rd_value]) AS v FROM checks),
x AS (SELECT check_id, field, regexp_extract_all({x} || ';', '{piece}') AS ps FROM c WHERE v IS NOT NULL),
i AS (SELECT check_id, field, list_filter(list_transform(list_transform(ps, lambda p: {bare}), lambda b: {back}), lambda y: y <> '') AS items FROM x),
f AS (SELECT DISTINCT check_id, field, unnest(range(len(items))) AS pos, unnest(items) AS item FROM i WHERE len(items) > 1) """


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_tables, p1_evidence, p1_stamps, p2_found, p2_counts, p5_found, p5_report)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _p1_sql() + _P1_FOUND,
        "p1_tables": _p1_sql() + _P1_TABLES,
        "p1_evidence": _p1_sql() + _P1_EVIDENCE,
        "p1_stamps": _p1_sql() + _P1_STAMPS,
        "p2_found": _p2_sql() + "SELECT check_id, field, pos, item FROM f",
        "p2_counts": _p2_sql() + ", n AS (SELECT check_id, field, max(pos) + 1 AS n_items FROM f GROUP BY 1, 2) SELECT field, n_items, count(*) AS n_fields FROM n GROUP BY 1, 2",
        "p5_found": _P5 + "SELECT ref_table, ref_key, missing_key, reason, period FROM found WHERE reason IS NOT NULL",
        "p5_report": _P5 + "SELECT ref_table, period, reason, count(*) AS n_refs, count(DISTINCT missing_key) AS n_keys FROM found WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
    }
