"""Queries of values in documents and of what names them, with tables of names that suit these documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triscope.functions.parse import FLOORS, ORDINALS, floor_numbers, floor_of, sections
from triscope.functions.text import composed
from triscope.operators.contexts import first_of_page, looking_back, nearest_in_sentence, under_headers
from triscope.plans.tables_sql import CHECKS_NOW, FILES_NOW
from triscope.plans.views import checks_now, files_now
from triscope.sources.tables import table

#: A line without a sentence's end, which heads a passage.
_HEADER = r"^[^.;:]{3,60}$"
_LENGTH = r"([0-9]+(?:,[0-9]+)?) мм"
_LEVEL = r"отметк[а-я]* ([+-][0-9]+,[0-9]+)"
_SHARE = r"([0-9]+(?:,[0-9]+)?) %"
#: What the documents speak of, by parts of its names, in the order in which they are tried.
SYSTEMS = {"ventilation": "вентилятор|воздуховод|завес|калорифер", "heating": "радиатор|конвектор|теплов|тёпл", "fire": "пожар|огнезащит|спринклер|эвакуац", "doors": "двер|витраж|парапет", "costs": "расценк|смет|накладн|прибыл"}


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text")


def q_under_headers(spark: SparkSession, d: str) -> DataFrame:
    """Lengths on the two lines after a line that heads them, by header: how many, and on how many documents."""
    v = under_headers(_texts(spark, d), "doc_id", "text", _HEADER, _LENGTH, 2)
    return v.groupBy("header", (F.col("line_no") - F.col("header_no")).alias("below")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def q_looking_back(spark: SparkSession, d: str) -> DataFrame:
    """Lengths by the system that their line or one of the three before it names, else the title, and how far back."""
    v = looking_back(_texts(spark, d), "doc_id", "text", _LENGTH, SYSTEMS, 3, title=True)
    return v.groupBy("name", "back").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def q_nearest_named(spark: SparkSession, d: str) -> DataFrame:
    """Shares by the system named nearest in their sentence, and on which side."""
    v = nearest_in_sentence(_texts(spark, d), "doc_id", "text", _SHARE, SYSTEMS)
    return v.groupBy("name", "side").agg(F.count("*").alias("n"), F.count_if(F.col("place") > 0).alias("n_later"))


def q_first_levels(spark: SparkSession, d: str) -> DataFrame:
    """The first level of each document; they have one page."""
    return first_of_page(_texts(spark, d), "doc_id", "text", _LEVEL)


def q_floors(spark: SparkSession, d: str) -> DataFrame:
    """Floors that places of checks and names of files speak of, with the number of floors each covers."""
    places = checks_now(spark, d, "location").select(F.col("location").alias("t")).unionByName(files_now(spark, d, "original_name").select(F.col("original_name").alias("t")))
    f = places.select(floor_of(F.col("t")).alias("floor")).where("floor <> ''")
    return f.groupBy("floor", F.size(floor_numbers(F.col("floor"))).alias("n_floors")).agg(F.count("*").alias("n"))


def q_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sizes that values and fragments name, by label."""
    c = checks_now(spark, d, "pd_value", "rd_value", "evidence").select(F.explode(F.concat(F.array("pd_value", "rd_value"), F.coalesce("evidence.fragment", F.array()))).alias("t"))
    s = c.select(F.inline(sections(F.col("t"))))
    return s.groupBy("label", "area").agg(F.count("*").alias("n"))


def q_composed_places(spark: SparkSession, d: str) -> DataFrame:
    """Places in composed form: how many there are, and how many differ from what is stored."""
    c = checks_now(spark, d, "location").where("location is not null").select("location", composed(F.col("location")).alias("form"))
    return c.agg(F.countDistinct("form").alias("n_forms"), F.count_if(F.col("form") != F.col("location")).alias("n_changed"), F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("q_")}


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL)"
_NAMED = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, '{p}') THEN '{n}'" for n, p in SYSTEMS.items()) + " END"
_EVERY = "|".join(f"(?:{p})" for p in SYSTEMS.values())



def oracle_sql() -> dict[str, str]:
    c, f = f"WITH {CHECKS_NOW}", f"WITH {FILES_NOW}"
    back = " ".join(f"WHEN n{i} IS NOT NULL AND NOT {' AND NOT '.join(f'g{j}' for j in range(i + 1))} THEN {i}" for i in range(4))
    lag = lambda i: "line" if not i else f"lag(line, {i}) OVER k"
    return {
        "q_under_headers": f"WITH {_LINES}, w AS (SELECT *, lag(line) OVER k AS a, lag(line, 2) OVER k AS b FROM l WINDOW k AS (PARTITION BY doc_id ORDER BY line_no)), h AS (SELECT doc_id, unnest(regexp_extract_all(line, '{_LENGTH}', 1)) AS v, CASE WHEN regexp_matches(a, '{_HEADER}') THEN 1 WHEN regexp_matches(b, '{_HEADER}') THEN 2 END AS below, a, b FROM w) SELECT CASE below WHEN 1 THEN a ELSE b END AS header, below, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM h WHERE below IS NOT NULL GROUP BY 1, 2",
        "q_looking_back": f"WITH {_LINES}, w AS (SELECT *, first_value(line) OVER k AS title, " + ", ".join(f"{_NAMED.format(lag(i))} AS n{i}, coalesce(regexp_matches({lag(i)}, '^\\s*$'), true) AS g{i}" for i in range(4)) + f" FROM l WINDOW k AS (PARTITION BY doc_id ORDER BY line_no)), v AS (SELECT doc_id, title, n0, n1, n2, n3, CASE {back} END AS back, unnest(regexp_extract_all(line, '{_LENGTH}', 1)) AS v FROM w) SELECT CASE back WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE {_NAMED.format('title')} END AS name, back, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM v GROUP BY 1, 2",
        "q_nearest_named": f"WITH s AS (SELECT unnest(string_split_regex(regexp_replace(text, '([.;!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS t FROM documents WHERE text IS NOT NULL), p AS (SELECT string_split_regex(t, '{_SHARE}') AS b, generate_series(1, len(regexp_extract_all(t, '{_SHARE}'))) AS ks FROM s WHERE regexp_matches(t, '{_SHARE}')), q AS (SELECT b, unnest(ks) AS k FROM p), r AS (SELECT k, regexp_extract_all(array_to_string(b[1:k], '  '), '{_EVERY}')[-1] AS before, regexp_extract_all(array_to_string(b[k + 1:], '  '), '{_EVERY}')[1] AS after FROM q) SELECT {_NAMED.format('coalesce(before, after)')} AS name, CASE WHEN before IS NOT NULL THEN 'before' WHEN after IS NOT NULL THEN 'after' END AS side, count(*) AS n, count(*) FILTER (k > 1) AS n_later FROM r GROUP BY 1, 2",
        "q_first_levels": f"SELECT DISTINCT doc_id, 0 AS page, regexp_extract(text, '{_LEVEL}', 1) AS value FROM documents WHERE regexp_matches(text, '{_LEVEL}')",
        "q_floors": c + ", f" + FILES_NOW[1:] + f", s AS (SELECT lower(t) AS t FROM (SELECT location AS t FROM c UNION ALL SELECT original_name FROM f)), w AS (SELECT regexp_extract_all(regexp_replace(regexp_replace(t, '([0-9])\\s*[–-]\\s*([0-9])', '\\1-\\2', 'g'), '([0-9])\\s*-?\\s*(?:{ORDINALS})([^а-яё]|$)', '\\1\\2', 'g'), '-?[0-9]+(?:-[0-9]+)?|[а-яё]+') AS w FROM s), p AS (SELECT array_to_string(list_distinct(list_filter(list_transform(w, lambda x, i: CASE WHEN regexp_matches(x, '[0-9]') AND (starts_with(w[i + 1], 'этаж') OR w[i + 1] = 'эт') THEN x || ' этаж' WHEN regexp_matches(x, '[0-9]') AND starts_with(w[i + 1], 'секци') THEN 'секция ' || x WHEN starts_with(x, 'секци') AND regexp_matches(w[i + 1], '[0-9]') AND NOT regexp_matches(coalesce(w[nullif(i - 1, 0)], ''), '[0-9]') THEN 'секция ' || w[i + 1] {' '.join(f"WHEN starts_with(x, '{k}') THEN '{v}'" for k, v in FLOORS.items())} END), lambda x: x IS NOT NULL)), ', ') AS floor FROM w) SELECT floor, CASE WHEN contains(floor, ' этаж') AND regexp_matches(floor, '^-?[0-9]+ этаж') THEN 1 END AS n_floors, count(*) AS n FROM p WHERE floor <> '' GROUP BY 1, 2",
        "q_sections": f"WITH {CHECKS_NOW}, t AS (SELECT unnest([pd_value, rd_value] || coalesce(list_transform(evidence, lambda e: e.fragment), [])) AS t FROM c), m AS (SELECT unnest(regexp_extract_all(t, '(?:^|[^0-9.,])[0-9]{{3,4}} ?[хxХX×] ?[0-9]{{3,4}}(?:$|[^0-9])')) AS m FROM t), s AS (SELECT CAST(regexp_extract(m, '([0-9]{{3,4}}) ?[хxХX×] ?([0-9]{{3,4}})', 1) AS BIGINT) AS a, CAST(regexp_extract(m, '([0-9]{{3,4}}) ?[хxХX×] ?([0-9]{{3,4}})', 2) AS BIGINT) AS b FROM m) SELECT least(a, b) || '×' || greatest(a, b) AS label, a * b AS area, count(*) AS n FROM s WHERE a BETWEEN 100 AND 3000 AND b BETWEEN 100 AND 3000 GROUP BY 1, 2",
        "q_composed_places": c + " SELECT count(DISTINCT nfc_normalize(location)) AS n_forms, count(*) FILTER (nfc_normalize(location) <> location) AS n_changed, count(*) AS n FROM c WHERE location IS NOT NULL",
    }
