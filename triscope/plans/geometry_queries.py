"""Queries over the boxes of evidence as tokens, labels, walls and lines of a sheet. A file is taken as one sheet of 1000 units a side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triscope.functions.parse import clause_of
from triscope.operators.boxes import visible_nearest
from triscope.operators.compare import evidence_met
from triscope.operators.layout import follow, grouped_lines, merged_level, visible_box, with_new_tokens
from triscope.operators.matching import once_printed
from triscope.plans.tables_sql import EVIDENCE
from triscope.plans.views import evidence_rows

SIDE = 1000


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    """fid, key, part, stage, page, fragment and the box in units of the sheet. The part (0, 1, 2) is the check's number modulo 3."""
    e = evidence_rows(spark, d).where("fid is not null and box is not null and size(box) = 4")
    at = lambda i: F.round(F.get("box", F.lit(i)) * SIDE, 3)
    return e.select("fid", F.concat_ws("/", "check_id", "ord").alias("key"), (F.col("check_id") % 3).alias("part"), "stage", "page", "fragment", *(at(i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


def q_new_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of part 0 of each sheet with those of part 1 that overlap none of them by a twentieth."""
    s = _sheet(spark, d).drop("fragment", "page", "stage")
    both = with_new_tokens(s.where("part = 0"), s.where("part = 1"), ["fid"], "key", 0.05)
    return both.groupBy("fid", "part").agg(F.count("*").alias("n"))


def q_merged_levels(spark: SparkSession, d: str) -> DataFrame:
    """Lower edges of boxes as level lines, those within ten units of height merged over gaps of forty."""
    return merged_level(_sheet(spark, d).select("fid", "x0", F.col("y1").alias("y0"), "x1", "y1"), ["fid"], 10.0, 40.0)


def q_grouped_lines(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of a page of a sheet as one line, with the common box and the mean width."""
    s = _sheet(spark, d).where("fragment is not null and page is not null").withColumn("score", F.col("x1") - F.col("x0"))
    return grouped_lines(s, ["fid", "page"], "key", "fragment", "score").select("fid", "page", "x0", "y0", "x1", "y1", F.round("score", 3).alias("score"), F.md5("line").alias("line_md5"))


def q_once_printed(spark: SparkSession, d: str) -> DataFrame:
    """Stages of evidence taken as words of a sheet, without those printed near an equal one among the ten before."""
    s = _sheet(spark, d).where("stage is not null")
    return once_printed(s, ["fid"], "key", "stage", 60.0, 10).groupBy("fid").agg(F.count("*").alias("n"))


def q_visible_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of sheets twice as wide as high, turned by their page's number, as they are seen."""
    s = _sheet(spark, d).where("page is not null").withColumn("y1", F.col("y1") / 2).withColumn("y0", F.col("y0") / 2)
    seen = visible_box(F.array("x0", "y0", "x1", "y1"), F.lit(float(SIDE)), F.lit(SIDE / 2), F.col("page") % 4 * 90)
    return s.select("key", *(F.get(seen, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


def _middle(df: DataFrame, name: str) -> DataFrame:
    return df.select("fid", F.col("key").alias(name), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))


def q_visible_nearest(spark: SparkSession, d: str) -> DataFrame:
    """For each box of part 0 the nearest of part 1 within 300 units that no diagonal of part 2 hides, else within 150."""
    s = _sheet(spark, d)
    of = lambda n: s.where(F.col("part") == n)
    v = visible_nearest(_middle(of(0), "key"), _middle(of(1), "label"), of(2).select("fid", "x0", "y0", "x1", "y1"), ["fid"], "key", "label", 300.0, 150.0)
    return v.select("fid", "key", "label", F.round("distance", 6).alias("distance"), "seen")


def q_walks(spark: SparkSession, d: str) -> DataFrame:
    """Where two hops along the diagonals of part 1 lead from the middle of each box of part 0, 200 units away at most."""
    s = _sheet(spark, d)
    w = follow(_middle(s.where("part = 0"), "key"), s.where("part = 1").withColumnRenamed("key", "id").select("fid", "id", "x0", "y0", "x1", "y1"), ["fid"], "key", 2, 200.0)
    return w.select("fid", "key", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "hops")


def q_evidence_met(spark: SparkSession, d: str) -> DataFrame:
    """Objects by whether each stage of a check's evidence meets, by page, the evidence that the object's other checks have."""
    e = evidence_rows(spark, d).where("oid is not null and stage is not null and page is not null")
    stages = lambda df, keys, name: df.groupBy(*keys, "stage").agg(F.collect_set("page").alias("pages")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("stage", "pages"))).alias(name))
    even, odd = e.where("check_id % 2 = 0"), e.where("check_id % 2 = 1")
    met = stages(even, ["oid", "check_id"], "wanted").join(stages(odd, ["oid"], "there"), "oid")
    return met.groupBy("oid").agg(F.count_if(evidence_met(F.col("wanted"), F.col("there"))).alias("n_met"), F.count("*").alias("n"))


def q_pages_after(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each file that have evidence of the as-built stage, or come right after one that has and hold other evidence."""
    pages = evidence_rows(spark, d).where("fid is not null and page is not null").groupBy("fid", "page").agg(F.max((F.col("stage") == "ID").cast("int")).alias("built"))
    after = pages.where("built = 1").select("fid", (F.col("page") + 1).alias("page"), F.lit(True).alias("after"))
    picked = pages.join(after, ["fid", "page"], "left").where("built = 1 or after")
    return picked.select("fid", "page", F.when(F.col("built") == 1, "built").otherwise("after").alias("why"))


def q_drawings(spark: SparkSession, d: str) -> DataFrame:
    """Pages with boxes over more than half of their width and two or more distinct fragments."""
    s = _sheet(spark, d).where("page is not null").groupBy("fid", "page").agg((F.max("x1") - F.min("x0")).alias("width"), F.countDistinct("fragment").alias("n_fragments"))
    return s.where((F.col("width") > SIDE / 2) & (F.col("n_fragments") >= 2)).select("fid", "page", F.round("width", 3).alias("width"), "n_fragments")


def q_clauses(spark: SparkSession, d: str) -> DataFrame:
    """The part of a fragment between commas that holds its first number with a unit."""
    e = evidence_rows(spark, d).where("fragment is not null").select("check_id", "ord", "fragment", F.nullif(F.regexp_extract("fragment", "[0-9]+ (?:мм|шт|кг)", 0), F.lit("")).alias("m")).where("m is not null")
    return e.select("check_id", "ord", clause_of(F.col("fragment"), F.col("m")).alias("clause"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("q_")}


_SHEET = EVIDENCE + ", s AS (SELECT fid, check_id || '/' || ord AS key, check_id % 3 AS part, stage, page, fragment, round(box[1] * 1000, 3) AS x0, round(box[2] * 1000, 3) AS y0, round(box[3] * 1000, 3) AS x1, round(box[4] * 1000, 3) AS y1 FROM e WHERE fid IS NOT NULL AND len(box) = 4)"
_SIDES = "((({0}x1 - {0}x0) * ({1} - {0}y0) - ({0}y1 - {0}y0) * ({2} - {0}x0)) * (({0}x1 - {0}x0) * ({3} - {0}y0) - ({0}y1 - {0}y0) * ({4} - {0}x0)) < 0)"


def oracle_sql() -> dict[str, str]:
    s = f"WITH {_SHEET}"
    hidden = "EXISTS (SELECT 1 FROM s w WHERE w.part = 2 AND w.fid = u.fid AND " + _SIDES.format("w.", "u.y", "u.x", "u.ly", "u.lx") + " AND ((u.lx - u.x) * (w.y0 - u.y) - (u.ly - u.y) * (w.x0 - u.x)) * ((u.lx - u.x) * (w.y1 - u.y) - (u.ly - u.y) * (w.x1 - u.x)) < 0)"
    overlap = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
    hop = "SELECT w.fid, w.key, coalesce(b.bx, w.x) AS x, coalesce(b.yy, w.y) AS y, CASE WHEN b.id IS NOT NULL THEN w.taken || [b.id] ELSE w.taken END AS taken FROM {0} w LEFT JOIN (SELECT key, fid, id, bx, yy FROM (SELECT w.key, w.fid, n.id, n.bx, n.yy, row_number() OVER (PARTITION BY w.fid, w.key ORDER BY sqrt((w.x - n.ax) * (w.x - n.ax) + (w.y - n.ay) * (w.y - n.ay)), n.id, n.bx, n.yy) AS k FROM {0} w JOIN n ON n.fid = w.fid AND sqrt((w.x - n.ax) * (w.x - n.ax) + (w.y - n.ay) * (w.y - n.ay)) <= 200 AND NOT list_contains(w.taken, n.id)) WHERE k = 1) b ON b.fid = w.fid AND b.key = w.key"
    turned = "CASE page % 4 WHEN 0 THEN [x0, y0, x1, y1] WHEN 1 THEN [500 - y1, x0, 500 - y0, x1] WHEN 2 THEN [1000 - x1, 500 - y1, 1000 - x0, 500 - y0] ELSE [y0, 1000 - x1, y1, 1000 - x0] END"
    share = lambda i, odd, even: f"round_even(least(1.0, greatest(0.0, t[{i}] / CASE WHEN page % 2 = 1 THEN {odd} ELSE {even} END)), 4)"
    return {
        "q_new_tokens": s + f" SELECT fid, part, count(*) AS n FROM s a WHERE part = 0 OR (part = 1 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.part = 0 AND b.fid = a.fid AND {overlap} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {overlap}) >= 0.05)) GROUP BY 1, 2",
        "q_merged_levels": s + ", l AS (SELECT fid, CAST(round_even(y1 / 10.0, 0) AS BIGINT) AS level, x0 AS a, x1 AS z FROM s), o AS (SELECT *, CASE WHEN max(z) OVER w IS NULL OR a > max(z) OVER w + 40 THEN 1 ELSE 0 END AS o FROM l WINDOW w AS (PARTITION BY fid, level ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT *, sum(o) OVER (PARTITION BY fid, level ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT fid, level, min(a) AS start, max(z) AS \"end\", count(*) AS n FROM g GROUP BY fid, level, g",
        "q_grouped_lines": s + " SELECT fid, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round(avg(x1 - x0), 3) AS score, md5(string_agg(fragment, ' ' ORDER BY key)) AS line_md5 FROM s WHERE fragment IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2",
        "q_once_printed": s + ", r AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY key) AS i FROM s WHERE stage IS NOT NULL) SELECT fid, count(*) AS n FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.fid = a.fid AND b.i BETWEEN a.i - 10 AND a.i - 1 AND b.stage = a.stage AND abs(b.x0 - a.x0) < 60 AND abs(b.y0 - a.y0) < 60) GROUP BY fid",
        "q_visible_boxes": s + f", h AS (SELECT key, page, x0, y0 / 2 AS y0, x1, y1 / 2 AS y1 FROM s WHERE page IS NOT NULL), t AS (SELECT key, page, {turned} AS t FROM h), v AS (SELECT key, {share(1, 500, 1000)} AS a, {share(2, 1000, 500)} AS b, {share(3, 500, 1000)} AS c, {share(4, 1000, 500)} AS d FROM t) SELECT key, least(a, c) AS x0, least(b, d) AS y0, greatest(a, c) AS x1, greatest(b, d) AS y1 FROM v",
        "q_visible_nearest": s + f", u AS (SELECT p.fid, p.key, q.key AS label, (p.x0 + p.x1) / 2 AS x, (p.y0 + p.y1) / 2 AS y, (q.x0 + q.x1) / 2 AS lx, (q.y0 + q.y1) / 2 AS ly FROM s p JOIN s q ON p.fid = q.fid AND p.part = 0 AND q.part = 1), v AS (SELECT *, sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)) AS dist, NOT {hidden} AS seen FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY fid, key ORDER BY seen DESC, dist, label) AS k FROM v WHERE dist <= 300 AND (seen OR dist <= 150)) SELECT fid, key, label, round(dist, 6) AS distance, seen FROM k WHERE k = 1",
        "q_walks": s + ", n AS (SELECT fid, key AS id, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS yy FROM s WHERE part = 1 UNION ALL SELECT fid, key, x1, y1, x0, y0 FROM s WHERE part = 1), w0 AS (SELECT fid, key, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, CAST([] AS VARCHAR[]) AS taken FROM s WHERE part = 0), w1 AS (" + hop.format("w0") + "), w2 AS (" + hop.format("w1") + ") SELECT fid, key, round(x, 3) AS x, round(y, 3) AS y, CAST(len(taken) AS INT) AS hops FROM w2",
        "q_evidence_met": f"WITH {EVIDENCE}, p AS (SELECT DISTINCT oid, check_id, stage, page FROM e WHERE oid IS NOT NULL AND stage IS NOT NULL AND page IS NOT NULL), m AS (SELECT oid, check_id, stage, bool_or(EXISTS (SELECT 1 FROM p q WHERE q.check_id % 2 = 1 AND q.oid = p.oid AND q.stage = p.stage AND q.page = p.page)) AS met FROM p WHERE check_id % 2 = 0 GROUP BY 1, 2, 3), k AS (SELECT oid, check_id, bool_and(met) AS met FROM m GROUP BY 1, 2) SELECT oid, count(*) FILTER (met) AS n_met, count(*) AS n FROM k WHERE oid IN (SELECT oid FROM p WHERE check_id % 2 = 1) GROUP BY oid",
        "q_pages_after": f"WITH {EVIDENCE}, p AS (SELECT fid, page, coalesce(bool_or(stage = 'ID'), false) AS built FROM e WHERE fid IS NOT NULL AND page IS NOT NULL GROUP BY 1, 2) SELECT fid, page, CASE WHEN built THEN 'built' ELSE 'after' END AS why FROM p WHERE built OR EXISTS (SELECT 1 FROM p q WHERE q.built AND q.fid = p.fid AND q.page = p.page - 1)",
        "q_drawings": s + " SELECT fid, page, round(max(x1) - min(x0), 3) AS width, count(DISTINCT fragment) AS n_fragments FROM s WHERE page IS NOT NULL GROUP BY 1, 2 HAVING max(x1) - min(x0) > 500 AND count(DISTINCT fragment) >= 2",
        "q_clauses": f"WITH {EVIDENCE}, m AS (SELECT check_id, ord, fragment, regexp_extract(fragment, '[0-9]+ (?:мм|шт|кг)') AS m FROM e) SELECT check_id, ord, list_filter(string_split_regex(fragment, '[,;]'), lambda x: contains(x, m))[1] AS clause FROM m WHERE m <> ''",
    }
