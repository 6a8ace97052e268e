"""Queries over the lines of documents: context, segments, facts, frequencies, near-equal words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triscope.functions.fuzzy import has_phrase, near
from triscope.functions.marks import parse_marks, system_of
from triscope.functions.text import comma_number
from triscope.operators.packed import split_packed
from triscope.operators.sequences import line_context, line_continued, lines, segments
from triscope.plans.views import checks_now
from triscope.sources.tables import table

_FACT = r"([0-9]+(?:,[0-9]+)?) (мм|кВт|м²|шт)"
_CODE = r"[0-9]{2}-[0-9]{2}/[0-9]{2}-([А-Я]{2})[0-9]"


def _texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", *columns)


def q_line_context(spark: SparkSession, d: str) -> DataFrame:
    """Lines that name a level, with the lines around them."""
    return line_context(_texts(spark, d), "doc_id", "text").where(F.lower("line").contains("отметк")).select("doc_id", "line_no", F.md5("context").alias("context_md5"))


def q_line_continued(spark: SparkSession, d: str) -> DataFrame:
    """Lines that end no sentence, with the next one."""
    rows = line_continued(_texts(spark, d), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("joined")).alias("n_chars"))


def q_segments(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a document that start at an empty line."""
    return segments(_texts(spark, d), "doc_id", "text", lambda x: x == "").groupBy("doc_id", "segment").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def q_number_facts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with their units in the texts: how many, and their span, by stage and unit."""
    found = _texts(spark, d, "stage").select("stage", F.explode(F.regexp_extract_all("text", F.lit(_FACT), F.lit(0))).alias("m"))
    facts = found.select("stage", F.regexp_extract("m", _FACT, 2).alias("unit"), comma_number(F.col("m")).alias("v"))
    return facts.groupBy("stage", "unit").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))


def q_code_frequency(spark: SparkSession, d: str) -> DataFrame:
    """The marks of set codes in the texts by frequency."""
    found = _texts(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_CODE), F.lit(1))).alias("mark"))
    return found.groupBy("mark").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def q_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold a digit and two or more stems of a parameter's name, counted per parameter.

    Lines and names meet on stems, each stem of a line once; the names are a fixed list.
    """
    stems = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit("([а-яё]{5,})"), F.lit(1)), lambda w: F.substring(w, 1, 5)))
    names = table(spark, d, "param_catalog", "parameter_code", "parameter_name").select("parameter_code", F.explode(stems(F.col("parameter_name"))).alias("stem"))
    ls = lines(_texts(spark, d), "doc_id", "text").where(F.col("line").rlike("[0-9]")).select("doc_id", "line_no", F.explode(stems(F.col("line"))).alias("stem"))
    hits = ls.join(F.broadcast(names), "stem").groupBy("parameter_code", "doc_id", "line_no").agg(F.count("*").alias("n")).where("n >= 2")
    return hits.groupBy("parameter_code").agg(F.count("*").alias("n_lines"), F.countDistinct("doc_id").alias("n_docs"))


def q_short_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with next to no text, by stage."""
    return _texts(spark, d, "stage").groupBy("stage").agg(F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) < 80).alias("n_short"), F.count("*").alias("n_docs"))


def q_equal_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts under more than one document, and over how many objects they spread."""
    t = _texts(spark, d, "object_id").where("text <> ''")
    return t.groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n_docs"), F.countDistinct("object_id").alias("n_objects")).where("n_docs > 1")


def q_near_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the texts that nearly equal a stated word."""
    words = _texts(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([а-яё]{4,})"), F.lit(1))).alias("word"))
    return near(words, ["отметка", "замечание", "показатель", "ведомость", "исполнительная"]).select("word", "target", F.round("ratio", 6).alias("ratio"))


def q_near_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which a phrase stands nearly as stated."""
    return has_phrase(_texts(spark, d, "stage"), "text", ["замечание", "снято"]).groupBy("stage").agg(F.count_if("found").alias("n_found"))


def q_system_marks(spark: SparkSession, d: str) -> DataFrame:
    """Marks of systems in single and packed values: how often each system is named."""
    c = checks_now(spark, d, "pd_value").where("pd_value is not null").select("check_id", "pd_value")
    marks = split_packed(c, "pd_value", singles=True).select("check_id", F.explode(parse_marks(F.col("item"))).alias("mark"))
    return marks.groupBy(system_of(F.col("mark")).alias("system")).agg(F.count("*").alias("n"), F.countDistinct("check_id").alias("n_checks"))


def q_character_errors(spark: SparkSession, d: str) -> DataFrame:
    """Character agreement of design and working value where they say the same, by label and over all.

    Without SQL: the edit distance at hand there counts bytes, not characters; tests/test_edit_distance.py has a brute-force twin.
    """
    c = checks_now(spark, d, "violation_label", "pd_value", "rd_value").where("pd_value is not null and rd_value is not null")
    edits = c.select("violation_label", F.levenshtein("pd_value", "rd_value").alias("e"), F.length("pd_value").alias("n"))
    sums = edits.groupingSets([["violation_label"], []], "violation_label").agg(F.grouping("violation_label").alias("overall"), F.sum("e").alias("edits"), F.sum("n").alias("chars"), F.count_if(F.col("e") == 0).alias("n_exact"), F.count("*").alias("n"))
    return sums.withColumn("accuracy", F.round(1 - F.try_divide(F.col("edits").cast("double"), F.col("chars")), 9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("q_")}


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL)"
_AROUND = f"WITH {_LINES}, w AS (SELECT *, lag(line) OVER k AS before, lead(line) OVER k AS after FROM l WINDOW k AS (PARTITION BY doc_id ORDER BY line_no))"
_STEMS = "list_distinct(list_transform(regexp_extract_all(lower({0}), '([а-яё]{{5,}})', 1), lambda w: substr(w, 1, 5)))"


def oracle_sql() -> dict[str, str]:
    return {
        "q_line_context": _AROUND + " SELECT doc_id, line_no, md5(concat_ws(' | ', line, before, after)) AS context_md5 FROM w WHERE contains(lower(line), 'отметк')",
        "q_line_continued": _AROUND + r" SELECT doc_id, count(*) AS n_lines, CAST(sum(length(CASE WHEN regexp_matches(line, '[.;!?:]\s*$') THEN line ELSE concat_ws(' ', line, after) END)) AS BIGINT) AS n_chars FROM w GROUP BY doc_id",
        "q_segments": f"WITH {_LINES}, s AS (SELECT doc_id, line, CAST(count(*) FILTER (line = '') OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM l) SELECT doc_id, segment, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM s GROUP BY 1, 2",
        "q_number_facts": f"WITH m AS (SELECT stage, unnest(regexp_extract_all(text, '{_FACT}', 0)) AS m FROM documents), v AS (SELECT stage, regexp_extract(m, '{_FACT}', 2) AS unit, CAST(replace(regexp_extract(m, '{_FACT}', 1), ',', '.') AS DOUBLE) AS v FROM m) SELECT stage, unit, count(*) AS n, min(v) AS least, max(v) AS most FROM v GROUP BY 1, 2",
        "q_code_frequency": f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_CODE}', 1)) AS mark FROM documents) SELECT mark, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY mark",
        "q_cooccurrence": f"WITH {_LINES}, p AS (SELECT parameter_code, unnest({_STEMS.format('parameter_name')}) AS stem FROM param_catalog), s AS (SELECT doc_id, line_no, unnest({_STEMS.format('line')}) AS stem FROM l WHERE regexp_matches(line, '[0-9]')), h AS (SELECT parameter_code, doc_id, line_no FROM s JOIN p USING (stem) GROUP BY ALL HAVING count(*) >= 2) SELECT parameter_code, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM h GROUP BY 1",
        "q_short_texts": "SELECT stage, count(*) FILTER (length(trim(coalesce(text, ''))) < 80) AS n_short, count(*) AS n_docs FROM documents GROUP BY stage",
        "q_equal_texts": "SELECT md5(text) AS text_md5, count(*) AS n_docs, count(DISTINCT object_id) AS n_objects FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1",
    }
