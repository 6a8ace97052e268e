"""Queries p3, p4, p6, p7 and p8 over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triscope.functions.keys import clean_key
from triscope.functions.lookalikes import FROM_GREEK, LOOSE, TO_LATIN, TO_RUSSIAN
from triscope.llm import mojibake
from triscope.llm.canonical import changed, with_plain
from triscope.llm.leakage import leaks
from triscope.llm.mixture import mixture
from triscope.llm.subjects import assign_subjects
from triscope.sources.tables import table


def _names(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files", "file_id", "source", "original_name", "relative_path")
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("original_name", "relative_path")))
    return files.select(clean_key(F.col("file_id")).alias("file_id"), "source", F.inline(pairs)).distinct()


def p3_repairs(spark: SparkSession, d: str) -> DataFrame:
    """The spoilt names and paths with their repaired form."""
    return mojibake.repair(_names(spark, d), "file_id").where("spoilt >= 0.5").select("file_id", "field", "text", "repaired", "chain")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields of files of which some part was decoded wrongly."""
    return mojibake.repair(_names(spark, d), "file_id").where("spoilt >= 0.5").select("file_id", "field").distinct()


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    """check_id, field, pos, text of the values and the evidence's fragments."""
    checks = table(spark, d, "checks", "check_id", "pd_value", "rd_value", "evidence")
    own = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(-1).cast("bigint").alias("pos"), F.col(c).alias("text")) for c in ("pd_value", "rd_value")))
    fragments = F.transform("evidence", lambda e, i: F.struct(F.lit("evidence.fragment").alias("field"), i.cast("bigint").alias("pos"), e["fragment"].alias("text")))
    return checks.select("check_id", F.inline(F.concat(own, F.coalesce(fragments, F.array())))).where("text is not null")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values and fragments that aren't in plain form."""
    return changed(_fragments(spark, d), "text").select("check_id", "field", "pos").distinct()


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Checks whose design and working value are equal as stored, and in plain form, by violation label."""
    checks = table(spark, d, "checks", "check_id", "violation_label", "pd_value", "rd_value").where("pd_value is not null and rd_value is not null").distinct()
    plain = with_plain(checks, {"pd_value": "pd_plain", "rd_value": "rd_plain"})
    return plain.groupBy("violation_label").agg(F.count("*").alias("n"), F.count_if(F.col("pd_value") == F.col("rd_value")).alias("n_equal_stored"), F.count_if(F.col("pd_plain") == F.col("rd_plain")).alias("n_equal_plain"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items of which they hold twelve words in a row."""
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked: documents and distinct windows found of each."""
    return _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("window_no").alias("n_windows"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixture(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "source_weights"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents with their copies."""
    return _mixture(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each weighted source."""
    return _mixture(spark, d)[1]


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return assign_subjects(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "subjects"), table(spark, d, "subject_labels", "doc_id", "subject_code"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of each document."""
    return _subjects(spark, d)


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """The make-up of the corpus by subject: documents, and characters shared evenly among a document's subjects."""
    of = _subjects(spark, d)
    size = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.length("text").alias("chars"))
    shares = of.join(of.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id").join(size, "doc_id")
    return shares.groupBy("subject_code").agg(F.count("*").alias("n_docs"), F.sum(F.col("chars") / F.col("n")).alias("chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_repairs, p4_found, p4_agreement, p6_found, p6_items, p7_mixture, p7_shares, p8_found, p8_composition)}


def _translated(c: str, pairs: dict[str, str]) -> str:
    kept = {a: b for a, b in pairs.items() if "'" not in a + b}
    return f"translate({c}, '{''.join(kept)}', '{''.join(kept.values())}')"


_WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_RUSSIAN_ONLY = "".join(chr(c) for c in [*range(0x410, 0x450), 0x401, 0x451] if chr(c) not in TO_LATIN)
_ALIKE = "".join(TO_LATIN) + "".join(TO_RUSSIAN)


def _plain_sql(c: str) -> str:
    """The plain form of a text; characters that the test tables don't hold are left aside."""
    shown = f"nfc_normalize({_translated(f"regexp_replace(regexp_replace({c}, '\\p{{Cf}}', '', 'g'), '\\p{{Zs}}', ' ', 'g')", _WIDE | FROM_GREEK)})"
    letters = "regexp_replace(w, '[^\\p{L}]', '', 'g')"
    word = f"CASE WHEN regexp_matches(w, '[{_RUSSIAN_ONLY}]') OR regexp_full_match({letters}, '[{_ALIKE}]*') THEN {_translated('w', TO_RUSSIAN)} ELSE {_translated('w', TO_LATIN)} END"
    return f"array_to_string(list_transform(regexp_extract_all({shown}, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+'), lambda w: {word}), '')"


def _words_sql(c: str) -> str:
    """The words of a text as they read."""
    return f"regexp_extract_all({_translated(f"strip_accents(regexp_replace(lower(nfc_normalize({c})), '[\\p{{Cf}}\\p{{Mn}}]', '', 'g'))", LOOSE | {'ё': 'е', 'й': 'и'})}, '[\\p{{L}}\\p{{N}}]+')"


def oracle_sql() -> dict[str, str]:
    fragments = """t AS (SELECT check_id, 'pd_value' AS field, -1 AS pos, pd_value AS t FROM checks UNION ALL SELECT check_id, 'rd_value', -1, rd_value FROM checks
UNION ALL SELECT check_id, 'evidence.fragment', i - 1, e.fragment FROM (SELECT check_id, unnest(evidence) AS e, generate_subscripts(evidence, 1) AS i FROM checks))"""
    broken = "(\\w|[а-яёА-ЯЁ])[-‐‑\xad][ \\t]*\\r?\\n\\s*"
    grams = lambda key, rows: f"SELECT DISTINCT {key}, array_to_string(w[i + 1:i + 12], ' ') AS g FROM (SELECT {key}, w, unnest(range(greatest(len(w) - 11, 0))) AS i FROM ({rows}))"
    both = lambda key, name: f"SELECT {key}, {_words_sql('text')} AS w FROM {name} WHERE text IS NOT NULL UNION ALL SELECT {key}, {_words_sql(f"regexp_replace(text, '{broken}', '\\1', 'g')")} FROM {name} WHERE contains(text, chr(10))"
    found = f"WITH d AS ({grams('doc_id', both('doc_id', 'documents'))}), i AS ({grams('item_id', both('item_id', 'eval_items'))}) "
    return {
        "p4_found": f"WITH {fragments} SELECT DISTINCT check_id, field, CAST(pos AS BIGINT) AS pos FROM t WHERE {_plain_sql('t')} <> t",
        "p4_agreement": f"WITH c AS (SELECT DISTINCT check_id, violation_label, pd_value, rd_value FROM checks WHERE pd_value IS NOT NULL AND rd_value IS NOT NULL) SELECT violation_label, count(*) AS n, count(*) FILTER (pd_value = rd_value) AS n_equal_stored, count(*) FILTER ({_plain_sql('pd_value')} = {_plain_sql('rd_value')}) AS n_equal_plain FROM c GROUP BY 1",
        "p6_items": found + f", n AS (SELECT item_id, k, array_to_string(w[k + 1:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 11, 0))) AS k FROM (SELECT item_id, {_words_sql('text')} AS w FROM (SELECT DISTINCT item_id, text FROM eval_items) WHERE text IS NOT NULL))) SELECT item_id, count(DISTINCT doc_id) AS n_docs, count(DISTINCT k) AS n_windows FROM n JOIN d USING (g) GROUP BY 1",
        "p6_found": found + "SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)",
    }
