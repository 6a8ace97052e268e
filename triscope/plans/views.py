"""Views that several queries start from: current files, current checks, evidence rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triscope.functions.keys import clean_key
from triscope.operators.records import current
from triscope.sources.tables import table


def files_now(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The last received row of each file, with clean keys fid and oid."""
    wanted = dict.fromkeys(["file_id", "object_id", "received_at", *columns])
    df = table(spark, d, "files", *wanted)
    return current(df, clean_key(F.col("file_id")), [F.col("received_at"), F.col("file_id")], "fid").withColumn("oid", clean_key(F.col("object_id")))


def checks_now(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The last received row of each check, with the clean key oid."""
    wanted = dict.fromkeys(["check_id", "object_id", "received_at", *columns])
    df = table(spark, d, "checks", *wanted)
    return current(df, F.col("check_id"), [F.col("received_at"), F.coalesce("object_id", F.lit(""))], "cid").withColumn("oid", clean_key(F.col("object_id")))


def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per evidence entry of the current checks, with its place."""
    rows = checks_now(spark, d, "evidence").select("check_id", "oid", F.posexplode("evidence").alias("ord", "v")).where("v is not null")
    return rows.select("check_id", "oid", "ord", F.col("v.stage").alias("stage"), clean_key(F.col("v.file_id")).alias("fid"), F.col("v.pdf_page_number").alias("page"), F.col("v.bbox_norm").alias("box"), F.col("v.fragment").alias("fragment"))
