"""Sinks: folders per object, versions that appear whole or not at all, small reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT_ROWS = 100_000


def by_object(df: DataFrame, path: str, key: str = "object_id", rows_per_file: int = 2_000_000) -> None:
    """One folder per object, in files of about ``rows_per_file`` rows: an object is spread over as many parts as its measured size
    needs, so that no task holds a large object and a small one makes one file."""
    counts = df.groupBy(key).agg(F.ceil(F.count("*") / rows_per_file).alias("__parts")).where("__parts > 1")  # a row for each so many rows at most
    named = F.broadcast(counts.select(F.col(key).alias("__k"), "__parts"))
    spread = df.join(named, F.col(f"`{key}`").eqNullSafe(F.col("__k")), "left").withColumn("__part", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.coalesce("__parts", F.lit(1))))
    spread.repartition(F.col(key), F.col("__part")).select(*(F.col(f"`{c}`") for c in df.columns)).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(key).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions below a path."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[1]))


def write_version(df: DataFrame, path: str) -> int:
    """``df`` as the next version. Readers take complete versions only, so a broken write is never seen; its number isn't used again."""
    spark = df.sparkSession
    fs, p = _fs(spark, path)
    taken = [int(n[2:]) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("v=") and n[2:].isdigit()] if fs.exists(p) else []
    number = max(taken, default=0) + 1
    df.write.parquet(f"{path}/v={number}")
    return number


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A version, the last complete one by default."""
    there = versions(spark, path)
    if not there or (number is not None and number not in there):
        raise FileNotFoundError(f"no complete version at {path}")
    return spark.read.parquet(f"{path}/v={number or there[-1]}")


def report(df: DataFrame, path: str) -> None:
    """A small table as one indented JSON file that the driver writes; refused beyond ``REPORT_ROWS`` rows."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError("too long for a report")
    text = json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=2, default=str)
    fs, p = _fs(df.sparkSession, path)  # any file system that Spark can write to
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
