"""A cache addressed by content: what was computed once for a content is never computed again, whichever row brings it.

The key of a content is a digest over it and over the name of the computation's version, so that a new version begins anew. Results
are kept as complete versions (``sinks.write_version``): a run that breaks leaves nothing behind that a reader sees.

Cases: null content has no key and no result; equal contents are computed once; an empty input computes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triscope.sources.sinks import versions, write_version

KEY = "cache_key"


def content_key(content: Column, version: str) -> Column:
    """Digest of a content and of the version of what is computed from it."""
    return F.sha2(F.concat(F.lit(version + "\x00"), content), 256)


def cached(rows: DataFrame, content: str, version: str, compute: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, int]:
    """``rows`` with the columns that ``compute`` gives of their content, and for how many contents it ran.

    ``compute`` gets the contents that aren't there yet, each once, as a table of ``cache_key`` and ``content``; its result must keep
    ``cache_key``. A row with null content gets nulls.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn(KEY, content_key(F.col(f"`{content}`"), version))
    wanted = keyed.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.first(F.col(f"`{content}`")).alias("content"))
    there = _held(spark, path)
    fresh = wanted if there is None else wanted.join(there.select(KEY), KEY, "left_anti")
    number = write_version(compute(fresh), path)
    ran = spark.read.parquet(f"{path}/v={number}").count()
    return keyed.join(_held(spark, path), KEY, "left").drop(KEY), ran


def _held(spark, path: str) -> DataFrame | None:
    """All results of complete versions."""
    complete = versions(spark, path)
    return spark.read.parquet(*(f"{path}/v={n}" for n in complete)) if complete else None
