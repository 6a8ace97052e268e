"""Records that arrive repeatedly, late, and in revisions: current rows, newest revisions, duplicates, versions.

All of these are aggregations with map-side combine (``max_by`` over structs), not windows, so that a key that holds a third
of the rows is combined before it moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def current(df: DataFrame, key: Column, order: list[Column], name: str = "key") -> DataFrame:
    """The last row of each key by ``order`` (nulls first). Rows with a null key fall away; ``name`` is added."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != name))
    picked = df.withColumn("__key", key).where("__key is not null").groupBy("__key").agg(F.max_by(row, F.struct(*order)).alias("r"))
    return picked.select(F.col("__key").alias(name), "r.*")


def newest_revision(df: DataFrame, group: list[str], order: list[Column], pick: str) -> DataFrame:
    """Per group the ``pick`` of the row that is last by ``order``, and how many rows the group has."""
    return df.groupBy(*group).agg(F.max_by(pick, F.struct(*order)).alias(pick), F.count("*").alias("n_rows"))


def revision_conflicts(df: DataFrame, group: list[str], revision: str, content: str) -> DataFrame:
    """Groups whose highest revision stands on rows of different content."""
    per = df.groupBy(*group, revision).agg(F.count("*").alias("n_rows"), F.countDistinct(content).alias("n_contents"))
    top = per.groupBy(*group).agg(F.max(F.struct(F.col(revision), F.col("n_rows"), F.col("n_contents"))).alias("t"))
    return top.where("t.n_rows > 1 and t.n_contents > 1").select(*group, *(F.col("t")[c].alias(c) for c in (revision, "n_rows", "n_contents")))


def duplicates(df: DataFrame, content: str, wide: str, narrow: str) -> DataFrame:
    """Contents on more than one row, and whether they spread over ``wide`` groups, over ``narrow`` ones, or lie within one."""
    groups = df.where(F.col(content).isNotNull()).groupBy(content).agg(F.count("*").alias("n_rows"), F.countDistinct(wide).alias("n_wide"), F.countDistinct(narrow).alias("n_narrow"))
    kind = F.when(F.col("n_wide") > 1, "across_" + wide).when(F.col("n_narrow") > 1, "across_" + narrow).otherwise("within")
    return groups.where("n_rows > 1").withColumn("kind", kind)


def first_of_content(df: DataFrame, group: list[str], order: list[Column], key: str) -> DataFrame:
    """Each row with ``accepted``: whether it is the first of its content within its group."""
    first = df.groupBy(*group).agg(F.min_by(key, F.struct(*order)).alias("__first"))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    return df.alias("a").join(first.alias("b"), same).select("a.*", (F.col(f"a.{key}") == F.col("b.__first")).alias("accepted"))


def content_hash(df: DataFrame, group: str, order: list[str], line: Column, bucket: Column) -> DataFrame:
    """One hash per group over its ordered lines, made in two levels: lines of a bucket, then buckets.

    ``bucket`` must be a prefix of the order (equal buckets adjoin) that holds a bounded number of lines, so that no list of
    lines grows with the group.
    """
    sorted_lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    low = df.withColumn("__bucket", bucket).groupBy(group, "__bucket").agg(F.sha2(F.array_join(F.transform(sorted_lines, lambda x: x["line"]), "\n"), 256).alias("h"), F.count("*").alias("n"))
    high = F.array_sort(F.collect_list(F.struct("__bucket", "h")))
    return low.groupBy(group).agg(F.sha2(F.array_join(F.transform(high, lambda x: x["h"]), "\n"), 256).alias("content_hash"), F.sum("n").alias("n_rows"))


def overlay(base: DataFrame, new: DataFrame, code: str, place: str, replaceable: Column) -> DataFrame:
    """``base`` under ``new``: rows of the same code and place give way, as do ``replaceable`` rows of a code that ``new`` has."""
    keys = new.select(code, place).distinct().withColumnsRenamed({code: "__c", place: "__p"})
    codes = new.select(F.col(code).alias("__c")).distinct()
    rest = base.join(keys, base[code].eqNullSafe(F.col("__c")) & base[place].eqNullSafe(F.col("__p")), "left_anti")
    flagged = rest.withColumn("__r", F.coalesce(replaceable, F.lit(False)))
    kept = flagged.join(codes, flagged[code].eqNullSafe(F.col("__c")) & F.col("__r"), "left_anti").drop("__r")
    return kept.unionByName(new)


def carried(df: DataFrame, key: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Each version with ``outcome``: first, carried (all of ``same`` as in the version before, nulls equal) or reset."""
    w = W.partitionBy(*key).orderBy(*order)
    state = F.struct(*same)
    rows = df.withColumn("version", F.row_number().over(w)).withColumn("__before", F.lag(state).over(w))
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col("__before")[c])
    outcome = F.when(F.col("version") == 1, "first").when(equal, "carried").otherwise("reset")
    return rows.withColumn("outcome", outcome).drop("__before")


def multiset_difference(left: DataFrame, right: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per group and value how often it stands left and right, matched one to one: common, lost, added. By counts, not pairs."""
    a = left.groupBy(*group, value).agg(F.count("*").alias("l"))
    b = right.groupBy(*group, value).agg(F.count("*").alias("r"))
    both = a.join(b, [*group, value], "full_outer").fillna(0, ["l", "r"])
    return both.select(*group, value, F.least("l", "r").alias("common"), F.greatest(F.col("l") - F.col("r"), F.lit(0)).alias("lost"), F.greatest(F.col("r") - F.col("l"), F.lit(0)).alias("added"))
