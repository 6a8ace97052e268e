"""Findings about a registry of files: one aggregation per family, one row per object, type and detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triscope.operators.records import duplicates

#: Names of temporary files; callers may give another pattern.
TEMPORARY = r"(?i)(^|/)(~\$|\.~)|\.(tmp|bak|dwl2?|log|db|crdownload)$|(^|/)(desktop\.ini|\.ds_store)$"
STAGES = ("PD", "RD", "ID")


def _rows(df: DataFrame, kind: str, detail: Column, n: Column) -> DataFrame:
    return df.select("oid", F.lit(kind).alias("type"), detail.alias("detail"), n.cast("bigint").alias("n"))


def findings(files: DataFrame, staged: DataFrame, temporary_names: str = TEMPORARY) -> DataFrame:
    """oid, type, detail, n. ``files`` has fid, oid, stage, original_name, relative_path, size_bytes, sha256; ``staged`` oid, section
    and s, one row per stage that a file counts for. Files without an object fall away."""
    f = files.where("oid is not null")
    one = lambda cond, kind, detail=F.lit(""): _rows(f.where(cond).groupBy("oid", F.coalesce(detail, F.lit("")).alias("d")).agg(F.count("*").alias("n")), kind, F.col("d"), F.col("n"))
    base = F.element_at(F.split("relative_path", "/"), -1)
    empty = one(F.coalesce("size_bytes", F.lit(0)) == 0, "EMPTY_OR_UNREADABLE", F.col("stage"))
    temporary = one(F.col("relative_path").rlike(temporary_names), "TEMPORARY_ARTIFACT")
    renamed = one(base != F.col("original_name"), "NAME_DIFFERS_FROM_PATH")
    kinds = duplicates(f.withColumnsRenamed({"oid": "objects", "stage": "stages"}), "sha256", "objects", "stages").select("sha256", "kind")
    repeated = _rows(f.join(kinds, "sha256").groupBy("oid", "kind").agg(F.count("*").alias("n")), "EXACT_DUPLICATES", F.col("kind"), F.col("n"))
    present = staged.groupBy("oid").agg(F.collect_set("s").alias("there"))
    missing = _rows(present.select("oid", F.explode(F.array_except(F.array(*map(F.lit, STAGES)), "there")).alias("d")), "STAGE_MISSING", F.col("d"), F.lit(1))
    section = staged.where("section is not null and section <> 'OTHER'").groupBy("oid", "section").agg(F.count_if(F.col("s") == "PD").alias("p"), F.count_if(F.col("s") == "RD").alias("r"))
    lacking = _rows(section.where("p > 0 and r = 0"), "DISCIPLINE_MISSING_IN_RD", F.col("section"), F.col("p"))
    out = empty
    for part in (temporary, renamed, repeated, missing, lacking):
        out = out.unionByName(part)
    return out


def compact(lists: Column, n: int | None = 20) -> Column:
    """The first ``n`` members of a list, all for None."""
    return lists if n is None else F.slice(lists, 1, n)
