"""Readers: JSON lines and whole JSON files, registries in CSV, binary files with their kind and digest, archive members."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "path string, member string, size bigint, readable boolean"
#: First bytes of 7z and rar.
OTHER_ARCHIVES = (b"7z\xbc\xaf\x27\x1c", b"Rar!\x1a\x07")


def json_lines(spark: SparkSession, path: str, schema: str, keep_broken: bool = False) -> DataFrame:
    """Rows of a JSON lines file or folder. Blank lines are skipped; broken ones fall away, or stand in ``broken`` alone."""
    df = spark.read.schema(f"{schema}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return df if keep_broken else df.where("broken is null").drop("broken")


def whole_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file, or per element where the file holds a list."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def registry_csv(spark: SparkSession, paths: str | list[str], schema: str, separator: str = ";") -> DataFrame:
    """Rows of registries with a header, with the file each comes from."""
    return spark.read.schema(schema).option("header", True).option("sep", separator).option("enforceSchema", False).csv(paths).withColumn("registry", F.input_file_name())


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modified, length, content of the files below a folder. Files without bytes give no row."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).withColumnRenamed("modificationTime", "modified")


def kind_of_content(content: Column) -> Column:
    """pdf, zip, xml or unknown, by the bytes at either end; empty for no bytes."""
    head, tail = F.substring(content, 1, 1024), F.substring(content, -1024, 1024)
    text = lambda b: F.decode(b, "ISO-8859-1")
    start = F.regexp_replace(text(head), r"^(ï»¿)?\s+", "")
    return (
        F.when(F.length(content) == 0, "empty")
        .when(start.startswith("%PDF-") & text(tail).contains("%%EOF"), "pdf")
        .when(F.substring(content, 1, 4) == F.unhex(F.lit("504B0304")), "zip")
        .when(F.regexp_replace(start, "^ï»¿", "").startswith("<"), "xml")
        .otherwise("unknown")
    )


def digests(files: DataFrame) -> DataFrame:
    """path, length, sha256 and kind of binary files."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), kind_of_content(F.col("content")).alias("kind"))


def archive_members(files: DataFrame) -> DataFrame:
    """``MEMBERS``: one row per file within each archive (path, content). An archive that can't be read gives one row,
    with ``readable`` false; 7z and rar, told by their first bytes, aren't supported: one row with ``readable`` null.

    Names that an old archiver wrote in the Russian DOS encoding are put right, which the archive's own flag tells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.infolist():
                            if not m.is_dir():
                                name = m.filename
                                if not m.flag_bits & 0x800:
                                    try:
                                        name = name.encode("cp437").decode("cp866")
                                    except UnicodeError:
                                        pass
                                rows.append((path, name, m.file_size, True))
                except (zipfile.BadZipFile, TypeError, OSError):
                    rows.append((path, None, None, None if content and content.startswith(OTHER_ARCHIVES) else False))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "member", "size", "readable"])

    return files.select("path", "content").mapInArrow(run, MEMBERS)


def compare_members(expected: DataFrame, there: DataFrame, key: str = "member", size: str = "size") -> DataFrame:
    """Each expected or present name with ok, missing, extra or size."""
    a, b = expected.select(key, F.col(size).alias("__a"), F.lit(1).alias("__e")), there.select(key, F.col(size).alias("__b"), F.lit(1).alias("__t"))
    state = F.when(F.col("__t").isNull(), "missing").when(F.col("__e").isNull(), "extra").when(F.col("__a").eqNullSafe(F.col("__b")), "ok").otherwise("size")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def new_rows(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last incoming row of each key that isn't there yet."""
    row = F.struct(*(F.col(f"`{c}`") for c in incoming.columns))
    last = incoming.groupBy(*key).agg(F.max_by(row, F.struct(*order)).alias("__r")).select("__r.*")
    return last.join(existing.select(*key).distinct(), key, "left_anti")
