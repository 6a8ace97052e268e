"""Runs a stream over what is there and gives its result as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from triscope.sources.scratch import shared_path


def finished(spark: SparkSession, folder: str, query: Callable[[DataFrame], DataFrame], mode: str, files: int = 1) -> DataFrame:
    """The output of ``query`` over the Parquet files at ``folder``, read as a stream of ``files`` at a time until none is left.

    In append and update mode all rows that came out, with the number of their batch; in complete mode the last result. State and
    output are in the shared folder; a batch that is repeated after a failure overwrites its own output.
    """
    schema = spark.read.parquet(folder).schema
    out = shared_path(spark, "stream")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    single = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(path)  # a stream reads folders
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    stream = source.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString()) if single else source.parquet(folder)
    kind = query(stream).schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={0 if mode == 'complete' else number}")

    running = query(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    running.awaitTermination()
    full = T.StructType([*kind.fields, T.StructField("batch", T.IntegerType())])
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/data")
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", f"{out}/data").parquet(f"{out}/data")
