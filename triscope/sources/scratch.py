"""Intermediate tables in the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only a local session that has none (tests, notebooks) gets a
temporary folder; on a cluster a missing setting is an error, as a machine-local folder would lose data with its machine.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: File systems and paths of what was written; they outlive a stopped session.
_made: list[tuple[object, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; it is also set as the context's own where that is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="triscope-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the driver ends."""
    path = f"{shared_dir(spark)}/triscope-{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _made.append((place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back.

    This cuts lineage, survives the loss of executors, and later readers read only the columns they need. The tables are
    removed when the driver ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Remove all tables written so far. For long sessions: call it once the results that rest on them are written."""
    while _made:
        fs, place = _made.pop()
        try:
            fs.delete(place, True)
        except Exception:  # the JVM may be gone
            pass
