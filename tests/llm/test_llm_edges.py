"""The queries of the package over odd tables: empty ones, rows of nulls, further columns whose names clash with inner ones."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from triscope.llm.queries import queries

CLASHING = {n: "string" for n in ("text", "words", "field", "chain", "plain", "key", "subject_code", "repaired", "pattern")} | {n: "int" for n in ("pos", "terms", "counts", "n_tokens", "size", "part", "rank", "spoilt", "id", "item_id", "token", "docs", "sentences", "latin", "e")}


def spoil(spark, folder, to, kind):
    for path in glob.glob(f"{folder}/*.parquet"):
        df = spark.read.parquet(path)
        if kind == "empty":
            df = df.limit(0)
        elif kind == "nulls":
            df = df.limit(4).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields)).unionByName(df.limit(3)).unionByName(df.limit(3))
        else:
            df = df.withColumns({c: F.lit("7").cast(t) for c, t in CLASHING.items() if c not in df.columns})
        df.coalesce(1).write.parquet(f"{to}/{os.path.basename(path)}")
    return str(to)


@pytest.mark.parametrize("kind", ["empty", "nulls", "clash"])
def test_odd_tables(spark, data, tmp_path, kind):
    odd = spoil(spark, data, tmp_path, kind)
    for name, query in ((n, q) for n, q in queries().items() if n.endswith(("found", "mixture", "shares"))):
        rows = query(spark, odd).collect()
        if kind == "empty":
            assert rows == [], name
        elif kind == "clash":
            assert sorted(map(str, rows)) == sorted(map(str, query(spark, data).collect())), name
