"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, chosen so that the source's tokens make up its share of the
whole. The documents of a source stand in a fixed order (size class, then a hash); the expected copies are summed along it,
one random offset per source is added, and a document is emitted once for each whole number that the sum passes at it. As the
order runs through the sizes, the tokens drawn come close to what is expected.

The sums are prefix sums over two levels: within buckets (source, size class, hash) of about ``BUCKET_DOCS`` documents, whose number
comes from the measured size of each class, and over the table of buckets, which has a row for each so many documents. So no task
ever holds a whole source or class, however large it is.

Size: unless ``total_tokens`` is given, the mixture is as large as the targets allow with no source over its cap; all shares
are then met up to one document per size class. With a larger ``total_tokens`` the capped sources fall short, and the report
shows by how much. Targets of sources without text can't be met; the others keep their proportions.

Cases: sources are compared in lower case without outer white space. Null, unknown and unweighted sources, and null and empty
texts, are left out. Weights that are null, negative or zero, or whose cap is below one, draw nothing. A source listed
twice has the sum of its shares and the larger cap. Repeated rows count once. No documents or no weights: an empty mixture.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from triscope.sources.scratch import written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern of public byte-level tokenizers that cuts text before the merges; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a bucket, about.
BUCKET_DOCS = 200_000
_made: dict[int, object] = {}


def source_key(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), F.lit(""))


def _encoding(ranks: bytes):
    key = hash(ranks)
    if key not in _made:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        _made[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _made[key]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens of the documents with a source and text. ``tokenizer`` is a rank file that the driver reads."""
    with open(tokenizer, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())  # one file of a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(sent.value).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t)) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "source", "n_tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").where("source is not null and text <> ''")
    return rows.mapInArrow(run, f"doc_id {kind}, source string, n_tokens bigint")


def plan(counts: DataFrame, weights: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per weighted source: share, cap, documents and tokens there, and the expected copies of each document."""
    wanted = weights.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats >= 1").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    there = counts.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    every = W.partitionBy()  # as many rows as weighted sources
    plan = wanted.join(there, "source", "left").withColumn("share", F.col("target_share") / F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(every))
    most = F.min(F.when(F.col("tokens") > 0, F.col("max_repeats") * F.col("tokens") / F.col("share"))).over(every)
    total = F.lit(float(total_tokens)) if total_tokens is not None else most
    return plan.withColumn("expected", F.when(F.col("tokens") > 0, F.least(F.col("max_repeats").cast("double"), F.col("share") * total / F.col("tokens"))).otherwise(F.lit(0.0))).drop("share")


def sample(counts: DataFrame, planned: DataFrame, seed: int = 0, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """doc_id, source, n_tokens, copies of the chosen documents."""
    size = F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1))) * 4).cast("int")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("n_tokens"))
    sized = counts.join(F.broadcast(planned.select("source", "expected", "max_repeats")), "source").where("expected > 0 and n_tokens > 0").withColumn("size", size)
    classes = sized.groupBy("source", "size").agg(F.ceil(F.count("*") / bucket_docs).alias("spread"))  # weighted sources times size classes
    rows = sized.join(F.broadcast(classes), ["source", "size"]).withColumn("part", F.pmod(order, F.col("spread")).cast("int")).drop("spread")
    buckets = rows.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("source").orderBy("size", "part").rowsBetween(W.unboundedPreceding, -1)  # buckets, not rows
    starts = buckets.select("source", "size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(W.partitionBy("source", "size", "part").orderBy(order, "doc_id"))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(1 << 53)) / float(1 << 53)
    sums = rows.withColumn("rank", rank).join(F.broadcast(starts), ["source", "size", "part"]).withColumn("upto", (F.col("start") + F.col("rank")) * F.col("expected") + offset)
    # the sum before a document is taken anew from its rank, so that no whole number is passed twice or not at all
    copies = F.least(F.floor("upto") - F.floor((F.col("start") + F.col("rank") - 1) * F.col("expected") + offset), F.col("max_repeats").cast("bigint"))
    return sums.select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def mixture(documents: DataFrame, weights: DataFrame, tokenizer: str = TOKENIZER, total_tokens: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The chosen documents, and the report: target and reached share of each weighted source."""
    counts = written(token_counts(documents, tokenizer).distinct(), "tokens")
    planned = plan(counts, weights, total_tokens)
    chosen = sample(counts, planned, seed)
    drawn = chosen.groupBy("source").agg(F.count("*").alias("n_chosen"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_drawn"))
    report = planned.join(drawn, "source", "left").fillna(0, ["n_docs", "tokens", "n_chosen", "n_copies", "most_copies", "tokens_drawn"])
    return chosen, report.withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens_drawn").cast("double"), F.sum("tokens_drawn").over(W.partitionBy())), F.lit(0.0)))
