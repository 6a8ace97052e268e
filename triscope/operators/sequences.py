"""Ordered rows: islands, intervals, trailing counts, order statistics, folds, context of lines.

Keys may be hot (one may hold a third of all rows), so the operators over time cut each key into chunks: a chunk is solved by
itself and the chunks' edges are put together afterwards, on as many rows as there are chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered(df: DataFrame, key: list[str], chunk: Column, order: list[Column | str], name: str = "no") -> DataFrame:
    """Each row with its number from 1 within its key, in order of ``chunk`` (null first) and then ``order``.

    Two levels: numbers within a chunk, and counts of the chunks before it, so that only the table of chunks is ever sorted by
    key as a whole. ``chunk`` must not run against ``order``.
    """
    rows = df.withColumn("__chunk", chunk)
    before = W.partitionBy(*key).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy(*key, "__chunk").agg(F.count("*").alias("__n"))
    starts = counts.select(*(F.col(k).alias(f"__{k}") for k in key), F.col("__chunk").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = rows.withColumn("__local", F.row_number().over(W.partitionBy(*key, "__chunk").orderBy(*order)))
    same = F.col("__chunk").eqNullSafe(F.col("__c"))
    for k in key:
        same = same & local[k].eqNullSafe(F.col(f"__{k}"))
    return local.join(starts, same).withColumn(name, F.col("__local") + F.col("__start")).drop("__chunk", "__c", "__start", "__local", *(f"__{k}" for k in key))


def islands(df: DataFrame, key: list[str], value: str, chunk: int = 4096) -> DataFrame:
    """first, last, n of the runs of consecutive whole numbers of ``value`` per key; repeated numbers count once."""
    distinct = df.where(F.col(value).isNotNull()).select(*key, value).distinct()
    rows = numbered(distinct, key, F.floor(F.col(value) / chunk), [value], "__no").withColumn("__i", F.col(value) - F.col("__no"))
    return rows.groupBy(*key, "__i").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("__i")


def range_text(df: DataFrame, key: list[str]) -> DataFrame:
    """The islands of each key as text such as ``17-20,22``."""
    part = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    runs = F.array_sort(F.collect_list(F.struct("first", part.alias("part"))))
    return df.groupBy(*key).agg(F.array_join(F.transform(runs, lambda r: r["part"]), ",").alias("ranges"))


def expand_ranges(c: Column) -> Column:
    """``17-20,22`` as an array of numbers; broken parts fall away."""
    ends = F.transform(F.split(c, ","), lambda p: F.struct(F.regexp_extract(p, r"^\s*([0-9]+)", 1).try_cast("int").alias("a"), F.regexp_extract(p, r"([0-9]+)\s*$", 1).try_cast("int").alias("b")))
    good = F.filter(ends, lambda e: e["a"].isNotNull() & (e["b"] >= e["a"]))
    return F.flatten(F.transform(good, lambda e: F.sequence(e["a"], e["b"])))


def merge_intervals(df: DataFrame, key: str, start: str, end: str, gap: float = 0.0, chunk: float = 86_400.0) -> DataFrame:
    """Unions of the intervals of a key that overlap or lie at most ``gap`` apart: key, start, end, n. Numbers, not times.

    Two levels: how far the intervals reach is known within a chunk of starts by a window, and from the chunks before by one over
    the chunks' own reach; the same holds for the number of unions begun.
    """
    rows = df.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).select(key, start, end, F.floor(F.col(start) / chunk).alias("__chunk"))
    within = W.partitionBy(key, "__chunk").orderBy(start, end)
    before = W.partitionBy(key).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    reached = rows.groupBy(key, "__chunk").agg(F.max(end).alias("__m")).select(key, "__chunk", F.max("__m").over(before).alias("__far"))
    reach = F.greatest(F.max(end).over(within.rowsBetween(W.unboundedPreceding, -1)), F.col("__far"))
    opened = rows.join(reached, [key, "__chunk"]).withColumn("__r", reach).withColumn("__o", (F.col("__r").isNull() | (F.col(start) > F.col("__r") + gap)).cast("int"))
    begun = opened.groupBy(key, "__chunk").agg(F.sum("__o").alias("__s")).select(key, "__chunk", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__b"))
    unions = opened.join(begun, [key, "__chunk"]).withColumn("__g", F.sum("__o").over(within.rowsBetween(W.unboundedPreceding, 0)) + F.col("__b"))
    return unions.groupBy(key, "__g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__g")


def trailing_count(df: DataFrame, key: str, at: str, seconds: int, chunk_seconds: int | None = None) -> DataFrame:
    """Each row with ``n_trailing``: rows of its key in the ``seconds`` up to and with its own time (microseconds in ``at``).

    Keys are cut into chunks of time; rows near the end of a chunk are copied into the next one to be counted there only.
    """
    chunk = (chunk_seconds or max(3600, 10 * seconds)) * 1_000_000
    span = seconds * 1_000_000
    own = F.floor(F.col(at) / chunk)
    spread = F.array_distinct(F.array(own, F.floor((F.col(at) + span) / chunk)))
    rows = df.where(F.col(at).isNotNull()).withColumn("__own", own).withColumn("__chunk", F.explode(spread))
    w = W.partitionBy(key, "__chunk").orderBy(F.col(at)).rangeBetween(-span, 0)
    return rows.withColumn("n_trailing", F.count("*").over(w)).where("__chunk = __own").drop("__own", "__chunk")


def quantile_by_rank(df: DataFrame, value: str, shares: list[float], bins: int = 4096, small: int = 1_000_000) -> DataFrame:
    """share, value at place ``min(n - 1, floor(share * n))`` of the sorted values, exactly.

    The values are counted in bins between bounds that close in on each wanted place; each round scans once and brings back as
    many counts as there are bins. Once a bin holds at most ``small`` values, or a single one many times, its values are ranked.
    Nulls don't count; no values give no rows.
    """
    spark = df.sparkSession
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    n, lo, hi = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    out: list[tuple[float, float]] = []
    for share in shares if n else ():
        place, low, high, here = min(n - 1, int(share * n)), lo, hi, n
        while low < high and here > small:
            width = (high - low) / bins
            b = F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / width)).cast("int")
            counts = v.where(F.col("v").between(low, high)).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
            for _, c, a, z in counts:
                if place < c:
                    low, high, here = a, z, c
                    break
                place -= c
        if low < high:
            same = v.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("c"))
            upto = same.withColumn("r", F.sum("c").over(W.orderBy("v")))  # at most ``small`` rows
            low = upto.where(F.col("r") > place).agg(F.min("v")).first()[0]
        out.append((float(share), float(low)))
    return spark.createDataFrame(out, "share double, value double")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no from 0, line of each text."""
    return df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def line_context(df: DataFrame, key: str, text: str, radius: int = 1, join: str = " | ") -> DataFrame:
    """Each line with the lines within ``radius``, its own first. From the array of a text's lines: no shuffle, no window."""
    split = F.split(text, "\n")
    at = lambda i: F.concat_ws(join, F.get("ls", i), *(F.get("ls", i + d) for d in [*range(-radius, 0), *range(1, radius + 1)]))
    rows = df.where(F.col(text).isNotNull()).select(key, split.alias("ls"))
    context = F.transform("ls", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), at(i).alias("context")))
    return rows.select(key, F.inline(context))


def line_continued(df: DataFrame, key: str, text: str, ended: str = r"[.;!?:]\s*$") -> DataFrame:
    """Each line, with the next one appended unless it ends a sentence."""
    rows = df.where(F.col(text).isNotNull()).select(key, F.split(text, "\n").alias("ls"))
    joined = lambda x, i: F.when(F.regexp_like(x, F.lit(ended)), x).otherwise(F.concat_ws(" ", x, F.get("ls", i + 1)))
    return rows.select(key, F.inline(F.transform("ls", lambda x, i: F.struct(i.alias("line_no"), joined(x, i).alias("joined")))))


def segments(df: DataFrame, key: str, text: str, starts: Callable[[Column], Column]) -> DataFrame:
    """Lines of each text grouped into segments; a segment starts at a line for which ``starts`` holds.

    Lines before the first start are segment 0. From the array of a text's lines: no shuffle, no window.
    """
    rows = df.where(F.col(text).isNotNull()).select(F.col(key), F.split(text, "\n").alias("ls"))
    begun = F.filter(F.transform("ls", lambda x, i: F.when(F.coalesce(starts(x), F.lit(False)), i)), lambda i: i.isNotNull())
    held = rows.withColumn("begun", begun)
    line = F.transform("ls", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.size(F.filter("begun", lambda b: b <= i)).cast("bigint").alias("segment")))
    return held.select(key, F.inline(line))


def fold_states(events: DataFrame, key: str, at: str, tie: str, kind: str, retries: int = 2) -> DataFrame:
    """The state that an ordered fold of each key's events ends in; the batch twin of ``triscope.streaming.states``.

    ``done`` ends a key; so does the failure after ``retries`` repeats; what comes later is ignored. Written as aggregates (the
    first end wins), so that a hot key is combined before it moves: failures are counted up to the first ``done``.
    """
    order = F.struct(F.col(at), F.col(tie))
    done = events.where(F.col(kind) == "done").groupBy(key).agg(F.min(order).alias("done_at"))
    failed = events.where(F.col(kind) == "failed").select(key, order.alias("o"))
    # the failure that ends a key is its (retries + 1)-th: rank within bounded candidates only
    w = W.partitionBy(key).orderBy("o")
    ends = failed.withColumn("r", F.row_number().over(w)).where(F.col("r") <= retries + 1).groupBy(key).agg(F.max("r").alias("n_failed_first"), F.max(F.when(F.col("r") == retries + 1, F.col("o"))).alias("failed_at"))
    seen = events.groupBy(key).agg(F.count("*").alias("n_events"), F.max(order).alias("last_at"))
    state = F.when(F.col("done_at").isNotNull() & (F.col("failed_at").isNull() | (F.col("done_at") < F.col("failed_at"))), "DONE").when(F.col("failed_at").isNotNull(), "FAILED").otherwise("PARSING")
    return seen.join(done, key, "left").join(ends, key, "left").select(key, "n_events", state.alias("state"))
