"""Queries over events: rates, quantiles, sessions, intervals, folds of state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triscope.operators.sequences import fold_states, islands, merge_intervals, quantile_by_rank, trailing_count
from triscope.sources.tables import table
from triscope.streaming.run import finished
from triscope.streaming.states import process_states


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def q_throttle(spark: SparkSession, d: str) -> DataFrame:
    """Users with three or more errors within a day, and their most."""
    e = trailing_count(_events(spark, d).where("event_type = 'error'"), "user_id", "at", 86_400)
    return e.groupBy("user_id").agg(F.max("n_trailing").alias("most"), F.count_if(F.col("n_trailing") >= 3).alias("n_over")).where("most >= 3")


def q_latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Values at given places of the sorted values."""
    return quantile_by_rank(table(spark, d, "events", "value"), "value", [0.5, 0.95, 0.99])


def q_active_users(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users of each quarter of an hour."""
    e = _events(spark, d)
    return e.groupBy(F.floor(F.col("at") / 900_000_000).alias("quarter")).agg(F.countDistinct("user_id").alias("n_users"), F.count("*").alias("n_events"))


def q_trailing_users(spark: SparkSession, d: str) -> DataFrame:
    """Users and events by type within the last day, hour and quarter of an hour up to the last event."""
    e = _events(spark, d)
    last = e.agg(F.max("at").alias("last"))  # one row
    spans = F.explode(F.array(*(F.struct(F.lit(n).alias("span"), F.lit(s).alias("seconds")) for n, s in (("day", 86_400), ("hour", 3_600), ("quarter", 900)))))
    near = e.join(F.broadcast(last)).where(F.col("at") > F.col("last") - 86_400_000_000).select("*", spans.alias("s"))
    return near.where(F.col("at") > F.col("last") - F.col("s.seconds").cast("bigint") * 1_000_000).groupBy(F.col("s.span").alias("span"), "event_type").agg(F.countDistinct("user_id").alias("n_users"), F.count("*").alias("n"))


def q_busy_days(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive days on which a user was active."""
    e = _events(spark, d).withColumn("day", F.floor(F.col("at") / 86_400_000_000))
    return islands(e, ["user_id"], "day")


def q_busy_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans that a user's events cover, each event lasting as many minutes as its value says, joined over gaps of an hour."""
    e = _events(spark, d).select("user_id", F.col("at").alias("start"), (F.col("at") + F.round(60_000_000 * F.col("value")).cast("bigint")).alias("end"))
    return merge_intervals(e, "user_id", "start", "end", gap=3_600_000_000, chunk=86_400_000_000)


def q_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users, ended by a day without events."""
    e = table(spark, d, "events", "user_id", "ts").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "24 hours")).agg(F.count("*").alias("n_events"))
    return e.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n_events").alias("longest"))


def q_process_states(spark: SparkSession, d: str) -> DataFrame:
    """The state that each process (a user of an hour) ends in: purchase as done, error as failed."""
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("progress")
    e = _events(spark, d).select(F.concat_ws("-", "user_id", F.floor(F.col("at") / 86_400_000_000)).alias("process"), "at", "event_id", kind.alias("kind"))
    return fold_states(e, "process", "at", "event_id", "kind", retries=0)


def q_event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Events by type and a field of their properties."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events", "event_type", "props").groupBy("event_type", F.floor(k / 10).alias("tens")).agg(F.count("*").alias("n"), F.sum(k).alias("total"))


def q_stream_hourly(spark: SparkSession, d: str) -> DataFrame:
    """Events and their sum by hour and type, counted by a stream: hours that are over by an hour at the stream's end, each once."""

    def hourly(e: DataFrame) -> DataFrame:
        counted = e.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"))
        return counted.select(F.col("window.start").alias("hour"), "event_type", "n", "cents")

    return finished(spark, f"{d}/events.parquet", hourly, "append").drop("batch")


def q_stream_states(spark: SparkSession, d: str) -> DataFrame:
    """The states of q_process_states as a stream of events leaves them; those silent for a day at its end have failed."""

    def states(e: DataFrame) -> DataFrame:
        kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("progress")
        day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
        return process_states(e.select(F.concat_ws("-", "user_id", day).alias("process"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind")), delay="1 hour", timeout_ms=86_400_000, retries=0)

    updates = finished(spark, f"{d}/events.parquet", states, "update")
    return updates.groupBy("process").agg(F.max("n_events").alias("n_events"), F.max_by("state", F.struct("batch", "n_events", "state")).alias("state"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    sql = {
        "q_throttle": "WITH t AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'error') SELECT user_id, max(n) AS most, count(*) FILTER (n >= 3) AS n_over FROM t GROUP BY user_id HAVING max(n) >= 3",
        "q_latency_quantiles": "WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), q AS (SELECT unnest([0.5, 0.95, 0.99]) AS share) SELECT CAST(share AS DOUBLE) AS share, value FROM q, s WHERE i = least(n - 1, CAST(floor(CAST(share AS DOUBLE) * n) AS BIGINT))",
        "q_active_users": "SELECT epoch_us(ts) // 900000000 AS quarter, count(DISTINCT user_id) AS n_users, count(*) AS n_events FROM events GROUP BY 1",
        "q_trailing_users": "WITH s AS (SELECT unnest(['day', 'hour', 'quarter']) AS span, unnest([86400, 3600, 900]) AS seconds) SELECT span, event_type, count(DISTINCT user_id) AS n_users, count(*) AS n FROM events, s WHERE epoch_us(ts) > (SELECT max(epoch_us(ts)) FROM events) - seconds * CAST(1000000 AS BIGINT) GROUP BY 1, 2",
        "q_busy_days": "WITH d AS (SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS day FROM events), g AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM d) SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS n FROM g GROUP BY user_id, i",
        "q_busy_spans": "WITH e AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(60000000 * value) AS BIGINT) AS t FROM events WHERE value >= 0), o AS (SELECT *, CASE WHEN s > max(t) OVER w + 3600000000 OR max(t) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(s) AS start, max(t) AS \"end\", count(*) AS n FROM g GROUP BY user_id, g",
        "q_sessions": "WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 24 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o), s AS (SELECT user_id, g, count(*) AS n FROM g GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM s GROUP BY user_id",
        "q_process_states": "WITH e AS (SELECT user_id || '-' || (epoch_us(ts) // 86400000000) AS process, ts, event_id, event_type FROM events), r AS (SELECT process, count(*) AS n_events, min(struct_pack(a := ts, b := event_id)) FILTER (event_type = 'purchase') AS d, min(struct_pack(a := ts, b := event_id)) FILTER (event_type = 'error') AS f FROM e GROUP BY process) SELECT process, n_events, CASE WHEN d IS NOT NULL AND (f IS NULL OR d < f) THEN 'DONE' WHEN f IS NOT NULL THEN 'FAILED' ELSE 'PARSING' END AS state FROM r",
        "q_stream_hourly": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2",
        "q_event_properties": "WITH k AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, k // 10 AS tens, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM k GROUP BY 1, 2",
    }
    silent = "SELECT p.process, p.n_events, CASE WHEN p.state = 'PARSING' AND l.last + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR THEN 'FAILED' ELSE p.state END AS state FROM p JOIN l USING (process)"
    last = "l AS (SELECT user_id || '-' || (epoch_us(ts) // 86400000000) AS process, max(ts) AS last FROM events GROUP BY 1)"
    return sql | {"q_stream_states": f"WITH p AS ({sql['q_process_states']}), {last} {silent}"}
