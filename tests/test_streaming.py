from datetime import datetime, timedelta

from triscope.operators.sequences import fold_states
from triscope.streaming import states

T = datetime(2024, 1, 1)
SCHEMA = "process string, ts timestamp, event_id long, kind string"


def feed(spark, tmp_path, batches, query, name):
    """Runs a query over files that arrive one after the other."""
    source = tmp_path / "in"
    source.mkdir()
    q = query(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp"))
    running = None
    for i, rows in enumerate(batches):
        part = tmp_path / f"part{i}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(part))
        next(part.glob("*.parquet")).rename(source / f"{i:03d}.parquet")
        running = running or q.outputMode("update" if name == "states" else "append").start()
        running.processAllAvailable()
    running.stop()
    return spark.table(name).collect()


def test_states_equal_the_batch_fold(spark, tmp_path):
    events = [("a", "progress"), ("b", "failed"), ("a", "done"), ("b", "failed"), ("c", "progress"), ("a", "failed"), ("b", "failed"), ("b", "done"), ("d", "failed")]
    rows = [(p, T + timedelta(seconds=i), i, k) for i, (p, k) in enumerate(events)]
    got = feed(spark, tmp_path, [rows[:4], rows[2:7], rows[7:]], lambda s: states.process_states(s, retries=2), "states")  # two are delivered twice
    last = {}
    for r in got:
        last[r.process] = max(last.get(r.process, (0, "")), (r.n_events, r.state))
    batch = fold_states(spark.createDataFrame(rows, SCHEMA), "process", "ts", "event_id", "kind", 2)
    assert {k: v[1] for k, v in last.items()} == {r.process: r.state for r in batch.collect()}


def test_silent_processes_fail(spark, tmp_path):
    rows = [[("a", T, 1, "progress")], [("z", T + timedelta(hours=5), 2, "progress")], [("z", T + timedelta(hours=6), 3, "progress")]]
    got = feed(spark, tmp_path, rows, lambda s: states.process_states(s, delay="1 minute", timeout_ms=60_000), "states")
    assert ("a", "FAILED") in {(r.process, r.state) for r in got}


def test_ended_processes_are_forgotten(spark, tmp_path):
    """A process that failed by silence is remembered for as long again; an event long after begins a new one."""
    at = lambda h: T + timedelta(hours=h)
    rows = [[("a", T, 1, "progress")], *([("z", at(5 * i), 10 + i, "progress")] for i in range(1, 5)), [("a", at(30), 90, "progress")], [("z", at(31), 91, "progress")]]
    got = feed(spark, tmp_path, rows, lambda s: states.process_states(s, delay="1 minute", timeout_ms=3_600_000), "states")
    assert [(r.state, r.n_events) for r in got if r.process == "a"] == [("PARSING", 1), ("FAILED", 1), ("PARSING", 1)]


def test_rates(spark, tmp_path):
    rows = [[("a", T + timedelta(seconds=i), i, "failed") for i in range(12)], [("z", T + timedelta(hours=5), 99, "failed")], [("z", T + timedelta(hours=9), 100, "failed")]]
    got = feed(spark, tmp_path, rows, lambda s: states.rates(s, "process"), "rates")
    assert {r.process for r in got} == {"a"} and max(r.n for r in got) == 12


def test_lines(spark):
    df = spark.createDataFrame([('{"type":"progress","process_id":"p","progress":1.5}',), ("{broken",), ("plain",), (None,)], "value string")
    assert [(r.type, r.process_id, r.progress) for r in states.progress_lines(df).collect()][:3] == [("progress", "p", 1.0), ("log", None, None), ("log", None, None)]
