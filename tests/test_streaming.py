"""Streams give what the batch operators give, also across restarts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.operators import readings, series
from tidegauge.sources import readers, writers
from tidegauge.streaming import alerts, jobs


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted(tuple(r) for r in picked.collect())


def message(i, temperature):
    return f'{{"measurement_ts":{1700000000000 + i * 500},"temperature":{temperature},"humidity":{i}.5,"sensor":pod-{i % 3}}}'


LINES = [message(i, (i * 7) % 16 - 2) for i in range(60)] + ["junk", message(1, "5.3"), '{"a":1,"b":,,"c":1}']


def drop(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_bridge_equals_batch_across_a_restart(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        src = readers.text_stream(spark, str(source), max_files=1)
        jobs.bridge(
            src, writers.topic_files(out, "records"), str(tmp_path / "cp"), writers.dead_files(out, "dead")
        ).awaitTermination()

    drop(source, "1.txt", LINES[:30])
    run()
    drop(source, "2.txt", LINES[30:])
    run()
    batch = readings.to_topic(readings.parse_telemetry(spark.createDataFrame([(x,) for x in LINES], "value string")))
    assert rows(spark.read.text(f"{out}/records"), "value") == rows(batch, "value")
    dead = rows(spark.read.json(f"{out}/dead"), "value", "error")
    assert dead == sorted([("junk", "parse"), ('{"a":1,"b":,,"c":1}', "parse")])
    record = json.loads(batch.first().value)
    assert set(record) == set(readings.FIELDS) and all(isinstance(v, str) for v in record.values())


@pytest.fixture
def topic(spark, tmp_path):
    """Topic records of all lines plus two damaged ones, in two files."""
    frame = spark.createDataFrame([(x,) for x in LINES], "value string")
    records = [r.value for r in readings.to_topic(readings.parse_telemetry(frame)).collect()]
    records += ["{broken", '{"temperature":"1"}']
    drop(tmp_path / "topic", "1.txt", records[:40])
    drop(tmp_path / "topic", "2.txt", records[40:])
    return records


@pytest.mark.parametrize("store_name", ["file", "none"])
def test_analyzer_equals_batch(spark, tmp_path, topic, store_name):
    out = str(tmp_path / "out")
    jobs.analyzer(
        readers.text_stream(spark, str(tmp_path / "topic"), max_files=1),
        writers.get_store(store_name, f"{out}/store"),
        writers.topic_files(out, "actions"),
        str(tmp_path / "cp"),
        writers.dead_files(out, "dead"),
        processed_ms=lambda: F.lit(1700000099000),
    ).awaitTermination()
    frame = spark.createDataFrame([(r,) for r in topic], "value string")
    routed = readings.route(readings.type_readings(readings.from_topic(frame)), 0, 10)
    acting = readings.actions(routed.valid, 2, 8)
    want = rows(acting.select(readings.action_message(F.lit(1700000099000)).alias("value")))
    assert rows(spark.read.text(f"{out}/actions"), "value") == want
    assert rows(spark.read.json(f"{out}/dead"), "value", "error") == rows(routed.dead, "value", "error")
    assert routed.dead.count() == 3
    assert sum(part.count() for part in routed) == len(topic)
    if store_name == "file":
        columns = ["reading_ts", "sensor", "temperature", "humidity"]
        for table, part in (("temperature", routed.valid), ("temperature_invalid", routed.invalid)):
            assert rows(readers.stored_csv(spark, f"{out}/store/{table}"), *columns) == rows(part, *columns)


def test_dropped_dead_letters_are_logged(spark, tmp_path, caplog):
    drop(tmp_path / "in", "1.txt", LINES)
    src = readers.text_stream(spark, str(tmp_path / "in"))
    with caplog.at_level("WARNING", logger=jobs.__name__):
        jobs.bridge(src, writers.topic_files(str(tmp_path), "records"), str(tmp_path / "cp")).awaitTermination()
    assert "2 dead letters" in caplog.text


def test_analyzer_replays_a_failed_batch_once(spark, tmp_path, topic):
    """The store fails after the actions went out; the restart repeats the batch, not its rows."""
    out = str(tmp_path / "out")
    good = writers.file_store(f"{out}/store")
    failures = []

    def failing(frame, table, batch_id):
        if batch_id == 1 and table == schemas.INVALID_TABLE and not failures:
            failures.append(batch_id)
            raise RuntimeError("store is down")
        good(frame, table, batch_id)

    def run():
        jobs.analyzer(
            readers.text_stream(spark, str(tmp_path / "topic"), max_files=1),
            failing, writers.topic_files(out, "actions"), str(tmp_path / "cp"),
        ).awaitTermination()

    with pytest.raises(Exception, match="store is down"):
        run()
    run()
    frame = spark.createDataFrame([(r,) for r in topic], "value string")
    routed = readings.route(readings.type_readings(readings.from_topic(frame)), 0, 10)
    assert readers.stored_csv(spark, f"{out}/store/temperature").count() == routed.valid.count()
    assert readers.stored_csv(spark, f"{out}/store/temperature_invalid").count() == routed.invalid.count()
    assert spark.read.text(f"{out}/actions").count() == readings.actions(routed.valid, 2, 8).count()


def test_actuator(spark, tmp_path):
    lines = [f"processed_ts:2 reading_ts:{1700000000 + i} actuator_id:actuator-0 sensor:s action:shutdown" for i in range(5)]
    drop(tmp_path / "in", "1.txt", lines + ["no action"])
    jobs.actuator(
        readers.text_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"),
        F.lit(1700000010000),
    ).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "out")), "delay_ms")
    assert got == [(6000,), (7000,), (8000,), (9000,), (10000,)]


def test_log_counts_equal_batch_once_the_watermark_passed(spark, tmp_path):
    schema = "timestamp TIMESTAMP, sensor STRING, status STRING"

    def logs(name, data):
        spark.createDataFrame(data, "t string, sensor string, status string").selectExpr(
            "CAST(t AS TIMESTAMP) AS timestamp", "sensor", "status"
        ).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    first = [(f"2024-01-01 00:0{m}:{s:02d}", f"s{s % 2}", "ok" if s % 5 else None) for m in range(3) for s in range(0, 60, 7)]
    logs("d=1", first)
    logs("d=2", [("2024-01-06 00:00:00", "s0", "ok")])
    # Spark rejects late records one batch after the watermark moved.
    logs("d=3", [("2024-01-06 00:01:00", "s0", "ok")])
    # More than 72 h behind the newest record: rejected.
    logs("d=4", [("2024-01-01 00:00:01", "s0", "ok"), ("2024-01-12 00:00:00", "s0", "ok")])

    def run():
        src = (
            spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
            .parquet(str(tmp_path / "in"))
        )
        jobs.log_counts(src, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()

    run()
    batch = series.counts(
        spark.createDataFrame(first, "t string, sensor string, status string").selectExpr(
            "CAST(t AS TIMESTAMP) AS timestamp", "sensor", "status"
        ),
        "timestamp", "1 minute", ["sensor"], "status",
    )
    got = spark.read.parquet(str(tmp_path / "out")).filter("window_start < '2024-01-02'")
    assert rows(got) == rows(batch)


def alert_events(samples, hold, silence):
    """Events of aligned samples (series, step, active) in plain Python."""
    out, by = [], {}
    for name, step, active in sorted(samples):
        by.setdefault(name, []).append((step, active))
    for name, points in by.items():
        since = last = None
        for step, active in points:
            if since is not None and step - last > silence:
                out.append((name, last + silence, since, "resolved"))
                since = None
            if active and since is None:
                since, fired = step, False
                out.append((name, step, since, "pending"))
            if active and not fired and step - since >= hold:
                fired = True
                out.append((name, since + hold, since, "firing"))
            if not active and since is not None:
                out.append((name, step, since, "resolved"))
                since = None
            last = step
        if since is not None:
            out.append((name, last + silence, since, "resolved"))
    return sorted(out)


@pytest.fixture
def live(spark, tmp_path):
    """A folder that a stream of alerts reads file by file; (write, run) for samples (instance, second, up)."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "instance string, s bigint, up int, ts timestamp"

    def write(samples):
        frame = spark.createDataFrame(samples, "instance string, s bigint, up int")
        frame = frame.withColumn("ts", F.timestamp_seconds("s"))
        frame.coalesce(1).write.mode("append").parquet(str(source))

    def run(hold_ms, **how):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        src = src.withColumn("job", F.lit(None).cast("string"))
        query = alerts.sustained_alerts(
            src, ["instance", "job"], "ts", F.col("up") == 0, hold_ms, out, str(tmp_path / "cp"), **how
        )
        query.awaitTermination()
        got = spark.read.parquet(out).filter("instance NOT LIKE 'z%'")
        assert got.filter("job <> ''").count() == 0
        return rows(got, "instance", "at_ms", "active_since", "state")

    return write, run


def test_live_alerts_equal_batch(spark, live):
    """Runs that are open across slices, batches and a restart; the batch operator finds the same ones."""
    write, run = live
    ups = {"a,b": [0] * 12 + [1] + [0] * 4 + [1] * 3 + [0] * 40, "b": [1, 1] + [0] * 30 + [1, 0, 1]}
    samples = [(name, i * 10 + 3, up) for name, values in ups.items() for i, up in enumerate(values)]
    how = {"slice_": "1 minute"}
    write([x for x in samples if x[1] < 50])
    write([x for x in samples if 50 <= x[1] < 100])
    first = run(60_000, **how)
    write([x for x in samples if x[1] >= 100])
    write([("z", 5000, 1)])  # much later: the watermark passes all steps above, and timers
    write([("z2", 6000, 1)])
    got = run(60_000, **how)
    assert set(first) < set(got)
    aligned = [(name, s // 10 * 10_000, up == 0) for name, s, up in samples]
    assert got == alert_events(aligned, 60_000, 300_000)
    grid = spark.createDataFrame(aligned, "instance string, step_ms bigint, active boolean")
    batch = series.sustained(grid, ["instance"], "step_ms", F.col("active"), 60_000)
    runs = batch.groupBy("instance", "active_since").agg(F.max(F.expr("state = 'firing'")).alias("fired"))
    assert {(r.instance, r.active_since) for r in runs.collect()} == {(n, since) for n, _, since, s in got if s == "pending"}
    assert {(r.instance, r.active_since) for r in runs.filter("fired").collect()} == {
        (n, since) for n, _, since, s in got if s == "firing"
    }


def test_a_silent_series_resolves_and_is_forgotten(spark, live, tmp_path):
    """A series that stops while firing, and one that comes back after a silence."""
    write, run = live
    samples = [("gone", s, 0) for s in range(0, 200, 10)]
    samples += [("back", s, 0) for s in [*range(0, 100, 10), *range(900, 1000, 10)]] + [("back", 1000, 1)]
    write([x for x in samples if x[1] < 500])
    write([("z", 700, 1)])
    write([x for x in samples if x[1] >= 500])
    write([("z", 5000, 1)])
    write([("z", 6000, 1)])
    got = run(60_000, silence="2 minutes", slice_="1 minute")
    assert got == alert_events([(n, s * 1000, up == 0) for n, s, up in samples], 60_000, 120_000)
    assert ("gone", 310_000, 0, "resolved") in got
    # Nothing is kept of series without an open run.
    kept = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "run").load(str(tmp_path / "cp"))
    assert kept.count() == 0


def test_a_slice_may_not_hide_a_silence(spark, live):
    write, run = live
    write([("a", 1, 1)])
    with pytest.raises(ValueError, match="slice"):
        run(60_000, silence="1 minute", slice_="5 minutes")


def test_boundaries_of_slices(spark):
    """Only the ends of stretches go on, at most as many as a slice has steps."""
    ups = [0, 0, 0, 1, 0, 1, 1, 1, 1, 0, 0, 0] + [1] * 12
    samples = spark.createDataFrame([("a", i * 10, u) for i, u in enumerate(ups)], "i string, s bigint, u int")
    aligned = alerts.aligned_condition(samples.withColumn("ts", F.timestamp_seconds("s")), ["i"], "ts", F.col("u") == 0)
    got = alerts.boundaries(aligned, ["i"], "2 minutes").orderBy("first_ms").collect()
    assert [(r.first_ms, r.last_ms, r.steps, r.actives) for r in got] == [
        (0, 110_000, [0, 20_000, 30_000, 40_000, 50_000, 80_000, 90_000, 110_000], [True, True, False, True, False, False, True, True]),
        (120_000, 230_000, [120_000, 230_000], [False, False]),
    ]
