"""Readers and writers on small files."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.operators import generate
from tidegauge.operators import readings as operators
from tidegauge.sources import readers, writers


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted(tuple(r) for r in picked.collect())


@pytest.fixture
def readings(spark):
    return spark.createDataFrame(
        [(100, 101, "s1", 5, 1.5), (100, 102, "s2", 6, 2.5), (90_000, 103, "s1", 7, 3.5)], schemas.READING
    )


def test_value_file(spark, tmp_path):
    (tmp_path / "values.csv").write_text("5,1.25\n 7 , 2.5 \n")
    assert rows(readers.value_file(spark, str(tmp_path))) == [(5, 1.25), (7, 2.5)]


def test_metric_csv_drops_repeated_headers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("timestamp,value,host\n1,2.5,w1\ntimestamp,value,host\n2,3.5,w2\n")
    got = readers.metric_csv(spark, str(tmp_path), ["timestamp", "value", "host"])
    assert rows(got, "timestamp", "value", "host", "pod_name") == [(1, 2.5, "w1", None), (2, 3.5, "w2", None)]


def test_metric_csv_checks_the_layout(spark, tmp_path):
    (tmp_path / "m.csv").write_text("value,timestamp\n1,2\n")
    with pytest.raises(Exception, match="header"):
        readers.metric_csv(spark, str(tmp_path), ["timestamp", "value"]).collect()


def test_append_export_round_trip(spark, tmp_path):
    path = str(tmp_path / "export")
    columns = ["timestamp", "value", "host", "container_name", "pod_name"]
    for n in (1, 2):
        part = spark.createDataFrame([(n, n + 0.5, "h", "c", "p")], schemas.METRIC_CSV)
        writers.append_export(part, path)
    assert rows(readers.metric_csv(spark, path, columns), "timestamp", "value") == [(1, 1.5), (2, 2.5)]


def test_log_csv(spark, tmp_path):
    (tmp_path / "l.csv").write_text("timestamp,sensor,status\n2024-01-01 00:00:30,s1,ok\n2024-01-01 00:01:00,s1,\n")
    got = rows(readers.log_csv(spark, str(tmp_path)).fillna("-", ["status"]))
    assert got == [(datetime(2024, 1, 1, 0, 0, 30), "s1", "ok"), (datetime(2024, 1, 1, 0, 1), "s1", "-")]


def test_inventories(spark, tmp_path):
    (tmp_path / "pods.json").write_text('{"namespace":"n","pod_name":"p","host":"h","labels":{"workload_id":"1"}}\n')
    assert readers.pod_inventory(spark, str(tmp_path / "pods.json")).first().labels == {"workload_id": "1"}
    (tmp_path / "nodes.json").write_text(
        '{"labels":{},"conditions":[{"type":"Ready","status":"True"}],"addresses":[{"type":"Hostname","address":"a"}]}\n'
    )
    assert readers.node_inventory(spark, str(tmp_path / "nodes.json")).first().addresses[0].address == "a"


def test_catalogue_table(spark, tmp_path):
    spark.createDataFrame([(1, 2, "n", None)], schemas.CATALOGUE["yaml_workload"]).write.parquet(
        str(tmp_path / "yaml_workload")
    )
    assert rows(readers.catalogue_table(spark, str(tmp_path), "yaml_workload"), "id", "replicas") == [(1, 2)]


def test_file_store_replays_without_repeats(spark, readings, tmp_path):
    store = writers.get_store("file", str(tmp_path))
    for batch in (0, 0, 1):
        store(readings, schemas.VALID_TABLE, batch)
    stored = readers.stored_csv(spark, f"{tmp_path}/temperature/batch_id=0")
    assert rows(stored) == rows(readings)
    assert readers.stored_csv(spark, f"{tmp_path}/temperature").count() == 6


def test_relational_store_numbers_on(spark, readings, tmp_path):
    store = writers.get_store("mysql", str(tmp_path))
    empty = readings.filter("temperature > 1000")
    for batch, rows_of_batch in ((0, readings), (1, empty), (2, readings), (2, readings)):
        store(rows_of_batch, schemas.INVALID_TABLE, batch)
    stored = readers.stored_table(spark, f"{tmp_path}/temperature_invalid")
    assert [r[0] for r in rows(stored, "id")] == [1, 2, 3, 4, 5, 6]
    assert dict(stored.dtypes)["readingTS"] == "string" and dict(stored.dtypes)["humidity"] == "float"
    writers.clear(spark, str(tmp_path))
    store(readings, schemas.INVALID_TABLE, 7)
    assert rows(readers.stored_table(spark, f"{tmp_path}/temperature_invalid"), "id") == [(1,), (2,), (3,)]


@pytest.mark.parametrize("keys, kept", [(("readingTS",), 2), (("readingTS", "sensorID"), 3)])
def test_keyed_store(spark, readings, tmp_path, keys, kept):
    store = writers.get_store("cassandra", str(tmp_path), keys=keys)
    store(readings, schemas.VALID_TABLE, 0)
    newer = spark.createDataFrame([(100, 200, "s2", 9, 0.5)], schemas.READING)
    for batch in (1, 1):
        store(newer, schemas.VALID_TABLE, batch)
    path = f"{tmp_path}/temperature"
    stored = readers.keyed_table(spark, path, keys)
    assert stored.count() == kept
    assert stored.filter("sensorID = 's2'").first().temperature == 9
    assert readers.keyed_table(spark, path, keys, first_day="1970-01-02").count() == 1
    plan = readers.keyed_table(spark, path, keys, last_day="1970-01-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_keyed_store_replay_drops_days_of_the_first_attempt(spark, readings, tmp_path):
    store = writers.keyed_store(str(tmp_path))
    store(readings, schemas.VALID_TABLE, 0)
    store(readings.filter("reading_ts = 100"), schemas.VALID_TABLE, 0)
    assert readers.keyed_table(spark, f"{tmp_path}/temperature").count() == 1


def test_merge(spark, tmp_path):
    """Rows of touched days are replaced, other days stay, repeating or merging nothing changes nothing."""

    def rows_of(data):
        return spark.createDataFrame(data, "k bigint, v bigint, day string").withColumn(
            "day", F.col("day").cast("date")
        )

    path = str(tmp_path / "t")

    def stored():
        return rows(readers.snapshot_table(spark, path, "k bigint, v bigint, day date"), "k", "v")

    writers.merge(spark, path, rows_of([(1, 1, "2024-01-01"), (2, 1, "2024-01-02"), (3, 1, "2024-01-03")]), ["k"], ["v"])
    for _ in range(2):
        writers.merge(spark, path, rows_of([(2, 5, "2024-01-02"), (4, 1, "2024-01-01")]), ["k"], ["v"])
    writers.merge(spark, path, rows_of([(9, 9, "2024-01-02")]).filter("k < 0"), ["k"], ["v"])
    assert stored() == [(1, 1), (2, 5), (3, 1), (4, 1)]
    # A day between two touched ones stays as it is.
    writers.merge(spark, path, rows_of([(1, 7, "2024-01-01"), (3, 7, "2024-01-03")]), ["k"], ["v"])
    assert stored() == [(1, 7), (2, 5), (3, 7), (4, 1)]


def test_no_store(readings, tmp_path):
    assert writers.get_store("none")(readings, schemas.VALID_TABLE, 0) is None
    assert list(tmp_path.iterdir()) == []


def test_save_values_and_sorted(spark, tmp_path):
    ids = spark.range(10)
    both = generate.value_table(ids, ids, "id", generate.ValueRange(0, 5), generate.ValueRange(11, 45), "x")
    writers.save_values(both, str(tmp_path / "v"))
    assert readers.value_file(spark, f"{tmp_path}/v/class=abnormal").filter("temperature >= 11").count() == 10
    writers.save_sorted(ids.selectExpr("10 - id AS value", "id AS tie"), str(tmp_path / "s"), "a", "b", "quicksort")
    stored = readers.snapshot_table(spark, str(tmp_path / "s"), schemas.SORTED_VALUE)
    assert rows(stored, "id", "value", "algorithm")[0] == (1, 1, "quicksort")


def test_snapshot_replaces(spark, tmp_path):
    for name in ("a", "b"):
        writers.replace_snapshot(spark.createDataFrame([(name,)], "pod string"), str(tmp_path / "p"))
    assert rows(readers.snapshot_table(spark, str(tmp_path / "p"), "pod string")) == [("b",)]


def test_only_a_missing_folder_is_an_empty_table(spark, tmp_path):
    assert writers._exists(spark, str(tmp_path / "none"), "id long") is None
    spark.range(3).write.parquet(str(tmp_path / "some"))
    with pytest.raises(AnalysisException):
        writers._exists(spark, str(tmp_path / "some"), "id long, id long").count()


def test_a_range_of_a_stored_table_is_pruned(spark, readings, tmp_path):
    writers.relational_store(str(tmp_path))(readings, schemas.VALID_TABLE, 0)
    stored = readers.stored_table(spark, f"{tmp_path}/temperature")
    got = operators.recent(stored, 90_000, 3600)
    assert rows(got) == [(90_000, "s1", 7, 3.5)]
    assert rows(operators.recent(stored, 100, 0, "s2")) == [(100, "s2", 6, 2.5)]
    # Same rows by the text alone.
    assert rows(operators.recent(stored.drop("reading_s", "day"), 90_000, 3600)) == rows(got)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(reading_s,86400)" in plan
