"""The running accuracy as a stream: corrections, restarts and batches that run again."""
import datetime
import random

import pytest
from pyspark.sql import functions as F

from evalspark.plans.scoring import resolve_log
from evalspark.streaming import results, running

SCHEMA = "problem_id INT, language STRING, model STRING, status STRING, is_correct INT, timestamp_utc TIMESTAMP"
KEYS = ["problem_id", "language", "model"]


def tries(rng, n, first):
    at = datetime.datetime(2026, 1, 1)
    return [(rng.randrange(12), rng.choice("ae"), rng.choice(["m1", "m2"]), rng.choice(["success", "error"]), rng.choice([0, 1, None]), at + datetime.timedelta(seconds=first + i))
            for i in range(n)]


def plain(spark, rows):
    now = resolve_log(spark.createDataFrame(rows, SCHEMA), KEYS)
    got = results.running_accuracy(now).where("n_total > 0").collect()
    return {(r["model"], r["language"]): (r["n_correct"], r["n_total"], r["accuracy"]) for r in got}


def test_stream_equals_batch_at_every_step(spark, tmp_path):
    rng = random.Random(4)
    rows, folder = [], str(tmp_path / "run")
    assert running.read_running_accuracy(spark, folder) is None
    for step in range(3):  # started again for every part; the last part comes in several micro-batches
        for piece in range(1 if step < 2 else 2):
            part = tries(rng, 25, 100 * len(rows))
            rows += part
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "log"))
        log = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "log"))
        running.running_accuracy_stream(log, folder, KEYS, ["model", "language"]).awaitTermination()
        got = running.read_running_accuracy(spark, folder).collect()
        assert {(r["model"], r["language"]): (r["n_correct"], r["n_total"], r["accuracy"]) for r in got} == plain(spark, rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    write = running._keep_totals(str(tmp_path / "t"), ["model"])
    one = spark.createDataFrame([("m", 1, 2), ("n", 1, 1)], "model STRING, n_correct LONG, n_total LONG")
    back = spark.createDataFrame([("m", -1, 0), ("n", -1, -1)], "model STRING, n_correct LONG, n_total LONG")
    write(one, 0)
    for _ in range(2):
        write(back, 1)
        (tmp_path / "t" / "batch=2").mkdir(exist_ok=True)  # begun and never finished
        got = spark.read.parquet(f"{tmp_path}/t/batch=1")
        assert {(r["model"], r["n_correct"], r["n_total"]) for r in got.collect()} == {("m", 0, 2), ("n", 0, 0)}
    assert running._batches(spark, str(tmp_path / "t")) == [0, 1]
    write(one, 2)
    assert running._batches(spark, str(tmp_path / "t")) == [1, 2]


def test_rows_are_merged_and_a_batch_that_runs_again_sees_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(running, "MERGE_AFTER", 2)
    rng, folder, rows = random.Random(7), str(tmp_path / "m"), []
    write = running._keep_rows(folder, KEYS, ["model", "language"], "is_correct", "status", "timestamp_utc")
    for batch in range(8):
        part = [(i if i < 11 else None, *rest) for i, *rest in tries(rng, 20, 1000 - 100 * batch if batch % 3 == 2 else 100 * batch)]  # late rows and keys without a value
        rows += part
        for _ in range(1 + batch % 2):
            write(spark.createDataFrame(part, SCHEMA), batch)
        got = running.read_running_accuracy(spark, folder).collect()
        assert {(r["model"], r["language"]): (r["n_correct"], r["n_total"], r["accuracy"]) for r in got} == plain(spark, rows)
    assert len(running._batches(spark, f"{folder}/whole")) <= 2 and len(running._batches(spark, f"{folder}/rows")) <= 6


def test_corrections_run_without_python(spark):
    """A call of Python a key took minutes for a few hundred thousand keys."""
    plan = running.corrections(spark.createDataFrame([], SCHEMA), KEYS, ["model", "language"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_the_first_of_rows_written_at_once_stays(spark):
    at = datetime.datetime(2026, 1, 1)
    rows = [(1, "a", "m1", "success", 0, at), (1, "a", "m1", "success", 1, at), (1, "a", "m1", "error", 1, at + datetime.timedelta(1))]
    first = running.corrections(spark.createDataFrame(rows, SCHEMA).coalesce(1), KEYS, ["model"])
    assert [(r["row_correct"], r["n_correct"], r["n_total"]) for r in first.collect()] == [(0, 0, 1)]
    again = running.corrections(spark.createDataFrame(rows[1:], SCHEMA), KEYS, ["model"], before=first)
    assert again.count() == 0


def test_groups_must_be_part_of_the_key(spark):
    log = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        running.corrections(log.withColumn("place", F.lit("x")), KEYS, ["place"])


def test_one_of_two_writers_of_a_version_fails(spark, tmp_path):
    snap = str(tmp_path / "snap")
    rows = spark.createDataFrame([(1, "a", "m", "success", 1, 0)], "problem_id INT, language STRING, model STRING, status STRING, timestamp_utc INT, bucket INT")
    results._commit(rows, snap, "one", 0, 0, [0])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        results._commit(rows.withColumn("status", F.lit("error")), snap, "two", 0, 0, [0])
    assert [r["status"] for r in results.read_snapshot(spark, snap).collect()] == ["success"]
    results.upsert_batch(snap, KEYS, buckets=1)(rows.drop("bucket").where("false"), 5)  # an empty batch leaves the rows
    assert results.read_snapshot(spark, snap).count() == 1
