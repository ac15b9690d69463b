"""Readers, strict JSON, digests, sinks, stream."""
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from evalspark.operators.checks import CheckFailed
from evalspark.plans.scoring import resolve_log, score_responses
from evalspark.sources import files, readers, sinks, strict_json
from evalspark.streaming import results


def test_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": "é"}\n', encoding="utf-8")
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a INT, b STRING").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a INT").collect()
    (tmp_path / "m1.csv").write_bytes("﻿id,text\n1,\"two\nlines \"\"q\"\"\"\n2,b\n".encode())
    (tmp_path / "m2.csv").write_text("id,text,extra\n3,c,z\n")
    rows = readers.read_csv(spark, str(tmp_path / "m1.csv")).collect()
    assert rows[0].asDict() == {"id": "1", "text": 'two\nlines "q"'}
    both = {"m1": str(tmp_path / "m1.csv"), "m2": str(tmp_path / "m2.csv")}
    union = readers.read_union(spark, both, expected_rows={"m1": 2, "m2": 1})
    assert {(r.source_file, r.n_rows) for r in readers.rows_per_source(union).collect()} == {("m1", 2), ("m2", 1)}
    with pytest.raises(CheckFailed):
        readers.read_union(spark, both, expected_rows={"m1": 3, "m2": 1})


def test_numbered_lines_over_many_splits(spark, tmp_path):
    lines = [f"line {i} " + "é" * (i % 17) for i in range(5000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = readers.numbered_lines(spark, str(tmp_path / "big.txt"))
        assert spark.read.text(str(tmp_path / "big.txt")).rdd.getNumPartitions() > 5
        got = df.orderBy("line_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.value for r in got] == lines and [r.line_number for r in got] == list(range(1, 5001))
    sizes, total = [], 0
    for line in lines:
        total += len(line.encode()) + 1
        sizes.append(total)
    assert [r.bytes_through for r in got] == sizes
    assert readers.bounded_prefix(df, 100, 10 ** 9).count() == 100
    assert readers.bounded_prefix(df, 10 ** 6, sizes[41]).count() == 42
    assert readers.bounded_prefix(df, 10 ** 6, sizes[41] - 1).count() == 41


@pytest.mark.parametrize("line, problem", [
    ('{"a": 1}', None), (' {"a": {"b": [1, null]}} ', None), ('{}', None), ('{"a": 1, "a": 2}', "malformed"), ('{"a": {"b": 1, "b": 2}}', "malformed"), ('{"a": NaN}', "malformed"),
    ('{"a": Infinity}', "malformed"), ('{"a": 1} x', "malformed"), ('{"a": 1} {"b": 2}', "malformed"), ('{"a": 1}, {"b": 2}', "malformed"), ('[1]', "not_object"), ('"x"', "not_object"), ('3', "not_object"), ('{"a": 1', "malformed")])
def test_strict_json(spark, line, problem):
    df = spark.createDataFrame([(line,)], "line STRING")
    r = df.select(strict_json.strict_object(F.col("line")).isNotNull().alias("ok"), strict_json.strict_problem(F.col("line")).alias("p")).first()
    assert (r.ok, r.p) == (problem is None, problem)


def test_sinks_and_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None, "train"), (2, "b", "x", "dev")], "z INT, a STRING, n STRING, split STRING")
    out = str(tmp_path / "out")
    written = sinks.write_jsonl(df, out, "split").collect()
    found = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in (tmp_path / "out").rglob("part-*")}
    assert {r.file_name: r.sha256 for r in written} == found
    train = [p for p in (tmp_path / "out" / "split=train").iterdir() if p.name.startswith("part")][0].read_text(encoding="utf-8")
    assert train == '{"a":"é","n":null,"split":"train","z":1}\n'
    for again in (lambda: sinks.write_jsonl(df, out), lambda: sinks.write_csv(df, out), lambda: sinks.write_table(df, out)):
        with pytest.raises(Exception, match="already exists"):
            again()
    sinks.write_table(df, str(tmp_path / "table"), "split")
    assert {(r.split, r.n_rows) for r in sinks.split_counts(spark.read.parquet(str(tmp_path / "table"))).collect()} == {("train", 1), ("dev", 1)}
    plain = tmp_path / "plain"
    plain.mkdir()
    for name in ("part-a", "part-b"):
        (plain / name).write_text(name)
    before = files.file_digests(spark, str(plain), "part-*").checkpoint()
    files.verify_files(before, before)
    (plain / "part-a").write_text("changed")
    (plain / "part-c").write_text("new")
    after = files.file_digests(spark, str(plain), "part-*")
    assert sorted(r.problem for r in files.digest_changes(before, after).collect()) == ["appeared", "changed"]
    with pytest.raises(CheckFailed):
        files.verify_files(after, before)


def result(i, lang, text, status="success", minute=0):
    return {"problem_id": i, "language": lang, "model": "m", "gold_answer": str(i), "generated_response": text, "finish_reason": "stop",
            "status": status, "timestamp_utc": f"2026-01-01T00:{minute:02d}:00Z", "error": ""}


def test_stream_equals_batch(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    def drop(name, rows):
        (log / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    drop("1.jsonl", [result(1, "english", "FINAL ANSWER: 1"), result(2, "english", None, "error")])
    scored, snap = str(tmp_path / "scored"), str(tmp_path / "snap")
    def run():
        results.append_scored(results.log_stream(spark, str(log)), scored, str(tmp_path / "c1")).awaitTermination()
        results.upsert_log(results.log_stream(spark, str(log)), snap, str(tmp_path / "c2")).awaitTermination()
    run()
    drop("2.jsonl", [result(2, "english", "FINAL ANSWER: 2", minute=5), result(1, "english", None, "error", 9), result(3, "arabic", "FINAL ANSWER: 4", minute=6)])
    run()
    batch = readers.read_jsonl(spark, str(log), readers.RESULT_SCHEMA)
    want = score_responses(batch.where("status = 'success'"))
    got = spark.read.parquet(scored)
    columns = ["problem_id", "language", "extracted_answer", "is_correct"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    latest = resolve_log(batch, results.LOG_KEYS).drop("n_versions")
    now = results.read_snapshot(spark, snap)
    cols = sorted(latest.columns)
    assert sorted(map(str, now.select(cols).collect())) == sorted(map(str, latest.select(cols).collect()))
    assert {(r.problem_id, r.status) for r in now.collect()} == {(1, "success"), (2, "success"), (3, "success")}
    # A stream that starts again with new progress, from batch 0, keeps what is there and adds to it; compaction changes nothing.
    again = tmp_path / "again"
    again.mkdir()
    (again / "3.jsonl").write_text(json.dumps(result(9, "english", "FINAL ANSWER: 9", minute=7)) + "\n")
    results.upsert_log(results.log_stream(spark, str(again)), snap, str(tmp_path / "c9")).awaitTermination()
    results.compact_log(spark, snap)
    assert {r.problem_id for r in results.read_snapshot(spark, snap).collect()} == {1, 2, 3, 9}
    latest = latest.unionByName(resolve_log(readers.read_jsonl(spark, str(again), readers.RESULT_SCHEMA), results.LOG_KEYS).drop("n_versions"))
    # A replayed batch writes the same content again.
    results.upsert_batch(snap)(readers.read_jsonl(spark, str(log / "2.jsonl"), readers.RESULT_SCHEMA), 1)
    assert sorted(map(str, results.read_snapshot(spark, snap).select(cols).collect())) == sorted(map(str, latest.select(cols).collect()))
    live = results.running_accuracy(spark.readStream.schema(got.schema).parquet(scored))
    q = live.writeStream.format("memory").queryName("acc").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("acc").collect())) == sorted(map(str, results.running_accuracy(got).collect()))
