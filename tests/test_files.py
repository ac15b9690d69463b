"""Line ranges, committed line files and the change guard."""
import os
import random

import pytest
from pyspark.sql import functions as F

from evalspark.sources import committed, files, line_ranges


def plain_prefix(data, max_rows, max_bytes):
    out, at = [], 0
    for i, line in enumerate(data.splitlines(keepends=True) if b"\r" not in data else [x + b"\n" for x in data.split(b"\n")[:-1]] + [data.split(b"\n")[-1]], 1):
        if not line or i > max_rows or at + len(line) > max_bytes:
            break
        out.append((i, at, at + len(line), line.removesuffix(b"\n").removesuffix(b"\r").decode()))
        at += len(line)
    return out


CASES = {"plain": b"".join(b"line %d\n" % i for i in range(400)), "no break at the end": b"a\nbb\nccc", "blank lines": b"\n\n\nx\n\n", "long line": b"s\n" + b"y" * 9000 + b"\nend\n",
         "empty": b"", "crlf": b"a\r\nb\r\n\r\nc", "accents": "é\nüü\n漢字\n".encode() * 50}


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 4096])
def test_every_range_size_gives_the_lines(tmp_path, range_bytes):
    for name, data in CASES.items():
        if range_bytes == 1 and len(data) > 5000:
            continue
        path = tmp_path / "f"
        path.write_bytes(data)
        got = [(at, line.removesuffix(b"\n")) for b in range(0, len(data), range_bytes) for at, line, _ in line_ranges.range_lines(line_ranges.ByteRange(str(path), b, min(b + range_bytes, len(data))))]
        want, at = [], 0
        for line in data.split(b"\n"):
            want.append((at, line))
            at += len(line) + 1
        assert got == (want if not data.endswith(b"\n") else want[:-1]) if data else got == [], name


def test_prefix_of_several_files(spark, tmp_path):
    rng = random.Random(1)
    for i, data in enumerate(CASES.values()):
        (tmp_path / f"f{i}.txt").write_bytes(data)
    (tmp_path / "_hidden").write_bytes(b"no\n")
    for _ in range(3):
        rows, size, step = rng.randrange(0, 60), rng.randrange(0, 12_000), rng.choice([50, 700, 5000])
        got = {}
        for r in line_ranges.file_prefix(spark, str(tmp_path), rows, size, step).collect():
            got.setdefault(os.path.basename(r["file"]), []).append((r["line_number"], r["first_byte"], r["bytes_through"], r["value"]))
        for i, data in enumerate(CASES.values()):
            assert sorted(got.get(f"f{i}.txt", [])) == plain_prefix(data, rows, size), (i, rows, size, step)
    one = line_ranges.file_prefix(spark, str(tmp_path / "f0.txt"), 2, 10**9)
    assert [r["value"] for r in one.orderBy("line_number").collect()] == ["line 0", "line 1"]
    assert one.rdd.getNumPartitions() == 1


def test_reads_stay_near_the_budget(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"0123456789\n" * 200_000)
    step = 16_384
    ranges, read = line_ranges.planned_ranges(spark, str(tmp_path), 10**9, 100_000, step)
    assert ranges[-1].begin < 100_000 and read < 100_000 + step
    ranges, read = line_ranges.planned_ranges(spark, str(tmp_path), 5_000, 10**9, step)
    assert [r.before for r in ranges] == sorted(r.before for r in ranges) and ranges[-1].before < 5_000
    assert read < 3 * 5_000 * 11 + step  # waves double: at most the same again beyond the cut, and a range


def test_rows_appear_when_the_job_commits(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(1000, numPartitions=4).select(F.col("id"), F.when(F.col("id") % 5 == 0, "dev").otherwise("train").alias("split"))
    failing = rows.withColumn("id", F.when(F.col("id") == 990, F.raise_error(F.lit("stopped here")).cast("bigint")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="stopped here"):
        committed.write_lines(failing, path, "split")
    assert os.listdir(tmp_path) == []  # three tasks had written
    digests = committed.write_lines(rows, path, "split")
    assert digests.count() == len([f for _, _, fs in os.walk(path) for f in fs if f.startswith("part-")])
    back = spark.read.text(path)
    assert back.count() == committed.committed_rows(path) == 1000 and {r[0]: r[1] for r in back.groupBy("split").count().collect()} == {"dev": 200, "train": 800}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        committed.write_lines(rows.limit(3), path)
    assert os.listdir(tmp_path) == ["out"] and spark.read.text(path).count() == 1000
    empty = str(tmp_path / "none")
    committed.write_lines(rows.where("id < 0"), empty)
    assert committed.committed_rows(empty) == 0


def test_files_of_failed_attempts_are_left_out(spark, tmp_path):
    writer = committed._Writer(str(tmp_path / "out"), None)
    folder = writer.staging
    os.makedirs(folder)
    for name in ("good", "torn"):
        with open(f"{folder}/part-{name}", "w") as f:
            f.write(name + "\n")
    writer.commit([committed.Written([f"{folder}/part-good"], 1), None])
    assert sorted(os.listdir(tmp_path / "out")) == ["_SUCCESS", "part-good"]
    os.makedirs(str(tmp_path / f"out{committed.MARK}dead"))
    assert committed.clear_staging(spark, str(tmp_path / "out")) == 1 and os.listdir(tmp_path) == ["out"]


def test_changed_files_are_seen(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name)
    before = spark.createDataFrame(files.file_digests(spark, str(tmp_path)).collect())
    (tmp_path / "a").write_text("b")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_text("d")
    got = {r["file_name"]: r["problem"] for r in files.digest_changes(before, files.file_digests(spark, str(tmp_path)), "file_name").collect()}
    assert got == {"a": "changed", "b": "vanished", "d": "appeared"}
