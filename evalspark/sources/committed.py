"""Line files that appear whole or not at all (S-10, S-11).

Tasks write below a staging folder next to the destination and report their files. Only the driver's commit makes them visible: it drops what no successful
attempt reported, and moves the staging folder to the destination, which must not exist at that moment. A failed job removes the staging folder; a job
that was killed leaves one that no reader looks at and that ``clear_staging`` removes.
"""
import json
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from evalspark.functions.digests import canonical_json
from evalspark.sources.files import file_digests, open_store

MARK = ".staging-"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


def _exists(store, place: str) -> bool:
    import pyarrow.fs as fs
    return store.get_file_info(place).type != fs.FileType.NotFound


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, split: str | None):
        self.path, self.split = path.rstrip("/"), split
        self.staging = f"{self.path}{MARK}{uuid.uuid4().hex}"

    def write(self, iterator):
        store, place = open_store(self.staging)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{uuid.uuid4().hex}.jsonl"
        streams, rows = {}, 0
        try:
            for batch in iterator:
                lines = batch.column(batch.schema.get_field_index("value")).to_pylist()
                keys = batch.column(batch.schema.get_field_index(self.split)).to_pylist() if self.split else [None] * len(lines)
                for key, line in zip(keys, lines):
                    if key not in streams:
                        folder = f"{place}/{self.split}={key}" if self.split else place
                        store.create_dir(folder, recursive=True)
                        streams[key] = (f"{folder}/{name}", store.open_output_stream(f"{folder}/{name}"))
                    streams[key][1].write(line.encode() + b"\n")
                    rows += 1
        finally:
            for _, stream in streams.values():
                stream.close()
        return Written([f for f, _ in streams.values()], rows)

    def commit(self, messages):
        import pyarrow.fs as fs
        store, place = open_store(self.staging)
        _, goal = open_store(self.path)
        if _exists(store, goal):
            self.abort(messages)
            raise FileExistsError(f"PATH_ALREADY_EXISTS: {self.path}")
        store.create_dir(place, recursive=True)
        good = {f for m in messages if m for f in m.files}
        for info in store.get_file_info(fs.FileSelector(place, recursive=True)):
            if info.type == fs.FileType.File and info.path not in good:
                store.delete_file(info.path)  # of attempts that failed or ran twice
        with store.open_output_stream(f"{place}/_SUCCESS") as done:
            done.write(json.dumps({"rows": sum(m.rows for m in messages if m)}).encode())
        store.move(place, goal)

    def abort(self, messages):
        store, place = open_store(self.staging)
        if _exists(store, place):
            store.delete_dir(place)


class CommittedLines(DataSource):
    """A sink for a column ``value`` and, with the option split, a folder level; options: path, split."""

    @classmethod
    def name(cls) -> str:
        return "committed_lines"

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("this sink does not overwrite")
        return _Writer(self.options["path"], self.options.get("split"))


def write_lines(df: DataFrame, path: str, split: str | None = None) -> DataFrame:
    """JSON lines, keys sorted, nulls kept, text not escaped, all of them or none; an existing path is refused when the job commits.

    Returns the digest table of the files. ``split`` becomes a folder level.
    """
    spark = df.sparkSession
    spark.dataSource.register(CommittedLines)
    writer = df.select(canonical_json(df).alias("value"), *([split] if split else [])).write.format("committed_lines").mode("append").option("path", path)
    (writer.option("split", split) if split else writer).save()
    return file_digests(spark, path, "part-*")


def committed_rows(path: str) -> int:
    """Rows that the commit recorded."""
    store, place = open_store(path)
    with store.open_input_stream(f"{place.rstrip('/')}/_SUCCESS") as done:
        return json.loads(done.read())["rows"]


def clear_staging(spark: SparkSession, path: str) -> int:
    """Removes what killed jobs left beside ``path``; not while one writes. Returns the number of folders."""
    import pyarrow.fs as fs
    store, place = open_store(path.rstrip("/"))
    folder, _, name = place.rpartition("/")
    left = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith(name + MARK)]
    for p in left:
        store.delete_dir(p)
    return len(left)
