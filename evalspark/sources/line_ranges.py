"""First lines of large text files, reading no more than the first lines (S-04).

Files are cut into byte ranges. A line belongs to the range in which it begins, so its first byte is known without reading what is before it; only line numbers
need the counts of earlier ranges. The ranges of a file are counted in waves that double in size, from the front, until the row budget is reached; ranges
that begin beyond the byte budget are never planned. The scan then reads the counted ranges with their first line number at hand: no window, no shuffle.
"""
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evalspark.sources.files import listed_files, open_store

RANGE_BYTES = 32 << 20
PIECE, TAIL = 1 << 20, 512        # bytes read at a time inside a range and beyond its end
LINES = "file string, line_number bigint, first_byte bigint, bytes_through bigint, value string"
COUNTS = "file string, first_byte bigint, n_lines bigint, bytes_read bigint"


@dataclass
class ByteRange(InputPartition):
    file: str
    begin: int
    end: int
    before: int = 0  # lines of the file that begin earlier


def range_lines(part: ByteRange, read: list[int] | None = None) -> Iterator[tuple[int, bytes, bool]]:
    """(first byte, line with its break, ended) of every line that begins in the range; the last line of a file may lack its break.

    Reads from one byte before the range to the end of its last line, in pieces; ``read`` receives their sizes.
    """
    store, place = open_store(part.file)
    with store.open_input_file(place) as stream:
        at = max(part.begin - 1, 0)  # the byte before tells whether a line begins at the range
        stream.seek(at)
        held, whole = b"", part.begin == 0
        while True:
            piece = stream.read(min(PIECE, max(part.end - at - len(held), TAIL)))
            if read is not None:
                read.append(len(piece))
            held += piece
            while (cut := held.find(b"\n")) >= 0:
                line, held = held[:cut + 1], held[cut + 1:]
                if whole:
                    yield at, line, True
                at, whole = at + len(line), True
                if at >= part.end:
                    return
            if not piece:
                if whole and held:
                    yield at, held, False
                return


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.ranges = [ByteRange(*r) for r in json.loads(options["ranges"])]
        self.count = options["mode"] == "count"
        self.limits = int(options["max_rows"]), int(options["max_bytes"])

    def partitions(self):
        return self.ranges

    def read(self, part):
        if self.count:
            read: list[int] = []
            n = sum(1 for at, line, _ in range_lines(part, read) if at + len(line) <= self.limits[1])
            yield pa.RecordBatch.from_pydict({"file": [part.file], "first_byte": [part.begin], "n_lines": [n], "bytes_read": [sum(read)]})
            return
        rows: list[tuple] = []
        for i, (at, line, ended) in enumerate(range_lines(part), part.before + 1):
            if i > self.limits[0] or at + len(line) > self.limits[1]:
                break
            rows.append((part.file, i, at, at + len(line), line[:-1] if ended else line))
            if len(rows) == 4096:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [f.split()[0] for f in LINES.split(", ")]
        cells = dict(zip(names, map(list, zip(*rows))))
        return pa.RecordBatch.from_pydict(cells | {"value": [v.removesuffix(b"\r").decode("utf-8", "replace") for v in cells["value"]]})


class LineRanges(DataSource):
    """Byte ranges of text files as a source; options: ranges (JSON list of file, begin, end, lines before), mode, max_rows, max_bytes."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return COUNTS if self.options["mode"] == "count" else LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def _scan(spark: SparkSession, ranges: list[ByteRange], mode: str, max_rows: int, max_bytes: int) -> DataFrame:
    spark.dataSource.register(LineRanges)
    cells = json.dumps([[r.file, r.begin, r.end, r.before] for r in ranges])
    return spark.read.format("line_ranges").option("mode", mode).option("ranges", cells).option("max_rows", max_rows).option("max_bytes", max_bytes).load()


def planned_ranges(spark: SparkSession, path: str, max_rows: int, max_bytes: int, range_bytes: int = RANGE_BYTES) -> tuple[list[ByteRange], int]:
    """The ranges that hold the prefix of every file, with the lines before each, and the bytes that were read to find them."""
    open_files = {f: 0 for f, size in listed_files(path) if size and max_rows > 0}
    sizes, lines, wave, read = dict(listed_files(path)), dict.fromkeys(open_files, 0), 1, 0
    chosen: list[ByteRange] = []
    while open_files:
        tried = [ByteRange(f, b, min(b + range_bytes, sizes[f], max_bytes)) for f, first in open_files.items()
                 for b in range(first, min(sizes[f], max_bytes, first + wave * range_bytes), range_bytes)]
        if not tried:
            break
        found = {(r["file"], r["first_byte"]): (r["n_lines"], r["bytes_read"]) for r in _scan(spark, tried, "count", max_rows, max_bytes).collect()}  # one row a range
        for r in tried:
            n, taken = found[r.file, r.begin]
            read += taken
            if lines[r.file] < max_rows:
                chosen.append(ByteRange(r.file, r.begin, r.end, lines[r.file]))
            lines[r.file] += n
            open_files[r.file] = r.end
        open_files = {f: b for f, b in open_files.items() if lines[f] < max_rows and b < min(sizes[f], max_bytes)}
        wave *= 2
    return chosen, read


def file_prefix(spark: SparkSession, path: str, max_rows: int, max_bytes: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, line_number, first_byte, bytes_through, value): of every file the first ``max_rows`` complete lines within ``max_bytes``.

    Stops at the first line that does not fit, which also bounds a line longer than the budget; a last line without a break counts as complete. Lines are cut at
    line feeds, a carriage return before one is not part of the line; files without lines give none.
    """
    ranges, _ = planned_ranges(spark, path, max_rows, max_bytes, range_bytes)
    if not ranges:
        return spark.createDataFrame([], LINES)
    return _scan(spark, ranges, "lines", max_rows, max_bytes)
