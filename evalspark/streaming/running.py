"""Running accuracy over a log whose rows are tried again (R-03).

The current row of a key may change: a later try or a success replaces what was counted before. Each batch is reduced to its best row a key, compared with the
key's current row, and every change is a correction: minus the old row, plus the new one. Sums of corrections are the totals of the resolved log at every moment,
without reading the log again. A batch writes the rows that became current; the current row of a key is the best of all that were written. After MERGE_AFTER
batches they are written once as a whole. Totals are one row a group.
"""
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalspark.operators.ranges import attach

MERGE_AFTER = 16
_ROW = ["row_ok", "row_written", "row_correct"]


def _best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: a success before a failure, then the latest; of rows written at the same time the first one."""
    row = F.max(F.struct("row_ok", "row_written", "row_at", "row_correct")).alias("_row")
    return rows.withColumn("row_at", -F.monotonically_increasing_id()).groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in _ROW])


def corrections(log: DataFrame, keys: list[str], by: list[str], correct: str = "is_correct", status: str = "status", written: str = "timestamp_utc",
                before: DataFrame | None = None) -> DataFrame:
    """(keys, row_ok, row_written, row_correct, n_correct, n_total): rows of a batch that become current, and what each changes in the totals of its group.

    ``by`` are some of ``keys``; ``before`` holds the rows that earlier batches made current. Rows without a result count towards neither total.
    """
    if not set(by) <= set(keys):
        raise ValueError("groups must be part of the key: a row that moves to another group could not be taken back")
    kind = log.schema[written].dataType.typeName()
    when = F.unix_micros(written) if kind == "timestamp" else F.col(written).cast("bigint")
    slim = log.select(*keys, (F.col(status) == "success").alias("row_ok"), when.alias("row_written"), F.col(correct).cast("int").alias("row_correct"))
    new = _best(slim.where("row_ok IS NOT NULL AND row_written IS NOT NULL"), keys)
    if before is None:
        before = new.where("false")
    tried = new.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    old = _best(before.select(*keys, *_ROW).join(tried, same, "left_semi"), keys)  # a small batch is sent to the rows, these are not shuffled
    met = attach(new, old.select(*keys, *[F.col(c).alias(f"_{c}") for c in _ROW]), keys)
    better = F.col("_row_ok").isNull() | (F.struct("row_ok", "row_written") > F.struct(F.col("_row_ok").alias("row_ok"), F.col("_row_written").alias("row_written")))
    return met.where(better).select(
        *keys, *_ROW, (F.coalesce("row_correct", F.lit(0)) - F.coalesce("_row_correct", F.lit(0))).cast("bigint").alias("n_correct"),
        (F.col("row_correct").isNotNull().cast("bigint") - F.col("_row_correct").isNotNull().cast("bigint")).alias("n_total"))


def _batches(spark: SparkSession, totals: str) -> list[int]:
    """Batches whose totals were written whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(totals)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    done = [s.getPath() for s in store.listStatus(path) if s.isDirectory()]
    return sorted(int(p.getName().partition("=")[2]) for p in done if store.exists(p.suffix("/_SUCCESS")))


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _sum(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("n_correct").alias("n_correct"), F.sum("n_total").alias("n_total"))


def _keep_totals(totals: str, by: list[str]):
    """foreachBatch writer: the totals before plus the batch's corrections. A batch that runs again starts from the same totals and replaces its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = [b for b in _batches(spark, totals) if b < batch_id]
        rows = _sum(batch, by)
        if earlier:
            rows = _sum(rows.unionByName(spark.read.parquet(f"{totals}/batch={earlier[-1]}").select(rows.columns)), by)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{totals}/batch={batch_id}")
        for old in earlier[:-1]:  # the one before stays for a batch that runs again
            _drop(spark, f"{totals}/batch={old}")
    return write


def _keep_rows(folder: str, keys: list[str], by: list[str], correct: str, status: str, written: str):
    """foreachBatch writer: the rows that a batch makes current, then the totals. Only earlier batches are read, so a batch that runs again gives the same."""
    add = _keep_totals(f"{folder}/totals", by)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        wholes, parts = ([b for b in _batches(spark, f"{folder}/{kind}") if b < batch_id] for kind in ("whole", "rows"))
        since = [b for b in parts if not wholes or b > wholes[-1]]
        paths = [f"{folder}/whole/batch={b}" for b in wholes[-1:]] + [f"{folder}/rows/batch={b}" for b in since]
        if not paths and any(b < batch_id for b in _batches(spark, f"{folder}/totals")):
            raise ValueError(f"{folder} has totals but not the rows behind them")
        before = spark.read.parquet(*paths) if paths else None
        mine = f"{folder}/rows/batch={batch_id}"
        corrections(batch, keys, by, correct, status, written, before).write.mode("overwrite").parquet(mine)
        add(spark.read.parquet(mine).select(*by, "n_correct", "n_total"), batch_id)
        if len(since) >= MERGE_AFTER:
            _best(spark.read.parquet(*paths, mine).select(*keys, *_ROW), keys).write.mode("overwrite").parquet(f"{folder}/whole/batch={batch_id}")
            for kind, old in [("whole", b) for b in wholes[:-1]] + [("rows", b) for b in parts if b not in since]:
                _drop(spark, f"{folder}/{kind}/batch={old}")
    return write


def running_accuracy_stream(log: DataFrame, folder: str, keys: list[str], by: list[str], correct: str = "is_correct", status: str = "status",
                            written: str = "timestamp_utc", available_now: bool = True) -> StreamingQuery:
    """Keeps the totals of a streamed log below ``folder``, together with the current rows and the stream's progress: started again, it goes on where it was."""
    writer = log.writeStream.foreachBatch(_keep_rows(folder, keys, by, correct, status, written)).option("checkpointLocation", f"{folder}/progress")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_running_accuracy(spark: SparkSession, folder: str) -> DataFrame | None:
    """(by, n_correct, n_total, accuracy) after the last whole batch; None before the first. Groups without any result left are not shown."""
    done = _batches(spark, f"{folder}/totals")
    if not done:
        return None
    rows = spark.read.parquet(f"{folder}/totals/batch={done[-1]}").where("n_total > 0")
    return rows.withColumn("accuracy", F.col("n_correct") / F.col("n_total"))
