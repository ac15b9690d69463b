"""Result log as a stream (R-01..R-03)."""
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evalspark.plans.scoring import resolve_log, score_responses
from evalspark.sources.readers import RESULT_SCHEMA

LOG_KEYS = ["problem_id", "language", "model"]


def log_stream(spark: SparkSession, folder: str, schema: str = RESULT_SCHEMA, files_per_trigger: int = 1000) -> DataFrame:
    """New JSONL files of the append-only log; the rate limit keeps a backlog in bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("mode", "FAILFAST").json(folder)


def scored_stream(log: DataFrame) -> DataFrame:
    """Row-local scoring of successful rows: no state."""
    return score_responses(log.where("status = 'success'"))


def append_scored(log: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Scored rows appended to parquet, exactly once through the checkpoint (R-01)."""
    writer = scored_stream(log).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


_COMMITS = "source string, batch_id bigint, token string, bucket int, version bigint"


def _commits(spark: SparkSession, snapshot: str) -> DataFrame | None:
    """The commit table: a row for each bucket that a version wrote, with its folder token and the batch of the stream that made it."""
    try:
        return spark.read.schema(_COMMITS).parquet(f"{snapshot}-commits")
    except Exception as error:  # nothing committed yet
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def _commit(rows: DataFrame, snapshot: str, source: str, batch_id: int, version: int, buckets: list[int]) -> str:
    """Writes rows (with bucket) as a new version and then its commit rows; without those nobody reads the folder.

    A version is a folder of its own and is refused where it exists, so of two writers that saw the same log one fails and leaves nothing that is read.
    """
    token = uuid.uuid4().hex
    rows.withColumn("token", F.lit(token)).write.mode("append").partitionBy("token", "bucket").parquet(snapshot)
    spark = rows.sparkSession
    done = [(source, batch_id, token, b) for b in buckets] or [(source, batch_id, token, None)]
    spark.createDataFrame(done, _COMMITS.rpartition(",")[0]).coalesce(1).write.mode("errorifexists").parquet(f"{snapshot}-commits/version={version}")
    return token


def upsert_batch(snapshot: str, keys: list[str] | None = None, buckets: int = 64, source: str = ""):
    """foreachBatch writer that keeps one row per key as versioned snapshots (R-02).

    A version is one more than the highest committed one, whatever the batch is called, so a stream that starts again
    with new progress goes on above what is there. A batch is known by (source, batch id); one that was committed is not written again. Only
    key buckets that the batch touches are rewritten.
    """
    keys = keys or LOG_KEYS

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _commits(spark, snapshot)
        last = -1
        if done is not None:
            last, seen = done.agg(F.max("version"), F.count_if((F.col("source") == source) & (F.col("batch_id") == batch_id))).first()
            if seen:
                return
        bucketed = batch.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets))).persist()
        try:
            before = read_snapshot(spark, snapshot, keep_bucket=True)
            # At most ``buckets`` values: a bounded driver list.
            touched = [r["bucket"] for r in bucketed.select("bucket").distinct().collect()]
            merged = bucketed
            if before is not None:
                merged = merged.unionByName(before.where(F.col("bucket").isin(touched)), allowMissingColumns=True)
            _commit(resolve_log(merged, keys + ["bucket"]).drop("n_versions"), snapshot, source, batch_id, last + 1, touched)
        finally:
            bucketed.unpersist()
    return write


def read_snapshot(spark: SparkSession, snapshot: str, keep_bucket: bool = False) -> DataFrame | None:
    """Current rows: for every bucket its newest committed version."""
    done = _commits(spark, snapshot)
    if done is None or done.isEmpty():
        return None
    newest = done.where("bucket IS NOT NULL").groupBy("bucket").agg(F.max_by("token", "version").alias("token"))  # from commit rows alone
    if newest.isEmpty():
        return None
    current = spark.read.parquet(snapshot).join(F.broadcast(newest), ["bucket", "token"], "left_semi").drop("token")  # a row a bucket
    return current if keep_bucket else current.drop("bucket")


def compact_log(spark: SparkSession, snapshot: str) -> None:
    """All buckets as one version; the folders before it are deleted. Not while a stream writes."""
    rows, done = read_snapshot(spark, snapshot, keep_bucket=True), _commits(spark, snapshot)
    if rows is None:
        return
    last = done.agg(F.max("version")).first()[0]
    held = [r["bucket"] for r in done.where("bucket IS NOT NULL").select("bucket").distinct().collect()]  # at most as many as there are buckets
    token = _commit(rows, snapshot, "compaction", last + 1, last + 1, held)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(snapshot)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("token=") and name != f"token={token}":
            store.delete(status.getPath(), True)


def upsert_log(log: DataFrame, snapshot: str, checkpoint: str, keys: list[str] | None = None) -> StreamingQuery:
    return log.writeStream.foreachBatch(upsert_batch(snapshot, keys, source=checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_accuracy(scored: DataFrame, model: str = "model", side: str = "language", correct: str = "is_correct") -> DataFrame:
    """Accuracy per (model, side); on a stream the state is one row per group (R-03)."""
    return scored.groupBy(model, side).agg(F.sum(correct).cast("bigint").alias("n_correct"), F.count(correct).alias("n_total"),
                                           F.avg(correct).alias("accuracy"))
