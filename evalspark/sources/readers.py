"""JSONL, CSV and table readers (S-01..S-04, S-13, S-14)."""
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LITERAL_ROWS = 100_000

RESULT_SCHEMA = """problem_id INT, source_index BIGINT, model STRING, language STRING, gold_answer STRING,
 extracted_answer STRING, is_correct INT, extraction_method STRING, needs_manual_review INT, review_reason STRING,
 all_explicit_answers STRING, question STRING, generated_response STRING, input_tokens INT, output_tokens INT,
 generation_seconds DOUBLE, finish_reason STRING, timestamp_utc TIMESTAMP, status STRING, error STRING"""


def table(spark: SparkSession, folder: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A parquet table of a dataset folder; the scan prunes to ``columns``."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(scan: DataFrame, key: str) -> DataFrame:
    """A scan with fewer partitions than cores (one row group, one compressed file), spread by a unique key.

    Work per row that costs more than moving the row once should not run on one core. A scan that already has
    enough partitions is returned as it is, so large inputs never pay a shuffle. For scans only: asking a plan
    with exchanges for its partitions would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def read_jsonl(spark: SparkSession, paths, schema) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, a malformed line stops the job (S-01)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def read_csv(spark: SparkSession, paths, schema=None, multiline: bool = True) -> DataFrame:
    """CSV with header, optional byte-order mark and quoted line breaks (S-02).

    ``multiline=False`` lets one large file be split over tasks when no cell holds a line break.
    """
    reader = spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').option("quote", '"')
    return (reader.schema(schema) if schema else reader).csv(paths)


def read_union(spark: SparkSession, files: dict[str, str], fmt: str = "csv", expected_rows: dict[str, int] | None = None) -> DataFrame:
    """Files that may differ in columns, as one table with ``source_file`` (S-03).

    ``files`` maps a label to a path. With ``expected_rows`` a label whose count differs stops the job.
    """
    parts = []
    for label, path in files.items():
        part = read_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
        parts.append(part.withColumn("source_file", F.lit(label)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if expected_rows:
        from evalspark.operators.checks import CheckFailed
        seen = {r["source_file"]: r["n"] for r in out.groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).collect()}
        wrong = {k: (v, seen.get(k, 0)) for k, v in expected_rows.items() if seen.get(k, 0) != v}
        if wrong:
            raise CheckFailed(f"row counts differ (expected, found): {wrong}")
    return out


def rows_per_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with file, 1-based line number and size in bytes including the line break.

    Every file split numbers its own lines; the totals of the splits before it in the same file are added.
    Splits are bounded by ``spark.sql.files.maxPartitionBytes``, so no window is larger than one split.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"))
    return _number(raw, ["file"], "_block", "_seq")


def _number(raw: DataFrame, by: list[str], block: str, seq: str) -> DataFrame:
    from evalspark.operators.ranges import attach
    sized = raw.withColumn("n_bytes", (F.octet_length("value") + 1).cast("bigint"))
    totals = sized.groupBy(*by, block).agg(F.count(F.lit(1)).alias("_n"), F.sum("n_bytes").alias("_b"))
    before = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
                            F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"))
    inside = Window.partitionBy(*by, block).orderBy(seq)
    return attach(sized, offsets, [*by, block]).select(
        *by, "value", "n_bytes", (F.row_number().over(inside) + F.col("_n0")).alias("line_number"),
        (F.sum("n_bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_b0")).alias("bytes_through"))


def bounded_prefix(lines: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """First ``max_rows`` complete lines within ``max_bytes`` (S-04).

    Running sizes only grow, so the condition stops at the first line that does not fit.
    """
    return lines.where((F.col("line_number") <= max_rows) & (F.col("bytes_through") <= max_bytes))


def ordered_prefix(df: DataFrame, order: str, text: str, max_rows: int, max_bytes: int) -> DataFrame:
    """The same budget on a table with an explicit unique order column.

    One pass adds up rows and bytes of each range of the column; only ranges that begin within the budget are then ordered and totalled row by row.
    """
    from evalspark.operators.ranges import in_ranges, range_bounds
    sized = in_ranges(df.withColumn("n_bytes", (F.octet_length(text) + 1).cast("bigint")), order, range_bounds(df, order))
    totals = sized.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_bytes").alias("_b"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    begins = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"))
    within = begins.where((F.col("_n0") < max_rows) & (F.col("_b0") < max_bytes))
    inside = Window.partitionBy("_range").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    lines = sized.join(F.broadcast(within), "_range").select(*df.columns, "n_bytes", (F.row_number().over(inside) + F.col("_n0")).alias("line_number"),
                                                             (F.sum("n_bytes").over(upto) + F.col("_b0")).alias("bytes_through"))
    return bounded_prefix(lines, max_rows, max_bytes)


def literal_table(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """Curated side table from code (decisions, exclusions, corrections) (S-14).

    Up to LITERAL_ROWS rows it is sent to every task; a longer list is left to the planner, which knows its size.
    """
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= LITERAL_ROWS else table


def bilingual_configs(a: DataFrame, b: DataFrame, index: str, question: str, answer: str) -> DataFrame:
    """Two language configurations of one dataset side by side (S-13), joined on the explicit position column."""
    left = a.select(F.col(index).alias("source_index"), F.col(question).alias("question_a"), F.col(answer).alias("answer_a"))
    right = b.select(F.col(index).alias("source_index"), F.col(question).alias("question_b"), F.col(answer).alias("answer_b"))
    return left.join(right, "source_index", "full_outer")
