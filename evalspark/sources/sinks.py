"""Sinks that never overwrite (S-09..S-12)."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.digests import canonical_json
from evalspark.sources.files import file_digests


def write_jsonl(df: DataFrame, path: str, split: str | None = None) -> DataFrame:
    """JSON lines, keys sorted, nulls kept, text not escaped; refuses an existing path (S-09..S-11).

    Returns the digest table of the written part files. ``split`` becomes a folder level.
    """
    line = canonical_json(df)
    out = df.select(line.alias("value"), *([split] if split else []))
    writer = out.write.mode("errorifexists")
    (writer.partitionBy(split) if split else writer).text(path)
    return file_digests(df.sparkSession, path, "part-*")


def write_csv(df: DataFrame, path: str) -> DataFrame:
    """CSV with header; refuses an existing path (S-12)."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)
    return file_digests(df.sparkSession, path, "part-*")


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Parquet, optionally partitioned by split; refuses an existing path."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))
