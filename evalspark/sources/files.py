"""File digests and verification (S-06..S-08)."""
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.checks import require_empty


def file_digests(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, file_name, n_bytes, sha256) per file of any size (S-06).

    Spark lists the files; tasks read them in blocks through the file system named in the path, so no file is ever one row.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    listed = reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("n_bytes"))

    def hashed(batches):
        for batch in batches:
            yield batch.assign(sha256=[_file_sha(p) for p in batch["path"]])
    return listed.repartition("path").mapInPandas(hashed, "path string, file_name string, n_bytes bigint, sha256 string")


def open_store(path: str):
    """The file system a path names, and the place in it; usable on the driver and in tasks."""
    import pyarrow.fs as fs
    return (fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)


def listed_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder in order of their names; names that begin with _ or . are left out."""
    import pyarrow.fs as fs
    store, place = open_store(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path[:-len(place)] if path.endswith(place) else "file:"
    below = store.get_file_info(fs.FileSelector(place, recursive=True))
    return sorted((prefix + f.path, f.size) for f in below if f.type == fs.FileType.File and not any(p[0] in "_." for p in f.path[len(place):].strip("/").split("/")))


def remove_below(path: str, names: list[str]) -> None:
    """Removes folders below ``path``."""
    store, place = open_store(path)
    for name in names:
        store.delete_dir(f"{place.rstrip('/')}/{name}")


def _file_sha(path: str, block: int = 1 << 20) -> str:
    store, place = open_store(path)
    digest = hashlib.sha256()
    with store.open_input_stream(place, compression=None) as stream:
        while piece := stream.read(block):
            digest.update(piece)
    return digest.hexdigest()


def manifest_mismatches(actual: DataFrame, manifest: DataFrame, name: str = "file_name") -> DataFrame:
    """Pinned files that are missing or differ (S-07)."""
    pinned = manifest.select(name, F.col("sha256").alias("expected"))
    return pinned.join(actual.select(name, F.col("sha256").alias("actual")), name, "left") \
        .where(~F.col("actual").eqNullSafe(F.col("expected"))) \
        .withColumn("problem", F.when(F.col("actual").isNull(), "missing").otherwise("changed"))


def verify_files(actual: DataFrame, manifest: DataFrame) -> None:
    require_empty(manifest_mismatches(actual, manifest), "pinned digest mismatch")


def digest_changes(before: DataFrame, after: DataFrame, name: str = "path") -> DataFrame:
    """Files that appeared, vanished or changed between two digest tables (S-08)."""
    a, b = before.select(name, F.col("sha256").alias("before")), after.select(name, F.col("sha256").alias("after"))
    return a.join(b, name, "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))) \
        .withColumn("problem", F.when(F.col("before").isNull(), "appeared").when(F.col("after").isNull(), "vanished")
                    .otherwise("changed"))
