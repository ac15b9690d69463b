"""Session settings the library is designed for, and plan helpers that depend on them."""
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "evalspark", master: str | None = None, shuffle_partitions: int | None = None,
                  checkpoint_dir: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Methods beyond this size are not compiled by the JVM; wide regular-expression projections run faster split up.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    if checkpoint_dir and not spark.conf.get("spark.checkpoint.dir", None) \
            and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir)
    return spark


def shuffle_width(spark: SparkSession) -> int:
    """Number of reduce tasks the session asks for; also used as the number of value ranges."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local master without that setting (tests on one machine) gets a folder of its own; a cluster that
    names none gets none, and jobs that keep rows stop.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted and context.master.startswith("local"):
        wanted = tempfile.mkdtemp(prefix="evalspark-checkpoints-")
    if wanted:
        context.setCheckpointDir(wanted)
    return wanted


def cut_lineage(df: DataFrame) -> DataFrame:
    """Rows kept in the shared checkpoint folder: computed once, and a lost executor costs a re-read only."""
    if not ensure_checkpoint_dir(df.sparkSession):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return df.checkpoint(eager=True)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that filters and projections above must not inline.

    A filter on a projected column is pushed below the projection together with the whole expression, which
    would evaluate it again per use. A generator with exactly one output row stops that.
    """
    cell = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.inline(cell))
