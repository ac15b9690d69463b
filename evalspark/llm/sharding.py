"""Records dealt over weighted shards by rendezvous hashing.

Every (key, shard) pair has a draw u in (0, 1) from its digest; the record goes to the shard with the smallest -ln(u) / weight. A shard is chosen with a
chance in proportion to its weight, and a shard more or less only takes or gives its own records: no draw of another pair changes.

Placement is row-local (one digest per shard). Only numbering moves rows, and only the narrow columns it is asked for, counted before they are shuffled.

Defined results: a null key is placed like an empty text; equal keys share a shard whatever their texts; repeated rows each get a slot of their own; an empty
table gives no rows; input columns named like an output column are replaced.
"""
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.shared import kept

DRAW_HEX = 12               # hex digits of a draw: 48 bits
ROWS_PER_BIN = 1 << 16      # different rows that one numbering window holds
COPIES_PER_ROW = 1 << 16    # slots of equal rows written out from one row of a task


def equal_weights(shards: int) -> dict[int, float]:
    return {s: 1.0 for s in range(shards)}


def home(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key under (shard: weight); equal costs go to the smaller shard."""
    if not weights or any(w <= 0 for w in weights.values()):
        raise ValueError("shards need weights above zero")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def cost(shard: int, weight: float) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat(text, F.lit(f":{shard}"))), 1, DRAW_HEX), 16, 10).cast("double")
        return -F.log((draw + 0.5) / F.lit(float(16 ** DRAW_HEX))) / F.lit(float(weight))
    return F.array_min(F.array(*[F.struct(cost(s, w).alias("cost"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]))["shard"]


def place(records: DataFrame, key_col: str, weights: Mapping[int, float], out: str = "shard") -> DataFrame:
    """Records with their shard. No shuffle."""
    shard = home(F.col(key_col), weights)
    return records.drop(*[c for c in [out] if c != key_col]).withColumn(out, shard)


def moves(records: DataFrame, key_col: str, before: Mapping[int, float], after: Mapping[int, float]) -> DataFrame:
    """(from_shard, to_shard, n_rows) of the records that change their shard between two layouts."""
    pair = records.select(home(F.col(key_col), before).alias("from_shard"), home(F.col(key_col), after).alias("to_shard"))
    return pair.where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count(F.lit(1)).alias("n_rows"))


def slots(rows: DataFrame, shard: str, columns: list[str], out: str = "slot", rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """(shard, columns, slot): gapless numbers from 0 inside every shard, in digest order of ``columns``.

    Rows equal in ``columns`` are counted before the shuffle and written out at the end, so copies cost one row. Digests are uniform: bins of equal
    width hold similar numbers of different rows, and a bin adds the totals of the bins before it. The counted rows are kept, so that both
    passes see the same ones.
    """
    told = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    counted = rows.select(shard, *columns).groupBy(shard, *columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_digest", F.md5(told))
    counted = kept(counted, "slots")
    bins = max(1, -(-counted.count() // rows_per_bin))
    binned = counted.withColumn("_bin", F.floor(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("bigint") * F.lit(bins) / F.lit(float(1 << 32))))
    totals = binned.groupBy(shard, "_bin").agg(F.sum("_n").alias("_total"))
    before = Window.partitionBy(shard).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(shard).alias("_s"), F.col("_bin").alias("_b"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(shard, "_bin").orderBy("_digest", *columns).rowsBetween(Window.unboundedPreceding, -1)
    first = binned.withColumn("_first", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    first = first.join(offsets, F.col(shard).eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_b"))) \
        .select(shard, *columns, "_n", (F.col("_first") + F.col("_offset")).alias("_first"))
    first = kept(first, "first-slots")
    few = first.where(F.col("_n") <= COPIES_PER_ROW)
    many = first.where(F.col("_n") > COPIES_PER_ROW).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(COPIES_PER_ROW).cast("bigint"))))
    many = many.repartition(F.col(shard), F.col("_first"), F.col("_at")).select(
        shard, *columns, F.least(F.col("_n") - F.col("_at"), F.lit(COPIES_PER_ROW)).alias("_n"), (F.col("_first") + F.col("_at")).alias("_first"))
    return few.unionByName(many).select(shard, *columns, F.explode(F.sequence("_first", F.col("_first") + F.col("_n") - 1)).alias(out))


def write_shards(records: DataFrame, key_col: str, weights: Mapping[int, float], folder: str, rows_per_file: int = 1_000_000) -> None:
    """Whole records below ``folder`` as shard=<number>/*.parquet; refuses an existing folder.

    Rebalancing splits large shards over tasks and joins small ones, so files are of similar size and no shard is one task.
    """
    placed = place(records, key_col, weights)
    placed.hint("rebalance", "shard").write.mode("errorifexists").option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(folder)
