"""Order-dependent totals on data of any size (S-04, W-02, W-03, W-04, T-03).

A window without a partition key would pull every row through one task. Here the ordering column is
cut into value ranges of similar row counts; each range is a window partition of its own and takes a
carried-in offset from the totals of the ranges before it. The range totals have at most one row per
range and group key, so only they meet in a small window.

Callers first reduce to one row per distinct value (``distinct_values``): a value that holds a third
of all rows is then one row, never one task.
"""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.session import cut_lineage, shuffle_width


def range_bounds(df: DataFrame, order: str, ranges: int | None = None) -> DataFrame:
    """One row ``bounds``: cut points of an ordering column, from a quantile sketch that tasks merge inside the plan. No job runs before the query does.

    The cuts decide only how evenly the ranges fill, never a result.
    """
    ranges = ranges or shuffle_width(df.sparkSession)
    probs = F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array().cast("array<double>")
    value = F.col(order).cast("double")
    sketch = df.select(value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).agg(F.kll_sketch_agg_double("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return sketch.select(F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("s", probs)).alias("bounds"))


def in_ranges(df: DataFrame, order: str, bounds: DataFrame, ranges: int | None = None, out: str = "_range") -> DataFrame:
    """Rows with the index of the range their value falls into; a balanced CASE tree over the cut points, log2(ranges) comparisons a row."""
    value, last = F.col(order).cast("double"), (ranges or shuffle_width(df.sparkSession)) - 1

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.get("_bounds", F.lit(mid)), node(lo, mid)).otherwise(node(mid + 1, hi))
    return df.withColumn("_bounds", bounds.scalar()).withColumn(out, node(0, last)).drop("_bounds")


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row table as scalar subqueries: no join at all."""
    cell = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("_one_row", cell).select(*df.columns, *[
        F.col(f"_one_row.{c}").alias(c) for c in one_row.columns])


def attach(df: DataFrame, totals: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join per-key totals back; keys are compared null-safely, the right side's copies are dropped."""
    if not keys:
        return with_scalars(df, totals)
    renamed = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                            *[c for c in totals.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(renamed, same, how).drop(*[f"_k{i}" for i in range(len(keys))])


def distinct_values(df: DataFrame, by: list[str], value: str, aggs: list[Column]) -> DataFrame:
    """One row per (group, value) with partial aggregation on the map side."""
    return df.groupBy(*by, value).agg(*aggs)


def running_totals(df: DataFrame, order: str, totals: dict[str, str], by: list[str] | None = None,
                   descending: bool = False, ranges: int | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """Add running sums of columns along ``order`` (one row per value and group expected).

    ``totals`` maps the new column to the summed column. Sums include the current row.
    """
    by = by or []
    bounds = range_bounds(df, order, ranges) if bounds is None else bounds
    cut = in_ranges(df, order, bounds, ranges)
    per_range = cut.groupBy(*by, "_range").agg(*[F.sum(src).alias(f"_sum_{out}") for out, src in totals.items()])
    range_key = F.col("_range").desc() if descending else F.col("_range").asc()
    # At most as many rows per group key as there are ranges.
    carried_over = Window.partitionBy(*(by or [F.lit(0)])).orderBy(range_key).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(*by, "_range", *[
        F.coalesce(F.sum(f"_sum_{out}").over(carried_over), F.lit(0)).alias(f"_off_{out}") for out in totals])
    order_key = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*by, "_range").orderBy(order_key).rowsBetween(Window.unboundedPreceding, 0)
    joined = attach(cut, offsets, [*by, "_range"])
    for out, src in totals.items():
        joined = joined.withColumn(out, F.sum(src).over(inside) + F.col(f"_off_{out}"))
    return joined.drop("_range", *[f"_off_{out}" for out in totals])


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None, extra: list[Column] | None = None,
                  ranges: int | None = None) -> DataFrame:
    """One row per distinct value with its tie count and average rank (W-03).

    ``extra`` adds aggregates per value, for example the number of rows of one sample.
    """
    by = by or []
    bounds = range_bounds(df, value, ranges)
    counted = distinct_values(df, by, value, [F.count(F.lit(1)).alias("ties"), *(extra or [])])
    ranked = running_totals(counted, value, {"_upto": "ties"}, by, bounds=bounds)
    return ranked.withColumn("avg_rank", F.col("_upto") - (F.col("ties") - 1) / F.lit(2.0)).drop("_upto")


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] | None = None,
                      ranges: int | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation (T-03), one row per group.

    The position of each percentile falls between two ranks; both are read from running counts of
    distinct values, so no group is ever held in memory.
    """
    by = by or []
    present = df.where(F.col(value).isNotNull())
    bounds = range_bounds(present, value, ranges)
    counted = distinct_values(present, by, value, [F.count(F.lit(1)).alias("_n")])
    placed = running_totals(counted, value, {"_upto": "_n"}, by, bounds=bounds)
    sizes = counted.groupBy(*by).agg(F.sum("_n").alias("_total"))
    placed = attach(placed, sizes, by)
    first = F.col("_upto") - F.col("_n")
    aggs = []
    for name, p in probs.items():
        position = F.lit(p) * (F.col("_total") - 1)
        low, high = F.floor(position), F.ceil(position)

        def at(rank):
            return F.max(F.when((first <= rank) & (rank < F.col("_upto")), F.col(value)))
        share = F.max(position - low)
        aggs.append((at(low) + (at(high) - at(low)) * share).alias(name))
    return placed.groupBy(*by).agg(*aggs)


def numbered(df: DataFrame, order: str, out: str = "position", start: int = 1, ranges: int | None = None) -> DataFrame:
    """Dense numbering along a unique ordering column (W-04)."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), order, {"_pos": "_one"}, ranges=ranges) \
        .withColumn(out, F.col("_pos") + F.lit(start - 1)).drop("_pos", "_one")


def text_ranks(df: DataFrame, text: str, by: list[str] | None = None, out: str = "text_rank") -> DataFrame:
    """Rank of any text inside its group in whole-text order, whatever the texts' lengths and prefixes.

    Spark cuts (group, text) into ranges of similar size; the cut rows are kept, so that counts and ranks see the same ranges. Equal
    texts meet in one range and get ranks in no fixed order.
    """
    by = by or []
    cut = cut_lineage(df.repartitionByRange(*by, text).withColumn("_part", F.spark_partition_id()))
    sizes = cut.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_part").orderBy(text)
    return attach(cut, offsets, [*by, "_part"]).withColumn(out, F.row_number().over(inside) + F.col("_off")).drop("_part", "_off")


def digest_ranks(df: DataFrame, digest: str, by: list[str] | None = None, out: str = "digest_rank",
                 hex_chars: int = 3) -> DataFrame:
    """Rank of a hex digest inside its group, for groups of any size.

    Digests are uniform, so their first characters cut every group into equal parts; a group that
    holds a third of all rows becomes 16^hex_chars window partitions.
    """
    by = by or []
    cut = df.withColumn("_part", F.substring(digest, 1, hex_chars))
    sizes = cut.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_part").orderBy(digest)
    return attach(cut, offsets, [*by, "_part"]).withColumn(out, F.row_number().over(inside) + F.col("_off")) \
        .drop("_part", "_off")
