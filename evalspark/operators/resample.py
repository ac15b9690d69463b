"""Paired bootstrap and sign-flip randomisation (T-02..T-05).

Two modes give the same statistic:

``hash``    every row is one draw slot; the draw of replicate b at slot k is a digest of (seed, b, k).
            Repeatable in any SQL engine. Work is rows × replicates, expanded and summed inside the map
            task, so only replicates × tasks partial sums are shuffled. For small and medium tables.
``collapse`` outcomes are first reduced to distinct values with counts (a handful for 0/1 outcomes), by group; values fall into
            blocks of about VALUES_PER_BLOCK. A replicate draws the block totals first and then, block by block in different
            tasks, the values inside: together one multinomial draw over all counts. Work is replicates × distinct values whatever
            the number of rows, and no task holds more than a block. For large tables.
"""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.ranges import attach, with_scalars
from evalspark.session import shuffle_width

DRAW_HEX = 12       # hex digits of the digest used for one draw: 48 bits
REPLICATES_PER_TASK = 2048
VALUES_PER_BLOCK = 4096


def _draw(seed: int, replicate: Column, slot: Column) -> Column:
    text = F.concat(F.lit(f"{seed}:"), replicate.cast("string"), F.lit(":"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, DRAW_HEX), 16, 10).cast("bigint")


def _replicates(df: DataFrame, count: int) -> DataFrame:
    """Every slot times every replicate. The narrow slots are spread first: the expansion is count times larger."""
    return df.repartition(shuffle_width(df.sparkSession)).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def value_counts_row(df: DataFrame, value: str) -> DataFrame:
    """One row: sorted distinct values with cumulative counts, for the ``hash`` mode and its few distinct values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    row = counted.agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("cells"))
    upto = F.transform("cells", lambda x, i: F.aggregate(
        F.slice("cells", 1, i + 1), F.lit(0).cast("bigint"), lambda acc, y: acc + y["c"]))
    return row.select(
        F.transform("cells", lambda x: x["v"]).alias("values"), upto.alias("upto"),
        F.aggregate("cells", F.lit(0).cast("bigint"), lambda acc, x: acc + x["c"]).alias("n"))


def value_blocks(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """(by, block, values, counts, totals, n): distinct values in blocks, with the totals of all blocks of the group."""
    counted = df.select(*by, value.cast("double").alias("v")).where("v IS NOT NULL").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))
    sizes = counted.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / VALUES_PER_BLOCK)).cast("int").alias("nb"), F.sum("c").alias("n"))
    placed = attach(counted, sizes, by).withColumn("block", F.pmod(F.xxhash64("v"), F.col("nb")).cast("int"))
    cells = F.array_sort(F.collect_list(F.struct("v", "c")))
    blocks = placed.groupBy(*by, "block", "n").agg(cells.alias("cells"), F.sum("c").alias("total"))
    totals = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("block", "total"))).alias("totals"))
    return attach(blocks, totals, by).select(*by, "block", F.transform("cells", lambda x: x["v"]).alias("values"), F.transform("cells", lambda x: x["c"]).alias("counts"),
                                             "totals", "n")


def _per_replicate(blocks: DataFrame, by: list[str], replicates: int, draw) -> DataFrame:
    """(by, replicate, s, n): the sums that ``draw(row, replicate)`` gives for all blocks of a group."""
    chunks = -(-replicates // REPLICATES_PER_TASK)
    spread = blocks.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("_g", F.xxhash64(F.lit(0), *by))
    if chunks > 1 or by:
        spread = spread.repartition("_chunk", "block", *by)

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                first = dict(zip(pdf.columns, row))
                ids = np.arange(first["_chunk"] * REPLICATES_PER_TASK, min(replicates, (first["_chunk"] + 1) * REPLICATES_PER_TASK))
                yield pd.DataFrame({c: [first[c]] * len(ids) for c in by} | {"replicate": ids.astype("int32"), "s": [draw(first, int(i)) for i in ids], "n": first["n"]})
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in blocks.schema.fields if f.name in by)
    return spread.mapInPandas(run, fields + "replicate int, s double, n bigint").groupBy(*by, "replicate").agg(F.sum("s").alias("s"), F.first("n").alias("n"))


def bootstrap_means_hash(df: DataFrame, slot: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, mean): a draw below the cumulative count of a value picks that value."""
    rows = df.where(F.col(value).isNotNull()).select(slot)
    drawn = with_scalars(_replicates(rows, replicates), value_counts_row(df, value)).withColumn(
        "_pick", F.pmod(_draw(seed, F.col("replicate"), F.col(slot)), F.col("n")))
    below = F.size(F.filter("upto", lambda u: u <= F.col("_pick")))
    return drawn.select("replicate", F.try_element_at("values", below + 1).alias("_v")).groupBy("replicate").agg(
        F.avg("_v").alias("mean"))


def bootstrap_means_collapsed(df: DataFrame, value: str, replicates: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """(by, replicate, mean): one multinomial draw per replicate and group over the value counts."""
    by = by or []

    def draw(row, replicate):
        key = [seed, int(row["_g"]) & (2**63 - 1), replicate]
        totals = np.array([t["total"] for t in row["totals"]], dtype=float)
        hits = np.random.default_rng(key).multinomial(int(row["n"]), totals / totals.sum())
        mine = hits[[t["block"] for t in row["totals"]].index(row["block"])]
        counts = np.asarray(row["counts"], dtype=float)
        inside = np.random.default_rng([*key, int(row["block"]) + 1]).multinomial(int(mine), counts / counts.sum())
        return float(np.dot(inside, np.asarray(row["values"], dtype=float)))
    sums = _per_replicate(value_blocks(df, F.col(value), by), by, replicates, draw)
    return sums.select(*by, "replicate", (F.col("s") / F.col("n")).alias("mean"))


def percentile_interval(means: DataFrame, value: str = "mean", low: float = 0.025, high: float = 0.975, by: list[str] | None = None) -> DataFrame:
    """Percentile interval of the replicates, linear interpolation; the replicate count is a parameter."""
    return means.groupBy(*(by or [])).agg(F.percentile(value, F.lit(low)).alias("ci_low"), F.percentile(value, F.lit(high)).alias("ci_high"),
                                          F.count(F.lit(1)).alias("n_replicates"))


def paired_bootstrap(df: DataFrame, slot: str, value: str, replicates: int = 10_000, seed: int = 42,
                     mode: str = "collapse", by: list[str] | None = None) -> DataFrame:
    """Bootstrap interval of the mean of a paired difference (T-02), one row per group of ``by``."""
    if mode == "hash" and not by:
        means = bootstrap_means_hash(df, slot, value, replicates, seed)
    elif mode == "collapse":
        means = bootstrap_means_collapsed(df, value, replicates, seed, by)
    else:
        raise ValueError(f"unknown mode: {mode}")
    return attach(percentile_interval(means, by=by), df.groupBy(*(by or [])).agg(F.avg(value).alias("observed")), by or [])


def sign_flip_sums_hash(df: DataFrame, slot: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, flipped sum); rows with difference 0 cannot contribute and are left out."""
    rows = df.where(F.col(value) != 0).select(slot, F.col(value).cast("bigint").alias("_d"))
    sign = F.when(F.pmod(_draw(seed, F.col("replicate"), F.col(slot)), F.lit(2)) == 0, 1).otherwise(-1)
    return _replicates(rows, replicates).groupBy("replicate").agg(F.sum(F.col("_d") * sign).alias("flipped"))


def sign_flip_sums_collapsed(df: DataFrame, value: str, replicates: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """(by, replicate, flipped): a binomial draw per distinct magnitude."""
    by = by or []

    def draw(row, replicate):
        rng = np.random.default_rng([seed, int(row["_g"]) & (2**63 - 1), replicate, int(row["block"])])
        counts = np.asarray(row["counts"], dtype=np.int64)
        return float(np.dot(2 * rng.binomial(counts, 0.5) - counts, np.asarray(row["values"], dtype=float)))
    sums = _per_replicate(value_blocks(df.where(F.col(value) != 0), F.abs(F.col(value)), by), by, replicates, draw)
    return sums.select(*by, "replicate", F.round("s").cast("bigint").alias("flipped"))


def sign_flip_test(df: DataFrame, slot: str, value: str, replicates: int = 100_000, seed: int = 42,
                   mode: str = "collapse", by: list[str] | None = None) -> DataFrame:
    """Two-sided randomisation p = (extreme + 1) / (replicates + 1) of integer differences (T-04), one row per group of ``by``.

    Sums are compared as integers, so ties with the observed sum count exactly.
    """
    by = by or []
    if mode == "hash" and not by:
        sums = sign_flip_sums_hash(df, slot, value, replicates, seed)
    elif mode == "collapse":
        sums = sign_flip_sums_collapsed(df, value, replicates, seed, by)
    else:
        raise ValueError(f"unknown mode: {mode}")
    observed = df.groupBy(*by).agg(F.coalesce(F.sum(F.col(value).cast("bigint")), F.lit(0).cast("bigint")).alias("observed_sum"), F.count(value).alias("n"))
    hits = attach(sums, observed.select(*by, "observed_sum"), by).groupBy(*by).agg(
        F.count_if(F.abs("flipped") >= F.abs("observed_sum")).alias("hit"), F.count(F.lit(1)).alias("seen"))
    # Without any non-zero difference no replicate row exists and every flip equals the observed sum 0.
    extreme = F.when(F.coalesce("seen", F.lit(0)) == 0, F.lit(replicates)).otherwise(F.col("hit")).cast("bigint")
    return attach(observed, hits, by).select(
        *by, "n", "observed_sum", (F.col("observed_sum") / F.col("n")).alias("observed"), extreme.alias("n_extreme"),
        ((extreme + 1) / F.lit(replicates + 1.0)).alias("randomisation_p"))


def gap_difference_study(wide: DataFrame, slot: str, value: str = "gap_difference", replicates: int = 10_000,
                         randomisations: int = 100_000, seed: int = 42, mode: str = "collapse", by: list[str] | None = None) -> DataFrame:
    """Cross-model gap difference with interval and randomisation p (T-05), one row per group of ``by``."""
    interval = paired_bootstrap(wide, slot, value, replicates, seed, mode, by).drop("observed")
    return attach(interval, sign_flip_test(wide, slot, value, randomisations, seed, mode, by), by or [])
