"""Deterministic sampling, splitting and ordering (W-06..W-15)."""
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.digests import seeded
from evalspark.functions.steps import coverage_labels
from evalspark.operators.checks import CheckFailed, require_empty
from evalspark.operators.ranges import digest_ranks, with_scalars
from evalspark.session import cut_lineage


def hash_threshold(fraction: float) -> str:
    """Hex text of fraction·2²⁵⁶; digests below it are chosen (same double product as integer comparison)."""
    if not 0 < fraction < 1:
        raise CheckFailed("fraction must be between zero and one")
    return f"{int(math.ldexp(fraction, 256)):064x}"


def threshold_split(key: Column, seed: int, dev_fraction: float, anchored: Column | None = None) -> Column:
    """train/dev by digest threshold; an anchored assignment wins (W-09). Strictly row-local: no shuffle."""
    drawn = F.when(seeded(seed, "split", key) < hash_threshold(dev_fraction), "dev").otherwise("train")
    return drawn if anchored is None else F.coalesce(anchored, drawn)


def group_reservoir(df: DataFrame, group: str, k: int, seed: int, anchors: DataFrame | None = None) -> DataFrame:
    """Anchored groups first, then the groups with the lowest digests, k groups in all (W-06).

    Distinct groups, then TakeOrdered: every task keeps at most k candidates. Independent of row order and
    partitioning. Returns (group, priority, anchored, anchored_split).
    """
    priority = seeded(seed, "reservoir", F.col(group))
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    if anchors is None:
        return groups.withColumn("priority", priority).orderBy("priority").limit(k) \
            .withColumn("anchored", F.lit(False)).withColumn("anchored_split", F.lit(None).cast("string"))
    if (n := anchors.select(group).distinct().count()) > k:
        raise CheckFailed(f"a budget of {k} groups is smaller than the {n} anchored ones")
    fixed = anchors.select(group, F.col("split").alias("anchored_split"))
    marked = groups.join(fixed, group, "left").withColumn("anchored", F.col("anchored_split").isNotNull()) \
        .withColumn("priority", priority)
    return marked.orderBy(F.col("anchored").desc(), "priority").limit(k).select(group, "priority", "anchored", "anchored_split")


def check_reservoir(selected: DataFrame, k: int, anchors: DataFrame | None, group: str) -> None:
    """Gates of W-06: enough groups, every anchor present, budget not smaller than the anchors."""
    if k < 2:
        raise CheckFailed("need at least two groups")
    if selected.count() < k:
        raise CheckFailed("fewer eligible groups than requested")
    if anchors is not None:
        require_empty(anchors.select(group).join(selected.select(group), group, "left_anti"), "anchored groups not selected")


def ranked_group_sample(df: DataFrame, group: str, k: int, seed: int, dev_fraction: float) -> DataFrame:
    """Prefix mode (W-07): k lowest ``seed:key`` digests; the first n_dev of them are dev.

    n_dev rounds half to even and leaves at least one group on either side. The rank window runs over at
    most k groups (the budget), never over the source.
    """
    ranked = df.select(group).where(F.col(group).isNotNull()).distinct().withColumn("priority", seeded(seed, F.col(group))) \
        .orderBy("priority").limit(k)
    numbered = digest_ranks(ranked, "priority", out="rank", hex_chars=1)
    sized = with_scalars(numbered, ranked.agg(F.count(F.lit(1)).alias("n_groups")))
    n_dev = F.greatest(F.lit(1), F.least(F.col("n_groups") - 1, F.bround(F.col("n_groups") * F.lit(dev_fraction)).cast("bigint")))
    return sized.withColumn("split", F.when(F.col("rank") <= n_dev, "dev").otherwise("train")).drop("n_groups")


def collect_groups(df: DataFrame, selected: DataFrame, group: str, seed: int, dev_fraction: float) -> DataFrame:
    """All rows of the selected groups with their split (W-08). The selection is at most k rows wide."""
    joined = df.join(selected.select(group, "anchored_split"), group)
    return joined.withColumn("split", threshold_split(F.col(group), seed, dev_fraction, F.col("anchored_split"))) \
        .drop("anchored_split")


def allocate_quota(sizes: DataFrame, category: str, size: str, total: int) -> DataFrame:
    """Largest-remainder allocation over categories (W-10); ties by category name.

    ``sizes`` has one row per category; ranks among categories use integer remainders, so no float ties.
    """
    all_rows = sizes.agg(F.sum(size).alias("_all"))
    ideal = with_scalars(sizes, all_rows).withColumn("_base", F.floor(F.col(size) * total / F.col("_all"))) \
        .withColumn("_rest", F.pmod(F.col(size) * total, F.col("_all")))
    given = ideal.agg(F.sum("_base").alias("_given"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_rest").desc(), F.col(category))
    ranked = with_scalars(ideal, given).withColumn("_rank", F.row_number().over(order))  # one row per category
    return ranked.select(category, size, (F.col("_base") + (F.col("_rank") <= total - F.col("_given")).cast("int")).alias("quota"))


def stratified_pick(df: DataFrame, key: str, category: str, total: int, seed: int) -> DataFrame:
    """Quota per category by largest remainder, lowest digests inside it (W-10): (key, category, split)."""
    items = df.select(key, category).distinct().withColumn("_digest", seeded(seed, F.col(key)))
    sizes = items.groupBy(category).agg(F.count(F.lit(1)).alias("n_items"))
    ranked = digest_ranks(items, "_digest", [category], "_rank")
    quota = allocate_quota(sizes, category, "n_items", total).select(category, "quota")
    return ranked.join(quota, category).withColumn(
        "split", F.when(F.col("_rank") <= F.col("quota"), "dev").otherwise("train")).select(key, category, "split")


def sample_unused(df: DataFrame, key: str, k: int, seed: int, used: DataFrame | None = None) -> DataFrame:
    """k keys in digest order, used ones left out (W-11)."""
    pool = df.select(key).distinct()
    if used is not None:
        pool = pool.join(used.select(key).distinct(), key, "left_anti")
    return pool.withColumn("_digest", seeded(seed, "sample", F.col(key))).orderBy("_digest").limit(k).select(key)


SIGNATURE_COUNT = 24  # 3 length classes × 4 error positions × 2 neutral flags


def coverage_candidates(df: DataFrame, quota: Column, seed: int, split: str = "split", limit: int | None = None) -> DataFrame:
    """Rows that a greedy coverage choice can ever reach.

    The gain of a row depends only on its coverage signature, so within (split, variant, signature) rows are
    taken in digest order; only the first ``quota`` of each matter. ``limit`` (a plain number) lets Spark apply
    the rank limit before the shuffle.
    """
    labels = coverage_labels(F.size("steps"), F.col("first_error_step"), F.col("source_step_ratings"))
    signed = df.withColumn("labels", labels).withColumn("signature", F.array_join("labels", "/")) \
        .withColumn("priority", seeded(seed, F.col("id")))
    order = Window.partitionBy(split, "variant", "signature").orderBy("priority")
    ranked = signed.withColumn("_rank", F.row_number().over(order))
    if limit is not None:
        ranked = ranked.where(F.col("_rank") <= limit)
    return ranked.where(F.col("_rank") <= quota).drop("_rank")


def greedy_coverage(df: DataFrame, counts: dict[str, int], seed: int, excluded: DataFrame | None = None,
                    max_steps: int | None = None, split: str = "split") -> DataFrame:
    """Equal variant quotas per split, most new coverage labels first, digest tie-break (W-12).

    Returns (split, id, variant, pick_order). What a row adds depends on its signature alone, and once a signature is picked it adds nothing
    more. So the picks that add labels come from the first row of each signature (at most SIGNATURE_COUNT of a split and variant, which
    come to the driver), and the rest of a quota is plain digest order, ranked in parts of the digest, so that a quota of any size is never one
    task. The narrow rows are computed once and kept.
    """
    for name, count in counts.items():
        if count < 2 or count % 2:
            raise CheckFailed(f"{name}: counts must be even and at least two")
    rows = df.where(F.col(split).isin(list(counts)))
    if max_steps is not None:
        rows = rows.where(F.size("steps") <= max_steps)
    if excluded is not None:
        rows = rows.join(excluded.select("id").distinct(), "id", "left_anti")
    labels = coverage_labels(F.size("steps"), F.col("first_error_step"), F.col("source_step_ratings"))
    signed = cut_lineage(rows.select(split, "id", "variant", labels.alias("labels"), seeded(seed, F.col("id")).alias("priority")))
    signed = signed.toDF(*signed.columns)  # columns of their own: kept rows would go by those of ``df``, which callers join with
    heads: dict[tuple[str, str], list] = {}
    for r in signed.groupBy(split, "variant", "labels").agg(F.min(F.struct("priority", "id")).alias("head"), F.count(F.lit(1)).alias("n")).collect():
        heads.setdefault((r[split], r["variant"]), []).append(r)
    chosen, wanted, base = [], F.lit(0), F.lit(0)
    for name, count in counts.items():
        seen: set[str] = set()
        for turn, variant in enumerate(("correct", "incorrect")):
            quota, left = count // 2, heads.get((name, variant), [])
            if sum(r["n"] for r in left) < quota:
                raise CheckFailed(f"not enough {variant} trajectories in {name}")
            picked = []
            while left and len(picked) < quota:
                best = min(left, key=lambda r: (-len(set(r["labels"]) - seen), r["head"]["priority"]))
                if not set(best["labels"]) - seen:
                    break
                seen |= set(best["labels"])
                left.remove(best)
                picked.append(best["head"]["id"])
            chosen += [(i, turn * quota + at) for at, i in enumerate(picked, 1)]
            mine = (F.col(split) == name) & (F.col("variant") == variant)
            wanted = F.when(mine, quota - len(picked)).otherwise(wanted)
            base = F.when(mine, turn * quota + len(picked)).otherwise(base)
    place = F.lit(None).cast("int")
    if chosen:
        place = F.try_element_at(F.create_map(*[F.lit(x) for pair in chosen for x in pair]), F.col("id"))
    placed = signed.select(split, "id", "variant", "priority", place.alias("_place"))
    first = placed.where("_place IS NOT NULL").select(split, "id", "variant", F.col("_place").alias("pick_order"))
    rest = digest_ranks(placed.where("_place IS NULL"), "priority", [split, "variant"]).where(F.col("digest_rank") <= wanted)
    return first.unionAll(rest.select(split, "id", "variant", (F.col("digest_rank") + base).cast("int").alias("pick_order")))


def display_order(df: DataFrame, problem: str, side: str, first: str) -> DataFrame:
    """By problem, one side first (W-13). A range-partitioned sort for reports."""
    return df.orderBy(problem, F.when(F.col(side) == first, 0).otherwise(1), side)


def alternating_plan(problems: DataFrame, key: str, a: str, b: str, side: str = "language") -> DataFrame:
    """Odd keys a first, even keys b first (W-14): (key, turn, side)."""
    order = F.when(F.pmod(F.col(key), F.lit(2)) == 1, F.array(F.lit(a), F.lit(b))).otherwise(F.array(F.lit(b), F.lit(a)))
    return problems.select(key, F.posexplode(order).alias("turn", side))
