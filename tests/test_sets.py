"""Id containers and digest trees against plain sets."""
import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import checks, idsets, snapshots
from evalspark.plans import review


def plain_gaps(ids, low, high):
    out, at = [], low
    for i in sorted(x for x in set(ids) if low <= x <= high):
        if i > at:
            out.append((at, i - 1))
        at = i + 1
    return out + ([(at, high)] if at <= high else [])


@pytest.mark.parametrize("dense", [True, False, None])
def test_gaps_match_plain_sets(spark, dense):
    rng = random.Random(3)
    W = idsets.WIDTH
    cases = [[], [5], list(range(100)), [rng.randrange(-3 * W, 3 * W) for _ in range(200)], [0, W - 1, W, 2 * W, 2 * W - 1], [i * W for i in range(-4, 5)],
             [W * W * k + rng.choice([-1, 0, 1]) for k in range(-3, 4)], [x for x in range(70_000) if x % 1000]]
    for ids in cases:
        low, high = (min(ids) - 3, max(ids) + 2) if ids and rng.random() < 0.6 else (-10, 2 * W + 7)
        df = spark.createDataFrame([(i,) for i in [*ids, *ids[:3], None]], "id LONG")
        got = idsets.id_gap_ranges(df, "id", low, high, dense).collect()
        assert sorted((r["first_id"], r["last_id"]) for r in got if r["problem"] == "missing") == plain_gaps(ids, low, high)
        assert sorted(r["first_id"] for r in got if r["problem"] == "unexpected") == sorted(x for x in set(ids) if not low <= x <= high)
        assert all(r["n_ids"] == r["last_id"] - r["first_id"] + 1 for r in got)


def test_a_wide_range_costs_its_ids_only(spark):
    ids = [7 + k * 10**13 for k in range(40)] + [2**62]
    df = spark.createDataFrame([(i,) for i in ids], "id LONG")
    got = idsets.gap_ranges(df, "id", 0, 2**62).collect()
    assert sorted(map(tuple, got)) == plain_gaps(ids, 0, 2**62)
    rows = idsets.single_ids(spark.createDataFrame([(1, 200_000), (5, 5)], "first_id LONG, last_id LONG"))
    assert rows.count() == 200_001 and rows.agg(F.min("id"), F.max("id")).first() == (1, 200_000)
    old = checks.id_gaps(spark.createDataFrame([(1,), (3,), (3,), (9,)], "k INT"), "k", 1, 5).collect()
    assert sorted((r["id"], r["problem"]) for r in old) == [(2, "missing"), (4, "missing"), (5, "missing"), (9, "unexpected")]


@pytest.mark.parametrize("dense", [True, False])
def test_ids_without(spark, dense):
    rng = random.Random(4)
    left = [(g, rng.randrange(-70_000, 70_000)) for g in ("a", "b", None) for _ in range(300)]
    right = [x for x in left if rng.random() < 0.5] + [("c", 1), ("a", None)]
    got = idsets.ids_without(*(spark.createDataFrame(t, "g STRING, id LONG") for t in (left, right)), "id", ["g"], dense).collect()
    assert sorted(map(str, ((r["g"], r["id"]) for r in got))) == sorted(map(str, set(left) - set(right)))


def tables(spark):
    rng = random.Random(5)
    left = [(rng.randrange(200), rng.choice([None, "x", "y"]), rng.choice([None, 0.5, -0.0, 0.0])) for _ in range(400)]
    right = left[20:] + left[50:53] + [(1, "x", None), (1, None, None), (999, "new", 1.0)]
    return left, right, *(spark.createDataFrame(t, "k INT, s STRING, d DOUBLE") for t in (left, right))


@pytest.mark.parametrize("keys,bits", [(["k"], 12), (None, 4), (["s"], 1)])
def test_row_differences_match_except_all(spark, keys, bits):
    _, _, a, b = tables(spark)
    plain = a.exceptAll(b).withColumn("side", F.lit("only_left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("only_right")))
    assert sorted(map(str, snapshots.row_differences(a, b, keys, bits).collect())) == sorted(map(str, plain.collect()))


def test_equal_snapshots_exchange_digests_only(spark):
    a = spark.range(5000).select("id", (F.col("id") % 7).cast("string").alias("v"))
    same = a.repartition(5, "v")
    assert snapshots.row_differences(a, same, ["id"]).count() == 0
    left, right = snapshots.differing_parts(a, same.withColumn("v", F.when(F.col("id") == 77, "z").otherwise(F.col("v"))), ["id"])
    assert 1 <= left.count() == right.count() < 12  # the rows of one leaf of 4,096
    moved = snapshots.digest_tree(a, ["id"])
    assert snapshots.unequal_nodes(moved, snapshots.digest_tree(same, ["id"])).count() == 0
    odd = snapshots.unequal_nodes(moved, snapshots.digest_tree(a.where("id <> 77"), ["id"])).collect()
    assert sorted(r["level"] for r in odd) == [0, 1, 2, 3]
    swapped = spark.createDataFrame([(1, None, "q")], "k INT, a STRING, b STRING"), spark.createDataFrame([(1, "q", None)], "k INT, a STRING, b STRING")
    assert snapshots.row_differences(*swapped, ["k"]).count() == 2


def test_revision_diff_reads_changed_records(spark):
    old = spark.createDataFrame([(i, f"t{i}", i % 3) for i in range(60)], "id INT, t STRING, n INT")
    new = old.where("id <> 4").withColumn("t", F.when(F.col("id") == 9, "changed").otherwise(F.col("t"))).unionAll(spark.createDataFrame([(70, "late", 1)], "id INT, t STRING, n INT"))
    got = review.revision_diff(old, new, "id", ["t", "n"]).collect()
    assert sorted((r["id"], r["change"], r["field"]) for r in got) == [(4, "removed", "n"), (4, "removed", "t"), (9, "changed", "t"), (70, "added", "n"), (70, "added", "t")]
