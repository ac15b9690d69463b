"""Published values, exact references and scale behaviour of the statistics."""
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalspark.operators import pairs, ranges, resample, scores, stats, tails


def exact_mcnemar(b, c):
    n, k = b + c, min(b, c)
    return float(min(Fraction(1), 2 * sum(Fraction(math.comb(n, i)) for i in range(k + 1)) / Fraction(2) ** n))


def test_mcnemar_published_and_exact(spark):
    published = {(17, 8): 0.1077521443, (14, 5): 0.0635681152, (176, 0): 2.088e-53, (85, 8): 2.264e-17, (9, 0): 0.00390625, (0, 0): 1.0}
    large = [(700, 650), (1200, 1000), (3000, 2500), (5, 1500), (1000, 1000), (900, 100)]
    rows = spark.createDataFrame([(b, c) for b, c in list(published) + large], "b LONG, c LONG")
    got = {(r.b, r.c): r.p for r in rows.withColumn("p", stats.mcnemar_p(F.col("b"), F.col("c"))).collect()}
    for key, value in published.items():
        assert got[key] == pytest.approx(value, rel=1e-3)
        assert got[key] == pytest.approx(exact_mcnemar(*key), rel=1e-12)
    for key in large:
        assert got[key] == pytest.approx(exact_mcnemar(*key), rel=1e-9)


def test_tails_published():
    assert tails.t_two_sided(9.763085, 19) == pytest.approx(7.733e-09, rel=1e-3)
    assert tails.t_quantile(0.975, 19) == pytest.approx(2.0930, abs=5e-5)
    assert tails.signed_rank_exact(0, 20) == pytest.approx(2 / 2 ** 20)
    assert tails.signed_rank_exact(5, 20) == pytest.approx(1.907e-05, rel=1e-3)
    assert tails.gamma_tail(0.5, 1.920729) == pytest.approx(0.05, rel=1e-5)          # chi-square 3.841459, one degree
    assert tails._TAILS["f"](4.351243, 1, 20) == pytest.approx(0.05, rel=1e-4)
    assert tails._TAILS["normal"](1.959964, 1, 1) == pytest.approx(0.05, rel=1e-5)


def test_rank_sum_published_u(spark):
    # 20 against 20 values, U = 393: seven pairs are out of order.
    first = [x + 100 for x in range(20)]
    second = list(range(20))
    first[0] = 12.5
    rows = spark.createDataFrame([(float(v), 1) for v in first] + [(float(v), 0) for v in second], "v DOUBLE, g INT")
    r = stats.rank_sum_test(rows, "v", F.col("g") == 1).first()
    assert r.mann_whitney_u == 393
    assert r.mann_whitney_p == pytest.approx(1.918e-07, rel=1e-2)


@pytest.fixture(scope="module")
def hot(spark):
    """One third of all rows share one value, one group holds most rows."""
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=3000), 2)
    v[::3] = 0.25
    g = np.where(np.arange(3000) % 10 < 8, "big", "small")
    return pd.DataFrame({"g": g, "v": v, "y": (rng.random(3000) < 0.4).astype(int), "id": np.arange(3000)})


def test_percentiles_and_ranks_match_pandas(spark, hot):
    df = spark.createDataFrame(hot).repartition(7)
    got = {r.g: r for r in ranges.exact_percentiles(df, "v", {"a": 0.0, "b": 0.3, "c": 0.5, "d": 0.975, "e": 1.0}, ["g"]).collect()}
    for name, part in hot.groupby("g"):
        for c, p in zip("abcde", (0.0, 0.3, 0.5, 0.975, 1.0)):
            assert got[name][c] == pytest.approx(np.quantile(part.v, p))
    ranks = {(r.g, r.v): r.avg_rank for r in ranges.average_ranks(df, "v", ["g"]).collect()}
    expected = hot.assign(r=hot.groupby("g").v.rank())
    assert ranks == {(r.g, r.v): r.r for r in expected.itertuples()}


def test_running_totals_null_group(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 2, 1), ("a", 1, 5), ("a", 3, 2)], "g STRING, v INT, n LONG")
    got = sorted((str(r.g), r.v, r.t) for r in ranges.running_totals(df, "v", {"t": "n"}, ["g"]).collect())
    assert got == [("None", 1, 1), ("None", 2, 2), ("a", 1, 5), ("a", 3, 7)]


def test_auc_and_threshold_match_brute_force(spark, hot):
    df = spark.createDataFrame(hot)
    pos, neg = hot[hot.y == 1].v.to_numpy(), hot[hot.y == 0].v.to_numpy()
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert scores.roc_auc(df, "y", "v").first().auc == pytest.approx(wins / (len(pos) * len(neg)))
    best = max(((int(((hot.v >= t) == (hot.y == 1)).sum()), -t) for t in hot.v.unique()))
    r = scores.best_threshold(df, "y", "v").first()
    assert (r.tp + r.tn, r.threshold) == (best[0], -best[1])


def test_signed_rank_small_exact(spark):
    rows = spark.createDataFrame([(float(i), 0.0) for i in range(1, 21)], "a DOUBLE, b DOUBLE")
    r = stats.signed_rank_test(rows, "a", "b").first()
    assert (r.wilcoxon_w, r.n_nonzero) == (0, 20) and r.wilcoxon_p == pytest.approx(1.907e-06, rel=1e-3)
    none = stats.signed_rank_test(rows.withColumn("a", F.lit(0.0)), "a", "b").first()
    assert none.wilcoxon_w is None and none.wilcoxon_p is None


def test_bootstrap_modes_agree_with_published_interval(spark):
    # 85 and 8 discordant of 200: published gap 0.385, interval [0.305, 0.46]; one lattice step is 1/200.
    d = [1] * 85 + [-1] * 8 + [0] * 107
    df = spark.createDataFrame(list(enumerate(d)), "id LONG, d INT")
    for mode, n in (("collapse", 10_000), ("hash", 500)):
        r = resample.paired_bootstrap(df, "id", "d", n, 42, mode).first()
        assert r.observed == pytest.approx(0.385) and r.n_replicates == n
        slack = 0.005 if mode == "collapse" else 0.015
        assert abs(r.ci_low - 0.305) <= slack + 1e-9 and abs(r.ci_high - 0.46) <= slack + 1e-9
    a = resample.paired_bootstrap(df.repartition(1), "id", "d", 200, 7, "hash").first()
    assert a == resample.paired_bootstrap(df.repartition(5), "id", "d", 200, 7, "hash").first()


def test_sign_flip(spark):
    df = spark.createDataFrame([(i, 1) for i in range(30)], "id LONG, d INT")
    for mode in ("hash", "collapse"):
        assert resample.sign_flip_test(df, "id", "d", 500, 1, mode).first().randomisation_p == pytest.approx(1 / 501)
    zero = df.withColumn("d", F.lit(0))
    for mode in ("hash", "collapse"):
        assert resample.sign_flip_test(zero, "id", "d", 50, 1, mode).first().randomisation_p == 1.0
    even = spark.createDataFrame([(i, 1 if i % 2 else -1) for i in range(40)], "id LONG, d INT")
    assert resample.sign_flip_test(even, "id", "d", 400, 1).first().randomisation_p > 0.8


def test_collapse_takes_many_values_and_groups(spark, monkeypatch):
    """Continuous outcomes in several blocks and groups: the intervals are those of the normal approximation."""
    df = spark.range(4000).select(F.col("id"), (F.col("id") % 2).alias("g"), (F.sin("id") + F.col("id") % 2).alias("d"))
    monkeypatch.setattr(resample, "VALUES_PER_BLOCK", 300)
    got = {r["g"]: r for r in resample.paired_bootstrap(df, "id", "d", 400, 7, by=["g"]).collect()}
    for g in (0, 1):
        mean, sd = df.where(F.col("g") == g).agg(F.avg("d"), F.stddev_pop("d")).first()
        half = 1.96 * sd / 2000 ** 0.5
        assert got[g]["n_replicates"] == 400 and got[g]["observed"] == pytest.approx(mean)
        assert got[g]["ci_low"] == pytest.approx(mean - half, abs=half * 0.25) and got[g]["ci_high"] == pytest.approx(mean + half, abs=half * 0.25)
    again = {r["g"]: r for r in resample.paired_bootstrap(df.repartition(5), "id", "d", 400, 7, by=["g"]).collect()}
    assert all(got[g]["ci_low"] == pytest.approx(again[g]["ci_low"], abs=1e-12) for g in (0, 1))
    flips = {r["g"]: r for r in resample.sign_flip_test(df.select("id", "g", F.when(F.col("g") == 1, 1).otherwise(F.pmod("id", F.lit(4)) - 1).alias("d")), "id", "d", 500, 7, by=["g"]).collect()}
    assert flips[1]["n_extreme"] == 0 and flips[0]["n_extreme"] > 400


def test_large_tails():
    assert tails.t_two_sided(2.0, 1e12) == pytest.approx(0.045500263896, rel=1e-10)
    assert tails.t_two_sided(2.0, 1e10) == pytest.approx(0.045500263924, rel=1e-9)
    assert tails.binomial_two_sided(5e11 - 1e6, 1e12) == pytest.approx(0.0454998, rel=1e-4)


def test_pairing_gates(spark):
    long = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (2, "a", 1)], "p INT, s STRING, c INT")
    assert pairs.paired_outcomes(long, ["p"], "s", "c", "a", "b").count() == 1
    with pytest.raises(ValueError):
        pairs.paired_outcomes(long, ["p"], "s", "c", "a", "b", on_missing="error")
    with pytest.raises(ValueError):
        pairs.one_to_one_join(long, long, ["p"])
    ids = spark.range(20).withColumn("g", F.lit("x"))
    assert pairs.joined_ids(ids, ["g"], "id").first()["excluded_ids"] == ",".join(map(str, range(20)))
    assert {r["n_ids"] for r in pairs.listed_ids(ids, ["g"], "id").collect()} == {20} and pairs.listed_ids(ids, ["g"], "id").count() == 20
