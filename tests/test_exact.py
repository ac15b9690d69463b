"""Exact distributions of resampled sums against convolution, enumeration and published rows."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.operators import lattice, pairs, resample, stats

#: English-only and Arabic-only discordant pairs, pairs, and the published interval of 10,000 draws, of twelve published rows the eight with counts.
PUBLISHED = [(85, 8, 200, 0.305, 0.46), (176, 0, 200, 0.835, 0.925), (82, 8, 196, 0.29591836734693877, 0.45408163265306123), (173, 0, 196, 0.8367346938775511, 0.9285714285714286),
             (81, 8, 191, 0.3036649214659686, 0.4607329842931937), (169, 0, 191, 0.837696335078534, 0.9267015706806283), (80, 8, 186, 0.3064516129032258, 0.46774193548387094),
             (164, 0, 186, 0.8333333333333334, 0.9247311827956989)]


def test_published_intervals_lie_within_one_step(spark):
    rows = [(i, d) for i, (up, down, n, _, _) in enumerate(PUBLISHED) for d in [1] * up + [-1] * down + [0] * (n - up - down)]
    got = {r["g"]: r for r in lattice.bootstrap_interval(spark.createDataFrame(rows, "g INT, d INT"), "d", by=["g"]).collect()}
    for i, (up, down, n, low, high) in enumerate(PUBLISHED):
        assert got[i]["n"] == n and got[i]["observed"] == pytest.approx((up - down) / n)
        assert abs(got[i]["ci_low"] - low) <= 1 / n + 1e-9 and abs(got[i]["ci_high"] - high) <= 1 / n + 1e-9


def convolved(a, c):
    share = np.zeros(a.max() - a.min() + 1)
    share[a - a.min()] = c / c.sum()
    out = np.array([1.0])
    for _ in range(c.sum()):
        out = np.convolve(out, share)
    return np.cumsum(out), int(c.sum() * a.min())


def test_mean_distribution_matches_convolution():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a = np.unique(rng.integers(-4, 5, rng.integers(1, 5)))
        c = rng.integers(1, 40, len(a))
        upto, first = convolved(a, c)
        found = lattice.MeanDistribution(a, c)
        for p in (0.001, 0.025, 0.5, 0.975):
            assert found.quantile(p) == first + int(np.argmax(upto >= p - 1e-13))
        at = np.arange(len(upto)) + first - found.centre
        assert max(abs(found.below(int(y)) - u) for y, u in zip(at, upto)) < 1e-12


def test_work_does_not_grow_with_rows():
    found = lattice.MeanDistribution(np.array([-1, 0, 1]), np.array([3 * 10**11, 4 * 10**11, 3 * 10**11]))
    assert len(found.k) < 100
    assert found.quantile(0.975) / 10**12 == pytest.approx(1.959964 * math.sqrt(0.6 / 10**12), rel=1e-5)


def test_signs_match_enumeration(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g in range(25):
        d = rng.integers(-5, 6, rng.integers(1, 13)) * int(rng.choice([1, 3]))
        rows += [(g, int(x)) for x in d]
        sizes = [abs(int(x)) for x in d if x]
        sums = [abs(sum(s)) for s in itertools.product(*[(-x, x) for x in sizes])]
        want[g] = (len(d), int(d.sum()), np.mean([s >= abs(d.sum()) for s in sums]))
    got = lattice.sign_flip_exact(spark.createDataFrame(rows, "g INT, d INT"), "d", by=["g"]).collect()
    assert {r["g"] for r in got} == set(want)
    for r in got:
        n, total, p = want[r["g"]]
        assert (r["n"], r["observed_sum"]) == (n, total) and r["sign_flip_p"] == pytest.approx(p, rel=1e-11)


def test_far_tails_keep_their_digits():
    tail = lattice.SignedSum(np.array([1]), np.array([2000]), 800).tail()
    assert tail == pytest.approx(sum(math.comb(2000, k) for k in range(1400, 2001)) / 2**2000, rel=1e-10)
    parts = lattice.SignedSum(np.arange(1, 60), np.ones(59, int), 590)
    cuts = [0, 7, parts.frequencies() // 2, parts.frequencies()]
    assert sum(parts.part(a, b) for a, b in zip(cuts, cuts[1:])) == pytest.approx(parts.part(0, parts.frequencies()), rel=1e-12)


def test_extreme_and_empty_groups(spark):
    rows = [("ends", 1)] * 3000 + [("zero", 0)] * 5 + [("even", 1), ("even", -1), (None, 2), (None, None)]
    df = spark.createDataFrame(rows, "g STRING, d INT")
    got = {r["g"]: r for r in lattice.sign_flip_exact(df, "d", by=["g"]).collect()}
    assert got["ends"]["log10_p"] == pytest.approx(-2999 * math.log10(2)) and got["ends"]["sign_flip_p"] == 0.0
    assert got["zero"]["sign_flip_p"] == got["even"]["sign_flip_p"] == got[None]["sign_flip_p"] == 1.0
    limits = {r["g"]: (r["ci_low"], r["ci_high"]) for r in lattice.bootstrap_interval(df, "d", by=["g"]).collect()}
    assert limits["ends"] == (1, 1) and limits["zero"] == (0, 0) and limits[None] == (2, 2)
    assert lattice.sign_flip_exact(df.where("false"), "d", by=["g"]).count() == 0
    one = lattice.bootstrap_interval(df.where("g = 'even'"), "d").first()
    assert (one["n"], one["observed"]) == (2, 0)
    assert lattice.bootstrap_interval(df.where("g = 'even'"), "d", by=["g"], max_cells=1).first()["ci_low"] is None
    odd = spark.createDataFrame([(1,), (2,), (4,)], "d INT")
    assert lattice.sign_flip_exact(odd, "d", max_cells=2).first()["sign_flip_p"] is None and lattice.sign_flip_exact(odd, "d").first()["sign_flip_p"] == 0.25
    with pytest.raises(Exception, match="not on the lattice"):
        lattice.bootstrap_interval(spark.createDataFrame([(0.25,)], "d DOUBLE"), "d").collect()
    halves = lattice.bootstrap_interval(spark.createDataFrame([(0.5,), (1.0,), (0.0,)], "d DOUBLE"), "d", step=0.5).first()
    assert halves["observed"] == 0.5 and halves["ci_low"] == 0.0 and halves["ci_high"] == 1.0


def test_draws_agree_with_the_exact_distribution(spark):
    d = [1] * 85 + [-1] * 8 + [0] * 107 + [2] * 10
    df = spark.createDataFrame(list(enumerate(d)), "id LONG, d INT")
    exact, drawn = lattice.bootstrap_interval(df, "d").first(), resample.paired_bootstrap(df, "id", "d", 10_000, 42).first()
    assert drawn["observed"] == pytest.approx(exact["observed"])
    for c in ("ci_low", "ci_high"):
        assert abs(exact[c] - drawn[c]) <= 2 / len(d)
    flat = spark.createDataFrame(list(enumerate([1] * 22 + [-1] * 14 + [2] * 3)), "id LONG, d INT")
    p, drawn = lattice.sign_flip_exact(flat, "d").first()["sign_flip_p"], resample.sign_flip_test(flat, "id", "d", 20_000, 1).first()["randomisation_p"]
    assert abs(p - drawn) < 5 * math.sqrt(p * (1 - p) / 20_000)


def rank_p(d):
    """Shift algorithm over doubled average ranks: the plain dynamic programme."""
    size = np.abs(d[d != 0])
    ranks = np.array([2 * (size < s).sum() + (size == s).sum() + 1 for s in size])
    ways = np.zeros(ranks.sum() + 1)
    ways[0] = 1.0
    for r in ranks:
        ways[r:] += ways[:-r].copy()
        ways /= 2
    plus = ranks[d[d != 0] > 0].sum()
    low = min(plus, ranks.sum() - plus)
    return min(1.0, 2 * ways[:low + 1].sum())


def test_signed_ranks_with_ties_at_any_size(spark):
    rng = np.random.default_rng(3)
    groups = {g: np.round(rng.normal(0.15, 1, n) * scale) for g, (n, scale) in enumerate([(1, 1), (7, 1), (30, 2), (60, 1), (150, 40), (400, 3)])}
    df = spark.createDataFrame([(g, float(x), 0.0) for g, d in groups.items() for x in d], "g INT, a DOUBLE, b DOUBLE")
    got = {r["g"]: r for r in stats.signed_rank_test(df, "a", "b", ["g"], method="exact").collect()}
    for g, d in groups.items():
        if (d != 0).any():
            assert got[g]["method"] == "exact" and got[g]["wilcoxon_p"] == pytest.approx(rank_p(d), rel=1e-9)
    many = stats.signed_rank_test(df, "a", "b", ["g"]).where("g = 5").first()
    normal = stats.signed_rank_test(df, "a", "b", ["g"], method="normal").where("g = 5").first()
    assert many["method"] == "exact" and normal["method"] == "normal" and abs(many["wilcoxon_p"] - normal["wilcoxon_p"]) < 0.01


def test_scenarios_from_masks_equal_repeated_rows(spark):
    names = ["full", "one", "two", "none_left"]
    rows = spark.range(60).select("id", (F.col("id") % 3 - 1).alias("d"), (F.col("id") % 2).alias("model"))
    drops = spark.createDataFrame([("one", i) for i in range(0, 60, 4)] + [("two", i) for i in range(0, 30)] + [("none_left", i) for i in range(60)] + [("other", 1)], "scenario STRING, id LONG")
    by_mask = pairs.scenario_value_counts(rows, "id", "d", names, drops, ["model"]).collect()
    by_row = pairs.scenario_rows(rows, "id", names, drops).groupBy("scenario", "model", "d").count().collect()
    assert {(r["scenario"], r["model"], r["a"]): r["c"] for r in by_mask} == {(r["scenario"], r["model"], r["d"]): r["count"] for r in by_row}
    plan = pairs.scenario_value_counts(rows, "id", "d", names, drops)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode") < plan.rindex("Aggregate")  # rows are counted below the generator
    with pytest.raises(ValueError):
        pairs.scenario_masks(rows, "id", [str(i) for i in range(64)], drops)


def test_pairing_refuses_repeated_rows(spark):
    rows = [(1, "a", "m", 1), (1, "b", "m", 0), (2, "a", "m", 1), (3, "c", "m", 1), (4, "a", "m", 1), (4, "b", "m", 0), (4, "b", "m", 1), (5, "b", "m", 1)]
    df = spark.createDataFrame(rows, "p INT, s STRING, m STRING, c INT")
    assert {r["problem"]: (r["n_keys"], r["n_rows"]) for r in pairs.unpaired_keys(df, ["p"], "s", "a", "b").collect()} == {
        "repeated": (1, 3), "only_a": (1, 1), "only_b": (1, 1), "neither": (1, 1)}
    assert pairs.paired_outcomes(df.where("p <> 4"), ["p"], "s", "c", "a", "b").count() == 1
    with pytest.raises(Exception, match="repeated rows of b"):
        pairs.paired_outcomes(df, ["p"], "s", "c", "a", "b").collect()
    with pytest.raises(Exception, match="repeated rows of m/b"):
        pairs.cross_model_outcomes(df, "p", "m", "s", "c", ("m", "n"), ("a", "b")).collect()


def test_signs_of_many_ranks_are_whole_and_ship_plain_arrays(spark):
    """A window of more than 2**28 frequencies; the sum of 600,000 ranks is normal to about 1e-6."""
    df = spark.range(60_000).selectExpr("'g' AS g", "20 * id + 11 AS a", "10L AS c")
    a, c = 20 * np.arange(60_000) + 11, 10
    spread = math.sqrt(float((a.astype(float) ** 2 * c).sum()))
    x = 2 * int(0.75 * spread) + int((a * c).sum()) % 2
    got = lattice.two_sided_signs(df, spark.createDataFrame([("g", x)], "g STRING, x BIGINT"), ["g"]).first()
    assert got["sign_p"] == pytest.approx(math.erfc(x / spread / math.sqrt(2)), abs=3e-6)
    sizes = lattice.SignedSum(a, np.full(60_000, c), x)
    assert sizes.frequencies() > 1 << 28 and sum(len(k) for k in sizes._audible(0, 1 << 24, sizes.a, sizes.chance, sizes.c)) < 1 << 14


def test_blocks_of_frequencies_keep_all_that_count():
    """Sizes that are nearly all even: half a period away the factors are large again."""
    rng = np.random.default_rng(3)
    for odd in (1, 3):
        a, c = np.array([*rng.choice(np.arange(2, 400, 2), 40, replace=False), *[2 * i + 1 for i in range(odd)]]), np.ones(40 + odd, int)
        chances = np.ones(1)
        for v in a:
            wider = np.zeros(len(chances) + 2 * v)
            wider[:len(chances)] += chances / 2
            wider[2 * v:] += chances / 2
            chances = wider
        total = int(a.sum())
        for x in (total % 2 + 2, total // 3 // 2 * 2 + total % 2):
            assert lattice.SignedSum(a, c, x).tail() == pytest.approx(chances[x + total:].sum(), rel=1e-11)


@pytest.mark.parametrize("method", ["exact", "auto"])
def test_signed_ranks_with_more_sizes_than_a_task_holds(spark, method):
    """Groups above and below the limit, ties, zeros, one with every sign alike; none falls back on the normal distribution or is left without p."""
    rng = np.random.default_rng(4)
    groups = {g: np.round(rng.normal(0.15, 1, n) * scale) for g, (n, scale) in enumerate([(30, 2), (150, 40), (400, 3), (90, 1000)])}
    groups[4] = np.arange(1.0, 13.0)
    df = spark.createDataFrame([(g, float(x), 0.0) for g, d in groups.items() for x in d], "g INT, a DOUBLE, b DOUBLE")
    got = {r["g"]: r for r in stats.signed_rank_test(df, "a", "b", ["g"], method, max_cells=9).collect()}
    assert sum(len(set(np.abs(d[d != 0]))) > 9 for d in groups.values()) == 3
    for g, d in groups.items():
        assert got[g]["method"] == "exact" and got[g]["wilcoxon_p"] == pytest.approx(rank_p(d), rel=1e-9)
    whole = stats.signed_rank_test(df.where("g = 1"), "a", "b", method=method, max_cells=9).first()
    assert whole["method"] == "exact" and whole["wilcoxon_p"] == pytest.approx(rank_p(groups[1]), rel=1e-9)
    even = spark.createDataFrame([(float(x), 0.0) for x in (3, -2, -1)], "a DOUBLE, b DOUBLE")
    assert stats.signed_rank_test(even, "a", "b", method=method, max_cells=2).first()["wilcoxon_p"] == 1.0


def test_windows_of_any_size():
    """2**45 and more frequencies: products modulo the window are right, and blocks left out keep the search short."""
    rng = np.random.default_rng(6)
    for size in (1 << 30, (1 << 38) + 7, (1 << 49) + 3, (1 << 57) + 1):
        k, m = rng.integers(0, size, (50, 1)), rng.integers(0, size, (1, 40))
        assert (lattice._times(k, m, size) == (k.astype(object) * m % size).astype(np.int64)).all()
    a, c = np.array([70_001, 150_003, 290_001, 510_007, 900_001]) * 1_000 + 3, np.full(5, 10**8)
    spread = math.sqrt(float((a.astype(float) ** 2 * c).sum()))
    x = 2 * int(0.35 * spread) + int((a * c).sum()) % 2
    s = lattice.SignedSum(a, c, x)
    assert s.frequencies() > 1 << 40
    near = np.concatenate(list(s._audible(0, 1 << 32, s.a, s.chance, s.c)))
    assert 0 < len(near) < 1 << 14 and near[0] == 0
