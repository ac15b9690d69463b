"""Paired and group statistics from sufficient statistics (T-01, T-06..T-15).

Every test is one or two distributed aggregates followed by arithmetic on one row per group.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.lattice import MAX_CELLS, signs_in_chunks, two_sided_signs
from evalspark.operators.ranges import attach, average_ranks
from evalspark.operators.tails import tail

PUBLISHED_EXACT_RANKS = 50  # differences up to which method "published" takes the exact signed-rank distribution


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p (T-01), for any number of discordant pairs; 1.0 without any. For result rows."""
    return tail("binomial", F.least(b, c), b + c)


def effect_label(d: Column) -> Column:
    """Fixed bounds 0.2 / 0.5 / 0.8 on the absolute effect (T-08)."""
    size = F.abs(d)
    return F.when(size.isNull(), None).when(size < 0.2, "negligible").when(size < 0.5, "small") \
        .when(size < 0.8, "medium").otherwise("large")


def bonferroni(p: Column, m) -> Column:
    return F.least(p * m, F.lit(1.0))


def verdict(p: Column, alpha: float = 0.05) -> Column:
    """Significance text (T-15)."""
    return F.when(p.isNull(), "not available").when(p < alpha, "significant").otherwise("not significant")


def paired_t_statistics(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """n, means, mean difference, sd, t, degrees of freedom and dz of a - b (T-06, T-08)."""
    d = F.col(a) - F.col(b)
    moments = df.where(d.isNotNull()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd_difference"))
    sd = F.nullif(F.col("sd_difference"), F.lit(0.0))
    return moments.withColumn("standard_error", F.col("sd_difference") / F.sqrt("n_pairs")) \
        .withColumn("paired_t", F.col("mean_difference") / F.nullif(F.col("standard_error"), F.lit(0.0))) \
        .withColumn("df", F.col("n_pairs") - 1) \
        .withColumn("cohens_dz", F.col("mean_difference") / sd) \
        .withColumn("effect", effect_label(F.col("cohens_dz")))


def paired_t_test(df: DataFrame, a: str, b: str, by: list[str] | None = None, confidence: float = 0.95) -> DataFrame:
    """T-06 with p and confidence interval."""
    stats = paired_t_statistics(df, a, b, by)
    reach = tail("t_quantile", F.lit((1 + confidence) / 2), F.col("df")) * F.col("standard_error")
    return stats.withColumn("paired_t_p", tail("t", F.col("paired_t"), F.col("df"))) \
        .withColumn("_reach", reach) \
        .withColumn("ci_low", F.col("mean_difference") - F.col("_reach")) \
        .withColumn("ci_high", F.col("mean_difference") + F.col("_reach")).drop("_reach")


def two_group_moments(df: DataFrame, value: str, in_first: Column, by: list[str] | None = None) -> DataFrame:
    v = F.col(value)
    first, second = F.when(in_first, v), F.when(~in_first, v)
    return df.where(v.isNotNull()).groupBy(*(by or [])).agg(
        F.count(first).alias("n1"), F.count(second).alias("n2"), F.avg(first).alias("mean1"), F.avg(second).alias("mean2"),
        F.var_samp(first).alias("var1"), F.var_samp(second).alias("var2"))


def welch_statistics(df: DataFrame, value: str, in_first: Column, by: list[str] | None = None) -> DataFrame:
    """Welch t, Satterthwaite degrees of freedom, pooled d (T-07, T-08)."""
    m = two_group_moments(df, value, in_first, by)
    e1, e2 = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / (F.col("n1") + F.col("n2") - 2))
    gap = F.col("mean1") - F.col("mean2")
    return m.withColumn("mean_difference", gap).withColumn("welch_t", gap / F.sqrt(e1 + e2)) \
        .withColumn("df", F.pow(e1 + e2, F.lit(2.0)) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))) \
        .withColumn("cohens_d", gap / F.nullif(pooled, F.lit(0.0))).withColumn("effect", effect_label(F.col("cohens_d")))


def welch_test(df: DataFrame, value: str, in_first: Column, by: list[str] | None = None) -> DataFrame:
    return welch_statistics(df, value, in_first, by).withColumn("welch_p", tail("t", F.col("welch_t"), F.col("df")))


def signed_rank_statistics(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Wilcoxon W, rank sums and tie term of a - b, zeros dropped (T-09).

    Differences are first reduced to distinct magnitudes with the number of positive and negative cases.
    """
    return _rank_sums(df, a, b, by or [], _signed_ranks(df, a, b, by or []))


def _signed_ranks(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    cases = df.withColumn("_d", F.col(a) - F.col(b)).where("_d <> 0").withColumn("_size", F.abs("_d"))
    return average_ranks(cases, "_size", by, [F.count_if(F.col("_d") > 0).alias("_pos"), F.count_if(F.col("_d") < 0).alias("_neg")])


def _rank_sums(df: DataFrame, a: str, b: str, by: list[str], ranked: DataFrame) -> DataFrame:
    t = F.col("ties").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum("ties").alias("n_nonzero"), F.sum(F.col("avg_rank") * F.col("_pos")).alias("w_plus"),
        F.sum(F.col("avg_rank") * F.col("_neg")).alias("w_minus"), F.sum(t * t * t - t).alias("tie_term"))
    zeros = df.groupBy(*by).agg(F.count_if(F.col(a) == F.col(b)).alias("n_zero"))
    return attach(sums, zeros, by).withColumn("wilcoxon_w", F.least("w_plus", "w_minus"))


def signed_rank_test(df: DataFrame, a: str, b: str, by: list[str] | None = None, method: str = "auto", max_cells: int = MAX_CELLS) -> DataFrame:
    """T-09 with p and the method it was taken by.

    ``exact`` is the distribution of the rank sum under random signs, ties and any number of differences included (zeros are dropped): a sum of doubled average
    ranks with random signs is a sum on a lattice. A group with more than ``max_cells`` different sizes is summed in chunks. ``auto`` is the same. ``normal`` corrects
    for ties; ``published`` is the rule behind published tables: exact for up to PUBLISHED_EXACT_RANKS differences without ties and zeros, else normal.
    """
    if method not in ("auto", "exact", "normal", "published"):
        raise ValueError(f"unknown method: {method}")
    by = by or []
    if method in ("auto", "exact"):
        ranked = _signed_ranks(df, a, b, by)
        s = _rank_sums(df, a, b, by, ranked)
        sizes = ranked.select(*by, (F.col("avg_rank") * 2).cast("bigint").alias("a"), F.col("ties").alias("c"))
        seen = s.where("n_nonzero > 0").select(*by, ((F.col("w_plus") - F.col("w_minus")) * 2).cast("bigint").alias("x"))
        s = attach(s, two_sided_signs(sizes, seen, by, max_cells).select(*by, F.col("sign_p").alias("_held")), by)
        s = attach(s, signs_in_chunks(sizes, seen, by, max_cells).select(*by, F.col("sign_p").alias("_chunked")), by)
        return s.withColumn("wilcoxon_p", F.coalesce("_held", "_chunked")).withColumn("method", F.when(F.col("wilcoxon_p").isNotNull(), "exact")).drop("_held", "_chunked", "n_zero")
    s = signed_rank_statistics(df, a, b, by)
    n = F.col("n_nonzero").cast("double")
    z = (F.col("wilcoxon_w") - n * (n + 1) / 4) / F.nullif(F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48), F.lit(0.0))
    sound = (F.col("tie_term") == 0) & (F.col("n_zero") == 0)
    exact = sound & (n <= PUBLISHED_EXACT_RANKS) if method == "published" else F.lit(False)
    return s.withColumn("_exact", tail("signed_rank", F.when(exact, F.col("wilcoxon_w")), n)) \
        .withColumn("_normal", tail("normal", F.when(~exact, z))) \
        .withColumn("wilcoxon_p", F.coalesce("_exact", "_normal")).withColumn("method", F.when(F.col("_exact").isNotNull(), "exact").otherwise("normal")) \
        .drop("_exact", "_normal", "n_zero")


def rank_sum_statistics(df: DataFrame, value: str, in_first: Column, by: list[str] | None = None) -> DataFrame:
    """Mann–Whitney U of the first group and its normal score (T-10)."""
    by = by or []
    ranked = average_ranks(df.where(F.col(value).isNotNull()).withColumn("_first", in_first.cast("int")), value, by,
                           [F.sum("_first").alias("_n1")])
    t = F.col("ties").cast("double")
    s = ranked.groupBy(*by).agg(F.sum("_n1").alias("n1"), (F.sum("ties") - F.sum("_n1")).alias("n2"),
                                F.sum(F.col("avg_rank") * F.col("_n1")).alias("_r1"), F.sum(t * t * t - t).alias("tie_term"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("tie_term") / (n * (n - 1))))
    return s.withColumn("mann_whitney_u", u).withColumn(
        "u_z", (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / F.nullif(sigma, F.lit(0.0))).drop("_r1")


def rank_sum_test(df: DataFrame, value: str, in_first: Column, by: list[str] | None = None) -> DataFrame:
    return rank_sum_statistics(df, value, in_first, by).withColumn(
        "mann_whitney_p", F.least(F.lit(1.0), tail("normal", F.greatest(F.col("u_z"), F.lit(0.0)))))


def anova_statistics(df: DataFrame, value: str, group: str) -> DataFrame:
    """One-way ANOVA F from group moments (T-11)."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("t"),
              F.sum(F.col("n") * F.col("v")).alias("within"))
    # Between-group sum of squares around the grand mean, in a second pass over the few group rows.
    grand = s.select("k", "n", "within", (F.col("t") / F.col("n")).alias("grand"))
    between = attach(g.select("n", "m").withColumnRenamed("n", "n_g"), grand, []).groupBy("k", "n", "within").agg(
        F.sum(F.col("n_g") * F.pow(F.col("m") - F.col("grand"), F.lit(2.0))).alias("between"))
    return between.select(
        (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"),
        ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("anova_f"))


def anova_test(df: DataFrame, value: str, group: str) -> DataFrame:
    return anova_statistics(df, value, group).withColumn(
        "anova_p", tail("f", F.col("anova_f"), F.col("df_between"), F.col("df_within")))


def kruskal_statistics(df: DataFrame, value: str, group: str, groups: list) -> DataFrame:
    """Kruskal–Wallis H with tie correction (T-12): distinct values carry one count per group."""
    names = [f"_g{i}" for i in range(len(groups))]
    ranked = average_ranks(df.where(F.col(value).isNotNull() & F.col(group).isin(groups)), value, [],
                           [F.count_if(F.col(group) == g).alias(n) for n, g in zip(names, groups)])
    t = F.col("ties").cast("double")
    s = ranked.agg(F.sum("ties").alias("n"), F.sum(t * t * t - t).alias("tie"),
                   *[F.sum(n).alias(f"{n}_n") for n in names],
                   *[F.sum(F.col("avg_rank") * F.col(n)).alias(f"{n}_r") for n in names])
    n = F.col("n").cast("double")
    total = sum([F.col(f"{g}_r") * F.col(f"{g}_r") / F.col(f"{g}_n") for g in names], F.lit(0.0))
    h = (F.lit(12.0) / (n * (n + 1)) * total - 3 * (n + 1)) / (1 - F.col("tie") / (n * n * n - n))
    return s.select((F.lit(len(groups)) - 1).cast("bigint").alias("df"), F.col("n").alias("n_rows"), h.alias("kruskal_h"))


def kruskal_test(df: DataFrame, value: str, group: str, groups: list) -> DataFrame:
    return kruskal_statistics(df, value, group, groups).withColumn("kruskal_p", tail("chi2", F.col("kruskal_h"), F.col("df")))


def category_comparison(wide: DataFrame, category: str, a: str, b: str, comparisons: int) -> DataFrame:
    """Per category: paired t, signed-rank, dz, interval and Bonferroni-corrected p (T-13, T-14)."""
    t = paired_t_test(wide, a, b, [category])
    w = signed_rank_test(wide, a, b, [category], method="published").select(category, "wilcoxon_w", "wilcoxon_p")
    return t.join(w, category, "left").withColumn("paired_t_p_bonferroni", bonferroni(F.col("paired_t_p"), comparisons)) \
        .withColumn("wilcoxon_p_bonferroni", bonferroni(F.col("wilcoxon_p"), comparisons)) \
        .withColumn("verdict", verdict(F.col("paired_t_p_bonferroni")))
