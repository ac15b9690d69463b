"""Score descriptions, classification metrics and tests on events."""
from pyspark.sql import functions as F

from evalspark.bindings.base import SCORES, SIGNS, query, scores, shown, table
from evalspark.operators import ranges, scores as A, stats as T

CATS = ("click", "error", "purchase", "signup", "view")
# Per user and category means: one pair of scores per problem.
USERS = f"""{SCORES}, users AS (SELECT problem_id, category, avg(score) FILTER (event_id % 2 = 0) AS a, avg(score) FILTER (event_id % 2 = 1) AS b FROM scores GROUP BY ALL)"""


def users(spark, d):
    even = F.col("event_id") % 2 == 0
    return scores(spark, d).groupBy("problem_id", "category").agg(F.avg(F.when(even, F.col("score"))).alias("a"), F.avg(F.when(~even, F.col("score"))).alias("b"))


@query("a04_describe", f"""WITH {SCORES} SELECT category, count(score) AS n, round(avg(score),6) AS mean, round(stddev_samp(score),6) AS sd, round(median(score),6) AS median, round(min(score),6) AS minimum, round(max(score),6) AS maximum FROM scores GROUP BY 1""")
def a04(spark, d):
    return shown(A.describe(scores(spark, d), ["category"], "score"))


@query("a05_grouped_scores", """SELECT event_type AS category, count(*) AS n_rows, round(avg(value),6) AS mean_average, round(avg(value - 1),6) AS mean_minimum, round(avg(value * 2),6) AS mean_maximum FROM events GROUP BY 1""")
def a05(spark, d):
    rows = scores(spark, d).withColumn("lo", F.col("score") - 1).withColumn("hi", F.col("score") * 2)
    return shown(A.grouped_scores(rows, ["category"], "score", "lo", "hi"))


@query("a06_score_summary", """SELECT vec_id, len(embedding)::INT AS num_steps, round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)),6) AS average_score, round(list_min(embedding)::DOUBLE,6) AS minimum_score, round(list_max(embedding)::DOUBLE,6) AS maximum_score FROM embeddings""")
def a06(spark, d):
    from evalspark.plans.study import with_score_summary
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("step_scores"))
    return shown(with_score_summary(rows).drop("step_scores"))


@query("a07_retention", f"""WITH {SCORES}, g AS (SELECT avg(score) FILTER (category='click') - avg(score) FILTER (category<>'click') AS gap, avg(score*score) FILTER (category='click') - avg(score*score) FILTER (category<>'click') AS baseline_gap FROM scores)
SELECT round(gap,6) AS gap, round(baseline_gap,6) AS baseline_gap, round(gap-baseline_gap,6) AS change, round(gap/baseline_gap,4) AS retained FROM g""")
def a07(spark, d):
    rows = scores(spark, d)
    return shown(A.retention(rows, "category", "score", "click", rows.withColumn("score", F.col("score") * F.col("score")))).withColumn("retained", F.round("retained", 4))


@query("a08_problem_gaps", f"""WITH {SCORES} SELECT problem_id, round(avg(score) FILTER (category='click'),6) AS correct_score, round(avg(score) FILTER (category<>'click'),6) AS incorrect_mean, round(avg(score) FILTER (category='click') - avg(score) FILTER (category<>'click'),6) AS gap FROM scores GROUP BY 1""")
def a08(spark, d):
    return shown(A.problem_gaps(scores(spark, d), "problem_id", "category", "score", "click"))


@query("w02_cumulative_counts", f"""WITH {SCORES}, c AS (SELECT score AS threshold, sum(label) AS p, sum(1-label) AS q FROM scores GROUP BY 1)
SELECT round(threshold,6) AS threshold, (sum(p) OVER (ORDER BY threshold DESC))::BIGINT AS tp, (sum(q) OVER (ORDER BY threshold DESC))::BIGINT AS fp FROM c""")
def w02(spark, d):
    return shown(A.score_curve(scores(spark, d), "label", "score").select("threshold", "tp", "fp"))


@query("w03_average_ranks", f"""WITH {SCORES}, r AS (SELECT category, score, count(*) OVER (PARTITION BY category, score) AS ties, rank() OVER (PARTITION BY category ORDER BY score) AS rk FROM scores)
SELECT DISTINCT category, round(score,6) AS score, ties, round(rk + (ties-1)/2.0,6) AS avg_rank FROM r""")
def w03(spark, d):
    return shown(ranges.average_ranks(scores(spark, d), "score", ["category"]))


RATES = """round((tp+tn)/(tp+fp+fn+tn),6) AS accuracy, round(CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END,6) AS "precision", round(CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END,6) AS recall, round(CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END,6) AS f1"""


@query("a18_confusion", f"""WITH {SCORES}, c AS (SELECT count_if(score>=60 AND label=1)::BIGINT AS tp, count_if(score>=60 AND label=0)::BIGINT AS fp, count_if(score<60 AND label=1)::BIGINT AS fn, count_if(score<60 AND label=0)::BIGINT AS tn FROM scores)
SELECT tp, fp, fn, tn, {RATES} FROM c""")
def a18(spark, d):
    return shown(A.confusion(scores(spark, d), "label", "score", 60.0))


@query("a18_class_report", f"""WITH {SCORES}, c AS (SELECT count_if(score>=60 AND label=1)::BIGINT AS tp, count_if(score>=60 AND label=0)::BIGINT AS fp, count_if(score<60 AND label=1)::BIGINT AS fn, count_if(score<60 AND label=0)::BIGINT AS tn FROM scores),
 m AS (SELECT tp+fn AS np, tn+fp AS nn, tp/(tp+fp) AS p1, tp/(tp+fn) AS r1, 2*tp/(2*tp+fp+fn) AS f1, tn/(tn+fn) AS p0, tn/(tn+fp) AS r0, 2*tn/(2*tn+fn+fp) AS f0 FROM c)
SELECT 'incorrect' AS class, round(p0,6) AS "precision", round(r0,6) AS recall, round(f0,6) AS f1, nn AS support FROM m UNION ALL SELECT 'correct', round(p1,6), round(r1,6), round(f1,6), np FROM m
UNION ALL SELECT 'macro', round((p0+p1)/2,6), round((r0+r1)/2,6), round((f0+f1)/2,6), nn+np FROM m
UNION ALL SELECT 'weighted', round((p0*nn+p1*np)/(nn+np),6), round((r0*nn+r1*np)/(nn+np),6), round((f0*nn+f1*np)/(nn+np),6), nn+np FROM m""")
def a18b(spark, d):
    return shown(A.class_report(A.confusion(scores(spark, d), "label", "score", 60.0)))


@query("a19_grid_sweep", f"""WITH {SCORES}, g AS (SELECT i, 0.2::DOUBLE + 0.05::DOUBLE * i AS threshold FROM range(13) t(i)), s AS (SELECT score / 300 AS score, label FROM scores),
 c AS (SELECT i, threshold, count_if(score>=threshold AND label=1) AS tp, count_if(score>=threshold AND label=0) AS fp, count_if(score<threshold AND label=1) AS fn, count_if(score<threshold AND label=0) AS tn FROM g, s GROUP BY ALL)
SELECT i::INT AS grid_index, round(threshold,6) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {RATES} FROM c""")
def a19(spark, d):
    return shown(A.grid_sweep(scores(spark, d).withColumn("score", F.col("score") / 300), "label", "score"))


@query("a19_best_grid_threshold", f"""WITH {SCORES}, g AS (SELECT i, 0.2::DOUBLE + 0.05::DOUBLE * i AS threshold FROM range(13) t(i)), s AS (SELECT score / 300 AS score, label FROM scores),
 c AS (SELECT i, threshold, count_if(score>=threshold AND label=1) AS tp, count_if(score>=threshold AND label=0) AS fp, count_if(score<threshold AND label=1) AS fn FROM g, s GROUP BY ALL)
SELECT i::INT AS grid_index, round(threshold,6) AS threshold, round(2*tp/(2*tp+fp+fn),6) AS f1 FROM c ORDER BY 2*tp/(2*tp+fp+fn) DESC, threshold LIMIT 1""")
def a19b(spark, d):
    sweep = A.grid_sweep(scores(spark, d).withColumn("score", F.col("score") / 300), "label", "score")
    return shown(A.best_by(sweep, "f1", "threshold").select("grid_index", "threshold", "f1"))


@query("a20_best_threshold", f"""WITH {SCORES}, c AS (SELECT score AS threshold, sum(label) AS p, sum(1-label) AS q FROM scores GROUP BY 1),
 k AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(q) OVER (ORDER BY threshold DESC) AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM c),
 m AS (SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (np-tp)::BIGINT AS fn, (nq-fp)::BIGINT AS tn FROM k)
SELECT round(threshold,6) AS threshold, tp, fp, fn, tn, {RATES} FROM m ORDER BY tp + tn DESC, threshold LIMIT 1""")
def a20(spark, d):
    return shown(A.best_threshold(scores(spark, d), "label", "score"))


@query("a21_roc_auc", f"""WITH {SCORES}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scores),
 s AS (SELECT sum(label)::BIGINT AS np, sum(1-label)::BIGINT AS nq, sum(rk) FILTER (label = 1) AS rs FROM r) SELECT np AS n_positive, nq AS n_negative, round((rs - np*(np+1)/2)/(np*nq), 6) AS auc FROM s""")
def a21(spark, d):
    return shown(A.roc_auc(scores(spark, d), "label", "score"))


@query("a22_histogram", f"""WITH {SCORES}, l AS (SELECT category, min(score) AS lo, max(score) AS hi FROM scores GROUP BY 1)
SELECT category, least(floor((score-lo)/((hi-lo)/10)), 9)::INT AS bin, count(*) AS n_rows, round(min(lo),6) AS lower, round(min(hi),6) AS upper FROM scores JOIN l USING (category) GROUP BY ALL""")
def a22(spark, d):
    return shown(A.histogram(scores(spark, d), "category", "score"))


@query("a22_five_numbers", f"""WITH {SCORES}, q AS (SELECT category, min(score) AS minimum, quantile_cont(score,.25) AS q1, median(score) AS median, quantile_cont(score,.75) AS q3, max(score) AS maximum FROM scores GROUP BY 1)
SELECT category, round(minimum,6) AS minimum, round(q1,6) AS q1, round(median,6) AS median, round(q3,6) AS q3, round(maximum,6) AS maximum, round(q1-1.5*(q3-q1),6) AS lower_fence, round(q3+1.5*(q3-q1),6) AS upper_fence FROM q""")
def a22b(spark, d):
    return shown(A.five_numbers(scores(spark, d), "category", "score"))


PT = f"""{USERS}, d AS (SELECT category, a, b, a-b AS d FROM users WHERE a IS NOT NULL AND b IS NOT NULL),
 m AS (SELECT category, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(d) AS md, stddev_samp(d) AS sd FROM d GROUP BY 1)"""


@query("t06_paired_t", f"""WITH {PT} SELECT category, n AS n_pairs, round(ma,6) AS mean_a, round(mb,6) AS mean_b, round(md,6) AS mean_difference, round(md/(sd/sqrt(n)),6) AS paired_t, n-1 AS df FROM m""")
def t06(spark, d):
    return shown(T.paired_t_statistics(users(spark, d), "a", "b", ["category"]).select("category", "n_pairs", "mean_a", "mean_b", "mean_difference", "paired_t", "df"))


def simpson(f: str, low: str, high: str, m: int = 400) -> str:
    """SQL of the integral of f, an expression in x, between two expressions."""
    return f"""(({high}) - ({low})) / {3 * m} * list_sum(list_transform(list_transform(range({m + 1}), lambda i: struct_pack(x := ({low}) + (({high}) - ({low})) * i / {m},
 w := CASE WHEN i = 0 OR i = {m} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)), lambda s: s.w * ({f.replace("{x}", "s.x")})))"""


def t_inside(angle: str, df: str) -> str:
    """P(|T| <= sqrt(df) tan(angle)) of Student's distribution; in the angle the density is a power of the cosine."""
    return f"""2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi()) * {simpson(f"pow(cos({{x}}), ({df}) - 1)", "0", angle)}"""


@query("t06_paired_t_p_values", f"""WITH RECURSIVE {PT}, q AS (SELECT category, n - 1 AS df, md, sd / sqrt(n) AS se, md / (sd / sqrt(n)) AS t FROM m),
 cut(category, df, low, high, k) AS (SELECT category, df, 0.0::DOUBLE, pi() / 2, 0 FROM q UNION ALL SELECT category, df, CASE WHEN inside < 0.95 THEN mid ELSE low END, CASE WHEN inside < 0.95 THEN high ELSE mid END, k + 1
  FROM (SELECT *, {t_inside("mid", "df")} AS inside FROM (SELECT *, (low + high) / 2 AS mid FROM cut WHERE k < 50)))
SELECT q.category, round(t,6) AS paired_t, round(1 - {t_inside("atan(abs(t) / sqrt(q.df))", "q.df")}, 6) + 0.0 AS paired_t_p, round(md - se * sqrt(q.df) * tan(high), 6) AS ci_low, round(md + se * sqrt(q.df) * tan(high), 6) AS ci_high
FROM q JOIN cut ON cut.category = q.category AND k = 50""")
def t06p(spark, d):
    return shown(T.paired_t_test(users(spark, d), "a", "b", ["category"]).select("category", "paired_t", "paired_t_p", "ci_low", "ci_high"))


@query("t07_welch_t", f"""WITH {SCORES}, m AS (SELECT count(*) FILTER (label=1) AS n1, count(*) FILTER (label=0) AS n2, avg(score) FILTER (label=1) AS m1, avg(score) FILTER (label=0) AS m2, var_samp(score) FILTER (label=1) AS v1, var_samp(score) FILTER (label=0) AS v2 FROM scores)
SELECT n1, n2, round(m1-m2,6) AS mean_difference, round((m1-m2)/sqrt(v1/n1+v2/n2),6) AS welch_t, round((v1/n1+v2/n2)**2/((v1/n1)**2/(n1-1)+(v2/n2)**2/(n2-1)),4) AS df FROM m""")
def t07(spark, d):
    return shown(T.welch_statistics(scores(spark, d), "score", F.col("label") == 1).select("n1", "n2", "mean_difference", "welch_t", F.round("df", 4).alias("df")))


@query("t07_welch_p_value", f"""WITH {SCORES}, m AS (SELECT count(*) FILTER (label=1) AS n1, count(*) FILTER (label=0) AS n2, avg(score) FILTER (label=1) AS m1, avg(score) FILTER (label=0) AS m2, var_samp(score) FILTER (label=1) AS v1, var_samp(score) FILTER (label=0) AS v2 FROM scores),
 w AS (SELECT (m1-m2)/sqrt(v1/n1+v2/n2) AS t, (v1/n1+v2/n2)**2/((v1/n1)**2/(n1-1)+(v2/n2)**2/(n2-1)) AS df FROM m)
SELECT round(t,6) AS welch_t, round(df,4) AS df, round(1 - {t_inside("atan(abs(t) / sqrt(df))", "df")}, 6) + 0.0 AS welch_p FROM w""")
def t07p(spark, d):
    return shown(T.welch_test(scores(spark, d), "score", F.col("label") == 1).select("welch_t", F.round("df", 4).alias("df"), "welch_p"))


@query("t08_effect_sizes", f"""WITH {PT}, e AS (SELECT category, md/sd AS dz FROM m) SELECT category, round(dz,6) AS cohens_dz, CASE WHEN abs(dz)<0.2 THEN 'negligible' WHEN abs(dz)<0.5 THEN 'small' WHEN abs(dz)<0.8 THEN 'medium' ELSE 'large' END AS effect FROM e""")
def t08(spark, d):
    return shown(T.paired_t_statistics(users(spark, d), "a", "b", ["category"]).select("category", "cohens_dz", "effect"))


@query("t08_pooled_effect", f"""WITH {SCORES}, m AS (SELECT count(*) FILTER (label=1) AS n1, count(*) FILTER (label=0) AS n2, avg(score) FILTER (label=1) AS m1, avg(score) FILTER (label=0) AS m2, var_samp(score) FILTER (label=1) AS v1, var_samp(score) FILTER (label=0) AS v2 FROM scores)
SELECT round((m1-m2)/sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)),6) AS cohens_d FROM m""")
def t08b(spark, d):
    return shown(T.welch_statistics(scores(spark, d), "score", F.col("label") == 1).select("cohens_d"))


# Whole cents, so that both engines see the same ties.
SR = f"""{SCORES}, best AS (SELECT problem_id, category, max(score) FILTER (event_id % 2 = 0) AS a, max(score) FILTER (event_id % 2 = 1) AS b FROM scores GROUP BY ALL),
 d AS (SELECT category, CAST(round(a * 100) AS BIGINT) - CAST(round(b * 100) AS BIGINT) AS d FROM best WHERE a IS NOT NULL AND b IS NOT NULL), z AS (SELECT category, d FROM d WHERE d <> 0),
 r AS (SELECT category, d, rank() OVER (PARTITION BY category ORDER BY abs(d)) + (count(*) OVER (PARTITION BY category, abs(d)) - 1)/2.0 AS rk FROM z)"""


def cent_pairs(spark, d):
    even = F.col("event_id") % 2 == 0
    cents = F.round(F.col("score") * 100).cast("bigint")
    return scores(spark, d).groupBy("problem_id", "category").agg(F.max(F.when(even, cents)).alias("a"), F.max(F.when(~even, cents)).alias("b")).dropna()


@query("t09_signed_rank", f"WITH {SR} SELECT category, count(*) AS n_nonzero, round(sum(rk) FILTER (d>0),6) AS w_plus, round(sum(rk) FILTER (d<0),6) AS w_minus, round(least(sum(rk) FILTER (d>0), sum(rk) FILTER (d<0)),6) AS wilcoxon_w FROM r GROUP BY 1")
def t09(spark, d):
    return shown(T.signed_rank_statistics(cent_pairs(spark, d), "a", "b", ["category"]).select("category", "n_nonzero", "w_plus", "w_minus", "wilcoxon_w"))


@query("t09_signed_rank_p_values", f"""WITH {SR}, sizes AS (SELECT category AS g, (2 * rk)::BIGINT AS a, count(*) AS c FROM r GROUP BY ALL),
 seen AS (SELECT category AS g, abs(sum(CASE WHEN d > 0 THEN 2 * rk ELSE -2 * rk END))::BIGINT AS x, least(sum(rk) FILTER (d>0), sum(rk) FILTER (d<0)) AS w FROM r GROUP BY 1), {SIGNS}
SELECT g AS category, round(w,6) AS wilcoxon_w, round(sign_p, 6) + 0.0 AS wilcoxon_p, 'exact' AS method FROM signs JOIN seen USING (g)""")
def t09p(spark, d):
    return shown(T.signed_rank_test(cent_pairs(spark, d), "a", "b", ["category"], method="exact").select("category", "wilcoxon_w", "wilcoxon_p", "method"))


@query("t10_rank_sum", f"""WITH {SCORES}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scores)
SELECT sum(label)::BIGINT AS n1, sum(1-label)::BIGINT AS n2, round(sum(rk) FILTER (label=1) - sum(label)*(sum(label)+1)/2, 6) AS mann_whitney_u FROM r""")
def t10(spark, d):
    return shown(T.rank_sum_statistics(scores(spark, d), "score", F.col("label") == 1).select("n1", "n2", "mann_whitney_u"))


@query("t10_rank_sum_p_value", f"""WITH {SCORES}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scores),
 tie AS (SELECT sum(c*c*c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM scores GROUP BY score)),
 u AS (SELECT sum(label)::DOUBLE AS n1, sum(1-label)::DOUBLE AS n2, sum(rk) FILTER (label=1) - sum(label)*(sum(label)+1)/2 AS u FROM r),
 z AS (SELECT u, (greatest(u, n1*n2 - u) - n1*n2/2 - 0.5) / sqrt(n1*n2/12 * (n1 + n2 + 1 - t / ((n1+n2) * (n1+n2-1)))) AS z FROM u, tie)
SELECT round(u,6) AS mann_whitney_u, round(z,6) AS u_z, round(least(1.0, 1 - 2 * {simpson("exp(-{x} * {x} / 2) / sqrt(2 * pi())", "0", "greatest(z, 0)")}), 6) + 0.0 AS mann_whitney_p FROM z""")
def t10p(spark, d):
    return shown(T.rank_sum_test(scores(spark, d), "score", F.col("label") == 1).select("mann_whitney_u", "u_z", "mann_whitney_p"))


@query("t11_anova", f"""WITH {SCORES}, g AS (SELECT category, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM scores GROUP BY 1), t AS (SELECT avg(score) AS gm, count(*) AS nn FROM scores)
SELECT count(*) - 1 AS df_between, max(nn) - count(*) AS df_within, round((sum(n*(m-gm)**2)/(count(*)-1))/(sum((n-1)*v)/(max(nn)-count(*))),6) AS anova_f FROM g, t""")
def t11(spark, d):
    return shown(T.anova_statistics(scores(spark, d), "score", "category"))


@query("t11_anova_p_value", f"""WITH {SCORES}, g AS (SELECT category, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM scores GROUP BY 1), t AS (SELECT avg(score) AS gm, count(*) AS nn FROM scores),
 f AS (SELECT (count(*) - 1)::DOUBLE AS a, (max(nn) - count(*))::DOUBLE AS b, (sum(n*(m-gm)**2)/(count(*)-1))/(sum((n-1)*v)/(max(nn)-count(*))) AS f FROM g, t)
SELECT round(f,6) AS anova_f, round(2 * exp(lgamma((a+b)/2) - lgamma(a/2) - lgamma(b/2)) * {simpson("pow(cos({x}), b - 1) * pow(sin({x}), a - 1)", "asin(sqrt(a*f / (b + a*f)))", "pi() / 2", 20000)}, 6) + 0.0 AS anova_p FROM f""")
def t11p(spark, d):
    return shown(T.anova_test(scores(spark, d), "score", "category").select("anova_f", "anova_p"))


@query("t12_kruskal", f"""WITH {SCORES}, r AS (SELECT category, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scores),
 tie AS (SELECT sum(c*c*c - c)::DOUBLE AS t FROM (SELECT count(*)::DOUBLE AS c FROM scores GROUP BY score)), g AS (SELECT count(*) AS n, sum(rk) AS rs FROM r GROUP BY category), n AS (SELECT count(*)::DOUBLE AS n FROM r)
SELECT (SELECT count(*) - 1 FROM g) AS df, n::BIGINT AS n_rows, round((12/(n*(n+1)) * (SELECT sum(rs*rs/g.n) FROM g) - 3*(n+1)) / (1 - t/(n*n*n-n)), 6) AS kruskal_h FROM n, tie""")
def t12(spark, d):
    return shown(T.kruskal_statistics(scores(spark, d), "score", "category", list(CATS)))


# For an even number of degrees of freedom the upper tail is a finite sum; the table's categories give four.
@query("t12_kruskal_p_value", f"""WITH {SCORES}, r AS (SELECT category, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scores),
 tie AS (SELECT sum(c*c*c - c)::DOUBLE AS t FROM (SELECT count(*)::DOUBLE AS c FROM scores GROUP BY score)), g AS (SELECT count(*) AS n, sum(rk) AS rs FROM r GROUP BY category), n AS (SELECT count(*)::DOUBLE AS n FROM r),
 h AS (SELECT (SELECT count(*) - 1 FROM g) AS df, (12/(n*(n+1)) * (SELECT sum(rs*rs/g.n) FROM g) - 3*(n+1)) / (1 - t/(n*n*n-n)) AS h FROM n, tie)
SELECT round(h,6) AS kruskal_h, round(exp(-h/2) * list_sum(list_transform(range(df // 2), lambda j: pow(h/2, j) / gamma(j + 1))), 6) + 0.0 AS kruskal_p FROM h""")
def t12p(spark, d):
    return shown(T.kruskal_test(scores(spark, d), "score", "category", list(CATS)).select("kruskal_h", "kruskal_p"))


@query("t13_bonferroni", "SELECT event_id, round(least(value / 500 * 5, 1.0), 6) AS corrected FROM events")
def t13(spark, d):
    return shown(scores(spark, d).select("event_id", T.bonferroni(F.col("score") / 500, 5).alias("corrected")))


@query("t14_category_comparison", f"""WITH {SR}, w AS (SELECT category, least(sum(rk) FILTER (d>0), sum(rk) FILTER (d<0)) AS w FROM r GROUP BY 1),
 m AS (SELECT category, count(*) AS n, avg(d) AS md, stddev_samp(d) AS sd FROM d GROUP BY 1)
SELECT category, n AS n_pairs, round(md,6) AS mean_difference, round(md/(sd/sqrt(n)),6) AS paired_t, round(md/sd,6) AS cohens_dz, round(w,6) AS wilcoxon_w FROM m JOIN w USING (category)""")
def t14(spark, d):
    out = T.category_comparison(cent_pairs(spark, d), "category", "a", "b", len(CATS))
    return shown(out.select("category", "n_pairs", "mean_difference", "paired_t", "cohens_dz", "wilcoxon_w"))


@query("t15_verdict", "SELECT event_id, CASE WHEN value IS NULL THEN 'not available' WHEN value / 500 < 0.05 THEN 'significant' ELSE 'not significant' END AS verdict FROM events")
def t15(spark, d):
    return scores(spark, d).select("event_id", T.verdict(F.col("score") / 500).alias("verdict"))
