"""Cross-model and score studies (C-16..C-18)."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.steps import logit_to_probability, score_summary
from evalspark.operators import scores, stats
from evalspark.operators.lattice import gap_difference_exact, gap_difference_of_counts, interval_of_counts
from evalspark.operators.pairs import attach_to_one, cross_contingency, cross_model_outcomes, joined_ids, scenario_outcomes, scenario_value_counts, summary_of_outcomes
from evalspark.operators.ranges import with_scalars
from evalspark.operators.resample import gap_difference_study
from evalspark.session import cut_lineage


def cross_model_study(long: DataFrame, key: str, model: str, side: str, correct: str, models: tuple[str, str],
                      sides: tuple[str, str], replicates: int, randomisations: int, seed: int, mode: str = "collapse") -> dict[str, DataFrame]:
    """Contingency per side and gap difference of two models (C-16)."""
    wide = cross_model_outcomes(long, key, model, side, correct, models, sides)
    gaps = wide.agg(F.avg("gap_1").alias("gap_first"), F.avg("gap_2").alias("gap_second"), F.avg("gap_difference").alias("gap_difference"))
    return {"wide": wide, "contingency": cross_contingency(wide), "gaps": gaps,
            "difference": gap_difference_study(wide, key, "gap_difference", replicates, randomisations, seed, mode),
            "exact": gap_difference_exact(wide, "gap_difference")}


def robustness_matrix(long: DataFrame, key: str, model: str, side: str, correct: str, models: tuple[str, str],
                      sides: tuple[str, str], scenarios: list[str], exclusions: DataFrame) -> DataFrame:
    """Scenario × model rows with exact interval, plus the cross-model gap difference with its interval and randomisation p on one model's rows (C-16, A-24, A-27)."""
    # A few counts a scenario and model: kept, for they are read several times.
    outcomes = cut_lineage(scenario_outcomes(long, key, model, side, correct, sides, scenarios, exclusions))
    matrix = summary_of_outcomes(outcomes, ["scenario", model])
    gaps = outcomes.groupBy("scenario", model, (F.col("b_correct") - F.col("a_correct")).cast("bigint").alias("a")).agg(F.sum("c").alias("c"))
    interval = interval_of_counts(gaps, by=["scenario", model]).select("scenario", model, "ci_low", "ci_high")
    wide = cross_model_outcomes(long, key, model, side, correct, models, sides)
    cross = gap_difference_of_counts(cut_lineage(scenario_value_counts(wide, key, "gap_difference", scenarios, exclusions)), by=["scenario"])
    named = cross.select("scenario", F.lit(models[1]).alias(model), F.col("n").alias("cross_n"), F.col("observed").alias("cross_gap_difference"), F.col("ci_low").alias("cross_ci_low"),
                         F.col("ci_high").alias("cross_ci_high"), F.col("sign_flip_p").alias("cross_randomisation_p"))
    return matrix.join(interval, ["scenario", model], "left").join(named, ["scenario", model], "left")


def scenario_summary(matrix: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Matrix with the excluded ids as text; for curated exclusion lists (A-27)."""
    return matrix.join(joined_ids(exclusions, ["scenario"], "id"), "scenario", "left").fillna("", ["excluded_ids"])


def half_replication(pairs: DataFrame, key: str, half: int | Column) -> DataFrame:
    """Gap per half of the id range (P-18); ``half`` is the last id of the first one, a number or a scalar subquery."""
    return pairs.withColumn("half", F.when(F.col(key) <= half, "first").otherwise("second")).groupBy("half").agg(
        F.count(F.lit(1)).alias("n"), F.avg("a_correct").alias("accuracy_a"), F.avg("b_correct").alias("accuracy_b"),
        F.avg("b_minus_a").alias("gap"))


def discrimination_study(rows: DataFrame, problem: str, category: str, score: str, correct: str, side: str,
                         sides: tuple[str, str]) -> dict[str, DataFrame]:
    """Per-problem discrimination gaps of two sides, paired tests on them, threshold and AUC per side (C-17)."""
    gaps = rows.groupBy(problem).agg(*[x for s in sides for x in (
        F.avg(F.when((F.col(side) == s) & (F.col(category) == correct), F.col(score))).alias(f"_c_{s}"),
        F.avg(F.when((F.col(side) == s) & (F.col(category) != correct), F.col(score))).alias(f"_i_{s}"))])
    wide = gaps.select(problem, *[(F.col(f"_c_{s}") - F.col(f"_i_{s}")).alias(f"gap_{n}") for n, s in zip("ab", sides)]) \
        .dropna(subset=["gap_a", "gap_b"])
    labelled = rows.withColumn("label", (F.col(category) == correct).cast("int"))
    return {"gaps": wide, "t": stats.paired_t_test(wide, "gap_b", "gap_a"), "wilcoxon": stats.signed_rank_test(wide, "gap_b", "gap_a", method="published"),
            **{f"threshold_{n}": scores.best_threshold(labelled.where(F.col(side) == s), "label", score) for n, s in zip("ab", sides)},
            **{f"auc_{n}": scores.roc_auc(labelled.where(F.col(side) == s), "label", score) for n, s in zip("ab", sides)}}


def step_scores_from_tokens(tokens: DataFrame, record: str, pos: str, flag: str, logit: str) -> DataFrame:
    """Token rows to step scores: probabilities at flagged positions in order (C-18, F-26).

    The array per record is as long as its steps; flags are filtered before the shuffle.
    """
    marked = tokens.where(F.col(flag) == 1).select(record, pos, logit_to_probability(F.col(logit)).alias("_p"))
    ordered = F.array_sort(F.collect_list(F.struct(pos, "_p")))
    return marked.groupBy(record).agg(F.transform(ordered, lambda x: x["_p"]).alias("step_scores"))


def with_score_summary(df: DataFrame, step_scores: str = "step_scores") -> DataFrame:
    return df.withColumns(score_summary(F.col(step_scores)))


def evaluation_summary(records: DataFrame, category: str, correct: str = "correct") -> DataFrame:
    """Category means and the correct-against-rest gap on every row (C-18, A-07)."""
    is_correct: Column = F.col(category) == correct
    gap = records.agg((F.avg(F.when(is_correct, F.col("average_score"))) - F.avg(F.when(~is_correct, F.col("average_score")))).alias("gap"))
    return with_scalars(scores.grouped_scores(records, [category], "average_score", "minimum_score", "maximum_score"), gap)


def reload_check(records: DataFrame, baseline: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Step and trajectory metrics against stored ones with verdict (A-09, A-10)."""
    current = scores.metric_rows(scores.step_metrics(records, "step_probs", "step_labels")).unionByName(
        scores.metric_rows(scores.trajectory_gap(records, "variant", "trajectory_score")))
    return scores.metric_deltas(current, baseline, tolerance)
