"""Score descriptions and classification metrics (A-04..A-22, A-28)."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.ranges import attach, distinct_values, exact_percentiles, range_bounds, running_totals, with_scalars


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sd (n-1), exact median, min, max per group (A-04)."""
    base = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                               F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    return attach(base, exact_percentiles(df, value, {"median": 0.5}, by), by)


def grouped_scores(df: DataFrame, by: list[str], average: str, minimum: str, maximum: str) -> DataFrame:
    """Named means per category (A-05, A-07)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(average).alias("mean_average"),
                               F.avg(minimum).alias("mean_minimum"), F.avg(maximum).alias("mean_maximum"))


def retention(df: DataFrame, category: str, value: str, correct: str, baseline: DataFrame) -> DataFrame:
    """Correct-against-rest gap next to the gap of a stored baseline: absolute change and ratio (A-07)."""
    is_correct = F.col(category) == correct
    def gap(table):
        return table.agg((F.avg(F.when(is_correct, F.col(value))) - F.avg(F.when(~is_correct, F.col(value)))).alias("gap"))
    both = with_scalars(gap(df), gap(baseline).withColumnRenamed("gap", "baseline_gap"))
    return both.withColumn("change", F.col("gap") - F.col("baseline_gap")) \
        .withColumn("retained", F.col("gap") / F.nullif(F.col("baseline_gap"), F.lit(0.0)))


def problem_gaps(df: DataFrame, problem: str, category: str, value: str, correct: str) -> DataFrame:
    """Per problem: correct score minus the mean of the other categories' scores (A-08)."""
    is_correct = F.col(category) == correct
    return df.groupBy(problem).agg(F.avg(F.when(is_correct, F.col(value))).alias("correct_score"),
                                   F.avg(F.when(~is_correct, F.col(value))).alias("incorrect_mean")) \
        .withColumn("gap", F.col("correct_score") - F.col("incorrect_mean"))


def step_metrics(records: DataFrame, probs: str, labels: str, cut: float = 0.5) -> DataFrame:
    """Step accuracy at ``cut``, mean score of valid and invalid steps, their difference (A-09)."""
    cells = records.select(F.inline(F.arrays_zip(F.col(probs).alias("p"), F.col(labels).alias("y"))))
    return cells.agg(
        F.count("y").alias("n_steps"),
        F.avg(((F.col("p") >= cut).cast("int") == F.col("y").cast("int")).cast("int")).alias("step_accuracy"),
        F.avg(F.when(F.col("y") == 1, F.col("p"))).alias("mean_valid"),
        F.avg(F.when(F.col("y") == 0, F.col("p"))).alias("mean_invalid")) \
        .withColumn("step_discrimination", F.col("mean_valid") - F.col("mean_invalid"))


def trajectory_gap(records: DataFrame, variant: str, score: str) -> DataFrame:
    return records.agg(F.avg(F.when(F.col(variant) == "correct", F.col(score))).alias("mean_correct"),
                       F.avg(F.when(F.col(variant) == "incorrect", F.col(score))).alias("mean_incorrect")) \
        .withColumn("trajectory_gap", F.col("mean_correct") - F.col("mean_incorrect"))


def metric_rows(one_row: DataFrame) -> DataFrame:
    """A one-row metric table as (metric, value) rows."""
    return one_row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                             for c in one_row.columns])))


def metric_deltas(current: DataFrame, baseline: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Metric by metric difference with a tolerance verdict (A-10)."""
    return baseline.withColumnRenamed("value", "baseline").join(
        current.withColumnRenamed("value", "current"), "metric", "full_outer") \
        .withColumn("difference", F.col("current") - F.col("baseline")) \
        .withColumn("within_tolerance", F.coalesce(F.abs("difference") < tolerance, F.lit(False)))


def best_run(history: DataFrame, metric: str, epoch: str, by: list[str] | None = None) -> DataFrame:
    """Row with the greatest metric; the lowest epoch wins a tie (A-11)."""
    rest = [c for c in history.columns if c not in (by or [])]
    return history.groupBy(*(by or [])).agg(F.max_by(F.struct(*rest), F.struct(F.col(metric), -F.col(epoch))).alias("_b")) \
        .select(*(by or []), "_b.*")


def history_table(history: DataFrame, epoch: str, metrics: list[str], baseline: dict[str, float]) -> DataFrame:
    """Metrics per epoch with change against a stored baseline and against the epoch before (A-28).

    The previous epoch is found by an equi-join on epoch + 1, so no global window is needed.
    """
    before = history.select((F.col(epoch) + 1).alias(epoch), *[F.col(m).alias(f"_before_{m}") for m in metrics])
    out = history.join(before, epoch, "left")
    for m in metrics:
        out = out.withColumn(f"{m}_change", F.col(m) - F.col(f"_before_{m}")).drop(f"_before_{m}")
        if m in baseline:
            out = out.withColumn(f"{m}_vs_baseline", F.col(m) - F.lit(baseline[m]))
    return out


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A-14."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def token_totals(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Sums of numeric text columns, blanks ignored (A-16)."""
    return df.groupBy(*(by or [])).agg(*[F.sum(F.col(c).try_cast("double")).alias(f"total_{c}") for c in columns],
                                       *[F.count(F.col(c).try_cast("double")).alias(f"n_{c}") for c in columns])


def _safe(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall, F1; a zero denominator gives 0."""
    precision, recall = _safe(tp, tp + fp), _safe(tp, tp + fn)
    return {"accuracy": _safe(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall,
            "f1": _safe(2 * precision * recall, precision + recall)}


def confusion(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """2×2 counts and rates at one threshold, one row (A-18)."""
    pred, real = F.col(score) >= threshold, F.col(label) == 1
    counts = df.where(F.col(score).isNotNull()).agg(
        F.count_if(pred & real).alias("tp"), F.count_if(pred & ~real).alias("fp"),
        F.count_if(~pred & real).alias("fn"), F.count_if(~pred & ~real).alias("tn"))
    return counts.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def class_report(confusion_row: DataFrame) -> DataFrame:
    """Per class, macro and weighted precision, recall, F1, support (A-18)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    pos, neg = rates(tp, fp, fn, tn), rates(tn, fn, fp, tp)
    n_pos, n_neg = tp + fn, tn + fp
    def line(name, pick, support):
        return F.struct(F.lit(name).alias("class"), *[pick(m).alias(m) for m in ("precision", "recall", "f1")], support.alias("support"))
    lines = [line("incorrect", lambda m: neg[m], n_neg), line("correct", lambda m: pos[m], n_pos),
             line("macro", lambda m: (neg[m] + pos[m]) / 2, n_neg + n_pos),
             line("weighted", lambda m: _safe(neg[m] * n_neg + pos[m] * n_pos, n_neg + n_pos), n_neg + n_pos)]
    return confusion_row.select(F.inline(F.array(*lines)))


def grid_sweep(df: DataFrame, label: str, score: str, start: float = 0.20, step: float = 0.05, count: int = 13) -> DataFrame:
    """Rates on a fixed threshold grid (A-19): two conditional counts per threshold in one aggregate.

    No row is repeated per threshold.
    """
    grid = [start + step * i for i in range(count)]
    real = F.col(label) == 1
    counts = df.where(F.col(score).isNotNull()).agg(
        F.count_if(real).alias("_p"), F.count_if(~real).alias("_q"),
        *[F.count_if((F.col(score) >= t) & real).alias(f"_tp{i}") for i, t in enumerate(grid)],
        *[F.count_if((F.col(score) >= t) & ~real).alias(f"_fp{i}") for i, t in enumerate(grid)])
    rows = counts.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("grid_index"), F.lit(t).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_fp{i}").alias("fp"),
        (F.col("_p") - F.col(f"_tp{i}")).alias("fn"), (F.col("_q") - F.col(f"_fp{i}")).alias("tn")) for i, t in enumerate(grid)])))
    return rows.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def best_by(df: DataFrame, metric: str, tie: str) -> DataFrame:
    """Row with the greatest metric, lowest ``tie`` first."""
    return df.agg(F.max_by(F.struct(*df.columns), F.struct(F.col(metric), -F.col(tie))).alias("_b")).select("_b.*")


def score_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """tp/fp/fn/tn and rates at every distinct score (A-20, W-02).

    Scores are reduced to distinct values first; cumulative counts run over value ranges, so neither a hot
    score nor the number of scores ends in one task.
    """
    rows = df.where(F.col(score).isNotNull())
    bounds = range_bounds(rows, score)
    real = F.col(label) == 1
    counted = distinct_values(rows, [], score, [F.count_if(real).alias("_p"), F.count_if(~real).alias("_q")])
    curve = running_totals(counted, score, {"tp": "_p", "fp": "_q"}, descending=True, bounds=bounds)
    totals = rows.agg(F.count_if(real).alias("_np"), F.count_if(~real).alias("_nq"))
    curve = with_scalars(curve, totals).select(
        F.col(score).alias("threshold"), "tp", "fp", (F.col("_np") - F.col("tp")).alias("fn"), (F.col("_nq") - F.col("fp")).alias("tn"))
    return curve.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def best_threshold(df: DataFrame, label: str, score: str, metric: str = "accuracy") -> DataFrame:
    return best_by(score_curve(df, label, score), metric, "threshold")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC-AUC with ties in Mann–Whitney form (A-21): positives against running negatives per distinct score."""
    rows = df.where(F.col(score).isNotNull())
    bounds = range_bounds(rows, score)
    real = F.col(label) == 1
    counted = distinct_values(rows, [], score, [F.count_if(real).alias("_p"), F.count_if(~real).alias("_q")])
    placed = running_totals(counted, score, {"_below": "_q"}, bounds=bounds)
    p, q = F.col("_p").cast("double"), F.col("_q").cast("double")
    return placed.agg(F.sum("_p").alias("n_positive"), F.sum("_q").alias("n_negative"),
                      F.sum(p * (F.col("_below") - q / 2)).alias("_won")) \
        .select("n_positive", "n_negative",
                (F.col("_won") / F.nullif(F.col("n_positive").cast("double") * F.col("n_negative"), F.lit(0.0))).alias("auc"))


def histogram(df: DataFrame, category: str, value: str, bins: int = 10) -> DataFrame:
    """Equal bins between the category's own min and max, last bin closed (A-22): counts per (category, bin)."""
    rows = df.where(F.col(value).isNotNull())
    limits = rows.groupBy(category).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    placed = attach(rows.select(category, value), limits, [category])
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)))
    return placed.groupBy(category, index.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("_lo").alias("lower"), F.min("_hi").alias("upper"))


def five_numbers(df: DataFrame, category: str, value: str) -> DataFrame:
    """Box-plot data: quartiles and 1.5 IQR fences (A-22)."""
    q = exact_percentiles(df, value, {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0}, [category])
    iqr = F.col("q3") - F.col("q1")
    return q.withColumn("lower_fence", F.col("q1") - 1.5 * iqr).withColumn("upper_fence", F.col("q3") + 1.5 * iqr)


def coverage_manifest(staged: DataFrame, split: str = "split") -> DataFrame:
    """Counters by variant per split, generation, length and first-error position (A-12), rows (dimension, split, bin, n).

    One pass with grouping sets; a missing value prints as ``None``.
    """
    shown = staged.select(split, "variant", F.coalesce(F.col("generation").cast("string"), F.lit("None")).alias("generation"),
                          F.size("steps").cast("string").alias("length"),
                          F.coalesce(F.col("first_error_step").cast("string"), F.lit("None")).alias("first_error"))
    dims = ["variant", "generation", "length", "first_error"]
    sets = [[F.col(split), F.col("variant")], [F.col("generation")], [F.col("length")], [F.col("first_error")]]
    cube = shown.groupingSets(sets, F.col(split), *[F.col(d) for d in dims]).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        bit = 1 << (len(dims) - 1 - i)
        active = F.col("_g").bitwiseAND(F.lit(bit)) == 0
        name, value = F.when(active, d).otherwise(name), F.when(active, F.col(d)).otherwise(value)
    return cube.select(name.alias("dimension"), F.coalesce(F.col(split), F.lit("all")).alias("split"), value.alias("bin"), "n")


def rating_counts(staged: DataFrame, ratings: str = "source_step_ratings") -> DataFrame:
    return staged.select(F.explode(ratings).alias("rating")).groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def supervision_summary(staged: DataFrame, split: str = "split") -> DataFrame:
    """Step, supervision and trajectory totals per split and overall (A-13)."""
    from evalspark.functions.steps import first_negative
    labels, mask = F.col("step_labels"), F.col("supervision_mask")
    def count_of(value):
        return F.size(F.filter(F.arrays_zip(labels.alias("y"), mask.alias("m")), lambda c: (c["m"] == 1) & (c["y"] == value)))
    rows = staged.select(split, F.size("steps").alias("n"), F.size(F.filter(mask, lambda m: m == 1)).alias("s"),
                         count_of(1).alias("pos"), count_of(0).alias("neg"), first_negative(labels, mask).alias("fn"))
    return rows.rollup(split).agg(
        F.sum("n").alias("steps"), F.sum("s").alias("supervised_steps"), (F.sum("n") - F.sum("s")).alias("neutral_masked_steps"),
        F.sum("pos").alias("targets_1"), F.sum("neg").alias("targets_0"),
        F.count_if(F.col("fn").isNotNull()).alias("has_negative"), F.count_if(F.col("fn").isNull()).alias("no_negative"),
        F.count(F.lit(1)).alias("trajectories")).withColumn(split, F.coalesce(F.col(split), F.lit("all")))


def supervision_distributions(staged: DataFrame, split: str = "split") -> DataFrame:
    """Step-count and first-negative distributions per split and overall (A-13), rows (split, distribution, bin, n)."""
    from evalspark.functions.steps import first_negative
    fn = first_negative(F.col("step_labels"), F.col("supervision_mask"))
    rows = staged.select(split, F.inline(F.array(
        F.struct(F.lit("step_count").alias("distribution"), F.size("steps").alias("bin")),
        F.struct(F.lit("first_negative").alias("distribution"), fn.alias("bin"))))).where(F.col("bin").isNotNull())
    return rows.groupingSets([[F.col(split), F.col("distribution"), F.col("bin")], [F.col("distribution"), F.col("bin")]],
                             F.col(split), F.col("distribution"), F.col("bin")) \
        .agg(F.count(F.lit(1)).alias("n")).withColumn(split, F.coalesce(F.col(split), F.lit("all")))
