"""Pairing and paired comparison (J-01..J-09, A-01..A-03, A-17, A-23..A-27, P-16, W-01)."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.checks import CheckFailed, duplicate_keys, require_empty
from evalspark.operators.ranges import with_scalars
from evalspark.operators.stats import mcnemar_p


def one_to_one_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose sides are first proven unique per key (J-01)."""
    require_empty(duplicate_keys(left, keys), "left keys are not unique")
    require_empty(duplicate_keys(right, keys), "right keys are not unique")
    return left.join(right, keys, how)


def suffixed_join(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner join; equal non-key names get a suffix per side (J-04)."""
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return a.join(b, keys)


def paired_outcomes(df: DataFrame, key: list[str], side: str, correct: str, a: str, b: str,
                    on_missing: str = "drop") -> DataFrame:
    """Long results to one row per key: a_correct, b_correct, b_minus_a (J-02). One shuffle, no self-join.

    A key with two rows of one side stops the job: which of them holds is for the caller to resolve (``latest_per_key``). ``on_missing``: ``drop`` keys
    without both sides (``unpaired_keys`` counts them), or ``error``.
    """
    wide = df.where(F.col(side).isin(a, b)).groupBy(*key).agg(
        _only(F.col(side) == a, correct, key, a).alias("a_correct"), _only(F.col(side) == b, correct, key, b).alias("b_correct"))
    complete = F.col("a_correct").isNotNull() & F.col("b_correct").isNotNull()
    if on_missing == "error":
        require_empty(wide.where(~complete), "keys without both sides")
    elif on_missing != "drop":
        raise CheckFailed(f"unknown on_missing: {on_missing}")
    return wide.where(complete).withColumn("b_minus_a", F.col("b_correct") - F.col("a_correct"))


def _only(condition: Column, value: str, key: list[str], name: str) -> Column:
    """The value of the one row under a condition; an aggregate that refuses two rows."""
    twice = F.raise_error(F.concat(F.lit(f"repeated rows of {name} for key "), F.to_json(F.struct(*key)))).cast("int")
    return F.when(F.count_if(condition) > 1, twice).otherwise(F.max(F.when(condition, F.col(value))).cast("int"))


def unpaired_keys(df: DataFrame, key: list[str], side: str, a: str, b: str) -> DataFrame:
    """(problem, n_keys, n_rows): what pairing refuses or leaves out: keys with repeated rows of a side, with one side only, with neither (J-02, J-03)."""
    n_a, n_b = F.count_if(F.col(side) == a), F.count_if(F.col(side) == b)
    per = df.groupBy(*key).agg(n_a.alias("_a"), n_b.alias("_b"), F.count(F.lit(1)).alias("_n"))
    problem = F.when((F.col("_a") > 1) | (F.col("_b") > 1), "repeated").when(F.col("_a") + F.col("_b") == 0, "neither").when(F.col("_b") == 0, f"only_{a}").when(F.col("_a") == 0, f"only_{b}")
    return per.withColumn("problem", problem).where("problem IS NOT NULL").groupBy("problem").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("_n").alias("n_rows"))


def cross_model_outcomes(df: DataFrame, key: str, model: str, side: str, correct: str,
                         models: tuple[str, str], sides: tuple[str, str]) -> DataFrame:
    """Two models and two sides on one row per problem, in one pass (J-03).

    Columns m1_a, m1_b, m2_a, m2_b, gap_1, gap_2, gap_difference; incomplete problems are dropped, a cell with two rows stops the job.
    """
    cells = {f"m{i}_{s}": (m, side_name) for i, m in enumerate(models, 1) for s, side_name in zip("ab", sides)}
    wide = df.groupBy(key).agg(*[_only((F.col(model) == m) & (F.col(side) == s), correct, [key], f"{m}/{s}").alias(name) for name, (m, s) in cells.items()])
    return wide.dropna(subset=list(cells)).withColumn("gap_1", F.col("m1_b") - F.col("m1_a")) \
        .withColumn("gap_2", F.col("m2_b") - F.col("m2_a")) \
        .withColumn("gap_difference", F.col("gap_2") - F.col("gap_1"))


def accuracy(df: DataFrame, keys: list[str], correct: str) -> DataFrame:
    """Correct, total and accuracy per group (A-01)."""
    return df.groupBy(*keys).agg(F.sum(correct).cast("bigint").alias("n_correct"),
                                 F.count(correct).alias("n_total"), F.avg(correct).alias("accuracy"))


def paired_counts() -> list[Column]:
    """2×2 outcome counts as aggregates over paired outcomes (A-02)."""
    a, b = F.col("a_correct"), F.col("b_correct")
    return [F.count(F.lit(1)).alias("n"),
            F.count_if((a == 1) & (b == 1)).alias("both_correct"),
            F.count_if((a == 0) & (b == 0)).alias("both_wrong"),
            F.count_if((a == 0) & (b == 1)).alias("b_only"),
            F.count_if((a == 1) & (b == 0)).alias("a_only"),
            F.count_if(a != b).alias("discordant"),
            F.avg(a).alias("accuracy_a"), F.avg(b).alias("accuracy_b"),
            F.avg(b - a).alias("gap")]


def paired_summary(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracies, gap, 2×2 table and exact McNemar p per group (A-01..A-03, T-01)."""
    table = pairs.groupBy(*(by or [])).agg(*paired_counts())
    return table.withColumn("gap_pp", F.col("gap") * 100).withColumn(
        "mcnemar_p", mcnemar_p(F.col("b_only"), F.col("a_only")))


def cross_contingency(wide: DataFrame) -> DataFrame:
    """Per side: both models right, only one, neither (A-17). One aggregate, then one row per side."""
    def cell(s, x, y):
        return F.count_if((F.col(f"m1_{s}") == x) & (F.col(f"m2_{s}") == y))
    counts = wide.agg(*[cell(s, x, y).alias(f"{s}_{x}{y}") for s in "ab" for x in (0, 1) for y in (0, 1)])
    return counts.select(F.inline(F.array(*[F.struct(
        F.lit(s).alias("side"), F.col(f"{s}_11").alias("both_models"), F.col(f"{s}_10").alias("only_first"),
        F.col(f"{s}_01").alias("only_second"), F.col(f"{s}_00").alias("neither")) for s in "ab"])))


def scenario_rows(df: DataFrame, key: str, scenarios: list[str], exclusions: DataFrame) -> DataFrame:
    """Rows repeated once per scenario that keeps them (P-16).

    ``exclusions`` has (scenario, id). Keys meet their exclusions once: the scenarios that drop a key are
    folded into one row per key (bounded by the number of scenarios), then each row is exploded over the
    scenarios left.
    """
    drops = exclusions.where(F.col("scenario").isin(scenarios)).groupBy(F.col("id").alias(key)).agg(*[
        F.max((F.col("scenario") == s).cast("int")).alias(f"_s{i}") for i, s in enumerate(scenarios)])
    kept = F.filter(F.array(*[F.when(F.coalesce(F.col(f"_s{i}"), F.lit(0)) == 0, F.lit(s))
                              for i, s in enumerate(scenarios)]), lambda x: x.isNotNull())
    return df.join(drops, key, "left").withColumn("scenario", F.explode(kept)) \
        .drop(*[f"_s{i}" for i in range(len(scenarios))])


def scenario_masks(df: DataFrame, key: str, scenarios: list[str], exclusions: DataFrame, out: str = "excluded_by") -> DataFrame:
    """Rows with one bit for each scenario that drops their key (P-16); no row is repeated."""
    if len(scenarios) > 63:
        raise ValueError("a mask holds 63 scenarios")
    bit = F.lit(0).cast("bigint")
    for i, s in enumerate(scenarios):
        bit = F.when(F.col("scenario") == s, F.lit(1 << i).cast("bigint")).otherwise(bit)
    drops = exclusions.where(F.col("scenario").isin(scenarios)).groupBy(F.col("id").alias(key)).agg(F.bit_or(bit).alias(out))
    return df.join(drops, key, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("bigint")))


def scenario_totals(counted: DataFrame, scenarios: list[str], by: list[str], mask: str = "excluded_by") -> DataFrame:
    """Sums per scenario from sums per mask: a scenario holds the rows of all masks without its bit (A-24, P-16).

    ``counted`` has one row a mask and group; only these few rows are repeated over the scenarios, so the number of rows shuffled does not depend on them.
    """
    sums = [c for c in counted.columns if c not in (*by, mask)]
    open_to = F.filter(F.array(*[F.when(F.col(mask).bitwiseAND(F.lit(1 << i).cast("bigint")) == 0, F.lit(s)) for i, s in enumerate(scenarios)]), lambda x: x.isNotNull())
    return counted.withColumn("scenario", F.explode(open_to)).groupBy("scenario", *by).agg(*[F.sum(c).alias(c) for c in sums])


def scenario_value_counts(df: DataFrame, key: str, value: str, scenarios: list[str], exclusions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(scenario, by, a, c): the outcomes of every scenario, counted once per mask."""
    by = by or []
    masked = scenario_masks(df.where(F.col(value).isNotNull()), key, scenarios, exclusions)
    counted = masked.groupBy("excluded_by", *by, F.col(value).cast("bigint").alias("a")).agg(F.count(F.lit(1)).alias("c"))
    return scenario_totals(counted, scenarios, [*by, "a"])


def compose_exclusions(sets: DataFrame, scenarios: dict[str, list[str]]) -> DataFrame:
    """(set_name, id) to (scenario, id): a scenario drops the union of its sets (P-16, U-04)."""
    of_set: dict[str, list[str]] = {}
    for scenario, names in scenarios.items():
        for name in names:
            of_set.setdefault(name, []).append(scenario)
    hit = F.lit(None).cast("array<string>")
    for name, found in of_set.items():
        hit = F.when(F.col("set_name") == name, F.array(*[F.lit(s) for s in found])).otherwise(hit)
    return sets.select("id", F.explode(hit).alias("scenario")).distinct()


def scenario_outcomes(long: DataFrame, key: str, model: str, side: str, correct: str, sides: tuple[str, str],
                      scenarios: list[str], exclusions: DataFrame) -> DataFrame:
    """(scenario, model, a_correct, b_correct, c) from one pairing shuffle and one count per exclusion mask: all that a scenario's row is made of."""
    pairs = paired_outcomes(long, [key, model], side, correct, *sides)
    counted = scenario_masks(pairs, key, scenarios, exclusions).groupBy("excluded_by", model, "a_correct", "b_correct").agg(F.count(F.lit(1)).alias("c"))
    return scenario_totals(counted, scenarios, [model, "a_correct", "b_correct"])


def summary_of_outcomes(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """``paired_summary`` of counted outcomes (by, a_correct, b_correct, c)."""
    a, b, c = F.col("a_correct"), F.col("b_correct"), F.col("c")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, c).otherwise(0))
    t = outcomes.groupBy(*by).agg(
        F.sum(c).alias("n"), total((a == 1) & (b == 1)).alias("both_correct"), total((a == 0) & (b == 0)).alias("both_wrong"), total((a == 0) & (b == 1)).alias("b_only"),
        total((a == 1) & (b == 0)).alias("a_only"), total(a != b).alias("discordant"), F.sum(a * c).alias("_a"), F.sum(b * c).alias("_b"))
    gap = (F.col("_b") - F.col("_a")) / F.col("n")
    return t.select(*by, "n", "both_correct", "both_wrong", "b_only", "a_only", "discordant", (F.col("_a") / F.col("n")).alias("accuracy_a"), (F.col("_b") / F.col("n")).alias("accuracy_b"),
                    gap.alias("gap"), (gap * 100).alias("gap_pp"), mcnemar_p(F.col("b_only"), F.col("a_only")).alias("mcnemar_p"))


def scenario_matrix(long: DataFrame, key: str, model: str, side: str, correct: str, sides: tuple[str, str],
                    scenarios: list[str], exclusions: DataFrame) -> DataFrame:
    """Paired summary for every (scenario, model) (A-24)."""
    return summary_of_outcomes(scenario_outcomes(long, key, model, side, correct, sides, scenarios, exclusions), ["scenario", model])


def overlay(df: DataFrame, decisions: DataFrame, keys: list[str], automatic: str, decided: str,
            out: str = "final_correct") -> DataFrame:
    """Decision overlay (J-09): the decision where there is one, else the automatic value.

    The automatic column is kept; ``changed`` marks overruled rows. Uniqueness of the decision keys is
    the caller's gate (``unmatched_decisions``).
    """
    joined = df.join(decisions, keys, "left")
    return joined.withColumn(out, F.coalesce(F.col(decided), F.col(automatic))) \
        .withColumn("reviewed", F.col(decided).isNotNull().cast("int")) \
        .withColumn("changed", (F.col(decided).isNotNull() & (F.col(decided) != F.col(automatic))).cast("int"))


def unmatched_decisions(df: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions that do not match exactly one row (gate of J-09)."""
    wanted = decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_decisions"))
    found = df.join(wanted.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return wanted.join(found, keys, "left").fillna(0, ["n_rows"]).where("n_rows <> 1 OR n_decisions <> 1")


def review_accounting(adjudicated: DataFrame, by: list[str], flagged: str, automatic: str, final: str) -> DataFrame:
    """Flagged, reviewed, changed and correct counts after review (A-23)."""
    return adjudicated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(flagged) == 1).alias("n_flagged"),
        F.count_if(F.col("reviewed") == 1).alias("n_reviewed"), F.count_if(F.col("changed") == 1).alias("n_changed"),
        F.count_if(F.col(automatic) == 1).alias("n_automatic_correct"),
        F.count_if(F.col(final) == 1).alias("n_final_correct"),
        F.count_if((F.col("reviewed") == 1) & (F.col(final) == 1)).alias("n_reviewed_correct"),
        F.count_if((F.col("reviewed") == 1) & (F.col(final) == 0)).alias("n_reviewed_wrong"))


def scoring_changes(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rows whose old and new score differ; a null old score counts as 0 (A-25)."""
    return df.where(F.coalesce(F.col(old), F.lit(0)) != F.coalesce(F.col(new), F.lit(0)))


def work_queue(problems: DataFrame, key: str, sides: list[str], log: DataFrame, side: str = "language",
               status: str = "status") -> DataFrame:
    """Planned (problem, side) pairs without a successful row (J-08). The plan is one explode per problem."""
    plan = problems.select(key, F.explode(F.array(*[F.lit(s) for s in sides])).alias(side))
    return plan.join(log.where(F.col(status) == "success").select(key, side), [key, side], "left_anti")


def position_join(left: DataFrame, raw_id: str, left_answer: Column, right: DataFrame, index: str,
                  right_answer: Column) -> DataFrame:
    """Join by a textual position with a range check (J-05): status clean, mismatched or unmapped, with reason.

    ``right_answer`` is evaluated on ``right`` before the join. The answers are compared as canonical numbers.
    """
    bound = right.agg(F.max(index)).scalar()
    probe = left.withColumn("_idx", F.trim(F.col(raw_id)).try_cast("bigint")).withColumn("left_number", left_answer)
    target = right.withColumn("right_number", right_answer).withColumn("_hit", F.lit(1))
    joined = probe.join(target, F.col("_idx") == F.col(index), "left").withColumn("_max", bound)
    status = F.when(F.col("_idx").isNull(), F.struct(F.lit("unmapped").alias("status"), F.lit("non-integer id").alias("reason"))) \
        .when((F.col("_idx") < 0) | (F.col("_idx") > F.col("_max")) | F.col("_hit").isNull(), F.struct(F.lit("unmapped").alias("status"), F.lit("id outside range").alias("reason"))) \
        .when(F.col("left_number").isNull() | F.col("right_number").isNull(), F.struct(F.lit("mismatched").alias("status"), F.lit("could not parse numeric answer").alias("reason"))) \
        .when(F.col("left_number") != F.col("right_number"), F.struct(F.lit("mismatched").alias("status"), F.lit("numeric answers differ").alias("reason"))) \
        .otherwise(F.struct(F.lit("clean").alias("status"), F.lit("").alias("reason")))
    return joined.withColumn("_s", status).select("*", "_s.status", "_s.reason").drop("_s", "_idx", "_max", "_hit")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the greatest by ``order`` (W-01).

    An aggregate, not a window: map-side combining leaves one row per key and task, so a key that holds
    a third of the log costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"),
                                 F.count(F.lit(1)).alias("n_versions"))
    return kept.select(*keys, "_row.*", "n_versions")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"),
                                 F.count(F.lit(1)).alias("n_versions"))
    return kept.select(*keys, "_row.*", "n_versions")


def listed_ids(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """The ids of every group, one row each, with their number in the group (A-27)."""
    ids = df.select(*by, key).distinct()
    return ids.join(ids.groupBy(*by).agg(F.count(F.lit(1)).alias("n_ids")), by)


def joined_ids(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Sorted id text per group (A-27): one text cell each, so for curated lists; ``listed_ids`` gives rows."""
    return df.select(*by, key).distinct().groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("excluded_ids"))


def attach_to_one(df: DataFrame, extra: DataFrame, column: str, value) -> DataFrame:
    """Columns of a one-row table attached to the rows with ``column = value`` only, null elsewhere (A-27)."""
    return with_scalars(df, extra).select(*df.columns, *[
        F.when(F.col(column) == value, F.col(c)).alias(c) for c in extra.columns])
