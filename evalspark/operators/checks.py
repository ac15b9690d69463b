"""Validation predicates (P-01..P-22) and reconciliation joins (J-10..J-15).

Checks return tables (offending rows, or one row per check); ``require_empty`` turns a table of
offenders into an error where a job must stop. Each check is one aggregate or one join.
"""
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators import idsets


class CheckFailed(ValueError):
    """A gate found offending rows; nothing was written."""


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Schema only, no job (P-01)."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise CheckFailed(f"missing columns: {missing}")
    return df


def resolve_column(df: DataFrame, candidates: list[str]) -> str:
    """First candidate present, exact match before case-insensitive match (P-02)."""
    for name in candidates:
        if name in df.columns:
            return name
    lower = {c.lower(): c for c in reversed(df.columns)}
    for name in candidates:
        if name.lower() in lower:
            return lower[name.lower()]
    raise CheckFailed(f"none of {candidates} in {df.columns}")


def rename_resolved(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    return df.withColumnsRenamed({resolve_column(df, names): new for new, names in wanted.items()})


def normalized_key(c: Column) -> Column:
    """Trim and lower (P-03)."""
    return F.lower(F.trim(c))


def lenient_int(c: Column, default: int | None = None) -> Column:
    """Bad text becomes null or ``default`` (P-05). The strict form is Spark's own cast (P-04)."""
    number = c.try_cast("double").try_cast("int")
    return number if default is None else F.coalesce(number, F.lit(default))


def outside_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Offending values with counts (P-06); null is an offender."""
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).groupBy(column).agg(
        F.count(F.lit(1)).alias("n_rows"))


def id_gaps(df: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Ids missing from low..high and ids outside it, one row each (P-07); ``idsets.id_gap_ranges`` gives ranges."""
    return idsets.single_ids(idsets.id_gap_ranges(df, key, low, high).drop("n_ids"))


def grid_gaps(df: DataFrame, key: str, category: str, categories: list) -> DataFrame:
    """(key, category) cells without a row (P-08).

    Each key keeps a bit per category (a bounded aggregate), and only missing cells are emitted:
    the full grid is never built.
    """
    present = df.groupBy(key).agg(*[F.max((F.col(category) == c).cast("int")).alias(f"_c{i}")
                                   for i, c in enumerate(categories)])
    gaps = F.filter(F.array(*[F.when(F.coalesce(F.col(f"_c{i}"), F.lit(0)) == 0, F.lit(c))
                              for i, c in enumerate(categories)]), lambda x: x.isNotNull())
    return present.select(key, F.explode(gaps).alias(category))


def expectation_table(df: DataFrame, checks: dict[str, tuple[Column, int]]) -> DataFrame:
    """One pass over the data; one row per check: name, expected, actual, ok (P-09)."""
    names = list(checks)
    counts = df.agg(*[F.count_if(cond).alias(f"_k{i}") for i, (cond, _) in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(checks[n][1]).cast("bigint").alias("expected"),
                              F.col(f"_k{i}").alias("actual"), (F.col(f"_k{i}") == checks[n][1]).alias("ok"))
                     for i, n in enumerate(names)])
    return counts.select(F.inline(rows))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (P-10)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def blank_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Blank cells per column, one row (P-11)."""
    return df.agg(*[F.count_if(F.trim(F.col(c)) == "").alias(f"blank_{c}") for c in columns])


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """Name of the first rule that applies, in order; null when none does."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for cond, name in rules])


def all_reasons(rules: list[tuple[Column, str]]) -> Column:
    """Names of every rule that applies."""
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]), lambda x: x.isNotNull())


def key_set_differences(left: DataFrame, right: DataFrame, keys: list[str], left_name: str = "left",
                        right_name: str = "right") -> DataFrame:
    """Keys on one side only (P-22, J-10). Both sides are reduced to distinct keys first."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    return a.join(b, keys, "full_outer").where(F.col("_l").isNull() | F.col("_r").isNull()).select(
        *keys, F.when(F.col("_l").isNull(), F.lit(f"only_{right_name}")).otherwise(
            F.lit(f"only_{left_name}")).alias("side"))


def coverage_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every left row needs exactly one right row: missing, unknown and doubled keys (J-10)."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, first_reason([
        (F.col("_r").isNull(), "missing"), (F.col("_l").isNull(), "unknown"),
        (F.col("_r") > 1, "doubled"), (F.col("_l") > 1, "repeated_source")]).alias("problem")) \
        .where(F.col("problem").isNotNull())


def changed_rows(current: DataFrame, locked: DataFrame, key: str, digest: str) -> DataFrame:
    """Locked keys whose current digest differs or is gone (J-11, J-15)."""
    now = current.select(key, F.col(digest).alias("actual_digest"))
    then = locked.select(key, F.col(digest).alias("locked_digest"))
    return then.join(now, key, "left").where(~F.col("actual_digest").eqNullSafe(F.col("locked_digest"))) \
        .withColumn("problem", F.when(F.col("actual_digest").isNull(), "missing").otherwise("changed"))


def leaking_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups present in more than one split (J-12). Min and max are enough: no set per group is built."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.min(split).alias("first_split"), F.max(split).alias("last_split"), F.count(F.lit(1)).alias("n_rows")) \
        .where("first_split <> last_split")


def repeated_across_batches(df: DataFrame, key: str, batch: str) -> DataFrame:
    """Ids accepted more than once, over all batches (J-13)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.min(batch).alias("first_batch"),
                               F.max(batch).alias("last_batch")).where("n_rows > 1")


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one table only, with multiplicity (J-14, U-06), in one pass over tables that are still to be computed.

    ``snapshots.row_differences`` reads stored tables twice and exchanges only what differs.
    """
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("only_left")) \
        .unionByName(right.exceptAll(left).withColumn("side", F.lit("only_right")))


def require_empty(offenders: DataFrame, message: str, show: int = 5) -> None:
    """Stop when a table of offenders has rows; at most ``show`` of them are fetched for the message."""
    sample = offenders.limit(show).collect()
    if sample:
        raise CheckFailed(f"{message}: {[r.asDict() for r in sample]}")


# Domains of the pilot records.
PILOT_FIELDS = ("id", "pair_id", "language", "source", "variant", "problem", "response",
                "step_labels", "first_error_step", "error_type")
PILOT_VARIANTS = ("correct", "incorrect")
PILOT_ERROR_TYPES = ("arithmetic", "operation_substitution", "operand_substitution", "intermediate_corruption",
                     "unit_conversion", "premature_conclusion", "semantic_logical")


def pilot_violations(df: DataFrame, language: str = "ar") -> DataFrame:
    """All violations per pilot record (P-12): one row per (id, violation).

    ``missing_fields`` (array of absent field names, when the reader provides it) stops the later rules.
    """
    from evalspark.functions.steps import first_position, split_steps
    labels, variant = F.col("step_labels"), F.col("variant")
    n_steps = F.size(split_steps(F.col("response")))
    first_zero = first_position(labels, F.lit(0))
    correct, wrong = variant == "correct", variant == "incorrect"
    bad_label = F.exists(labels, lambda x: ~F.coalesce(x.isin(0, 1), F.lit(False)))
    not_one = F.exists(labels, lambda x: ~F.coalesce(x == 1, F.lit(False)))
    after = F.exists(F.slice(labels, F.greatest(F.coalesce(first_zero, F.lit(1)), F.lit(1)),
                             F.greatest(F.size(labels), F.lit(0))),
                     lambda x: ~F.coalesce(x == 0, F.lit(False)))
    rules = [
        (~F.coalesce(F.col("language") == language, F.lit(False)), "language"),
        (~F.coalesce(variant.isin(*PILOT_VARIANTS), F.lit(False)), "variant"),
        (n_steps != F.size(labels), "step_count"),
        (bad_label, "label_domain"),
        (correct & not_one, "correct_has_zero_label"),
        (correct & F.col("first_error_step").isNotNull(), "correct_has_first_error"),
        (correct & F.col("error_type").isNotNull(), "correct_has_error_type"),
        (wrong & first_zero.isNull(), "incorrect_without_zero_label"),
        (wrong & ~first_zero.eqNullSafe(F.col("first_error_step")), "first_error_mismatch"),
        (wrong & first_zero.isNotNull() & after, "valid_after_error"),
        (wrong & ~F.coalesce(F.col("error_type").isin(*PILOT_ERROR_TYPES), F.lit(False)), "unknown_error_type"),
    ]
    found = all_reasons(rules)
    if "missing_fields" in df.columns:
        found = F.when(F.size("missing_fields") > 0, F.transform(
            "missing_fields", lambda f: F.concat(F.lit("missing:"), f))).otherwise(found)
    return df.select("id", F.explode(found).alias("violation"))


def staged_problem(unicode_form: bool = True, problem: str = "problem") -> Column:
    """First failing rule of a staged trajectory, null when it is sound (P-13)."""
    from evalspark.functions.digests import group_key
    from evalspark.functions.steps import first_position, labels_from_ratings, mask_from_ratings, split_steps
    n = F.size("steps")
    ratings, labels, mask = F.col("source_step_ratings"), F.col("step_labels"), F.col("supervision_mask")
    return first_reason([
        ((n < 1) | (F.size(ratings) != n) | (F.size(labels) != n) | (F.size(mask) != n), "step_alignment"),
        (F.size(split_steps(F.col("response"))) != n, "newline_alignment"),
        (~labels.eqNullSafe(labels_from_ratings(ratings)), "label_mapping"),
        (~mask.eqNullSafe(mask_from_ratings(ratings)), "neutral_mask"),
        (~F.col("first_error_step").eqNullSafe(first_position(ratings, F.lit(-1))), "first_error_alignment"),
        (~F.col("pair_id").eqNullSafe(group_key(F.col(problem), unicode_form)), "problem_grouping"),
    ])
