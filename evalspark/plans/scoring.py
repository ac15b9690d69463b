"""Scoring stored responses and adjudication (C-12..C-15, C-24)."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions import answers
from evalspark.functions.numbers import normalize_decimal, numeric_equal
from evalspark.functions.text import is_filled
from evalspark.operators.checks import CheckFailed, key_set_differences, require_empty
from evalspark.operators.pairs import latest_per_key, overlay, paired_outcomes, paired_summary, unmatched_decisions
from evalspark.operators.resample import paired_bootstrap


def score_responses(df: DataFrame, response: str = "generated_response", gold: str = "gold_answer",
                    finish: str | None = "finish_reason", mode: str = "decimal_text") -> DataFrame:
    """Extract, compare and flag every stored response (C-12). One projection over the response table, no shuffle."""
    out = answers.extract_first_marker(df, response, "_x")
    review, reason = F.col("_x.needs_review"), F.col("_x.reason")
    if finish:
        review, reason = answers.flag_truncated(review, reason, F.col(finish))
    # The extractor's answer is normalised already; normalising it again would change nothing.
    same = F.coalesce(F.col("_x.answer") == normalize_decimal(F.col(gold)), F.lit(False)) if mode == "decimal_text" \
        else numeric_equal(F.col("_x.answer"), F.col(gold), mode)
    return out.withColumn("extracted_answer", F.col("_x.answer")).withColumn("extraction_method", F.col("_x.method")) \
        .withColumn("needs_manual_review", review).withColumn("review_reason", reason) \
        .withColumn("all_explicit_answers", F.col("_x.all_answers")) \
        .withColumn("is_correct", same.cast("int")).drop("_x")


def reparse(df: DataFrame, response: str, gold: str, old_correct: str = "is_correct", old_answer: str = "extracted_answer") -> DataFrame:
    """Score stored responses again with the re-parser; the old columns are kept as ``old_*`` (C-13)."""
    renamed = df.withColumnsRenamed({old_correct: "old_is_correct", old_answer: "old_extracted_answer"})
    out = answers.extract_reparsed(renamed, response, "_x")
    return out.withColumn("extracted_answer", F.col("_x.answer")).withColumn("extraction_method", F.col("_x.method")) \
        .withColumn("needs_manual_review", F.col("_x.needs_review")).withColumn("review_reason", F.col("_x.reason")) \
        .withColumn("all_candidates", F.col("_x.all_answers")) \
        .withColumn("is_correct", F.coalesce(F.col("extracted_answer") == normalize_decimal(F.col(gold)), F.lit(False)).cast("int")) \
        .withColumn("score_changed", (F.coalesce(F.col("old_is_correct"), F.lit(0)) != F.col("is_correct")).cast("int")).drop("_x")


def review_sheet(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Flagged rows with empty manual columns (C-14)."""
    return scored.where("needs_manual_review = 1").select(
        *columns, F.lit(None).cast("int").alias("manual_correct"), F.lit("").alias("review_note"), F.lit("").alias("error_type"))


def flagged_correct_problems(scored: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Flagged rows scored correct against the expected key list (P-22)."""
    found = scored.where("needs_manual_review = 1 AND is_correct = 1")
    return key_set_differences(found, expected, keys, "scored", "expected")


def adjudicate(scored: DataFrame, decisions: DataFrame, keys: list[str], policy: str = "corrections") -> DataFrame:
    """Final correctness per row (C-15); the automatic score is kept.

    ``corrections``   listed rows take the decision, all others keep their score
    ``whitelist``     flagged rows are wrong unless listed as correct
    ``flagged_wrong`` every flagged row is wrong
    ``semantic``      flagged rows are wrong; listed rows, flagged or not, take the decision
    """
    rows = overlay(scored, decisions, keys, "is_correct", "manual_correct")
    flagged, decided = F.col("needs_manual_review") == 1, F.col("manual_correct")
    final = {
        "corrections": F.coalesce(decided, F.col("is_correct")),
        "whitelist": F.when(flagged, F.coalesce(decided, F.lit(0))).otherwise(F.col("is_correct")),
        "flagged_wrong": F.when(flagged, F.lit(0)).otherwise(F.col("is_correct")),
        "semantic": F.coalesce(decided, F.when(flagged, F.lit(0)).otherwise(F.col("is_correct"))),
    }
    if policy not in final:
        raise CheckFailed(f"unknown adjudication policy: {policy}")
    return rows.withColumn("final_correct", final[policy]) \
        .withColumn("adjudication_status", F.when(decided.isNotNull(), "manual_decision").when(
            flagged & (F.col("final_correct") != F.col("is_correct")), "flagged_not_accepted").otherwise("automatic")) \
        .withColumn("changed", (F.col("final_correct") != F.col("is_correct")).cast("int"))


def model_study(scored: DataFrame, decisions: DataFrame, key: str, side: str, sides: tuple[str, str], policy: str,
                replicates: int, seed: int, mode: str = "collapse") -> dict[str, DataFrame]:
    """Adjudicate, pair, test (C-15)."""
    require_empty(unmatched_decisions(scored, decisions, [key, side]), "decision does not match exactly one row")
    final = adjudicate(scored, decisions, [key, side], policy)
    pairs = paired_outcomes(final, [key], side, "final_correct", *sides)
    return {"adjudicated": final, "paired": pairs, "summary": paired_summary(pairs),
            "interval": paired_bootstrap(pairs, key, "b_minus_a", replicates, seed, mode)}


def replace_rows(results: DataFrame, repaired: DataFrame, keys: list[str], response: str = "generated_response") -> DataFrame:
    """New version of a result table with repaired rows (C-24).

    Refuses empty responses and keys that are not in the table. Columns missing in ``repaired`` are null there.
    """
    require_empty(repaired.where(~is_filled(F.col(response))).select(*keys), "empty repaired response")
    require_empty(repaired.join(results.select(*keys), keys, "left_anti").select(*keys), "repaired key not in the table")
    kept = results.join(repaired.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(repaired, allowMissingColumns=True)


def resolve_log(log: DataFrame, keys: list[str], written: str = "timestamp_utc") -> DataFrame:
    """Latest row per key; a successful row beats any failed one (W-01, R-02)."""
    return latest_per_key(log, keys, [(F.col("status") == "success").cast("int"), F.col(written)])
