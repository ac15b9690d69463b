"""Matched benchmark construction and audit (C-10, C-11, C-21)."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.functions.digests import seeded
from evalspark.functions.numbers import marked_answer, normalize_integral, numbers_in
from evalspark.operators.checks import CheckFailed, require_empty, row_differences
from evalspark.operators.pairs import position_join
from evalspark.operators.ranges import digest_ranks, numbered
from evalspark.operators.sampling import sample_unused
from evalspark.session import cut_lineage


def answer_mismatches(aligned: DataFrame) -> DataFrame:
    """Positions whose two answers differ after normalisation; the build stops when there is one."""
    a, b = normalize_integral(F.col("answer_a")), normalize_integral(F.col("answer_b"))
    return aligned.where(~a.eqNullSafe(b)).select("source_index", a.alias("answer_a"), b.alias("answer_b"))


def matched_rows(aligned: DataFrame) -> DataFrame:
    """Matched problems with the numbers of both questions and whether they agree as multisets."""
    rows = aligned.withColumn("numbers_a", numbers_in(F.col("question_a"))).withColumn("numbers_b", numbers_in(F.col("question_b")))
    agree = F.array_sort("numbers_a") == F.array_sort("numbers_b")
    return rows.withColumn("gold_answer", normalize_integral(F.col("answer_a"))).withColumn("question_numbers_match", agree) \
        .withColumn("manual_review", F.when(agree, "").otherwise("question numbers differ"))


def build(aligned: DataFrame, size: int, seed: int) -> DataFrame:
    """First matched benchmark (C-10): ``size`` positions in digest order, ids from 1 in position order."""
    require_empty(answer_mismatches(aligned), "answers do not align")
    chosen = sample_unused(aligned, "source_index", size, seed)
    rows = numbered(aligned.join(chosen, "source_index", "left_semi"), "source_index", "id")
    return matched_rows(rows)


def extend(aligned: DataFrame, existing: DataFrame, size: int, seed: int) -> DataFrame:
    """Extension by unused positions; the existing rows are kept unchanged and ids continue (C-10, U-06)."""
    require_empty(answer_mismatches(aligned), "answers do not align")
    chosen = sample_unused(aligned, "source_index", size, seed, existing.select("source_index"))
    start = existing.agg(F.max("id")).first()[0] + 1
    fresh = cut_lineage(matched_rows(numbered(aligned.join(chosen, "source_index", "left_semi"), "source_index", "id", start)))
    combined = existing.unionByName(fresh.select(*existing.columns))
    require_empty(row_differences(existing, combined.where(F.col("id") < start)).select("id", "side"), "existing rows changed")
    return combined


def cross_matched(left: DataFrame, raw_id: str, left_answer: str, right: DataFrame, index: str, right_answer: str) -> DataFrame:
    """Cross-dataset pairs by position (C-11, J-05): one row per left row with status and reason."""
    return position_join(left, raw_id, marked_answer(F.col(left_answer)), right, index, marked_answer(F.col(right_answer)))


def clean_sample(matched: DataFrame, index: str, size: int, seed: int) -> DataFrame:
    """``size`` clean pairs in digest order, numbered from 1 in that order."""
    clean = matched.where("status = 'clean'")
    chosen = sample_unused(clean, index, size, seed)
    picked = clean.join(chosen, index, "left_semi").withColumn("_d", seeded(seed, "sample", F.col(index)))
    return digest_ranks(picked, "_d", out="problem_id", hex_chars=1).drop("_d")


def audit_overlay(results: DataFrame, audit: DataFrame, key: str, default: str = "OK") -> DataFrame:
    """Audit status and note per problem; unlisted problems get the default (C-21)."""
    out = results.join(audit, key, "left")
    return out.withColumn("audit_status", F.coalesce("audit_status", F.lit(default))) \
        .withColumn("audit_note", F.coalesce("audit_note", F.lit("")))
