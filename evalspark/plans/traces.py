"""Step-rated traces: classification, conversion, group sampling (P-14, P-15, C-01, C-02)."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.digests import canonical_digest, group_key, raw_row_id
from evalspark.functions.steps import first_position, labels_from_ratings, mask_from_ratings, steps_to_text
from evalspark.functions.text import is_filled
from evalspark.operators.checks import CheckFailed, changed_rows, first_reason, leaking_groups, require_empty, staged_problem
from evalspark.operators.pairs import first_per_key
from evalspark.operators.sampling import check_reservoir, collect_groups, group_reservoir, ranked_group_sample
from evalspark.session import computed_once, cut_lineage

# Leaves whose JSON type matters (1, 1.0, true and "1" are different ratings) stay VARIANT.
TRACE_SCHEMA = """STRUCT<
 question: STRUCT<problem: VARIANT, pre_generated_steps: VARIANT>,
 label: STRUCT<finish_reason: VARIANT, steps: ARRAY<STRUCT<
   completions: ARRAY<STRUCT<text: VARIANT, rating: VARIANT, flagged: VARIANT>>,
   chosen_completion: VARIANT, human_completion: VARIANT>>>,
 generation: VARIANT, is_quality_control_question: VARIANT, is_initial_screening_question: VARIANT>"""

# Exclusion reasons in the order in which they are tested.
EXCLUSION_REASONS = (
    "quality_control_or_screening", "empty_problem", "unfinished_or_bad_problem", "not_phase2",
    "human_completion_requires_separate_policy", "ambiguous_original_completion",
    "missing_or_invalid_rating", "conflicting_duplicate_ratings", "flagged_duplicate_step",
    "invalid_completion_index", "selected_path_differs_from_generated", "flagged_step", "empty_step",
    "empty_trajectory", "error_not_at_labeled_endpoint", "solution_contains_error", "no_binary_supervision",
)


def _text(v: Column) -> Column:
    """String of a VARIANT that is a JSON string, else null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _whole(v: Column) -> Column:
    """Integer of a VARIANT that is a JSON integer, else null (booleans and 1.0 are not integers)."""
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def _absent(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def _truthy(v: Column) -> Column:
    """Python truth of a JSON value: null, false, 0, "" and empty containers are false."""
    text = F.to_json(v)
    return F.coalesce(~_absent(v) & ~text.isin("false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def parse_traces(lines: DataFrame, line: str = "line") -> DataFrame:
    """Raw lines to plain columns; every leaf keeps only what the rules need.

    steps: array of (chosen, choice_given, human, completions: array of (text, rating, flagged)).
    """
    t = F.from_json(F.col(line), TRACE_SCHEMA)
    parsed = computed_once(lines, _t=t)
    steps = F.transform("_t.label.steps", lambda s: F.struct(
        (~_absent(s["chosen_completion"])).alias("choice_given"),
        _whole(s["chosen_completion"]).alias("chosen"),
        (~_absent(s["human_completion"])).alias("human"),
        F.transform(s["completions"], lambda c: F.struct(
            _text(c["text"]).alias("text"), _whole(c["rating"]).alias("rating"),
            _truthy(c["flagged"]).alias("flagged"))).alias("completions")))
    generated = F.col("_t.question.pre_generated_steps")
    return parsed.select(
        *lines.columns,
        (_truthy(F.col("_t.is_quality_control_question")) | _truthy(F.col("_t.is_initial_screening_question"))).alias("screening"),
        _text(F.col("_t.question.problem")).alias("problem"),
        _text(F.col("_t.label.finish_reason")).alias("finish_reason"),
        F.when(F.schema_of_variant(generated).startswith("ARRAY"),
               F.try_variant_get(generated, "$", "array<string>")).alias("generated"),
        steps.alias("rated_steps"),
        _whole(F.col("_t.generation")).alias("generation"),
        (F.col("_t.label.steps").isNull() | F.exists("_t.label.steps", lambda s: s["completions"].isNull())).alias("misshapen"))


def malformed_traces(parsed: DataFrame) -> DataFrame:
    """Lines whose structure is not a trace at all; these stop a run instead of being counted."""
    return parsed.where(~F.col("screening") & F.coalesce(F.col("misshapen"), F.lit(True)))


def _extend(x: Column, names: tuple[str, ...], **more: Column) -> Column:
    return F.struct(*[x[n].alias(n) for n in names], *[c.alias(n) for n, c in more.items()])


def _judged(generated: Column) -> Column:
    """Steps with (reason, chosen, rating, text, matching), built in layers.

    Every layer is a transform over the one before it, so a value used by several rules is computed once per
    step and not once per use.
    """
    given = ("choice_given", "chosen", "human", "completions")
    wanted = F.transform("rated_steps", lambda s, i: _extend(s, given, wanted=F.try_element_at(generated, (i + 1).cast("int"))))
    matched = F.transform(wanted, lambda x: _extend(x, given + ("wanted",), matches=F.filter(F.transform(
        x["completions"], lambda c, j: F.when(c["text"] == x["wanted"], j)), lambda j: j.isNotNull())))
    indexed = F.transform(matched, lambda x: _extend(
        x, given + ("wanted", "matches"),
        index=F.when(x["choice_given"], x["chosen"]).otherwise(F.try_element_at(x["matches"], F.lit(1)).cast("bigint")),
        copies=F.transform(x["matches"], lambda j: F.element_at(x["completions"], j + 1))))
    placed = F.transform(indexed, lambda x: _extend(
        x, ("choice_given", "human", "completions", "wanted", "matches", "index", "copies"),
        in_range=F.coalesce((x["index"] >= 0) & (x["index"] < F.size(x["completions"])), F.lit(False))))
    # The guarded position keeps the lookup valid when the index is not.
    picked = F.transform(placed, lambda x: _extend(
        x, ("choice_given", "human", "wanted", "matches", "index", "copies", "in_range"),
        picked=F.try_element_at(x["completions"], F.when(x["in_range"], (x["index"] + 1).cast("int")).otherwise(F.lit(1)))))

    def known(rating):
        return F.coalesce(rating.isin(-1, 0, 1), F.lit(False))

    def rules(x):
        no_choice = ~x["choice_given"]
        repeated = no_choice & (F.size(x["matches"]) > 1)
        return first_reason([
            (no_choice & x["human"], "human_completion_requires_separate_policy"),
            (no_choice & (F.size(x["matches"]) == 0), "ambiguous_original_completion"),
            (repeated & F.exists(x["copies"], lambda c: ~known(c["rating"])), "missing_or_invalid_rating"),
            (repeated & (F.size(F.array_distinct(F.transform(x["copies"], lambda c: c["rating"]))) > 1), "conflicting_duplicate_ratings"),
            (repeated & F.exists(x["copies"], lambda c: c["flagged"]), "flagged_duplicate_step"),
            (~x["in_range"], "invalid_completion_index"),
            (~F.coalesce(x["picked"]["text"] == x["wanted"], F.lit(False)), "selected_path_differs_from_generated"),
            (~known(x["picked"]["rating"]), "missing_or_invalid_rating"),
            (x["picked"]["flagged"], "flagged_step"),
            (~is_filled(x["picked"]["text"]), "empty_step"),
        ])
    return F.transform(picked, lambda x: F.struct(
        rules(x).alias("reason"), x["index"].cast("int").alias("chosen"), x["picked"]["rating"].cast("int").alias("rating"),
        x["picked"]["text"].alias("text"),
        F.when(x["choice_given"], F.array(x["index"].cast("int"))).otherwise(
            F.transform(x["matches"], lambda j: j.cast("int"))).alias("matching")))


def classify(parsed: DataFrame) -> DataFrame:
    """Add ``reason`` (null when eligible), the judged steps and the derived arrays (P-14)."""
    judged = computed_once(parsed, judged=_judged(F.col("generated")))
    judged = judged.withColumn("ratings", F.transform("judged", lambda j: j["rating"])) \
        .withColumn("first_error_step", first_position(F.col("ratings"), F.lit(-1)))
    step_reason = F.try_element_at(F.filter(F.transform("judged", lambda j: j["reason"]), lambda r: r.isNotNull()), F.lit(1))
    finish, n = F.col("finish_reason"), F.size("judged")
    reason = F.coalesce(
        first_reason([
            (F.col("screening"), "quality_control_or_screening"),
            (~is_filled(F.col("problem")), "empty_problem"),
            (~F.coalesce(finish.isin("solution", "found_error"), F.lit(False)), "unfinished_or_bad_problem"),
            (F.col("generated").isNull(), "not_phase2")]),
        step_reason,
        first_reason([
            (n == 0, "empty_trajectory"),
            ((finish == "found_error") & ~F.col("first_error_step").eqNullSafe(n), "error_not_at_labeled_endpoint"),
            ((finish == "solution") & F.col("first_error_step").isNotNull(), "solution_contains_error"),
            (F.forall("ratings", lambda r: r == 0), "no_binary_supervision")]))
    return judged.withColumn("reason", reason)


def exclusion_counts(classified: DataFrame) -> DataFrame:
    """Counted reasons (P-15); a plain partial aggregation over at most 17 keys."""
    return classified.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def stage(classified: DataFrame, row_id: Column, revision: str, source_file: str, source: str,
          unicode_form: bool = True) -> DataFrame:
    """Eligible rows as staged trajectories."""
    texts = F.transform("judged", lambda j: j["text"])
    ratings = F.col("ratings")
    return classified.where(F.col("reason").isNull()).withColumn("_key", group_key(F.col("problem"), unicode_form)).select(
        row_id.alias("id"), F.col("_key").alias("pair_id"), F.col("_key").alias("problem_id"), F.lit("en").alias("language"),
        F.lit(source).alias("source"), F.lit("english_translation_pending").alias("stage"),
        F.when(F.col("first_error_step").isNull(), "correct").otherwise("incorrect").alias("variant"), "problem",
        steps_to_text(texts).alias("response"), texts.alias("steps"), ratings.alias("source_step_ratings"),
        labels_from_ratings(ratings).alias("step_labels"), mask_from_ratings(ratings).alias("supervision_mask"),
        "first_error_step", F.lit(None).cast("string").alias("error_type"),
        F.struct(
            F.lit(revision).alias("revision"), F.lit(source_file).alias("file"), F.col("line_number").cast("bigint").alias("line"),
            "generation", "finish_reason",
            F.transform("judged", lambda j: j["chosen"]).alias("chosen_completion_indices"),
            F.transform("judged", lambda j: j["matching"]).alias("matching_completion_indices"),
            (F.size("generated") - F.size("judged")).alias("unlabeled_tail_steps")).alias("source_metadata"))


def ingest(lines: DataFrame, groups: int, seed: int, dev_fraction: float, revision: str, source_file: str,
           source: str = "step_rated_traces") -> dict[str, DataFrame]:
    """Bounded ingestion (C-01): staged rows with split, exclusion counts, selection.

    ``lines`` has (line, line_number), usually from ``bounded_prefix``. Duplicate row ids keep the first line.
    """
    classified = cut_lineage(classify(parse_traces(lines)).drop("rated_steps"))
    require_empty(malformed_traces(classified).select("line_number"), "unexpected trace structure")
    converted = stage(classified, raw_row_id(F.col("line")), revision, source_file, source)
    selected = ranked_group_sample(converted, "problem_id", groups, seed, dev_fraction)
    rows = first_per_key(converted.join(selected.select("problem_id", "split"), "problem_id"), ["id"],
                         [F.col("source_metadata.line")]).drop("n_versions")
    require_empty(rows.select("id", staged_problem().alias("problem")).where("problem IS NOT NULL"), "staged row failed validation")
    require_empty(leaking_groups(rows, "problem_id", "split"), "group in both splits")
    return {"staged": rows, "exclusions": exclusion_counts(classified), "selected": selected, "converted": converted}


def anchor_problems(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Prior staged records that are missing or changed, and prior groups in two splits (J-15)."""
    now = current.withColumn("_d", canonical_digest(current))
    old = prior.drop("split")
    then = old.select(*current.columns).withColumn("_d", canonical_digest(old.select(*current.columns)))
    return changed_rows(now, then, "id", "_d").select("id", "problem").unionByName(
        leaking_groups(prior, "problem_id", "split").select(F.col("problem_id").alias("id"), F.lit("anchor_leak").alias("problem")))


def sample_groups(lines: DataFrame, groups: int, seed: int, dev_fraction: float, revision: str, source_file: str,
                  source: str = "step_rated_traces", prior: DataFrame | None = None, lock: DataFrame | None = None,
                  unicode_form: bool = True) -> dict[str, DataFrame]:
    """Full-source group sample (C-02): one parse, kept; gates, selection and collection read the kept rows.

    ``prior`` (staged rows with split) or ``lock`` (problem_id, split) anchors earlier assignments.
    """
    if prior is not None and lock is not None:
        raise CheckFailed("use either prior records or a split lock")
    classified = cut_lineage(classify(parse_traces(lines)).drop("rated_steps"))
    require_empty(malformed_traces(classified).select("line_number"), "unexpected trace structure")
    converted = cut_lineage(first_per_key(
        stage(classified, raw_row_id(F.col("line")), revision, source_file, source, unicode_form), ["id"],
        [F.col("source_metadata.line")]))
    unique = converted.drop("n_versions")
    anchors = lock
    if prior is not None:
        require_empty(anchor_problems(unique, prior), "anchored record missing or changed")
        anchors = prior.select("problem_id", "split").distinct()
    if anchors is not None and anchors.limit(groups + 1).count() > groups:
        raise CheckFailed("group budget is smaller than the anchored split")
    selected = group_reservoir(unique, "problem_id", groups, seed, anchors)
    check_reservoir(selected, groups, anchors, "problem_id")
    rows = collect_groups(unique, selected, "problem_id", seed, dev_fraction)
    require_empty(leaking_groups(rows, "problem_id", "split"), "group in both splits")
    if rows.select("split").distinct().count() < 2:
        raise CheckFailed("selected sample must contain both splits")
    duplicates = converted.agg((F.sum("n_versions") - F.count(F.lit(1))).alias("duplicate_row_ids"))
    return {"staged": rows, "exclusions": exclusion_counts(classified), "selected": selected, "duplicates": duplicates,
            "eligible": unique}
