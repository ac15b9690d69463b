"""Trace ingestion, review gate, merge and audits on documents."""
from pyspark.sql import functions as F

from evalspark.bindings.base import TRAJ, query, shown, spread, table, trajectories
from evalspark.bindings.samples import CHOICE, SEED, SIG, SPLIT, greedy_sql
from evalspark.functions.digests import canonical_digest, group_key, table_digest
from evalspark.functions.spans import to_template
from evalspark.functions.steps import steps_to_text
from evalspark.operators import checks, scores as A
from evalspark.plans import pilot, review, traces
from evalspark.session import cut_lineage

# ------------------------------------------------------------------ raw traces
# Every document becomes one JSON line. Lines of the text are steps; choices, repeats, flags and ratings
# follow from their lengths, so that every exclusion reason occurs.


def trace_lines(spark, d):
    docs = spread(table(spark, d, "documents", ["doc_id", "text"]), "doc_id")
    lines = F.split("text", "\n", -1)
    i = F.col("doc_id")
    base = docs.withColumn("all_steps", lines).withColumn("r", F.transform("all_steps", lambda s: (F.length(s) % 3 - 1).cast("int"))) \
        .withColumn("fe", F.array_position("r", F.lit(-1)).cast("int")) \
        .withColumn("n", F.when((F.col("fe") > 0) & (i % 4 != 3), F.col("fe")).otherwise(F.size("all_steps")))

    def step(s, k):
        n = F.length(s)
        rating = F.when(n % 37 == 0, F.lit(2)).otherwise((n % 3 - 1).cast("int"))
        own = F.struct(s.alias("text"), rating.alias("rating"), (n % 41 == 0).alias("flagged"))
        other = F.struct(F.concat(s, F.lit("?")).alias("text"), F.lit(1).alias("rating"), F.lit(False).alias("flagged"))
        twin = F.struct(s.alias("text"), F.when(n % 14 == 0, F.lit(0)).otherwise(rating).alias("rating"), (n % 35 == 0).alias("flagged"))
        open_choice = n % 7 == 0
        return F.struct(
            F.when(open_choice, F.array(other, own, twin)).when(n % 43 == 0, F.array(other)).otherwise(F.array(own)).alias("completions"),
            F.when(open_choice, F.lit(None).cast("int")).when(n % 31 == 0, F.lit(5)).otherwise(F.lit(0)).alias("chosen_completion"),
            F.when(open_choice & (n % 29 == 0), F.lit("repair")).alias("human_completion"))
    rated = F.transform(F.slice("all_steps", 1, F.col("n")), step)
    has_error = (F.col("fe") > 0) & (F.col("fe") <= F.col("n"))
    finish = F.when(i % 17 == 0, "give_up").when(i % 19 == 0, "solution").when(has_error, "found_error").otherwise("solution")
    row = F.struct(
        F.struct(F.when(i % 47 == 0, " ").otherwise(F.col("text")).alias("problem"),
                 F.when(i % 53 != 0, F.col("all_steps")).alias("pre_generated_steps")).alias("question"),
        F.struct(finish.alias("finish_reason"), rated.alias("steps")).alias("label"),
        (i % 4).cast("int").alias("generation"), (i % 23 == 0).alias("is_quality_control_question"), F.lit(False).alias("is_initial_screening_question"))
    return base.select("doc_id", (i + 1).alias("line_number"), F.to_json(row, {"ignoreNullFields": "false"}).alias("line"))


# The same rules over one row per step: position, then the first rule in order.
TRACE = r"""tr0 AS (SELECT doc_id, text, string_split(text, chr(10)) AS all_steps FROM documents),
 tr1 AS (SELECT *, list_transform(all_steps, lambda s: length(s) % 3 - 1) AS r FROM tr0),
 tr2 AS (SELECT *, coalesce(list_position(r, -1), 0) AS fe FROM tr1),
 tr3 AS (SELECT *, CASE WHEN fe > 0 AND doc_id % 4 <> 3 THEN fe ELSE len(all_steps) END AS n FROM tr2),
 st0 AS (SELECT doc_id, generate_subscripts(all_steps[1:n], 1) AS pos, unnest(all_steps[1:n]) AS s FROM tr3),
 st1 AS (SELECT *, length(s) AS n, length(s) % 7 = 0 AS is_open, CASE WHEN length(s) % 37 = 0 THEN 2 ELSE length(s) % 3 - 1 END AS rating FROM st0),
 st2 AS (SELECT *, CASE WHEN n % 14 = 0 THEN 0 ELSE rating END AS twin FROM st1),
 st3 AS (SELECT *, CASE WHEN is_open AND n % 29 = 0 THEN 'human_completion_requires_separate_policy'
   WHEN is_open AND (rating = 2 OR twin = 2) THEN 'missing_or_invalid_rating' WHEN is_open AND rating <> twin THEN 'conflicting_duplicate_ratings'
   WHEN is_open AND (n % 41 = 0 OR n % 35 = 0) THEN 'flagged_duplicate_step' WHEN NOT is_open AND n % 31 = 0 THEN 'invalid_completion_index'
   WHEN NOT is_open AND n % 43 = 0 THEN 'selected_path_differs_from_generated' WHEN rating = 2 THEN 'missing_or_invalid_rating'
   WHEN n % 41 = 0 THEN 'flagged_step' WHEN NOT regexp_matches(s, '\S') THEN 'empty_step' END AS reason FROM st2),
 st4 AS (SELECT doc_id, arg_min(reason, pos) FILTER (reason IS NOT NULL) AS step_reason, min(pos) FILTER (rating = -1) AS first_error, max(pos) AS n, bool_and(rating = 0) AS all_neutral FROM st3 GROUP BY 1),
 classified AS (SELECT doc_id, text, CASE WHEN doc_id % 23 = 0 THEN 'quality_control_or_screening' WHEN doc_id % 47 = 0 OR NOT regexp_matches(text, '\S') THEN 'empty_problem'
   WHEN doc_id % 17 = 0 THEN 'unfinished_or_bad_problem' WHEN doc_id % 53 = 0 THEN 'not_phase2' WHEN step_reason IS NOT NULL THEN step_reason
   WHEN doc_id % 19 <> 0 AND fe > 0 AND fe <= tr3.n AND first_error IS DISTINCT FROM st4.n THEN 'error_not_at_labeled_endpoint'
   WHEN NOT (doc_id % 19 <> 0 AND fe > 0 AND fe <= tr3.n) AND first_error IS NOT NULL THEN 'solution_contains_error' WHEN all_neutral THEN 'no_binary_supervision' END AS reason,
  first_error, st4.n AS n_steps, len(all_steps) - st4.n AS tail, doc_id % 19 <> 0 AND fe > 0 AND fe <= tr3.n AS ends_wrong FROM tr3 JOIN st4 USING (doc_id)),
 eligible AS (SELECT *, sha256(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS problem_id FROM classified WHERE reason IS NULL)"""


def classified(spark, d):
    return traces.classify(traces.parse_traces(trace_lines(spark, d)))


def staged_from_lines(spark, d):
    rows = traces.stage(classified(spark, d), F.col("doc_id").cast("string"), "r1", "documents", "driver", unicode_form=False)
    return rows.withColumn("doc_id", F.col("id").cast("bigint"))


@query("p14_exclusion_reasons", f"WITH {TRACE} SELECT doc_id, coalesce(reason, 'eligible') AS reason FROM classified")
def p14(spark, d):
    return classified(spark, d).select("doc_id", F.coalesce("reason", F.lit("eligible")).alias("reason"))


@query("p15_exclusion_counts", f"WITH {TRACE} SELECT reason, count(*) AS n_rows FROM classified WHERE reason IS NOT NULL GROUP BY 1")
def p15(spark, d):
    return traces.exclusion_counts(classified(spark, d))


@query("c01_trace_ingestion", f"""WITH {TRACE} SELECT doc_id, problem_id, CASE WHEN first_error IS NULL THEN 'correct' ELSE 'incorrect' END AS variant, n_steps::INT AS n_steps, first_error::INT AS first_error_step, tail::INT AS tail_steps, (doc_id % 4) AS generation FROM eligible""")
def c01(spark, d):
    return staged_from_lines(spark, d).select("doc_id", "problem_id", "variant", F.size("steps").alias("n_steps"), "first_error_step",
                                              F.col("source_metadata.unlabeled_tail_steps").alias("tail_steps"), F.col("source_metadata.generation").alias("generation"))


@query("c01_ranked_split", f"""WITH {TRACE}, k AS (SELECT problem_id, row_number() OVER (ORDER BY sha256('{SEED}:' || problem_id)) AS rank FROM (SELECT DISTINCT problem_id FROM eligible))
SELECT doc_id, CASE WHEN rank <= greatest(1, least(29, round_even(30 * 0.2, 0))) THEN 'dev' ELSE 'train' END AS split FROM eligible JOIN k USING (problem_id) WHERE rank <= 30""")
def c01b(spark, d):
    from evalspark.operators.sampling import ranked_group_sample
    rows = staged_from_lines(spark, d).select("doc_id", "problem_id")
    return rows.join(ranked_group_sample(rows, "problem_id", 30, SEED, 0.2).select("problem_id", "split"), "problem_id").select("doc_id", "split")


# Equal lines have one row id; the first line stays.
@query("c02_group_sample", f"""WITH {TRACE}, u AS (SELECT * FROM eligible QUALIFY row_number() OVER (PARTITION BY text, doc_id % 4, ends_wrong ORDER BY doc_id) = 1), s AS (SELECT problem_id FROM (SELECT DISTINCT problem_id FROM u) ORDER BY sha256('{SEED}:reservoir:' || problem_id) LIMIT 50)
SELECT doc_id, problem_id, {SPLIT} AS split, n_steps::INT AS n_steps FROM u WHERE problem_id IN (SELECT problem_id FROM s)""")
def c02(spark, d):
    lines = trace_lines(spark, d)
    out = traces.sample_groups(lines.drop("doc_id"), 50, SEED, 0.2, "r1", "documents", unicode_form=False)
    return out["staged"].select((F.col("source_metadata.line") - 1).alias("doc_id"), "problem_id", "split", F.size("steps").alias("n_steps"))


@query("p13_staged_validator", f"""WITH {TRAJ} SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'step_alignment' WHEN 1 THEN 'newline_alignment' WHEN 2 THEN 'label_mapping' WHEN 3 THEN 'neutral_mask' WHEN 4 THEN 'first_error_alignment' WHEN 5 THEN 'problem_grouping' END AS problem
 FROM traj""")
def p13(spark, d):
    k = F.col("doc_id") % 7
    rows = trajectories(spark, d).withColumn("problem", F.col("text")).withColumn("pair_id", F.when(k == 5, "x").otherwise(group_key(F.col("text"), False)))
    rows = rows.withColumn("response", F.concat(steps_to_text(F.col("steps")), F.when(k == 1, "\nmore").otherwise(""))) \
        .withColumn("step_labels", F.when(k == 2, F.transform("step_labels", lambda _: F.lit(7))).otherwise(F.col("step_labels"))) \
        .withColumn("supervision_mask", F.when(k == 0, F.concat("supervision_mask", F.array(F.lit(1)))).when(k == 3, F.transform("supervision_mask", lambda m: m + 1)).otherwise(F.col("supervision_mask"))) \
        .withColumn("first_error_step", F.when(k == 4, F.lit(999)).otherwise(F.col("first_error_step")))
    return rows.select("doc_id", checks.staged_problem(unicode_form=False).alias("problem"))


@query("a12_coverage_manifest", f"""WITH {TRAJ}, g AS (SELECT 'variant' AS dimension, split, variant AS bin FROM traj UNION ALL SELECT 'generation', 'all', generation::VARCHAR FROM traj UNION ALL SELECT 'length', 'all', n::VARCHAR FROM traj
  UNION ALL SELECT 'first_error', 'all', coalesce(first_error::VARCHAR, 'None') FROM traj) SELECT dimension, split, bin, count(*) AS n FROM g GROUP BY ALL""")
def a12(spark, d):
    return A.coverage_manifest(trajectories(spark, d))


@query("a12_rating_counts", f"WITH {TRAJ}, u AS (SELECT unnest(ratings) AS rating FROM traj) SELECT rating, count(*) AS n FROM u GROUP BY 1")
def a12b(spark, d):
    return A.rating_counts(trajectories(spark, d))


@query("a13_supervision_summary", f"""WITH {TRAJ}, r AS (SELECT split, n, len(list_filter(ratings, lambda r: r <> 0)) AS s, len(list_filter(ratings, lambda r: r = 1)) AS p, len(list_filter(ratings, lambda r: r = -1)) AS q, first_error FROM traj),
 a AS (SELECT * FROM r UNION ALL SELECT 'all', n, s, p, q, first_error FROM r)
SELECT split, sum(n)::BIGINT AS steps, sum(s)::BIGINT AS supervised_steps, sum(n - s)::BIGINT AS neutral_masked_steps, sum(p)::BIGINT AS targets_1, sum(q)::BIGINT AS targets_0, count(first_error) AS has_negative, count(*) - count(first_error) AS no_negative, count(*) AS trajectories FROM a GROUP BY 1""")
def a13(spark, d):
    return A.supervision_summary(trajectories(spark, d))


@query("a13_distributions", f"""WITH {TRAJ}, r AS (SELECT split, 'step_count' AS distribution, n::INT AS bin FROM traj UNION ALL SELECT split, 'first_negative', first_error::INT FROM traj WHERE first_error IS NOT NULL), a AS (SELECT * FROM r UNION ALL SELECT 'all', distribution, bin FROM r)
SELECT split, distribution, bin, count(*) AS n FROM a GROUP BY ALL""")
def a13b(spark, d):
    return A.supervision_distributions(trajectories(spark, d))


# ------------------------------------------------------------------ review corpus


def staged_docs(spark, d):
    """Staged source records with a protected formula in the problem text."""
    rows = trajectories(spark, d).withColumn("problem", F.concat("text", F.lit(" costs \\[x_"), F.col("doc_id").cast("string"), F.lit("\\]")))
    key = group_key(F.col("problem"), unicode_form=False)
    return rows.select(
        F.col("doc_id").cast("string").alias("id"), key.alias("pair_id"), key.alias("problem_id"), F.lit("en").alias("language"), F.lit("driver").alias("source"),
        F.lit("english_translation_pending").alias("stage"), "variant", "problem", steps_to_text(F.col("steps")).alias("response"), "steps", "source_step_ratings",
        "step_labels", "supervision_mask", "first_error_step", F.lit(None).cast("string").alias("error_type"), "split")


def queue_docs(spark, d):
    """A queue over every trajectory with supervision (the coverage choice is w12)."""
    staged = staged_docs(spark, d)
    queue = staged.select(F.struct(*[c for c in staged.columns if c != "split"]).alias("source_record"), "split")
    return queue.withColumn("source_record_sha256", canonical_digest(queue, "source_record"))


def drafted(spark, d, faults=True):
    """Translations, with planted faults on request; status as the draft step would set it."""
    q = queue_docs(spark, d)
    i = F.col("source_record.id").cast("bigint")
    def arabic(x):
        return F.concat(F.lit("ترجمة "), x)
    if not faults:
        i = F.lit(1)
    problem = F.when(i % 29 == 0, arabic(F.replace("source_record.problem", F.lit("\\[x_"), F.lit("\\[y_")))).when(i % 31 == 0, arabic(F.concat("source_record.problem", F.lit(" 7")))) \
        .when(i % 37 == 0, F.col("source_record.problem")).otherwise(arabic(F.col("source_record.problem")))
    steps = F.when(i % 41 == 0, F.slice("source_record.steps", 2, F.size("source_record.steps"))).otherwise(F.transform("source_record.steps", arabic))
    return q.withColumn("translation", F.struct(F.lit("ar").alias("target_language"), F.when(i % 43 == 0, "pending").otherwise("draft_automated_checks_passed").alias("status"),
                                                problem.alias("problem"), steps.alias("steps"), F.lit("").alias("review_notes")))


def decided(queue, faults=True):
    i = F.col("source_record.id").cast("bigint")
    rows = queue.select(
        F.col("source_record.id").alias("id"), F.lit(True).alias("human_review"), F.lit(" reviewer one ").alias("reviewer"),
        (F.when(i % 11 == 0, "reject").when(i % 13 == 0, "revise") if faults else F.when(i % 11 == 0, "reject")).otherwise("accept").alias("decision"),
        (F.when(i % 17 == 0, "2026-13-01") if faults else F.when(F.lit(False), "")).otherwise("2026-05-01").alias("reviewed_on"),
        (F.when(i % 19 == 0, F.lit(None).cast("string")).when(i % 22 == 0, "") if faults else F.when(F.lit(False), "")).otherwise("looked at").alias("notes"))
    bound = review.queue_digest(queue).select(F.col("table_sha256"))
    return rows.withColumn("review_queue_sha256", bound.scalar())


@query("c07_review_gate", f"""WITH {TRAJ}, q AS (SELECT doc_id AS i, split, text, steps FROM traj), g AS (SELECT i, CASE WHEN i % 11 = 0 THEN 'reject' WHEN i % 13 = 0 THEN 'revise' ELSE 'accept' END AS decision,
  CASE WHEN i % 19 = 0 THEN NULL WHEN i % 22 = 0 THEN '' ELSE 'looked at' END AS notes, i % 17 = 0 AS bad_date, split, len(list_filter(steps, lambda s: NOT regexp_matches(s, '\\S'))) AS blank, text FROM q)
SELECT i::VARCHAR AS id, decision, CASE WHEN decision = 'revise' THEN 'undecided' WHEN bad_date THEN 'bad_review_date' WHEN notes IS NULL THEN 'notes_missing' WHEN decision = 'reject' AND notes = '' THEN 'reject_without_reason'
  WHEN decision = 'accept' AND i IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'accepted_but_quarantined' WHEN decision = 'accept' AND i % 43 = 0 THEN 'draft_checks_not_passed' WHEN decision = 'accept' AND i % 41 = 0 THEN 'incomplete_steps'
  WHEN decision = 'accept' AND i % 29 = 0 THEN 'protected_spans_changed' WHEN decision = 'accept' AND i % 31 = 0 THEN 'numeric_sequence_changed' WHEN decision = 'accept' AND i % 37 = 0 THEN 'no_arabic_text' END AS blocked FROM g""")
def c07(spark, d):
    q = drafted(spark, d)
    barred = table(spark, d, "labels", ["doc_id", "toxic"]).where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    return review.gate(q, decided(q), barred).select(F.col("source_record.id").alias("id"), "decision", "blocked")


@query("c07_accepted_rows", f"""WITH {TRAJ} SELECT doc_id::VARCHAR AS id, 'ar' AS language, 'human_qc_accepted' AS stage, len(steps)::INT AS n_steps, array_to_string(list_transform(steps, lambda s: 'ترجمة ' || s), chr(10)) AS response, split, 'reviewer one' AS reviewer
 FROM traj WHERE doc_id % 11 <> 0""")
def c07b(spark, d):
    q = drafted(spark, d, faults=False)
    none = spark.createDataFrame([], "id STRING")
    gated = review.gate(q, decided(q, faults=False), none)
    return review.accepted_rows(gated).select("id", "language", "stage", F.size("steps").alias("n_steps"), "response", "split", F.col("qc.reviewer").alias("reviewer"))


@query("c03_work_queue")
def c03(spark, d):
    from evalspark.operators.sampling import threshold_split
    staged = staged_docs(spark, d).withColumn("split", threshold_split(F.col("problem_id"), SEED, 0.2))
    used = table(spark, d, "documents", ["doc_id", "lang"]).where("lang = 'fr'").select(F.col("doc_id").cast("string").alias("id"))
    return review.build_queue(staged, {"train": 8, "dev": 4}, SEED, used, max_steps=40).select(
        F.col("source_record.id").alias("id"), "split", F.col("source_record.variant").alias("variant"), "source_record_sha256")


@query("c03_queue_choice", f"""{greedy_sql("n <= 40 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')", 4, 2)}, chosen AS ({CHOICE})
SELECT id, chosen.split, chosen.variant, 'pending' AS status, 'pending' AS qc_status, false AS training_eligible, n::INT AS n_steps FROM chosen JOIN traj ON doc_id::VARCHAR = id""")
def c03b(spark, d):
    """The queue with the splits of its source: excluded records and long ones are never chosen."""
    used = table(spark, d, "documents", ["doc_id", "lang"]).where("lang = 'fr'").select(F.col("doc_id").cast("string").alias("id"))
    queue = review.build_queue(staged_docs(spark, d), {"train": 8, "dev": 4}, SEED, used, max_steps=40)
    return queue.select(F.col("source_record.id").alias("id"), "split", F.col("source_record.variant").alias("variant"), F.col("translation.status").alias("status"),
                        F.col("qc.status").alias("qc_status"), "training_eligible", F.size("translation.steps").alias("n_steps"))


@query("c04_source_lock", f"""WITH {TRAJ} SELECT split, doc_id::VARCHAR AS id, (row_number() OVER (PARTITION BY split ORDER BY doc_id::VARCHAR) - 1)::INT AS index FROM traj""")
def c04(spark, d):
    return review.freeze(queue_docs(spark, d)).select("split", "id", "index")


def draft_payload(spark, d):
    """Drafts in placeholder form keyed by (split, index), with planted faults, and the lock they answer to."""
    queue = drafted(spark, d).drop("translation").withColumn("translation", F.struct(F.lit("ar").alias("target_language"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("problem"),
                                                                                  F.lit(None).cast("array<string>").alias("steps"), F.lit(None).cast("string").alias("review_notes")))
    lock = review.freeze(queue)
    i = F.col("source_record.id").cast("bigint")
    texts = queue.select(F.col("source_record.id").alias("id"), F.concat(F.lit("ترجمة "), F.when(i % 6 == 1, F.replace(to_template(F.col("source_record.problem")), F.lit("<M0>"), F.lit("")))
                                                                         .otherwise(to_template(F.col("source_record.problem")))).alias("problem"),
                         F.transform("source_record.steps", lambda s: F.concat(F.lit("ترجمة "), to_template(s))).alias("_s"), i.alias("i"))
    drafts = texts.withColumn("steps", F.when(F.col("i") % 6 == 2, F.concat("_s", F.array(F.lit("ترجمة")))).otherwise(F.col("_s"))) \
        .join(lock.select("split", "index", "id"), "id").select("split", "index", "problem", "steps", F.lit("n").alias("review_notes"))
    return queue, lock, drafts


@query("c04_materialized_drafts", f"""WITH {TRAJ} SELECT doc_id::VARCHAR AS id, CASE doc_id % 6 WHEN 1 THEN 'protected_tokens_mismatch' WHEN 2 THEN 'step_count_changed' END AS draft_problem,
 CASE WHEN doc_id % 6 IN (1, 2) THEN 'pending' ELSE 'draft_automated_checks_passed' END AS status, CASE WHEN doc_id % 6 NOT IN (1, 2) THEN 'ترجمة ' || text || ' costs \\[x_' || doc_id || '\\]' END AS problem FROM traj""")
def c04b(spark, d):
    out = review.materialize(*draft_payload(spark, d))
    return out.select(F.col("source_record.id").alias("id"), "draft_problem", F.col("translation.status").alias("status"),
                      F.when(F.col("draft_problem").isNull(), F.col("translation.problem")).alias("problem"))


@query("c04_draft_report", f"""WITH {TRAJ} SELECT count(*) AS records, sum(len(steps) + (doc_id % 6 = 2)::INT)::BIGINT AS translated_steps, 0::BIGINT AS normalized_steps, count_if(doc_id % 6 IN (1, 2))::BIGINT AS failed_records FROM traj""")
def c04c(spark, d):
    return review.draft_report(review.materialize(*draft_payload(spark, d)))


@query("c05_review_sheet", f"""WITH {TRAJ}, u AS (SELECT doc_id, split, unnest(range(0, len(steps) + 1)) AS step, text, steps, ratings FROM traj)
SELECT doc_id::VARCHAR AS id, split, step::INT AS step, CASE WHEN step = 0 THEN text || ' costs \\[x_' || doc_id || '\\]' ELSE steps[step] END AS source_text, CASE WHEN step > 0 THEN 'ترجمة ' || steps[step] ELSE 'ترجمة ' || text || ' costs \\[x_' || doc_id || '\\]' END AS draft_text, CASE WHEN step > 0 THEN ratings[step] END AS rating FROM u""")
def c05(spark, d):
    return review.review_sheet(drafted(spark, d, faults=False)).drop("review_notes")


@query("c06_decision_template", f"""WITH {TRAJ} SELECT row_number() OVER (ORDER BY doc_id::VARCHAR) AS record_number, doc_id::VARCHAR AS id, split, false AS human_review, 'pending' AS decision, '' AS notes FROM traj""")
def c06(spark, d):
    return review.decision_template(queue_docs(spark, d)).select(F.col("record_number").cast("bigint").alias("record_number"), "id", "split", "human_review", "decision", "notes")


@query("table_digest", """WITH h AS (SELECT sha256(doc_id || ':' || text) AS h FROM documents)
SELECT count(*) AS n_rows, sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT) || ':' || sum(('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT) || ':' || sum(('0x' || substr(h, 33, 16))::UBIGINT::HUGEINT) || ':' || sum(('0x' || substr(h, 49, 16))::UBIGINT::HUGEINT)) AS table_sha256 FROM h""")
def tdigest(spark, d):
    rows = table(spark, d, "documents", ["doc_id", "text"]).select(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "text"), 256).alias("h"))
    return rows.agg(*table_digest(F.col("h")))


def merged_docs(spark, d):
    """Two batches of accepted rows: French documents may occur in both."""
    staged = staged_docs(spark, d).select("id", "problem_id", "split", F.col("problem").alias("source_problem"), "steps", "step_labels", "supervision_mask")
    i = F.col("id").cast("bigint")
    lang = table(spark, d, "documents", ["doc_id", "lang"]).select(F.col("doc_id").cast("string").alias("id"), "lang")
    rows = staged.join(lang, "id").withColumn("qc", F.struct(F.lit("reviewer one").alias("reviewer")))
    first = rows.where(i % 2 == 0).withColumn("batch_id", F.lit("b1"))
    return first.unionByName(rows.where((i % 2 == 1) | ((F.col("lang") == "fr") & (i % 6 == 0))).withColumn("batch_id", F.lit("b2"))
                             .withColumn("split", F.when(i % 6 == 0, "train").otherwise(F.col("split"))))


MERGED = f"""{TRAJ}, rows0 AS (SELECT doc_id, lang, split, n, text || ' costs \\[x_' || doc_id || '\\]' AS source_problem FROM traj),
 merged AS (SELECT doc_id::VARCHAR AS id, split, source_problem, 'b1' AS batch_id FROM rows0 WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id::VARCHAR, CASE WHEN doc_id % 6 = 0 THEN 'train' ELSE split END, source_problem, 'b2' FROM rows0 WHERE doc_id % 2 = 1 OR (lang = 'fr' AND doc_id % 6 = 0)),
 keyed AS (SELECT *, sha256(regexp_replace(regexp_replace(source_problem, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS k FROM merged)"""


@query("c08_merge_gates", f"""WITH {MERGED} SELECT id AS key, 'duplicate_id' AS problem FROM merged GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'quarantined' FROM merged WHERE id::BIGINT IN (SELECT doc_id FROM labels WHERE toxic = 1)
 UNION ALL SELECT k, 'group_leak' FROM keyed GROUP BY k HAVING min(split) <> max(split) UNION ALL SELECT k, 'text_leak' FROM keyed GROUP BY k HAVING min(split) <> max(split)""")
def c08(spark, d):
    barred = table(spark, d, "labels", ["doc_id", "toxic"]).where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    return review.merge_problems(merged_docs(spark, d), barred)


@query("c08_merge_manifest", f"""WITH {MERGED} SELECT count(*) AS accepted_records, count_if(split = 'train')::BIGINT AS train_records, count_if(split = 'dev')::BIGINT AS dev_records, count(DISTINCT k) AS source_problem_groups, count(DISTINCT k) AS normalized_source_problem_groups FROM keyed""")
def c08b(spark, d):
    return review.merge_manifest(merged_docs(spark, d))


@query("c08_batch_checks", """WITH b AS (SELECT lang AS batch_id, min(source) AS lo, count(*) AS n FROM documents GROUP BY 1)
SELECT batch_id, CASE WHEN batch_id = 'fr' THEN 'missing_decisions' WHEN batch_id = 'de' THEN 'bad_expected_review_queue_sha256' ELSE 'review_queue_changed' END AS problem FROM b WHERE batch_id <> 'en'""")
def c08c(spark, d):
    langs = table(spark, d, "documents", ["lang", "source"]).groupBy(F.col("lang").alias("batch_id")).agg(F.sha2(F.min("source"), 256).alias("sha"))
    b = F.col("batch_id")
    batches = langs.select("batch_id", F.lit("out").alias("export_dir"), F.lit("queue").alias("review_queue"), F.when(b == "fr", " ").otherwise("dec").alias("decisions"),
                           F.lit(None).cast("string").alias("expected_export_manifest_sha256"), F.when(b == "de", "XYZ").when(b != "en", F.sha2("sha", 256)).otherwise(F.col("sha")).alias("expected_review_queue_sha256"),
                           F.lit(None).cast("string").alias("expected_decisions_sha256"))
    actual = langs.select("batch_id", F.col("sha").alias("export_manifest_sha256"), F.col("sha").alias("review_queue_sha256"), F.col("sha").alias("decisions_sha256"))
    return review.batch_problems(batches, actual)


@query("c09_loader_checks", f"""WITH {TRAJ}, c AS (SELECT doc_id::VARCHAR AS id, doc_id % 8 = 0 AS pending, doc_id % 9 = 1 AS other, len(list_filter(ratings, lambda r: r <> 0)) = 0 AS none, split FROM traj)
SELECT id AS key, CASE WHEN pending THEN 'not_accepted' WHEN other THEN 'qc_identity' ELSE 'no_binary_supervision' END AS problem FROM c WHERE pending OR other OR none
UNION ALL SELECT 'dev', 'split_count' FROM c WHERE split = 'dev' GROUP BY ALL HAVING count(*) <> 1""")
def c09(spark, d):
    staged = staged_docs(spark, d)
    i = F.col("id").cast("bigint")
    n_train = staged.where("split = 'train'").count()
    corpus = staged.withColumn("source_problem", F.col("problem")).withColumn("stage", F.when(i % 8 == 0, "pending").otherwise("human_qc_accepted")).withColumn("language", F.lit("ar")) \
        .withColumn("qc", F.struct(F.lit("accept").alias("decision"), F.when(i % 9 == 1, "someone else").otherwise("reviewer one").alias("reviewer")))
    return review.corpus_problems(corpus, "reviewer one", {"train": n_train, "dev": 1})


@query("c22_revision_diff", """WITH n AS (SELECT doc_id, CASE WHEN doc_id % 25 = 0 THEN lang || 'x' ELSE lang END AS lang, CASE WHEN doc_id % 40 = 0 THEN NULL ELSE source END AS source FROM documents)
SELECT d.doc_id, 'changed' AS change, 'lang' AS field, '{"v":"' || d.lang || '"}' AS old_value, '{"v":"' || n.lang || '"}' AS new_value FROM documents d JOIN n USING (doc_id) WHERE d.lang <> n.lang
UNION ALL SELECT d.doc_id, 'changed', 'source', '{"v":"' || d.source || '"}', '{}' FROM documents d JOIN n USING (doc_id) WHERE n.source IS NULL""")
def c22(spark, d):
    old = table(spark, d, "documents", ["doc_id", "lang", "source"])
    new = old.withColumn("lang", F.when(F.col("doc_id") % 25 == 0, F.concat("lang", F.lit("x"))).otherwise(F.col("lang"))).withColumn("source", F.when(F.col("doc_id") % 40 != 0, F.col("source")))
    return review.revision_diff(old, new, "doc_id", ["lang", "source"])


@query("c22_revision_summary", """SELECT count_if(doc_id % 25 <> 0 AND source <> 'src3')::BIGINT AS unchanged, count_if(doc_id % 25 = 0 AND source <> 'src3')::BIGINT AS changed, 0::BIGINT AS added, count_if(source = 'src3')::BIGINT AS removed FROM documents""")
def c22b(spark, d):
    old = table(spark, d, "documents", ["doc_id", "lang", "source"])
    new = old.where("source <> 'src3'").withColumn("lang", F.when(F.col("doc_id") % 25 == 0, F.concat("lang", F.lit("x"))).otherwise(F.col("lang")))
    return review.revision_summary(old, new, "doc_id", ["lang", "source"])


@query("c23_batch_audit", f"""WITH {TRAJ} SELECT split, count(*) AS records, sum(n)::BIGINT AS steps, sum(len(list_filter(ratings, lambda r: r <> 0)))::BIGINT AS supervised_steps, sum(n - len(list_filter(ratings, lambda r: r <> 0)))::BIGINT AS masked_steps,
 count_if(EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = traj.doc_id))::BIGINT AS prior_overlap, count_if(lang = 'fr')::BIGINT AS quarantined_selected FROM traj GROUP BY split""")
def c23(spark, d):
    rows = trajectories(spark, d).withColumn("id", F.col("doc_id"))
    prior = table(spark, d, "labels", ["doc_id"]).select(F.col("doc_id").alias("id"))
    barred = table(spark, d, "documents", ["doc_id", "lang"]).where("lang = 'fr'").select(F.col("doc_id").alias("id"))
    return review.batch_audit(rows, prior, barred)


# ------------------------------------------------------------------ pilot pairs


def pilot_records(spark, d):
    """One pair per conversation turn of a user, numbered by the event of the same rank."""
    return pilot.generate_pairs(spread(table(spark, d, "events", ["event_id"]), "event_id").select((F.col("event_id") + 1).alias("pair_number")), SEED)


KINDS = "['arithmetic', 'operation_substitution', 'operand_substitution', 'intermediate_corruption', 'unit_conversion', 'premature_conclusion', 'semantic_logical']"


def _draw(name, low, high):
    return f"({low} + ('0x' || substr(md5('{SEED}:{name}:' || i), 1, 8))::BIGINT % {high - low + 1})"


@query("c19_pilot_pairs", f"""WITH k AS (SELECT event_id + 1 AS i, {KINDS}[1 + event_id % 7] AS kind FROM events),
 o AS (SELECT *, CASE kind WHEN 'arithmetic' THEN {_draw('a', 50, 90)} WHEN 'operation_substitution' THEN {_draw('a', 6, 14)} WHEN 'operand_substitution' THEN {_draw('a', 60, 120)} WHEN 'intermediate_corruption' THEN {_draw('a', 3, 8)} WHEN 'unit_conversion' THEN {_draw('a', 2, 9)} WHEN 'premature_conclusion' THEN {_draw('a', 4, 9)} WHEN 'semantic_logical' THEN {_draw('a', 30, 60)} END AS a,
  CASE kind WHEN 'arithmetic' THEN {_draw('b', 11, 24)} WHEN 'operation_substitution' THEN {_draw('b', 5, 11)} WHEN 'operand_substitution' THEN {_draw('b', 14, 33)} WHEN 'intermediate_corruption' THEN {_draw('b', 6, 12)} WHEN 'unit_conversion' THEN {_draw('b', 5, 50)} WHEN 'premature_conclusion' THEN {_draw('b', 12, 25)} WHEN 'semantic_logical' THEN {_draw('b', 4, 13)} END AS b,
  CASE kind WHEN 'arithmetic' THEN {_draw('c', 6, 19)} WHEN 'intermediate_corruption' THEN {_draw('c', 10, 30)} WHEN 'premature_conclusion' THEN {_draw('c', 7, 20)} END AS c FROM k),
 r AS (SELECT *, printf('ar_pilot_%04d', i) AS pair, CASE kind WHEN 'arithmetic' THEN a - b + c WHEN 'operation_substitution' THEN a * b WHEN 'intermediate_corruption' THEN a * b + c WHEN 'unit_conversion' THEN a * 60 + b
   WHEN 'premature_conclusion' THEN a * b - c ELSE a - b END AS good,
  CASE kind WHEN 'arithmetic' THEN a - b + c - 3 WHEN 'operand_substitution' THEN a - b - 5 WHEN 'intermediate_corruption' THEN a * b + 4 + c WHEN 'unit_conversion' THEN a * 100 + b WHEN 'premature_conclusion' THEN a * b ELSE a + b END AS bad FROM o)
SELECT pair || '_correct' AS id, 'correct' AS variant, good::VARCHAR AS final_number, 4 AS n_steps, NULL::INT AS first_error_step, NULL AS error_type FROM r
UNION ALL SELECT pair || '_wrong', 'incorrect', bad::VARCHAR, CASE WHEN kind = 'premature_conclusion' THEN 2 ELSE 4 END,
 CASE WHEN kind IN ('arithmetic', 'operand_substitution', 'intermediate_corruption') THEN 3 ELSE 2 END, kind FROM r""")
def c19(spark, d):
    last = F.element_at(F.split("response", "\n"), -1)
    return pilot_records(spark, d).select("id", "variant", F.regexp_extract(last, r"(\d+)", 1).alias("final_number"), F.size("step_labels").alias("n_steps"), "first_error_step", "error_type")


@query("p12_pilot_violations", """WITH p AS (SELECT event_id, event_id % 9 AS k FROM events) SELECT event_id::VARCHAR AS id, unnest(CASE k WHEN 0 THEN ['language'] WHEN 1 THEN ['variant'] WHEN 2 THEN ['step_count'] WHEN 3 THEN ['label_domain', 'correct_has_zero_label'] WHEN 4 THEN ['correct_has_first_error', 'correct_has_error_type']
 WHEN 5 THEN ['incorrect_without_zero_label', 'first_error_mismatch'] WHEN 6 THEN ['valid_after_error'] WHEN 7 THEN ['unknown_error_type'] ELSE [] END) AS violation FROM p""")
def p12(spark, d):
    k = F.col("event_id") % 9
    wrong = k.isin(5, 6, 7)
    labels = F.when(k == 3, F.array(F.lit(1), F.lit(2))).when(k == 6, F.array(F.lit(0), F.lit(1))).when(k == 7, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(1), F.lit(1)))
    rows = table(spark, d, "events", ["event_id"]).select(
        F.col("event_id").cast("string").alias("id"), F.when(k == 0, "en").otherwise("ar").alias("language"), F.when(k == 1, "other").when(wrong, "incorrect").otherwise("correct").alias("variant"),
        F.when(k == 2, "one").otherwise("one\ntwo").alias("response"), labels.alias("step_labels"), F.when(k.isin(4, 6), 1).when(k == 7, 2).when(k == 5, 1).cast("int").alias("first_error_step"),
        F.when(k == 7, "odd").when(wrong | (k == 4), "arithmetic").alias("error_type"))
    return checks.pilot_violations(rows)


@query("c20_pilot_split", f"""WITH k AS (SELECT conv_id + 1 AS i, {KINDS}[1 + conv_id % 7] AS kind FROM (SELECT DISTINCT conv_id FROM conversations)), n AS (SELECT kind, count(*) AS n FROM k GROUP BY 1), t AS (SELECT sum(n) AS t FROM n), f AS (SELECT kind, floor(n * 20 / t) AS base, (n * 20) % t AS rest FROM n, t),
 q AS (SELECT kind, base + (row_number() OVER (ORDER BY rest DESC, kind) <= 20 - (SELECT sum(base) FROM f))::INT AS quota FROM f),
 r AS (SELECT i, kind, row_number() OVER (PARTITION BY kind ORDER BY sha256('{SEED}:' || printf('ar_pilot_%04d', i))) AS rk FROM k)
SELECT printf('ar_pilot_%04d', i) AS pair_id, v AS variant, CASE WHEN rk <= quota THEN 'dev' ELSE 'train' END AS split FROM r JOIN q USING (kind), (VALUES ('correct'), ('incorrect')) x(v)""")
def c20(spark, d):
    numbers = table(spark, d, "conversations", ["conv_id"]).distinct().select((F.col("conv_id") + 1).alias("pair_number"))
    return pilot.split_pairs(cut_lineage(pilot.generate_pairs(numbers, SEED)), 20, SEED).select("pair_id", "variant", "split")
