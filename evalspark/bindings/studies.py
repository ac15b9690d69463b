"""Benchmark construction, scoring and study jobs."""
from pyspark.sql import functions as F

from evalspark.bindings.base import LIMITS, RESPONSES, SCORES, SIGNS, TRAJ, WIDE, MODELS, SIDES, query, responses, responses_of, results_long, scores, scratch, shown, sql_norm, table, trajectories
from evalspark.bindings.numbers import EXA
from evalspark.bindings.pairs import J05_LEFT, matched_input
from evalspark.bindings.tables import FLAGS, flagged
from evalspark.operators import pairs as P, scores as A
from evalspark.plans import benchmark, scoring, study
from evalspark.sources import readers
from evalspark.streaming import results, running

SEED = 42
# ------------------------------------------------------------------ matched benchmark


def aligned(spark, d):
    """Two language configurations of one dataset: orders with the same answer written two ways."""
    o = table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).selectExpr("o_orderkey AS source_index", "cast(o_totalprice AS bigint) AS whole")
    return o.select(
        "source_index", F.concat(F.lit("buy "), F.col("whole").cast("string"), F.lit(" for 1,200 each")).alias("question_a"),
        F.concat(F.lit("اشتر "), F.translate(F.col("whole").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩"), F.when(F.col("source_index") % 5 == 0, " بسعر ٧").otherwise(" بسعر ١٬٢٠٠")).alias("question_b"),
        F.concat(F.lit("$"), F.col("whole").cast("string"), F.lit(".0")).alias("answer_a"),
        F.translate(F.col("whole").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩").alias("answer_b"))


ALIGNED = """al AS (SELECT o_orderkey AS source_index, floor(o_totalprice)::BIGINT::VARCHAR AS gold, o_orderkey % 5 <> 0 AS agree FROM orders)"""


@query("c10_matched_build", f"""WITH {ALIGNED}, s AS (SELECT * FROM al ORDER BY sha256('{SEED}:sample:' || source_index) LIMIT 100)
SELECT row_number() OVER (ORDER BY source_index) AS id, source_index, gold AS gold_answer, agree AS question_numbers_match, CASE WHEN agree THEN '' ELSE 'question numbers differ' END AS manual_review FROM s""")
def c10(spark, d):
    return benchmark.build(aligned(spark, d), 100, SEED).select(F.col("id").cast("bigint").alias("id"), "source_index", "gold_answer", "question_numbers_match", "manual_review")


@query("c10_matched_extension", f"""WITH {ALIGNED}, s AS (SELECT * FROM al ORDER BY sha256('{SEED}:sample:' || source_index) LIMIT 100), n AS (SELECT * FROM al WHERE source_index NOT IN (SELECT source_index FROM s) ORDER BY sha256('7:sample:' || source_index) LIMIT 100)
SELECT row_number() OVER (ORDER BY source_index) AS id, source_index, gold AS gold_answer FROM s UNION ALL SELECT row_number() OVER (ORDER BY source_index) + 100, source_index, gold FROM n""")
def c10b(spark, d):
    rows = aligned(spark, d)
    return benchmark.extend(rows, benchmark.build(rows, 100, SEED), 100, 7).select(F.col("id").cast("bigint").alias("id"), "source_index", "gold_answer")


@query("c10_answer_alignment", f"WITH {ALIGNED} SELECT source_index, gold AS answer_a, gold || '9' AS answer_b FROM al WHERE source_index % 100 = 3")
def c10c(spark, d):
    rows = aligned(spark, d).withColumn("answer_b", F.when(F.col("source_index") % 100 == 3, F.concat("answer_b", F.lit("٩"))).otherwise(F.col("answer_b")))
    return benchmark.answer_mismatches(rows)


@query("c11_cross_dataset_pairs", f"""WITH {J05_LEFT}, x AS (SELECT l.doc_id, try_cast(l.raw_id AS BIGINT) AS idx, l.answer, r.item_id FROM lefts l LEFT JOIN rights r ON try_cast(l.raw_id AS BIGINT) = r.item_id),
 y AS (SELECT doc_id FROM x WHERE item_id IS NOT NULL AND try_cast(regexp_extract_all(string_split(translate(answer, ',$', ''), '####')[-1], '-?\\d+(?:\\.\\d+)?')[-1] AS DOUBLE) = item_id ORDER BY sha256('{SEED}:sample:' || doc_id) LIMIT 50)
SELECT doc_id, row_number() OVER (ORDER BY sha256('{SEED}:sample:' || doc_id)) AS problem_id FROM y""")
def c11(spark, d):
    left, right = matched_input(spark, d)
    matched = benchmark.cross_matched(left, "raw_id", "answer", right, "item_id", "gold")
    return benchmark.clean_sample(matched, "doc_id", 50, SEED).select("doc_id", F.col("problem_id").cast("bigint").alias("problem_id"))


@query("c21_audit_overlay", """WITH a AS (SELECT item_id AS doc_id, CASE WHEN item_id % 2 = 0 THEN 'AMBIGUOUS' ELSE 'WRONG_GOLD' END AS s FROM benchmark WHERE length(text) > 150)
SELECT coalesce(s, 'OK') AS audit_status, count(*) AS n_rows FROM documents LEFT JOIN a USING (doc_id) GROUP BY 1""")
def c21(spark, d):
    audit = table(spark, d, "benchmark", ["item_id", "text"]).where("length(text) > 150").select(F.col("item_id").alias("doc_id"), F.when(F.col("item_id") % 2 == 0, "AMBIGUOUS").otherwise("WRONG_GOLD").alias("audit_status"), F.lit("see note").alias("audit_note"))
    return A.value_counts(benchmark.audit_overlay(table(spark, d, "documents", ["doc_id"]), audit, "doc_id"), "audit_status")


# ------------------------------------------------------------------ review and adjudication


@query("c14_review_sheet", f"WITH {FLAGS} SELECT problem_id, language, is_correct, NULL::INT AS manual_correct, '' AS review_note, '' AS error_type FROM scored WHERE needs_manual_review = 1")
def c14(spark, d):
    return scoring.review_sheet(flagged(spark, d), ["problem_id", "language", "is_correct"])


POLICIES = ("corrections", "whitelist", "flagged_wrong", "semantic")
DEC = f"{FLAGS}, dec AS (SELECT problem_id, language, (o_custkey % 2)::INT AS manual FROM scored WHERE status = 'error'), j AS (SELECT s.*, manual FROM scored s LEFT JOIN dec USING (problem_id, language))"
FINAL = {"corrections": "coalesce(manual, is_correct)", "whitelist": "CASE WHEN needs_manual_review = 1 THEN coalesce(manual, 0) ELSE is_correct END",
         "flagged_wrong": "CASE WHEN needs_manual_review = 1 THEN 0 ELSE is_correct END", "semantic": "coalesce(manual, CASE WHEN needs_manual_review = 1 THEN 0 ELSE is_correct END)"}


def decisions(spark, d):
    return flagged(spark, d).where("status = 'error'").select("problem_id", "language", (F.col("o_custkey") % 2).cast("int").alias("manual_correct"))


@query("c15_adjudication_policies", f"WITH {DEC} SELECT problem_id, language, " + ", ".join(f"({FINAL[p]})::INT AS {p}" for p in POLICIES) + " FROM j")
def c15(spark, d):
    rows, dec = flagged(spark, d), decisions(spark, d)
    out = None
    for p in POLICIES:
        part = scoring.adjudicate(rows, dec, ["problem_id", "language"], p).select("problem_id", "language", F.col("final_correct").alias(p))
        out = part if out is None else out.join(part, ["problem_id", "language"])
    return out


@query("c15_model_summary", f"""WITH {DEC}, f AS (SELECT problem_id, language, {FINAL['semantic']} AS c FROM j), p AS (SELECT problem_id, max(c) FILTER (language = 'arabic') AS a, max(c) FILTER (language = 'english') AS b FROM f GROUP BY 1)
SELECT count(*) AS n, round(avg(a),6) AS accuracy_a, round(avg(b),6) AS accuracy_b, round(avg(b-a),6) AS gap, count_if(a=0 AND b=1)::BIGINT AS b_only, count_if(a=1 AND b=0)::BIGINT AS a_only FROM p WHERE a IS NOT NULL AND b IS NOT NULL""")
def c15b(spark, d):
    out = scoring.model_study(flagged(spark, d), decisions(spark, d), "problem_id", "language", SIDES, "semantic", 1000, SEED)
    return shown(out["summary"].select("n", "accuracy_a", "accuracy_b", "gap", "b_only", "a_only"))


@query("c16_cross_model_gaps", f"WITH {WIDE} SELECT round(avg(gap_1),6) AS gap_first, round(avg(gap_2),6) AS gap_second, round(avg(gap_difference),6) AS gap_difference FROM wide")
def c16b(spark, d):
    return shown(study.cross_model_study(results_long(spark, d), "problem_id", "model", "language", "is_correct", MODELS, SIDES, 100, 100, SEED)["gaps"])


@query("c16_cross_model_difference", f"""WITH RECURSIVE {WIDE}, vals AS (SELECT 0 AS g, gap_difference::BIGINT AS a, count(*) AS c FROM wide GROUP BY ALL), {LIMITS},
 sizes AS (SELECT 0 AS g, abs(gap_difference)::BIGINT AS a, count(*) AS c FROM wide WHERE gap_difference <> 0 GROUP BY ALL), seen AS (SELECT 0 AS g, sum(gap_difference)::BIGINT AS x FROM wide), {SIGNS}
SELECT n, x::DOUBLE AS observed_sum, round(x / n, 6) AS observed, round(ci_low,6) AS ci_low, round(ci_high,6) AS ci_high, round(sign_p,6) + 0.0 AS sign_flip_p FROM limits, seen, signs""")
def c16c(spark, d):
    return shown(study.cross_model_study(results_long(spark, d), "problem_id", "model", "language", "is_correct", MODELS, SIDES, 10_000, 100_000, SEED)["exact"].drop("log10_p"))


# ------------------------------------------------------------------ score studies


@query("c17_discrimination_gaps", f"""WITH {SCORES}, g AS (SELECT problem_id, avg(score) FILTER (event_id%2=0 AND category='click') - avg(score) FILTER (event_id%2=0 AND category<>'click') AS a, avg(score) FILTER (event_id%2=1 AND category='click') - avg(score) FILTER (event_id%2=1 AND category<>'click') AS b FROM scores GROUP BY 1),
 p AS (SELECT a, b, b-a AS d FROM g WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT count(*) AS n_pairs, round(avg(b),6) AS mean_a, round(avg(a),6) AS mean_b, round(avg(d),6) AS mean_difference, round(avg(d)/(stddev_samp(d)/sqrt(count(*))),6) AS paired_t, round(avg(d)/stddev_samp(d),6) AS cohens_dz FROM p""")
def c17(spark, d):
    rows = scores(spark, d).withColumn("language", F.when(F.col("event_id") % 2 == 0, "arabic").otherwise("english"))
    out = study.discrimination_study(rows, "problem_id", "category", "score", "click", "language", SIDES)
    return shown(out["t"].select("n_pairs", "mean_a", "mean_b", "mean_difference", "paired_t", "cohens_dz"))


@query("c17_side_auc", f"""WITH {SCORES}, r AS (SELECT event_id % 2 AS side, label, rank() OVER (PARTITION BY event_id % 2 ORDER BY score) + (count(*) OVER (PARTITION BY event_id % 2, score) - 1) / 2.0 AS rk FROM scores),
 s AS (SELECT side, sum(label)::BIGINT AS np, sum(1-label)::BIGINT AS nq, sum(rk) FILTER (label = 1) AS rs FROM r GROUP BY 1) SELECT CASE WHEN side = 0 THEN 'arabic' ELSE 'english' END AS language, np AS n_positive, nq AS n_negative, round((rs - np*(np+1)/2)/(np*nq), 6) AS auc FROM s""")
def c17b(spark, d):
    rows = scores(spark, d).withColumn("language", F.when(F.col("event_id") % 2 == 0, "arabic").otherwise("english"))
    out = study.discrimination_study(rows, "problem_id", "category", "score", "click", "language", SIDES)
    return shown(out["auc_a"].withColumn("language", F.lit("arabic")).unionByName(out["auc_b"].withColumn("language", F.lit("english"))).select("language", "n_positive", "n_negative", "auc"))


# Step probabilities from step lengths; labels from ratings.
STEPS = f"""{TRAJ}, pr AS (SELECT doc_id, variant, unnest(ratings) AS r, 1/(1+exp(-((length(unnest(steps)) % 13) - 6)::DOUBLE/3)) AS p FROM traj)"""


def step_records(spark, d):
    probs = F.transform("steps", lambda s: 1 / (1 + F.exp(-((F.length(s) % 13) - 6).cast("double") / 3)))
    return trajectories(spark, d).withColumn("step_probs", probs).withColumn("trajectory_score", F.array_min("step_probs"))


@query("a09_step_metrics", f"""WITH {STEPS} SELECT count(*) AS n_steps, round(avg(((p >= 0.5) = (r = 1))::INT),6) AS step_accuracy, round(avg(p) FILTER (r = 1),6) AS mean_valid, round(avg(p) FILTER (r = -1),6) AS mean_invalid,
 round(avg(p) FILTER (r = 1) - avg(p) FILTER (r = -1),6) AS step_discrimination FROM pr WHERE r <> 0""")
def a09(spark, d):
    return shown(A.step_metrics(step_records(spark, d), "step_probs", "step_labels"))


@query("a09_trajectory_gap", f"""WITH {STEPS}, t AS (SELECT doc_id, variant, min(p) AS s FROM pr GROUP BY ALL) SELECT round(avg(s) FILTER (variant='correct'),6) AS mean_correct, round(avg(s) FILTER (variant='incorrect'),6) AS mean_incorrect,
 round(avg(s) FILTER (variant='correct') - avg(s) FILTER (variant='incorrect'),6) AS trajectory_gap FROM t""")
def a09b(spark, d):
    return shown(A.trajectory_gap(step_records(spark, d), "variant", "trajectory_score"))


@query("a10_metric_deltas", f"""WITH {STEPS}, m AS (SELECT (doc_id % 5 = 0)::INT AS h, avg(p) FILTER (r = 1) AS v, avg(p) FILTER (r = -1) AS i FROM pr WHERE r <> 0 GROUP BY 1), x AS (SELECT 'mean_valid' AS metric, max(v) FILTER (h=0) AS baseline, max(v) FILTER (h=1) AS current FROM m UNION ALL SELECT 'mean_invalid', max(i) FILTER (h=0), max(i) FILTER (h=1) FROM m)
SELECT metric, round(baseline,6) AS baseline, round(current,6) AS current, round(current-baseline,6) AS difference, abs(current-baseline) < 0.02 AS within_tolerance FROM x""")
def a10(spark, d):
    rows = step_records(spark, d)
    def metrics(split):
        return A.metric_rows(A.step_metrics(rows.where(F.col("split") == split), "step_probs", "step_labels").select("mean_valid", "mean_invalid"))
    return shown(A.metric_deltas(metrics("dev"), metrics("train"), 0.02))


@query("a11_best_run", """WITH h AS (SELECT event_type, (user_id % 10)::INT AS epoch, max(value) AS metric FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY metric DESC, epoch) AS rk FROM h) SELECT event_type, epoch, round(metric,6) AS metric FROM r WHERE rk = 1""")
def a11(spark, d):
    h = table(spark, d, "events", ["event_type", "user_id", "value"]).groupBy("event_type", (F.col("user_id") % 10).cast("int").alias("epoch")).agg(F.max("value").alias("metric"))
    return shown(A.best_run(h, "metric", "epoch", ["event_type"]))


@query("a28_training_history", """WITH h AS (SELECT (user_id % 10)::INT AS epoch, avg(value) AS loss FROM events GROUP BY 1) SELECT epoch, round(loss,6) AS loss, round(loss - (SELECT h2.loss FROM h h2 WHERE h2.epoch = h.epoch - 1),6) AS loss_change, round(loss - 40.0,6) AS loss_vs_baseline FROM h""")
def a28(spark, d):
    h = table(spark, d, "events", ["user_id", "value"]).groupBy((F.col("user_id") % 10).cast("int").alias("epoch")).agg(F.avg("value").alias("loss"))
    return shown(A.history_table(h, "epoch", ["loss"], {"loss": 40.0}))


@query("c18_step_scores_from_tokens", """WITH t AS (SELECT conv_id, turn, length(text) % 2 AS flag, 1/(1+exp(-((length(text) % 13) - 6)::DOUBLE/3)) AS p FROM conversations)
SELECT conv_id, count(*)::INT AS num_steps, round(avg(p),6) AS average_score, round(min(p),6) AS minimum_score, round(max(p),6) AS maximum_score, round(arg_min(p, turn),6) AS first_step FROM t WHERE flag = 1 GROUP BY 1""")
def c18(spark, d):
    tokens = table(spark, d, "conversations", ["conv_id", "turn", "text"]).select("conv_id", "turn", (F.length("text") % 2).alias("flag"), (((F.length("text") % 13) - 6).cast("double") / 3).alias("logit"))
    out = study.with_score_summary(study.step_scores_from_tokens(tokens, "conv_id", "turn", "flag", "logit"))
    return shown(out.withColumn("first_step", F.col("step_scores")[0]).drop("step_scores"))


@query("c18_evaluation_summary", f"""WITH {STEPS}, t AS (SELECT doc_id, variant, avg(p) AS a, min(p) AS lo, max(p) AS hi FROM pr GROUP BY ALL)
SELECT variant, count(*) AS n_rows, round(avg(a),6) AS mean_average, round(avg(lo),6) AS mean_minimum, round(avg(hi),6) AS mean_maximum, (SELECT round(avg(a) FILTER (variant='correct') - avg(a) FILTER (variant<>'correct'),6) FROM t) AS gap FROM t GROUP BY 1""")
def c18b(spark, d):
    rows = study.with_score_summary(step_records(spark, d).select("doc_id", "variant", F.col("step_probs").alias("step_scores")))
    return shown(study.evaluation_summary(rows, "variant"))


@query("c18_reload_check", f"""WITH {STEPS}, s AS (SELECT count(*)::DOUBLE AS n_steps, avg(((p >= 0.5) = (r = 1))::INT) AS step_accuracy, avg(p) FILTER (r = 1) AS mean_valid, avg(p) FILTER (r = -1) AS mean_invalid,
  avg(p) FILTER (r = 1) - avg(p) FILTER (r = -1) AS step_discrimination FROM pr WHERE r <> 0), t AS (SELECT doc_id, variant, min(p) AS s FROM pr GROUP BY ALL),
 g AS (SELECT avg(s) FILTER (variant='correct') AS mean_correct, avg(s) FILTER (variant='incorrect') AS mean_incorrect, avg(s) FILTER (variant='correct') - avg(s) FILTER (variant='incorrect') AS trajectory_gap FROM t),
 m AS (UNPIVOT (SELECT * FROM s, g) ON COLUMNS(*) INTO NAME metric VALUE v)
SELECT metric, round(v + CASE metric WHEN 'step_accuracy' THEN 0.001 ELSE 0 END, 6) AS baseline, round(v, 6) AS current, round(CASE metric WHEN 'step_accuracy' THEN -0.001 ELSE 0 END, 6) + 0.0::DOUBLE AS difference, metric <> 'step_accuracy' AS within_tolerance FROM m""")
def c18c(spark, d):
    """Records stored, reloaded and evaluated again; one stored metric is off by more than the tolerance."""
    folder, records = scratch(spark, "reload"), step_records(spark, d)
    stored = A.metric_rows(A.step_metrics(records, "step_probs", "step_labels")).unionByName(A.metric_rows(A.trajectory_gap(records, "variant", "trajectory_score")))
    stored.withColumn("value", F.col("value") + F.when(F.col("metric") == "step_accuracy", 0.001).otherwise(0.0)).write.parquet(f"{folder}/metrics")
    fields = records.select("doc_id", "variant", "step_probs", "step_labels", "trajectory_score")
    fields.write.json(f"{folder}/records")
    return shown(study.reload_check(readers.read_jsonl(spark, f"{folder}/records", fields.schema), spark.read.parquet(f"{folder}/metrics")))


@query("c24_row_replacement", f"""WITH {RESPONSES}, k AS (SELECT problem_id, language, coalesce(generated_response, '') AS response FROM responses)
SELECT problem_id, language, CASE WHEN response = '' THEN 'FINAL ANSWER: 1' ELSE response END AS response FROM k""")
def c24(spark, d):
    rows = responses(spark, d).select("problem_id", "language", F.coalesce("generated_response", F.lit("")).alias("response"))
    repaired = rows.where("response = ''").select("problem_id", "language", F.lit("FINAL ANSWER: 1").alias("response"))
    return scoring.replace_rows(rows, repaired, ["problem_id", "language"], "response")


# ------------------------------------------------------------------ result log, as streams and in batch form


def stream_of(spark, d, name):
    """The table's file as a one-file stream."""
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("r01_incremental_scoring", f"""WITH {EXA}, te AS (SELECT *, {sql_norm('gold_answer')} AS gn FROM td WHERE status = 'success') SELECT problem_id, language, answer AS extracted_answer, coalesce((answer = gn)::INT, 0) AS is_correct FROM te""")
def r01(spark, d):
    folder = scratch(spark, "stream")
    results.append_scored(responses_of(stream_of(spark, d, "orders")), folder + "/rows", folder + "/progress").awaitTermination()
    return spark.read.parquet(folder + "/rows").select("problem_id", "language", "extracted_answer", "is_correct")


@query("r02_log_upsert", """WITH l AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 = 0 THEN 'success' ELSE 'error' END AS status FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (status = 'success') DESC, event_id DESC) AS rk FROM l)
SELECT user_id, event_type, event_id, status FROM r WHERE rk = 1""")
def r02_stream(spark, d):
    folder = scratch(spark, "stream")
    log = stream_of(spark, d, "events").select("user_id", "event_type", "event_id", F.col("event_id").alias("timestamp_utc"),
                                              F.when(F.col("event_id") % 3 == 0, "success").otherwise("error").alias("status"))
    results.upsert_log(log, folder + "/snapshot", folder + "/progress", ["user_id", "event_type"]).awaitTermination()
    return results.read_snapshot(spark, folder + "/snapshot").select("user_id", "event_type", "event_id", "status")


@query("r02_log_resolution", """WITH l AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 = 0 THEN 'success' ELSE 'error' END AS status FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (status = 'success') DESC, event_id DESC) AS rk, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM l)
SELECT user_id, event_type, event_id, status, n AS n_versions FROM r WHERE rk = 1""")
def r02(spark, d):
    log = table(spark, d, "events", ["user_id", "event_type", "event_id"]).withColumn("status", F.when(F.col("event_id") % 3 == 0, "success").otherwise("error"))
    return scoring.resolve_log(log, ["user_id", "event_type"], "event_id")


@query("r03_running_accuracy", """WITH l AS (SELECT user_id, event_type, event_id, value, CASE WHEN event_id % 3 = 0 THEN 'success' ELSE 'error' END AS status FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY (status = 'success') DESC, event_id DESC) AS rk FROM l)
SELECT (user_id % 7)::VARCHAR AS model, event_type AS language, sum((value > 50)::INT)::BIGINT AS n_correct, count(*) AS n_total, round(avg((value > 50)::INT),6) AS accuracy FROM r WHERE rk = 1 GROUP BY ALL""")
def r03(spark, d):
    """Accuracy over the upserted log, kept as a stream: three micro-batches, a restart after the first, keys tried again in later ones."""
    folder = scratch(spark, "running")
    events = table(spark, d, "events").select((F.col("user_id") % 7).cast("string").alias("model"), F.col("event_type").alias("language"), "user_id", "event_id",
                                              F.when(F.col("event_id") % 3 == 0, "success").otherwise("error").alias("status"), (F.col("value") > 50).cast("int").alias("is_correct"))

    def arrive(part):
        events.where(F.floor(F.col("event_id") / 7) % 3 == part).write.mode("append").parquet(f"{folder}/log")

    def go_on():
        log = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
        running.running_accuracy_stream(log, folder, ["user_id", "language", "model"], ["model", "language"], written="event_id").awaitTermination()
    arrive(0)
    go_on()
    arrive(2)
    arrive(1)
    go_on()
    return shown(running.read_running_accuracy(spark, folder).select("model", "language", "n_correct", "n_total", "accuracy"))
