"""Pairing, overlays, paired statistics on labels and documents."""
from pyspark.sql import functions as F

from evalspark.bindings.base import (
    LIMITS, LONG, MODELS, PAIRS, RESPONSES, SCENARIOS, SETS, SIDES, SIGNS, WIDE, exclusion_sets, query, responses, results_long, shown, spread, table,
)
from evalspark.operators import checks, idsets, lattice, pairs as P, resample, snapshots, stats
from evalspark.operators.ranges import attach, with_scalars
from evalspark.plans import study

COUNTS = """count(*) AS n, count_if(a=1 AND b=1)::BIGINT AS both_correct, count_if(a=0 AND b=0)::BIGINT AS both_wrong,
 count_if(a=0 AND b=1)::BIGINT AS b_only, count_if(a=1 AND b=0)::BIGINT AS a_only, count_if(a<>b)::BIGINT AS discordant,
 avg(a) AS accuracy_a, avg(b) AS accuracy_b, avg(b-a) AS gap"""
# Exact binomial tail through log-gamma: another route than the term recurrence.
MCNEMAR = """CASE WHEN b_only + a_only = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(b_only+a_only+1) - lgamma(i+1)
 - lgamma(b_only+a_only-i+1) - (b_only+a_only)*ln(2))) FROM generate_series(0, least(b_only, a_only)) t(i))) END"""


def m1_pairs(spark, d):
    return P.paired_outcomes(results_long(spark, d).where("model = 'm1'"), ["problem_id"], "language", "is_correct", *SIDES)


def all_pairs(spark, d):
    return P.paired_outcomes(results_long(spark, d), ["problem_id", "model"], "language", "is_correct", *SIDES)


def wide(spark, d):
    return P.cross_model_outcomes(results_long(spark, d), "problem_id", "model", "language", "is_correct", MODELS, SIDES)


@query("paired_comparison", f"""WITH {PAIRS}, t AS (SELECT model, {COUNTS} FROM pairs GROUP BY model)
SELECT model, n, both_correct, both_wrong, b_only, a_only, discordant, round(accuracy_a,6) AS accuracy_a, round(accuracy_b,6) AS accuracy_b,
 round(gap,6) AS gap, round(gap*100,6) AS gap_pp, round(log10(greatest({MCNEMAR}, 1e-300)),6) + 0.0 AS log10_mcnemar_p FROM t""")
def paired_comparison(spark, d):
    out = P.paired_summary(all_pairs(spark, d), ["model"])
    return shown(out.withColumn("log10_mcnemar_p", F.log10(F.greatest("mcnemar_p", F.lit(1e-300)))).drop("mcnemar_p"))


@query("j01_one_to_one_join", """SELECT l.doc_id, quality, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def j01(spark, d):
    return P.one_to_one_join(table(spark, d, "labels", ["doc_id", "quality"]), table(spark, d, "documents", ["doc_id", "lang"]), ["doc_id"])


@query("j02_language_pairing", f"WITH {PAIRS} SELECT problem_id, a AS a_correct, b AS b_correct, b-a AS b_minus_a FROM pairs WHERE model='m1'")
def j02(spark, d):
    return m1_pairs(spark, d)


@query("j03_cross_model_pairing", f"WITH {WIDE} SELECT * FROM wide")
def j03(spark, d):
    return wide(spark, d)


@query("j04_suffixed_merge", """SELECT l.doc_id, l.quality AS quality_first, r.quality AS quality_second, l.toxic FROM labels l
 JOIN (SELECT doc_id, quality FROM labels) r USING (doc_id)""")
def j04(spark, d):
    labels = table(spark, d, "labels")
    return P.suffixed_join(labels, labels.select("doc_id", "quality"), ["doc_id"], ("_first", "_second"))


J05_LEFT = """lefts AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'x' || doc_id WHEN doc_id % 9 = 1 THEN (doc_id + 100000000)::VARCHAR
  WHEN doc_id % 9 = 2 THEN '-' || (doc_id + 1) ELSE (doc_id % (SELECT count(*) FROM benchmark))::VARCHAR END AS raw_id,
  CASE WHEN doc_id % 7 = 0 THEN 'none' WHEN doc_id % 7 = 1 THEN '$' || (doc_id % (SELECT count(*) FROM benchmark)) || '.0'
  ELSE 'so #### ' || ((doc_id % (SELECT count(*) FROM benchmark)) + (doc_id % 7 = 2)::INT) END AS answer FROM documents),
 rights AS (SELECT item_id, 'first 1,000 then #### ' || item_id AS answer FROM benchmark)"""


def matched_input(spark, d):
    bench = table(spark, d, "benchmark", ["item_id"])
    n = bench.agg(F.count(F.lit(1))).scalar()
    docs = table(spark, d, "documents", ["doc_id"]).withColumn("n", n)
    left = docs.selectExpr(
        "doc_id", "CASE WHEN doc_id % 9 = 0 THEN concat('x', doc_id) WHEN doc_id % 9 = 1 THEN cast(doc_id + 100000000 AS string) "
        "WHEN doc_id % 9 = 2 THEN concat('-', doc_id + 1) ELSE cast(doc_id % n AS string) END AS raw_id",
        "CASE WHEN doc_id % 7 = 0 THEN 'none' WHEN doc_id % 7 = 1 THEN concat('$', doc_id % n, '.0') "
        "ELSE concat('so #### ', doc_id % n + CASE WHEN doc_id % 7 = 2 THEN 1 ELSE 0 END) END AS answer")
    right = bench.select("item_id", F.concat(F.lit("first 1,000 then #### "), F.col("item_id").cast("string")).alias("gold"))
    return left, right


@query("j05_position_join", f"""WITH {J05_LEFT}, x AS (SELECT l.doc_id, l.raw_id, try_cast(l.raw_id AS BIGINT) AS idx, l.answer, r.answer AS gold, r.item_id
  FROM lefts l LEFT JOIN rights r ON try_cast(l.raw_id AS BIGINT) = r.item_id),
 y AS (SELECT *, try_cast(regexp_extract_all(string_split(translate(answer, ',$', ''), '####')[-1], '-?\\d+(?:\\.\\d+)?')[-1] AS DOUBLE) AS a,
  try_cast(regexp_extract_all(string_split(translate(gold, ',$', ''), '####')[-1], '-?\\d+(?:\\.\\d+)?')[-1] AS DOUBLE) AS g FROM x)
SELECT doc_id, raw_id, CASE WHEN idx IS NULL OR item_id IS NULL THEN 'unmapped' WHEN a IS NULL OR g IS NULL OR a <> g THEN 'mismatched' ELSE 'clean' END AS status,
 CASE WHEN idx IS NULL THEN 'non-integer id' WHEN item_id IS NULL THEN 'id outside range' WHEN a IS NULL OR g IS NULL THEN 'could not parse numeric answer'
  WHEN a <> g THEN 'numeric answers differ' ELSE '' END AS reason FROM y""")
def j05(spark, d):
    from evalspark.plans.benchmark import cross_matched
    left, right = matched_input(spark, d)
    return cross_matched(left, "raw_id", "answer", right, "item_id", "gold").select("doc_id", "raw_id", "status", "reason")


@query("j06_semi_join", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j06(spark, d):
    chosen = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents", ["doc_id", "source"]).join(chosen, "doc_id", "left_semi")


@query("j07_anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j07(spark, d):
    dropped = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return table(spark, d, "documents", ["doc_id", "source"]).join(dropped, "doc_id", "left_anti")


@query("j02_unpaired_keys", f"""WITH l AS (SELECT user_id, event_type AS side FROM events WHERE event_type IN ('click', 'view', 'error') AND event_id % 3 = 0), k AS (SELECT user_id, count(*) FILTER (side = 'click') AS a, count(*) FILTER (side = 'view') AS b, count(*) AS n FROM l GROUP BY 1)
SELECT CASE WHEN a > 1 OR b > 1 THEN 'repeated' WHEN a + b = 0 THEN 'neither' WHEN b = 0 THEN 'only_click' WHEN a = 0 THEN 'only_view' END AS problem, count(*) AS n_keys, sum(n)::BIGINT AS n_rows FROM k WHERE a <> 1 OR b <> 1 GROUP BY 1""")
def j02b(spark, d):
    """What pairing would refuse or leave out."""
    log = table(spark, d, "events", ["event_id", "user_id", "event_type"]).where("event_type IN ('click', 'view', 'error') AND event_id % 3 = 0")
    return P.unpaired_keys(log.withColumnRenamed("event_type", "side"), ["user_id"], "side", "click", "view")


@query("j08_work_queue", f"""WITH {RESPONSES}, plan AS (SELECT DISTINCT problem_id, l.language FROM responses, (VALUES ('english'), ('arabic')) l(language))
SELECT problem_id, language FROM plan EXCEPT SELECT problem_id, language FROM responses WHERE status = 'success'""")
def j08(spark, d):
    log = responses(spark, d)
    return P.work_queue(log.select("problem_id").distinct(), "problem_id", ["english", "arabic"], log)


@query("j08_work_queue_by_containers", f"""WITH {RESPONSES}, plan AS (SELECT DISTINCT problem_id, l.language FROM responses, (VALUES ('english'), ('arabic')) l(language))
SELECT problem_id, language FROM plan EXCEPT SELECT problem_id, language FROM responses WHERE status = 'success'""")
def j08b(spark, d):
    """The same queue from containers of ids: planned minus successful, by language."""
    log = responses(spark, d).select("problem_id", "language", "status")
    plan = log.select("problem_id", F.explode(F.array(F.lit("english"), F.lit("arabic"))).alias("language"))
    return idsets.ids_without(plan, log.where("status = 'success'"), "problem_id", ["language"]).withColumn("problem_id", F.col("problem_id").cast(log.schema["problem_id"].dataType))


DECISIONS = """decisions AS (SELECT doc_id AS problem_id, 'arabic' AS language, quality AS manual_correct FROM labels WHERE quality = 0),
 auto AS (SELECT doc_id AS problem_id, 'arabic' AS language, toxic AS is_correct, (toxic = 1 OR doc_id % 4 = 0)::INT AS flagged FROM labels
  UNION ALL SELECT doc_id, 'english', quality, (doc_id % 6 = 0)::INT FROM labels)"""


def overlay_input(spark, d):
    labels = table(spark, d, "labels")
    auto = labels.select(F.col("doc_id").alias("problem_id"), F.inline(F.array(
        F.struct(F.lit("arabic").alias("language"), F.col("toxic").alias("is_correct"), ((F.col("toxic") == 1) | (F.col("doc_id") % 4 == 0)).cast("int").alias("flagged")),
        F.struct(F.lit("english").alias("language"), F.col("quality").alias("is_correct"), (F.col("doc_id") % 6 == 0).cast("int").alias("flagged")))))
    decisions = labels.where("quality = 0").select(F.col("doc_id").alias("problem_id"), F.lit("arabic").alias("language"), F.col("quality").alias("manual_correct"))
    return auto, decisions


@query("j09_decision_overlay", f"""WITH {DECISIONS} SELECT problem_id, language, is_correct, coalesce(manual_correct, is_correct) AS final_correct,
 (manual_correct IS NOT NULL)::INT AS reviewed, coalesce((manual_correct <> is_correct)::INT, 0) AS changed FROM auto LEFT JOIN decisions USING (problem_id, language)""")
def j09(spark, d):
    auto, decisions = overlay_input(spark, d)
    return P.overlay(auto, decisions, ["problem_id", "language"], "is_correct", "manual_correct").select(
        "problem_id", "language", "is_correct", "final_correct", "reviewed", "changed")


@query("j09_unmatched_decisions", """WITH dec AS (SELECT conv_id AS doc_id FROM conversations)
SELECT doc_id, count(*) AS n_decisions, (SELECT count(*) FROM labels l WHERE l.doc_id = dec.doc_id) AS n_rows FROM dec GROUP BY doc_id
HAVING count(*) <> 1 OR n_rows <> 1""")
def j09b(spark, d):
    decisions = table(spark, d, "conversations", ["conv_id"]).select(F.col("conv_id").alias("doc_id"))
    return P.unmatched_decisions(table(spark, d, "labels"), decisions, ["doc_id"])


@query("j10_coverage_report", """WITH l AS (SELECT doc_id, count(*) AS nl FROM documents GROUP BY 1),
 r AS (SELECT doc_id + (doc_id % 10 = 0)::INT AS doc_id, count(*) AS nr FROM labels GROUP BY 1)
SELECT doc_id, CASE WHEN nr IS NULL THEN 'missing' WHEN nl IS NULL THEN 'unknown' WHEN nr > 1 THEN 'doubled' ELSE 'repeated_source' END AS problem
 FROM l FULL JOIN r USING (doc_id) WHERE nr IS NULL OR nl IS NULL OR nr > 1 OR nl > 1""")
def j10(spark, d):
    right = table(spark, d, "labels", ["doc_id"]).select((F.col("doc_id") + (F.col("doc_id") % 10 == 0).cast("int")).alias("doc_id"))
    return checks.coverage_report(table(spark, d, "documents", ["doc_id"]), right, ["doc_id"])


@query("j11_frozen_source", """SELECT doc_id, sha256(text) AS actual_digest, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '.' ELSE text END) AS locked_digest, 'changed' AS problem
 FROM documents WHERE doc_id % 10 = 0""")
def j11(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "text"])
    now = docs.select("doc_id", F.sha2("text", 256).alias("sha"))
    locked = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha"))
    return checks.changed_rows(now, locked, "doc_id", "sha")


SPACE = "regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"


@query("j12_split_leakage", f"""WITH t AS (SELECT sha256({SPACE}) AS problem_id, CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM documents)
SELECT problem_id, min(split) AS first_split, max(split) AS last_split, count(*) AS n_rows FROM t GROUP BY 1 HAVING min(split) <> max(split)""")
def j12(spark, d):
    from evalspark.functions.digests import group_key
    docs = spread(table(spark, d, "documents", ["doc_id", "text"]), "doc_id").select(
        group_key(F.col("text"), unicode_form=False).alias("problem_id"), F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train").alias("split"))
    return checks.leaking_groups(docs, "problem_id", "split")


@query("j13_repeated_across_batches", """WITH t AS (SELECT doc_id, 'b1' AS batch_id FROM labels UNION ALL SELECT doc_id, 'b2' FROM documents WHERE lang = 'fr')
SELECT doc_id, count(*) AS n_rows, min(batch_id) AS first_batch, max(batch_id) AS last_batch FROM t GROUP BY 1 HAVING count(*) > 1""")
def j13(spark, d):
    rows = table(spark, d, "labels", ["doc_id"]).withColumn("batch_id", F.lit("b1")).unionByName(
        table(spark, d, "documents", ["doc_id", "lang"]).where("lang = 'fr'").select("doc_id", F.lit("b2").alias("batch_id")))
    return checks.repeated_across_batches(rows, "doc_id", "batch_id")


@query("j14_row_differences", """WITH a AS (SELECT doc_id, quality FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels)
SELECT *, 'only_left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'only_right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def j14(spark, d):
    a = table(spark, d, "labels", ["doc_id", "quality"])
    b = a.withColumn("quality", F.when(F.col("doc_id") % 50 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return snapshots.row_differences(a, b, ["doc_id"])


@query("j15_anchor_check", """WITH now AS (SELECT doc_id, sha256(text || lang) AS h FROM documents WHERE source <> 'src7'),
 old AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 20 = 3 THEN 'xx' ELSE lang END) AS h FROM documents)
SELECT old.doc_id, CASE WHEN now.h IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM old LEFT JOIN now USING (doc_id) WHERE now.h IS DISTINCT FROM old.h""")
def j15(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "text", "lang", "source"])
    now = docs.where("source <> 'src7'").select("doc_id", F.sha2(F.concat("text", "lang"), 256).alias("h"))
    old = docs.select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 20 == 3, "xx").otherwise(F.col("lang"))), 256).alias("h"))
    return checks.changed_rows(now, old, "doc_id", "h").select("doc_id", "problem")


@query("a01_accuracy", f"WITH {LONG} SELECT model, language, sum(is_correct)::BIGINT AS n_correct, count(*) AS n_total, round(avg(is_correct),6) AS accuracy FROM long GROUP BY ALL")
def a01(spark, d):
    return shown(P.accuracy(results_long(spark, d), ["model", "language"], "is_correct"))


@query("a02_outcome_table", f"WITH {PAIRS} SELECT both_correct, both_wrong, b_only, a_only, discordant FROM (SELECT {COUNTS} FROM pairs WHERE model='m1')")
def a02(spark, d):
    return m1_pairs(spark, d).agg(*P.paired_counts()).select("both_correct", "both_wrong", "b_only", "a_only", "discordant")


@query("a03_gap", f"WITH {PAIRS} SELECT model, round(avg(b-a),6) AS gap, round(avg(b-a)*100,6) AS gap_pp FROM pairs GROUP BY model")
def a03(spark, d):
    return shown(P.paired_summary(all_pairs(spark, d), ["model"]).select("model", "gap", "gap_pp"))


@query("a17_cross_contingency", f"""WITH {WIDE} SELECT 'a' AS side, count_if(m1_a=1 AND m2_a=1)::BIGINT AS both_models, count_if(m1_a=1 AND m2_a=0)::BIGINT AS only_first,
 count_if(m1_a=0 AND m2_a=1)::BIGINT AS only_second, count_if(m1_a=0 AND m2_a=0)::BIGINT AS neither FROM wide
UNION ALL SELECT 'b', count_if(m1_b=1 AND m2_b=1)::BIGINT, count_if(m1_b=1 AND m2_b=0)::BIGINT, count_if(m1_b=0 AND m2_b=1)::BIGINT, count_if(m1_b=0 AND m2_b=0)::BIGINT FROM wide""")
def a17(spark, d):
    return P.cross_contingency(wide(spark, d))


@query("a23_review_accounting", f"""WITH {DECISIONS}, o AS (SELECT language, is_correct, flagged, coalesce(manual_correct, is_correct) AS fin, manual_correct IS NOT NULL AS rev,
  coalesce(manual_correct <> is_correct, false) AS chg FROM auto LEFT JOIN decisions USING (problem_id, language))
SELECT language, count(*) AS n_rows, count_if(flagged=1)::BIGINT AS n_flagged, count_if(rev)::BIGINT AS n_reviewed, count_if(chg)::BIGINT AS n_changed,
 count_if(is_correct=1)::BIGINT AS n_automatic_correct, count_if(fin=1)::BIGINT AS n_final_correct, count_if(rev AND fin=1)::BIGINT AS n_reviewed_correct,
 count_if(rev AND fin=0)::BIGINT AS n_reviewed_wrong FROM o GROUP BY language""")
def a23(spark, d):
    auto, decisions = overlay_input(spark, d)
    return P.review_accounting(P.overlay(auto, decisions, ["problem_id", "language"], "is_correct", "manual_correct"), ["language"], "flagged", "is_correct", "final_correct")


MATRIX = f"""WITH {PAIRS}, {SETS}, s AS (SELECT scenario, model, a, b FROM pairs, names WHERE NOT EXISTS (SELECT 1 FROM excl e WHERE e.scenario = names.scenario AND e.id = pairs.problem_id)),
 t AS (SELECT scenario, model, {COUNTS} FROM s GROUP BY ALL)"""


@query("p16_scenario_filter", f"""WITH {PAIRS}, {SETS} SELECT scenario, problem_id, b - a AS b_minus_a FROM pairs, names WHERE model = 'm1'
 AND NOT EXISTS (SELECT 1 FROM excl e WHERE e.scenario = names.scenario AND e.id = pairs.problem_id)""")
def p16(spark, d):
    excl = P.compose_exclusions(exclusion_sets(spark, d), SCENARIOS)
    return P.scenario_rows(m1_pairs(spark, d), "problem_id", list(SCENARIOS), excl).select("scenario", "problem_id", "b_minus_a")


@query("a24_scenario_matrix", f"""{MATRIX} SELECT scenario, model, n, b_only, a_only, round(accuracy_a,6) AS accuracy_a, round(accuracy_b,6) AS accuracy_b, round(gap,6) AS gap,
 round(log10(greatest({MCNEMAR}, 1e-300)),6) + 0.0 AS log10_mcnemar_p FROM t""")
def a24(spark, d):
    excl = P.compose_exclusions(exclusion_sets(spark, d), SCENARIOS)
    m = P.scenario_matrix(results_long(spark, d), "problem_id", "model", "language", "is_correct", SIDES, list(SCENARIOS), excl)
    return shown(m.withColumn("log10_mcnemar_p", F.log10(F.greatest("mcnemar_p", F.lit(1e-300)))).select("scenario", "model", "n", "b_only", "a_only", "accuracy_a", "accuracy_b", "gap", "log10_mcnemar_p"))


RECURSIVE = "WITH RECURSIVE "
KEPT = """kept AS (SELECT names.scenario, w.* FROM names, wide w WHERE NOT EXISTS (SELECT 1 FROM excl WHERE excl.scenario = names.scenario AND excl.id = w.problem_id))"""


@query("c16_robustness_matrix", f"""{MATRIX.replace("WITH " + LONG, RECURSIVE + WIDE)}, {KEPT},
 vals AS (SELECT scenario || '/' || model AS g, (b - a)::BIGINT AS a, count(*) AS c FROM s GROUP BY ALL UNION ALL SELECT scenario, gap_difference::BIGINT, count(*) FROM kept GROUP BY ALL), {LIMITS},
 sizes AS (SELECT scenario AS g, abs(gap_difference)::BIGINT AS a, count(*) AS c FROM kept WHERE gap_difference <> 0 GROUP BY ALL),
 seen AS (SELECT scenario AS g, sum(gap_difference)::BIGINT AS x FROM kept GROUP BY 1), {SIGNS}
SELECT t.scenario, t.model, t.n, round(gap,6) AS gap, round(own.ci_low,6) AS ci_low, round(own.ci_high,6) AS ci_high, x.n AS cross_n, round(seen.x / x.n,6) AS cross_gap_difference,
 round(x.ci_low,6) AS cross_ci_low, round(x.ci_high,6) AS cross_ci_high, round(sign_p,6) + 0.0 AS cross_randomisation_p
FROM t JOIN limits own ON own.g = t.scenario || '/' || t.model LEFT JOIN limits x ON x.g = t.scenario AND model = 'm2' LEFT JOIN seen ON seen.g = x.g LEFT JOIN signs ON signs.g = x.g""")
def c16(spark, d):
    excl = P.compose_exclusions(exclusion_sets(spark, d), SCENARIOS)
    m = study.robustness_matrix(results_long(spark, d), "problem_id", "model", "language", "is_correct", MODELS, SIDES, list(SCENARIOS), excl)
    return shown(m.select("scenario", "model", "n", "gap", "ci_low", "ci_high", "cross_n", "cross_gap_difference", "cross_ci_low", "cross_ci_high", "cross_randomisation_p"))


@query("p18_half_replication", f"""WITH {PAIRS} SELECT CASE WHEN problem_id <= (SELECT (min(problem_id) + max(problem_id)) // 2 FROM pairs WHERE model='m1') THEN 'first' ELSE 'second' END AS half, count(*) AS n, round(avg(a),6) AS accuracy_a,
 round(avg(b),6) AS accuracy_b, round(avg(b-a),6) AS gap FROM pairs WHERE model='m1' GROUP BY 1""")
def p18(spark, d):
    """Halves of the id range that the table has."""
    rows = m1_pairs(spark, d)
    middle = rows.agg(F.floor((F.min("problem_id") + F.max("problem_id")) / 2)).scalar()
    return shown(study.half_replication(rows, "problem_id", middle))


# Customers are the problems, nations the curated units of the exclusion lists.
@query("a27_summary_with_exclusions", """WITH ex(scenario, id) AS (SELECT 'no_' || lower(r_name), n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
 names AS (SELECT DISTINCT scenario FROM ex), s AS (SELECT scenario, avg((c_acctbal > 0)::INT) AS acc, count(*) AS n FROM customer, names
  WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.scenario = names.scenario AND ex.id = c_nationkey) GROUP BY 1)
SELECT s.scenario, n, round(acc,6) AS accuracy, (SELECT string_agg(id::VARCHAR, ',' ORDER BY id) FROM ex WHERE ex.scenario = s.scenario) AS excluded_ids,
 CASE WHEN s.scenario = 'no_asia' THEN (SELECT count(*) FROM customer) END AS cross_n FROM s""")
def a27(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ex = nations.select(F.concat(F.lit("no_"), F.lower("r_name")).alias("scenario"), F.col("n_nationkey").alias("id"))
    names = sorted(r[0] for r in ex.select("scenario").distinct().collect())  # one name per region
    cust = table(spark, d, "customer", ["c_nationkey", "c_acctbal"])
    rows = P.scenario_rows(cust, "c_nationkey", names, ex).groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("c_acctbal") > 0).cast("int")).alias("accuracy"))
    full = study.scenario_summary(rows, ex)
    return shown(P.attach_to_one(full, cust.agg(F.count(F.lit(1)).alias("cross_n")), "scenario", "no_asia"))


@query("t01_mcnemar", f"""{MATRIX} SELECT scenario, model, round(log10(greatest({MCNEMAR}, 1e-300)),6) + 0.0 AS log10_p FROM t""")
def t01(spark, d):
    excl = P.compose_exclusions(exclusion_sets(spark, d), SCENARIOS)
    rows = P.scenario_rows(all_pairs(spark, d), "problem_id", list(SCENARIOS), excl).groupBy("scenario", "model").agg(*P.paired_counts())
    return shown(rows.select("scenario", "model", F.log10(F.greatest(stats.mcnemar_p(F.col("b_only"), F.col("a_only")), F.lit(1e-300))).alias("log10_p")))


B, R, SEED = 200, 200, 42
BOOT = f"""base AS (SELECT problem_id, b - a AS v FROM pairs WHERE model = 'm1'), arr AS (SELECT list(v ORDER BY v) AS vs, count(*) AS n FROM base),
 draws AS (SELECT i AS replicate, vs[1 + ('0x' || substr(md5('{SEED}:' || i || ':' || problem_id), 1, 12))::BIGINT % n] AS v FROM base, arr, range({B}) t(i)),
 means AS (SELECT replicate, avg(v) AS mean FROM draws GROUP BY 1)"""


@query("t02_paired_bootstrap", f"""WITH {PAIRS}, {BOOT} SELECT round(quantile_cont(mean, 0.025),6) AS ci_low, round(quantile_cont(mean, 0.975),6) AS ci_high, count(*) AS n_replicates,
 (SELECT round(avg(v),6) FROM base) AS observed FROM means""")
def t02(spark, d):
    return shown(resample.paired_bootstrap(m1_pairs(spark, d), "problem_id", "b_minus_a", B, SEED, mode="hash"))


def near_normal(df, spread):
    """The interval holds the mean and is as wide as the normal one, within an eighth and two lattice steps: what any stream of draws gives. Without an interval it is false."""
    width = F.lit(2 * 1.959964) * F.col(spread)
    fine = (F.col("ci_low") <= F.col("observed")) & (F.col("observed") <= F.col("ci_high")) & (F.abs(F.col("ci_high") - F.col("ci_low") - width) <= width / 8 + 2 / F.col("n"))
    return df.withColumn("as_expected", F.coalesce(fine, F.lit(False)))


@query("t02_bootstrap_collapsed")
def t02b(spark, d):
    """Drawn limits of all pairs, with their number and whether they are what draws give; a test holds them against the exact ones."""
    rows = m1_pairs(spark, d)
    one = rows.agg(F.count("b_minus_a").alias("n"), (F.stddev_pop("b_minus_a") / F.sqrt(F.count("b_minus_a"))).alias("se"))
    return shown(near_normal(with_scalars(resample.paired_bootstrap(rows, "problem_id", "b_minus_a", 10_000, SEED), one), "se").drop("se"))


@query("t02_exact_interval", f"""WITH RECURSIVE {PAIRS}, vals AS (SELECT model AS g, (b - a)::BIGINT AS a, count(*) AS c FROM pairs GROUP BY ALL), {LIMITS}
SELECT g AS model, n, round((SELECT avg(b - a) FROM pairs WHERE model = g),6) AS observed, round(ci_low,6) AS ci_low, round(ci_high,6) AS ci_high FROM limits""")
def t02x(spark, d):
    """The interval that infinitely many draws would give."""
    return shown(lattice.bootstrap_interval(all_pairs(spark, d), "b_minus_a", by=["model"]))


@query("t02_bootstrap_by_scenario", f"""{MATRIX.replace("WITH ", "WITH RECURSIVE ", 1)}, vals AS (SELECT scenario || '/' || model AS g, (b - a)::BIGINT AS a, count(*) AS c FROM s GROUP BY ALL), {LIMITS}
SELECT scenario, model, t.n, round(gap,6) AS observed, round(ci_low,6) AS ci_low, round(ci_high,6) AS ci_high FROM t JOIN limits ON g = scenario || '/' || model""")
def t02c(spark, d):
    """Interval of every scenario and model from counts per exclusion mask (A-24, C-16)."""
    excl = P.compose_exclusions(exclusion_sets(spark, d), SCENARIOS)
    counted = P.scenario_value_counts(all_pairs(spark, d), "problem_id", "b_minus_a", list(SCENARIOS), excl, ["model"])
    return shown(lattice.interval_of_counts(counted, by=["scenario", "model"]))


@query("t05_gap_difference_by_scenario", f"""WITH RECURSIVE {WIDE}, {SETS}, {KEPT}, vals AS (SELECT scenario AS g, gap_difference::BIGINT AS a, count(*) AS c FROM kept GROUP BY ALL), {LIMITS},
 sizes AS (SELECT scenario AS g, abs(gap_difference)::BIGINT AS a, count(*) AS c FROM kept WHERE gap_difference <> 0 GROUP BY ALL),
 seen AS (SELECT scenario AS g, sum(gap_difference)::BIGINT AS x FROM kept GROUP BY 1), {SIGNS}
SELECT g AS scenario, n, x::DOUBLE AS observed_sum, round(x / n, 6) AS observed, round(ci_low,6) AS ci_low, round(ci_high,6) AS ci_high, round(sign_p,6) + 0.0 AS sign_flip_p FROM limits JOIN seen USING (g) JOIN signs USING (g)""")
def t05c(spark, d):
    """Interval and randomisation p of the cross-model row of every scenario, both exact (C-16)."""
    excl = P.compose_exclusions(exclusion_sets(spark, d), SCENARIOS)
    counted = P.scenario_value_counts(wide(spark, d), "problem_id", "gap_difference", list(SCENARIOS), excl)
    return shown(lattice.gap_difference_of_counts(counted, by=["scenario"]).drop("log10_p"))


@query("t03_percentiles", """SELECT event_type AS category, round(quantile_cont(value, 0.025),6) AS p025, round(quantile_cont(value, 0.5),6) AS p50,
 round(quantile_cont(value, 0.975),6) AS p975 FROM events GROUP BY 1""")
def t03(spark, d):
    from evalspark.bindings.base import scores
    from evalspark.operators.ranges import exact_percentiles
    return shown(exact_percentiles(scores(spark, d), "score", {"p025": 0.025, "p50": 0.5, "p975": 0.975}, ["category"]))


FLIP = f"""fl AS (SELECT problem_id, gap_difference AS v FROM wide), obs AS (SELECT sum(v) AS s, count(*) AS n FROM fl),
 flips AS (SELECT i, sum(v * CASE WHEN ('0x' || substr(md5('{SEED}:' || i || ':' || problem_id), 1, 12))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS f
  FROM fl, range({R}) t(i) WHERE v <> 0 GROUP BY 1), ext AS (SELECT count_if(abs(f) >= abs((SELECT s FROM obs)))::BIGINT AS e FROM flips)"""


@query("t04_sign_flip", f"""WITH {WIDE}, {FLIP} SELECT n, s::BIGINT AS observed_sum, round(s / n, 6) AS observed, e AS n_extreme, round((e + 1) / ({R} + 1.0), 6) AS randomisation_p FROM obs, ext""")
def t04(spark, d):
    return shown(resample.sign_flip_test(wide(spark, d), "problem_id", "gap_difference", R, SEED, mode="hash"))


@query("t04_sign_flip_collapsed")
def t04b(spark, d):
    """Drawn p; a test holds it against the exact one."""
    return shown(resample.sign_flip_test(wide(spark, d), "problem_id", "gap_difference", 100_000, SEED))


@query("t04_exact_sign_flip", f"""WITH {WIDE}, vals AS (SELECT m1_a AS g, gap_difference::BIGINT AS v FROM wide), sizes AS (SELECT g, abs(v) AS a, count(*) AS c FROM vals WHERE v <> 0 GROUP BY ALL),
 seen AS (SELECT g, sum(v)::BIGINT AS x, count(*) AS n FROM vals GROUP BY 1), {SIGNS} SELECT g AS m1_a, n, x::DOUBLE AS observed_sum, round(x / n,6) AS observed, round(sign_p, 6) + 0.0 AS sign_flip_p FROM seen JOIN signs USING (g)""")
def t04x(spark, d):
    """The p that all sign assignments give, for problems that the first model solved or not."""
    return shown(lattice.sign_flip_exact(wide(spark, d), "gap_difference", by=["m1_a"]).drop("log10_p"))


@query("t05_gap_difference", f"""WITH {WIDE}, {FLIP}, arr AS (SELECT list(v ORDER BY v) AS vs, count(*) AS n FROM fl),
 means AS (SELECT i, avg(vs[1 + ('0x' || substr(md5('{SEED}:' || i || ':' || problem_id), 1, 12))::BIGINT % n]) AS mean FROM fl, arr, range({B}) t(i) GROUP BY 1)
SELECT (SELECT round(quantile_cont(mean, 0.025),6) FROM means) AS ci_low, (SELECT round(quantile_cont(mean, 0.975),6) FROM means) AS ci_high,
 {B}::BIGINT AS n_replicates, n, s::BIGINT AS observed_sum, round(s / n, 6) AS observed, e AS n_extreme, round((e + 1) / ({R} + 1.0), 6) AS randomisation_p FROM obs, ext""")
def t05(spark, d):
    return shown(resample.gap_difference_study(wide(spark, d), "problem_id", "gap_difference", B, R, SEED, mode="hash"))
