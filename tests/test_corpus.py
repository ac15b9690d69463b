"""Traces, sampling, review gate, merge: base cases and every negative case."""
import hashlib
import json

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.digests import canonical_digest
from evalspark.operators import checks, sampling
from evalspark.plans import pilot, review, traces


def trace(ratings=(0, 1, -1), finish="found_error", problem="Compute 2 + 2", **extra):
    steps = [{"completions": [{"text": f"step {i}", "rating": r, "flagged": False}], "chosen_completion": 0, "human_completion": None} for i, r in enumerate(ratings)]
    row = {"question": {"problem": problem, "pre_generated_steps": [f"step {i}" for i in range(len(ratings))]},
           "label": {"finish_reason": finish, "steps": steps}, "generation": 9, "is_quality_control_question": False, "is_initial_screening_question": False}
    row.update(extra)
    return row


def classify(spark, rows):
    lines = [r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows]
    df = spark.createDataFrame([(x, i + 1) for i, x in enumerate(lines)], "line STRING, line_number INT")
    return traces.classify(traces.parse_traces(df)).orderBy("line_number").collect()


def changed(fn, **kw):
    row = trace(**kw)
    fn(row)
    return row


def null_choice(row, i, human=None):
    row["label"]["steps"][i].update(chosen_completion=None, human_completion=human)


def copies(row, i, *variants):
    step = row["label"]["steps"][i]
    step["completions"] = [{"text": f"step {i}", "rating": r, "flagged": f} for r, f in variants]
    null_choice(row, i)


def put(row, i, **kw):
    row["label"]["steps"][i]["completions"][0].update(kw)


REASONS = [
    (trace(is_quality_control_question=True), "quality_control_or_screening"),
    (trace(is_initial_screening_question=True), "quality_control_or_screening"),
    (trace(problem="  "), "empty_problem"), (trace(problem=7), "empty_problem"),
    (trace(finish="give_up"), "unfinished_or_bad_problem"),
    (changed(lambda r: r["question"].pop("pre_generated_steps")), "not_phase2"),
    (changed(lambda r: null_choice(r, 2, "repair")), "human_completion_requires_separate_policy"),
    (changed(lambda r: (null_choice(r, 2), put(r, 2, text="other"))), "ambiguous_original_completion"),
    (changed(lambda r: copies(r, 2, (-1, False), (True, False))), "missing_or_invalid_rating"),
    (changed(lambda r: copies(r, 2, (-1, False), (1, False))), "conflicting_duplicate_ratings"),
    (changed(lambda r: copies(r, 2, (-1, False), (-1, True))), "flagged_duplicate_step"),
    (changed(lambda r: copies(r, 2, (-1, False), (-1, False))), None),
    (changed(lambda r: null_choice(r, 2)), None),
    (changed(lambda r: r["label"]["steps"][0].update(chosen_completion=3)), "invalid_completion_index"),
    (changed(lambda r: r["label"]["steps"][0].update(chosen_completion=-1)), "invalid_completion_index"),
    (changed(lambda r: r["label"]["steps"][0].update(chosen_completion=False)), "invalid_completion_index"),
    (changed(lambda r: r["label"]["steps"][0].update(chosen_completion=0.0)), "invalid_completion_index"),
    (changed(lambda r: put(r, 0, text="different")), "selected_path_differs_from_generated"),
    (changed(lambda r: put(r, 1, rating=True)), "missing_or_invalid_rating"), (changed(lambda r: put(r, 1, rating="1")), "missing_or_invalid_rating"),
    (changed(lambda r: put(r, 1, rating=1.0)), "missing_or_invalid_rating"), (changed(lambda r: put(r, 1, rating=None)), "missing_or_invalid_rating"),
    (changed(lambda r: put(r, 1, rating=2)), "missing_or_invalid_rating"),
    (changed(lambda r: put(r, 1, flagged=True)), "flagged_step"),
    (changed(lambda r: (put(r, 1, text=" "), r["question"]["pre_generated_steps"].__setitem__(1, " "))), "empty_step"),
    (trace(ratings=()), "empty_trajectory"),
    (trace(ratings=(1, -1, 1)), "error_not_at_labeled_endpoint"), (trace(ratings=(1, 1)), "error_not_at_labeled_endpoint"),
    (trace(ratings=(1, -1), finish="solution"), "solution_contains_error"), (trace(ratings=(0, 0), finish="solution"), "no_binary_supervision"),
    (trace(), None), (trace(ratings=(1, 0, 1), finish="solution"), None),
]


def test_exclusion_reasons(spark):
    got = [r.reason for r in classify(spark, [row for row, _ in REASONS])]
    assert got == [want for _, want in REASONS]


def test_conversion(spark):
    row = trace()
    row["question"]["pre_generated_steps"].append("tail")
    row["label"]["steps"][1]["completions"][0]["text"] = row["question"]["pre_generated_steps"][1] = "two\nlines"
    df = spark.createDataFrame([(json.dumps(row), 5)], "line STRING, line_number INT")
    c = traces.classify(traces.parse_traces(df))
    r = traces.stage(c, traces.raw_row_id(F.col("line")), "rev", "file", "src").first()
    assert (r.step_labels, r.supervision_mask, r.first_error_step, r.variant) == ([None, 1, 0], [0, 1, 1], 3, "incorrect")
    assert r.response == "step 0\ntwo lines\nstep 2"
    assert r.source_metadata.unlabeled_tail_steps == 1 and r.source_metadata.line == 5
    assert r.id == "trace_" + hashlib.sha256(json.dumps(row, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert r.problem_id == hashlib.sha256(b"Compute 2 + 2").hexdigest()


def test_malformed_structure_stops(spark):
    df = spark.createDataFrame([(json.dumps({"question": {"problem": "x", "pre_generated_steps": []}}), 1), ("not json", 2), (json.dumps(trace()), 3)], "line STRING, line_number INT")
    assert {r.line_number for r in traces.malformed_traces(traces.parse_traces(df)).collect()} == {1, 2}
    with pytest.raises(ValueError, match="unexpected trace structure"):
        traces.sample_groups(df, 2, 42, 0.5, "r", "f")


def many(n, per_group=2):
    return [trace(problem=f"problem {i // per_group}", ratings=(1, 0, 1) if i % 2 else (1, -1), finish="solution" if i % 2 else "found_error", generation=i % 3) for i in range(n)]


def lines_of(spark, rows, parts=1):
    return spark.createDataFrame([(json.dumps(r), i + 1) for i, r in enumerate(rows)], "line STRING, line_number INT").repartition(parts)


def key(i):
    return hashlib.sha256(f"problem {i}".encode()).hexdigest()


def test_group_sample_matches_brute_force_and_ignores_order(spark):
    rows = many(60) + many(4)                        # four repeated lines
    out = traces.sample_groups(lines_of(spark, rows, 5), 10, 42, 0.5, "r", "f")
    want = sorted((key(i) for i in range(30)), key=lambda k: hashlib.sha256(f"42:reservoir:{k}".encode()).hexdigest())[:10]
    assert {r.problem_id for r in out["selected"].collect()} == set(want)
    got = {(r.problem_id, r.split) for r in out["staged"].collect()}
    assert got == {(k, "dev" if int(hashlib.sha256(f"42:split:{k}".encode()).hexdigest(), 16) < 0.5 * 2 ** 256 else "train") for k in want}
    assert out["staged"].count() == 20 and out["duplicates"].first()[0] == 4
    again = traces.sample_groups(lines_of(spark, rows, 2), 10, 42, 0.5, "r", "f")
    assert sorted(r.id for r in again["staged"].collect()) == sorted(r.id for r in out["staged"].collect())
    # A lock anchors groups; a prior sample must come back unchanged.
    lock = spark.createDataFrame([(key(i), "train") for i in range(3)], "problem_id STRING, split STRING")
    locked = traces.sample_groups(lines_of(spark, rows), 10, 42, 0.5, "r", "f", lock=lock)
    assert {key(0), key(1), key(2)} <= {r.problem_id for r in locked["selected"].collect()}
    assert {r.split for r in locked["staged"].where(F.col("problem_id").isin(key(0), key(1), key(2))).collect()} == {"train"}
    grown = traces.sample_groups(lines_of(spark, rows), 15, 42, 0.5, "r", "f", prior=out["staged"])
    assert set(want) <= {r.problem_id for r in grown["selected"].collect()}
    with pytest.raises(ValueError, match="missing or changed"):
        traces.sample_groups(lines_of(spark, rows), 15, 42, 0.5, "r", "f", prior=out["staged"].withColumn("problem", F.lit("x")))
    with pytest.raises(ValueError, match="fewer eligible"):
        traces.sample_groups(lines_of(spark, rows), 31, 42, 0.5, "r", "f")
    with pytest.raises(ValueError, match="budget"):
        traces.sample_groups(lines_of(spark, rows), 2, 42, 0.5, "r", "f", lock=lock)


def test_ingest_prefix_mode(spark):
    out = traces.ingest(lines_of(spark, many(20) + [trace(finish="give_up")]), 5, 42, 0.5, "r", "f")
    ranked = sorted((key(i) for i in range(10)), key=lambda k: hashlib.sha256(f"42:{k}".encode()).hexdigest())[:5]
    assert {(r.problem_id, r.split) for r in out["selected"].collect()} == {(k, "dev" if i < 2 else "train") for i, k in enumerate(ranked)}   # round(2.5) is 2
    assert out["exclusions"].collect()[0].reason == "unfinished_or_bad_problem" and out["staged"].count() == 10


def greedy(rows, count, seed):
    seen, chosen = set(), []
    for variant in ("correct", "incorrect"):
        pool = [r for r in rows if r["variant"] == variant]
        for _ in range(count // 2):
            best = min(pool, key=lambda r: (-len(set(r["labels"]) - seen), hashlib.sha256(f"{seed}:{r['id']}".encode()).hexdigest()))
            pool.remove(best)
            seen |= set(best["labels"])
            chosen.append(best["id"])
    return chosen


def test_greedy_coverage_equals_brute_force(spark):
    from evalspark.functions.steps import coverage_labels
    data = [(f"id{i}", "train", "correct" if i % 2 else "incorrect", ["s"] * (1 + i * 7 % 20), [0 if i % 5 == 0 else 1] * (1 + i * 7 % 20), None if i % 2 else 1 + i * 3 % (1 + i * 7 % 20)) for i in range(120)]
    df = spark.createDataFrame(data, "id STRING, split STRING, variant STRING, steps ARRAY<STRING>, source_step_ratings ARRAY<INT>, first_error_step INT")
    rows = [r.asDict() for r in df.withColumn("labels", coverage_labels(F.size("steps"), F.col("first_error_step"), F.col("source_step_ratings"))).collect()]
    got = [r.id for r in sampling.greedy_coverage(df.repartition(4), {"train": 12}, 7).orderBy("pick_order").collect()]
    assert got == greedy(rows, 12, 7)
    barred = df.limit(5).select("id")
    assert not {r.id for r in barred.collect()} & {r.id for r in sampling.greedy_coverage(df, {"train": 12}, 7, barred).collect()}
    assert max(len(r.steps) for r in df.join(sampling.greedy_coverage(df, {"train": 4}, 7, max_steps=6), "id").collect()) <= 6
    for bad in (3, 0):
        with pytest.raises(ValueError):
            sampling.greedy_coverage(df, {"train": bad}, 7)
    with pytest.raises(Exception, match="not enough"):
        sampling.greedy_coverage(df, {"train": 200}, 7).collect()


def test_stratified_pick_with_hot_category(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"c{i % 4}") for i in range(900)], "k INT, c STRING")
    got = sampling.stratified_pick(df.repartition(6), "k", "c", 90, 42).collect()
    by = {}
    for i in range(900):
        by.setdefault("hot" if i % 3 else f"c{i % 4}", []).append(i)
    for c, ids in by.items():
        dev = {r.k for r in got if r.c == c and r.split == "dev"}
        assert dev == set(sorted(ids, key=lambda k: hashlib.sha256(f"42:{k}".encode()).hexdigest())[:len(dev)])
    assert sum(r.split == "dev" for r in got) == 90 and len(got) == 900


# ------------------------------------------------------------------ review gate


@pytest.fixture(scope="module")
def staged(spark):
    rows = [trace(problem=f"Find $x_{i}$ of {i}", ratings=(1, 0, 1) if i % 2 else (1, -1), finish="solution" if i % 2 else "found_error") for i in range(24)]
    c = traces.classify(traces.parse_traces(lines_of(spark, rows)))
    out = traces.stage(c, traces.raw_row_id(F.col("line")), "r", "f", "s")
    return out.withColumn("split", F.when(F.col("source_metadata.line") <= 12, "train").otherwise("dev")).cache()


def build(spark, staged, excluded=None):
    queue = review.build_queue(staged, {"train": 4, "dev": 2}, 42, excluded)
    lock = review.freeze(queue)
    from evalspark.functions.spans import to_template
    drafts = queue.select(F.col("source_record.id").alias("id"), F.concat(F.lit("ترجمة "), to_template(F.col("source_record.problem"))).alias("problem"),
                          F.transform("source_record.steps", lambda s: F.concat(F.lit("خطوة "), to_template(s))).alias("steps"), F.lit("n").alias("review_notes"))
    return queue, lock, drafts.join(lock, "id").select("split", "index", "problem", "steps", "review_notes")


@pytest.fixture(scope="module")
def batch(spark, staged):
    queue, lock, drafts = build(spark, staged)
    done = review.materialize(queue, lock, drafts).drop("draft_problem", "normalized_steps").checkpoint()
    return queue.checkpoint(), lock.checkpoint(), drafts.checkpoint(), done


def decide(done, **change):
    bound = review.queue_digest(done).first().table_sha256
    base = {"review_queue_sha256": F.lit(bound), "human_review": F.lit(True), "reviewer": F.lit("R"), "decision": F.lit("accept"), "reviewed_on": F.lit("2026-01-02"), "notes": F.lit("")}
    base.update({k: v if isinstance(v, Column) else F.lit(v).cast("boolean" if k == "human_review" else "string") for k, v in change.items()})
    return done.select(F.col("source_record.id").alias("id"), *[v.alias(k) for k, v in base.items()])


@pytest.fixture(scope="module")
def nobody(spark):
    return spark.createDataFrame([], "id STRING")


def test_queue_and_draft_stage(spark, staged, batch):
    queue, lock, drafts, done = batch
    assert queue.count() == 6 and {r.split: r.n for r in queue.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 4, "dev": 2}
    ordered = [r.id for r in lock.where("split = 'train'").orderBy("index").collect()]
    assert ordered == sorted(ordered)
    assert review.materialize_problems(queue, lock, drafts).count() == 0
    assert {r.s for r in done.select(F.col("translation.status").alias("s")).collect()} == {"draft_automated_checks_passed"}
    assert review.review_sheet(done).count() == done.select(F.sum(F.size("source_record.steps") + 1)).first()[0]
    assert review.materialize_problems(queue, lock, drafts.limit(5)).first().problem == "missing"
    assert review.materialize_problems(queue, lock, drafts.unionByName(drafts.limit(1))).first().problem == "doubled"
    assert review.materialize_problems(queue, lock.withColumn("source_record_sha256", F.lit("0" * 64)), drafts).count() == 6
    bad = review.materialize(queue, lock, drafts.withColumn("problem", F.lit("ترجمة")))
    assert {r.draft_problem for r in bad.select("draft_problem").collect()} == {"protected_tokens_mismatch"}
    # An approved comparison-copy change applies to its record and step only.
    one = lock.first().id
    rules = spark.createDataFrame([(one, 1, 1, "step", "stage")], "id STRING, step INT, position INT, find STRING, repl STRING")
    assert review.materialize(queue, lock, drafts, rules).agg(F.sum("normalized_steps")).first()[0] == 1
    used = build(spark, staged, lock.select("id"))[0]
    assert used.join(lock, used.source_record.id == lock.id, "left_semi").count() == 0
    with pytest.raises(ValueError, match="not sound"):
        review.build_queue(staged.withColumn("supervision_mask", F.array(F.lit(1))), {"train": 2}, 42)
    with pytest.raises(ValueError, match="not sound"):
        review.build_queue(staged.unionByName(staged.limit(1).withColumn("split", F.lit("dev"))), {"train": 2}, 42)


@pytest.mark.parametrize("change, blocked", [
    ({"decision": "pending"}, "undecided"), ({"decision": "revise"}, "undecided"), ({"human_review": False}, "no_attestation"),
    ({"reviewer": " "}, "no_reviewer"), ({"review_queue_sha256": "0" * 64}, "other_review_queue"), ({"reviewed_on": "2026-02-30"}, "bad_review_date"),
    ({"notes": None}, "notes_missing"), ({"decision": "reject"}, "reject_without_reason")])
def test_gate_blocks(spark, batch, nobody, change, blocked):
    done = batch[3]
    got = review.gate(done, decide(done, **change), nobody)
    assert {r.blocked for r in got.select("blocked").collect()} == {blocked}
    with pytest.raises(ValueError):
        review.export(done, decide(done, **change), nobody)


def test_gate_text_quarantine_and_coverage(spark, batch, nobody):
    done = batch[3]
    def blocked(queue, decisions=None, barred=nobody):
        return {r.blocked for r in review.gate(queue, decisions or decide(queue), barred).select("blocked").collect()}
    def edited(**kw):
        return done.withColumn("translation", F.struct(*[kw.get(f, F.col(f"translation.{f}")).alias(f) for f in ("target_language", "status", "problem", "steps", "review_notes")]))
    assert blocked(done) == {None}
    assert blocked(edited(problem=F.concat("translation.problem", F.lit(" 9")))) == {"numeric_sequence_changed"}
    assert blocked(edited(problem=F.replace("translation.problem", F.lit("$x"), F.lit("$y")))) == {"protected_spans_changed"}
    assert blocked(edited(status=F.lit("pending"))) == {"draft_checks_not_passed"}
    assert blocked(edited(steps=F.slice("translation.steps", 1, 1))) == {"incomplete_steps"}
    assert blocked(done.withColumn("source_record_sha256", F.lit("0" * 64))) == {"source_record_changed"}
    assert blocked(done, barred=done.select(F.col("source_record.id").alias("id"))) == {"accepted_but_quarantined"}
    assert review.unknown_decisions(done, decide(done).limit(5)).first().problem == "missing"
    assert review.unknown_decisions(done, decide(done).unionByName(decide(done).limit(1))).first().problem == "doubled"
    catalog = spark.createDataFrame([("a", True, "r", "w", "0" * 64), ("b", False, "r", "w", "1" * 64)], "id STRING, active BOOLEAN, reason STRING, reviewer STRING, source_record_sha256 STRING")
    assert [r.id for r in review.active_quarantine(catalog).collect()] == ["a"]
    for broken in (catalog.withColumn("reason", F.lit(" ")), catalog.withColumn("source_record_sha256", F.lit("AB")), catalog.withColumn("id", F.lit("same")), catalog.withColumn("active", F.lit(None).cast("boolean")), catalog.withColumn("id", F.lit(" a"))):
        with pytest.raises(ValueError):
            review.active_quarantine(broken)


def test_export_merge_and_load(spark, staged, batch, nobody):
    done = batch[3]
    first_id = done.orderBy("source_record.id").first().source_record.id
    dec = decide(done, decision=F.when(F.col("source_record.id") == first_id, "reject").otherwise("accept"), notes=F.lit("checked"))
    out = review.export(done, dec, nobody)
    assert out["accepted"].count() == 5 and out["rejected"].count() == 1
    row = out["accepted"].first()
    assert row.language == "ar" and row.stage == "human_qc_accepted" and row.source_record_id == row.id and row.qc.decision == "accept"
    q2, lock2, drafts2 = build(spark, staged, batch[1].select("id"))
    done2 = review.materialize(q2, lock2, drafts2).drop("draft_problem", "normalized_steps").checkpoint()
    dec2 = decide(done2)
    one = {"queue": done, "decisions": dec, "exported": out["accepted"].checkpoint()}
    two = {"queue": done2, "decisions": dec2, "exported": review.export(done2, dec2, nobody)["accepted"].checkpoint()}
    merged = review.merge({"b1": one, "b2": two}, nobody)
    m = merged["manifest"].first()
    assert (m.accepted_records, m.train_records + m.dev_records, m.source_problem_groups) == (11, 11, 11)
    assert merged["registry"].count() == 11 and merged["rejected"].count() == 1
    counts = {r.split: r.n for r in merged["merged"].groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert review.corpus_problems(merged["merged"], "R", counts).count() == 0
    assert review.corpus_problems(merged["merged"], "S", counts).count() == 11
    assert review.corpus_problems(merged["merged"], "R", {**counts, "dev": 99}).first().problem == "split_count"
    with pytest.raises(ValueError, match="merge blocked"):
        review.merge({"b1": one, "b2": one}, nobody)
    tampered = {**two, "exported": two["exported"].withColumn("problem", F.concat("problem", F.lit("!")))}
    with pytest.raises(ValueError, match="stored export differs"):
        review.merge({"b1": one, "b2": tampered}, nobody)
    other = {"queue": done2, "decisions": decide(done2, reviewer=F.lit("Q"))}
    other["exported"] = review.export(done2, other["decisions"], nobody)["accepted"]
    with pytest.raises(ValueError, match="merge blocked"):
        review.merge({"b1": one, "b2": other}, nobody)
    leak = merged["merged"].withColumn("batch_id", F.lit("x"))
    leak = leak.unionByName(leak.limit(1).withColumn("id", F.lit("new")).withColumn("split", F.when(F.col("split") == "train", "dev").otherwise("train")))
    assert {r.problem for r in review.merge_problems(leak, nobody).collect()} == {"group_leak", "text_leak"}


def test_pilot_pairs(spark):
    records = pilot.generate_pairs(pilot.pair_numbers(spark, 70), 42)
    assert pilot.pair_problems(records).count() == 0
    assert records.count() == 140 and records.where("error_type IS NOT NULL").select("error_type").distinct().count() == 7
    out = pilot.split_pairs(records, 14, 42)
    assert out.where("split = 'dev'").count() == 28
    assert {r.n for r in out.where("split = 'dev' AND variant = 'incorrect'").groupBy("error_type").agg(F.count("*").alias("n")).collect()} == {2}
    assert sorted(map(str, records.collect())) == sorted(map(str, pilot.generate_pairs(pilot.pair_numbers(spark, 70).repartition(3), 42).collect()))
    with pytest.raises(ValueError, match="not valid"):
        pilot.split_pairs(records.where("variant = 'incorrect'"), 4, 42)
    lost = records.withColumn("missing_fields", F.array(F.lit("source")))
    assert checks.pilot_violations(lost).select("violation").distinct().first()[0] == "missing:source"


def test_anchor_and_digest_changes(spark, staged):
    one = staged.drop("split")
    assert traces.anchor_problems(one, staged).count() == 0
    changed_row = one.withColumn("generation_text", F.lit("x")).drop("generation_text").withColumn("source", F.lit("other"))
    assert traces.anchor_problems(changed_row, staged).count() == staged.count()
    assert staged.select(canonical_digest(one)).distinct().count() == 24
