"""Review corpus: queue, drafts, decisions, export gate, merge, audits (C-03..C-09, C-22, C-23).

Every stage is a DataFrame bound to the stage before it by digests; the human step is an input table.
Gates list offending rows; nothing is written before all gates are empty.
"""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.digests import canonical_digest, normalized_text, table_digest
from evalspark.functions.spans import apply_rules, fill_template, placed_problem, protected_spans, recheck_problem
from evalspark.functions.steps import reviewed_steps_to_text, supervision_valid
from evalspark.functions.text import is_digest, is_filled, is_iso_date
from evalspark.operators.snapshots import differing_parts
from evalspark.operators.checks import (
    CheckFailed, coverage_report, first_reason, leaking_groups, repeated_across_batches, require_empty,
    row_differences, staged_problem,
)
from evalspark.operators.ranges import text_ranks, with_scalars
from evalspark.operators.sampling import greedy_coverage
from evalspark.operators.scores import supervision_summary
from evalspark.session import computed_once, cut_lineage

RULES_TYPE = "array<struct<find:string,repl:string>>"


def check_source(staged: DataFrame, language: str = "en", stage: str = "english_translation_pending") -> DataFrame:
    """Offending staged rows of a queue source: (id, problem)."""
    invalid = staged.select("id", F.coalesce(staged_problem(), first_reason([
        (~F.coalesce((F.col("language") == language) & (F.col("stage") == stage), F.lit(False)), "not_untranslated_staging")])
    ).alias("problem")).where("problem IS NOT NULL")
    doubled = staged.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("problem"))
    leaks = leaking_groups(staged, "problem_id", "split").select(F.col("problem_id").alias("id"), F.lit("split_overlap").alias("problem"))
    return invalid.unionByName(doubled).unionByName(leaks)


def quarantine_problems(catalog: DataFrame) -> DataFrame:
    """Why a quarantine catalog cannot be trusted; a catalog with any row here must not be used."""
    fields = catalog.select("id", first_reason([
        (~is_filled(F.col("id")) | (F.col("id") != F.trim("id")), "ambiguous_id"), (F.col("active").isNull(), "active_not_boolean"),
        (~is_filled(F.col("reason")), "missing_reason"), (~is_filled(F.col("reviewer")), "missing_reviewer"),
        (~is_digest(F.col("source_record_sha256")), "bad_digest")]).alias("problem")).where("problem IS NOT NULL")
    doubled = catalog.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("problem"))
    return fields.unionByName(doubled)


def active_quarantine(catalog: DataFrame) -> DataFrame:
    require_empty(quarantine_problems(catalog), "malformed quarantine catalog")
    return catalog.where("active").select("id")


def build_queue(staged: DataFrame, counts: dict[str, int], seed: int, excluded: DataFrame | None = None,
                quarantined: DataFrame | None = None, max_steps: int | None = None, target_language: str = "ar") -> DataFrame:
    """Work queue (C-03): coverage choice, then one queue row per chosen record, digest of the source record included."""
    require_empty(check_source(staged), "queue source is not sound")
    barred = [df.select("id") for df in (excluded, quarantined) if df is not None]
    chosen = greedy_coverage(staged, counts, seed, reduce(DataFrame.unionByName, barred) if barred else None, max_steps)
    rows = staged.join(chosen.select("id"), "id", "left_semi")
    record = F.struct(*[c for c in staged.columns if c != "split"])
    queue = rows.select(record.alias("source_record"), "split")
    return queue.withColumn("source_record_sha256", canonical_digest(queue, "source_record")).withColumn(
        "translation", F.struct(
            F.lit(target_language).alias("target_language"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("problem"),
            F.transform("source_record.steps", lambda _: F.lit(None).cast("string")).alias("steps"),
            F.lit(None).cast("string").alias("review_notes"))).withColumn(
        "qc", F.struct(F.lit("pending").alias("status"), F.lit(None).cast("string").alias("reviewer"),
                       F.lit(None).cast("string").alias("decision"), F.lit(None).cast("string").alias("notes"))) \
        .withColumn("training_eligible", F.lit(False))


def queue_digest(queue: DataFrame) -> DataFrame:
    """One row (n_rows, table_sha256) that binds decisions to a queue; row order does not matter."""
    return queue.select(canonical_digest(queue).alias("_d")).agg(*table_digest(F.col("_d")))


def freeze(queue: DataFrame) -> DataFrame:
    """Source lock: (split, index, id, problem_id, source_record_sha256), index in id order per split."""
    flat = queue.select("split", F.col("source_record.id").alias("id"), F.col("source_record.problem_id").alias("problem_id"),
                        "source_record_sha256")
    return text_ranks(flat, "id", ["split"], "_r").withColumn("index", (F.col("_r") - 1).cast("int")).drop("_r")


def materialize_problems(queue: DataFrame, lock: DataFrame, drafts: DataFrame) -> DataFrame:
    """Set-level gates of the draft step: coverage of the lock, frozen digests."""
    coverage = coverage_report(lock, drafts, ["split", "index"]).select(
        F.concat_ws("/", "split", F.col("index").cast("string")).alias("key"), "problem")
    frozen = lock.join(queue.select(F.col("source_record.id").alias("id"), canonical_digest(queue, "source_record").alias("_now")), "id", "left") \
        .where(~F.col("_now").eqNullSafe(F.col("source_record_sha256"))).select(F.col("id").alias("key"), F.lit("frozen_record_changed").alias("problem"))
    return coverage.unionByName(frozen)


def _with_rules(df: DataFrame, rules: DataFrame | None, id_column: str) -> DataFrame:
    """Approved comparison-copy changes as a map step → replacements (step 0 is the problem text)."""
    if rules is None:
        return df.withColumn("_rules", F.lit(None).cast(f"map<int,{RULES_TYPE}>"))
    folded = rules.groupBy("id", "step").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "find", "repl"))),
        lambda r: F.struct(r["find"].alias("find"), r["repl"].alias("repl"))).alias("_r")) \
        .groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("step").cast("int"), "_r"))).alias("_rules"))
    return df.join(folded.withColumnRenamed("id", "_rid"), F.col(id_column) == F.col("_rid"), "left").drop("_rid")


def _comparison_copy(text: Column, step: Column | int) -> Column:
    return apply_rules(text, F.try_element_at("_rules", step if isinstance(step, Column) else F.lit(step)))


def materialize(queue: DataFrame, lock: DataFrame, drafts: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Draft materialisation (C-04): every queue row with restored texts and ``draft_problem`` (null when clean).

    ``drafts`` has (split, index, problem, steps, review_notes); ``rules`` (id, step, position, find, repl).
    """
    keyed = lock.select("split", "index", "id")
    placed = drafts.join(keyed, ["split", "index"]).select(
        F.col("id").alias("_id"), F.col("problem").alias("_dp"), F.col("steps").alias("_ds"), F.col("review_notes").alias("_dn"))
    rows = _with_rules(queue.join(placed, F.col("source_record.id") == F.col("_id")), rules, "source_record.id")
    # Entry 0 is the problem text; every layer reads the one before it, so each text is restored once.
    sources = F.concat(F.array(F.col("source_record.problem")), F.col("source_record.steps"))
    compared = F.transform(sources, lambda s, i: _comparison_copy(s, i))
    paired = F.zip_with(compared, F.concat(F.array("_dp"), F.col("_ds")), lambda s, d: F.struct(s.alias("s"), d.alias("d"), protected_spans(s).alias("spans")))
    filled = F.transform(paired, lambda x: F.struct(x["s"].alias("s"), x["d"].alias("d"), x["spans"].alias("spans"),
                                                    fill_template(x["d"], x["spans"]).alias("text")))
    judged = F.transform(filled, lambda x: F.struct(x["text"].alias("text"), x["s"].alias("s"), placed_problem(x["s"], x["d"], x["spans"], x["text"]).alias("problem")))
    rows = computed_once(rows.withColumn("_sources", sources), _j=judged)
    first = F.try_element_at(F.filter(F.transform("_j", lambda x: x["problem"]), lambda x: x.isNotNull()), F.lit(1))
    problem = F.when(F.size("_ds") != F.size("source_record.steps"), F.lit("step_count_changed")).otherwise(first)
    texts = F.transform("_j", lambda x: x["text"])
    changed = F.zip_with("_j", "_sources", lambda x, s: x["s"] != s)
    return rows.withColumn("draft_problem", problem).withColumn("normalized_steps", F.size(F.filter(changed, lambda x: x))) \
        .withColumn("translation", F.struct(
            F.col("translation.target_language").alias("target_language"),
            F.when(F.col("draft_problem").isNull(), "draft_automated_checks_passed").otherwise("pending").alias("status"),
            F.element_at(texts, 1).alias("problem"), F.slice(texts, 2, F.size("_ds")).alias("steps"), F.col("_dn").alias("review_notes"))) \
        .withColumn("qc", F.struct(F.lit("pending_human_review").alias("status"), F.lit(None).cast("string").alias("reviewer"),
                                   F.lit(None).cast("string").alias("decision"), F.lit(None).cast("string").alias("notes"))) \
        .drop("_id", "_dp", "_ds", "_dn", "_rules", "_sources", "_j")


def draft_report(materialized: DataFrame) -> DataFrame:
    return materialized.agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("translation.steps")).alias("translated_steps"),
                            F.sum("normalized_steps").alias("normalized_steps"),
                            F.count_if(F.col("draft_problem").isNotNull()).alias("failed_records"))


def review_sheet(queue: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Bilingual sheet as a table (C-05): one row per record and step, step 0 is the problem text."""
    rows = queue if ids is None else queue.join(ids.select(F.col("id").alias("_id")), F.col("source_record.id") == F.col("_id"), "left_semi")
    s, t = F.col("source_record"), F.col("translation")
    cells = F.arrays_zip(
        F.concat(F.array(s["problem"]), s["steps"]).alias("source_text"), F.concat(F.array(t["problem"]), t["steps"]).alias("draft_text"),
        F.concat(F.array(F.lit(None).cast("int")), s["source_step_ratings"]).alias("rating"))
    return rows.select(s["id"].alias("id"), "split", F.posexplode(cells).alias("step", "_c"), t["review_notes"].alias("review_notes")) \
        .select("id", "split", "step", "_c.source_text", "_c.draft_text", "_c.rating", "review_notes")


def decision_template(queue: DataFrame) -> DataFrame:
    """All decisions pending (C-06), numbered from 1 over the queue, bound to the queue digest."""
    numbered = text_ranks(queue.select(F.col("source_record.id").alias("id"), "split"), "id", out="record_number")
    bound = queue_digest(queue).select(F.col("table_sha256").alias("review_queue_sha256"))
    return with_scalars(numbered, bound).select(
        "review_queue_sha256", F.lit(False).alias("human_review"), F.lit(None).cast("string").alias("reviewer"), "record_number", "id",
        "split", F.lit("pending").alias("decision"), F.lit(None).cast("string").alias("reviewed_on"), F.lit("").alias("notes"))


def gate(queue: DataFrame, decisions: DataFrame, quarantined: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Every queue row with its decision and the first rule that blocks the export (C-07); null when none does.

    Record-level rules run in one pass after three equi-joins on the record id (decision, quarantine, rules).
    """
    d = decisions.select(F.col("id").alias("_did"), "human_review", "reviewer", F.col("review_queue_sha256").alias("_bound"), "decision",
                         "reviewed_on", "notes")
    counts = decisions.groupBy(F.col("id").alias("_did")).agg(F.count(F.lit(1)).alias("_n"))
    one = d.dropDuplicates(["_did"]).join(counts, "_did")
    actual = queue_digest(queue).select(F.col("table_sha256").alias("_actual"))
    digested = queue.withColumn("_now", canonical_digest(queue, "source_record"))
    rows = digested.join(one, F.col("source_record.id") == F.col("_did"), "left") \
        .join(quarantined.select(F.col("id").alias("_qid")).distinct(), F.col("source_record.id") == F.col("_qid"), "left")
    rows = with_scalars(_with_rules(rows, rules, "source_record.id"), actual)
    s, t = F.col("source_record"), F.col("translation")
    accept = F.col("decision") == "accept"
    compared = F.transform(F.concat(F.array(s["problem"]), s["steps"]), lambda x, i: _comparison_copy(x, i))
    checked = F.zip_with(compared, F.concat(F.array(t["problem"]), t["steps"]), lambda x, y: recheck_problem(x, y))
    rows = computed_once(rows, _text_problem=F.try_element_at(F.filter(checked, lambda x: x.isNotNull()), F.lit(1)))
    blocked = first_reason([
        (F.col("_did").isNull() | (F.col("_n") != 1), "not_exactly_one_decision"),
        (~F.col("_bound").eqNullSafe(F.col("_actual")), "other_review_queue"),
        (~F.coalesce(F.col("human_review"), F.lit(False)), "no_attestation"),
        (~is_filled(F.col("reviewer")), "no_reviewer"),
        (~F.coalesce(F.col("split").isin("train", "dev"), F.lit(False)), "unknown_split"),
        (~F.col("_now").eqNullSafe(F.col("source_record_sha256")), "source_record_changed"),
        (~F.coalesce(F.col("decision").isin("accept", "reject"), F.lit(False)), "undecided"),
        (~is_iso_date(F.col("reviewed_on")), "bad_review_date"),
        (F.col("notes").isNull(), "notes_missing"),
        ((F.col("decision") == "reject") & ~is_filled(F.col("notes")), "reject_without_reason"),
        (accept & F.col("_qid").isNotNull(), "accepted_but_quarantined"),
        (accept & ~F.coalesce(t["status"] == "draft_automated_checks_passed", F.lit(False)), "draft_checks_not_passed"),
        (accept & ((F.size(t["steps"]) != F.size(s["steps"])) | F.exists(t["steps"], lambda x: ~is_filled(x))), "incomplete_steps"),
    ])
    return rows.withColumn("blocked", F.coalesce(blocked, F.when(accept, F.col("_text_problem")))) \
        .drop("_did", "_n", "_bound", "_actual", "_now", "_qid", "_rules", "_text_problem")


def unknown_decisions(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue ids and decision ids must be the same set, each once."""
    return coverage_report(queue.select(F.col("source_record.id").alias("id")), decisions, ["id"])


def export(queue: DataFrame, decisions: DataFrame, quarantined: DataFrame, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """Reviewed export (C-07): accepted and rejected rows, after every gate is empty."""
    require_empty(unknown_decisions(queue, decisions), "every record needs exactly one decision")
    gated = cut_lineage(gate(queue, decisions, quarantined, rules))  # judged once; the gates below read the kept rows
    require_empty(gated.select(F.col("source_record.id").alias("id"), "blocked").where("blocked IS NOT NULL"), "export blocked")
    sources = gated.select("source_record.*", "split")
    require_empty(sources.select("id", staged_problem().alias("problem")).where("problem IS NOT NULL"), "source row failed validation")
    require_empty(leaking_groups(sources, "problem_id", "split"), "source group in both splits")
    accepted = accepted_rows(gated)
    if accepted.limit(1).count() == 0:
        raise CheckFailed("no accepted records")
    return {"accepted": accepted, "rejected": rejected_rows(gated), "gated": gated}


def rejected_rows(gated: DataFrame) -> DataFrame:
    return gated.where("decision = 'reject'").select(F.col("source_record.id").alias("id"), "split", F.col("notes").alias("reason"))


def accepted_rows(gated: DataFrame) -> DataFrame:
    """Accepted records in corpus form: source ids, labels and masks kept, texts replaced."""
    s, t = F.col("source_record"), F.col("translation")
    replaced = {"language": t["target_language"], "stage": F.lit("human_qc_accepted"), "problem": t["problem"], "steps": t["steps"],
                "response": reviewed_steps_to_text(t["steps"])}
    fields = gated.schema["source_record"].dataType.fieldNames()
    return gated.where("decision = 'accept'").select(
        *[replaced.get(f, s[f]).alias(f) for f in fields], s["id"].alias("source_record_id"), s["problem"].alias("source_problem"),
        "source_record_sha256", "split", F.struct(F.trim("reviewer").alias("reviewer"), F.lit("accept").alias("decision"), "reviewed_on",
                                                  "notes").alias("qc"))


def batch_problems(batches: DataFrame, actual: DataFrame) -> DataFrame:
    """Batch list checks: filled names, unique ids, lowercase digests, pinned digests equal the actual ones.

    Both tables have batch_id; ``actual`` has export_manifest_sha256, review_queue_sha256, decisions_sha256.
    """
    names = ("export_manifest", "review_queue", "decisions")
    pinned = [f"expected_{n}_sha256" for n in names]
    counted = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = batches.join(counted, "batch_id", "left").join(actual, "batch_id", "left")
    return rows.select("batch_id", first_reason(
        [(~is_filled(F.col(c)), f"missing_{c}") for c in ("batch_id", "export_dir", "review_queue", "decisions")]
        + [(F.col("_n") > 1, "duplicate_batch_id")]
        + [(F.col(p).isNotNull() & ~is_digest(F.col(p)), f"bad_{p}") for p in pinned]
        + [(F.col(p).isNotNull() & ~F.col(p).eqNullSafe(F.col(f"{n}_sha256")), f"{n}_changed") for p, n in zip(pinned, names)]
    ).alias("problem")).where("problem IS NOT NULL")


def merge_problems(merged: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Cross-batch gates (C-08): repeated ids, quarantined ids, group and text leaks, more than one reviewer."""
    repeated = repeated_across_batches(merged, "id", "batch_id").select(F.col("id").alias("key"), F.lit("duplicate_id").alias("problem"))
    barred = merged.join(quarantined.select("id"), "id", "left_semi").select(F.col("id").alias("key"), F.lit("quarantined").alias("problem"))
    by_group = leaking_groups(merged, "problem_id", "split").select(F.col("problem_id").alias("key"), F.lit("group_leak").alias("problem"))
    texts = merged.select("split", F.sha2(normalized_text(F.col("source_problem")), 256).alias("key"))
    by_text = leaking_groups(texts, "key", "split").select("key", F.lit("text_leak").alias("problem"))
    blank = merged.where(~is_filled(F.col("source_problem"))).select(F.col("id").alias("key"), F.lit("missing_source_problem").alias("problem"))
    reviewers = merged.agg(F.min("qc.reviewer").alias("a"), F.max("qc.reviewer").alias("b")).where("a <> b") \
        .select(F.concat_ws("/", "a", "b").alias("key"), F.lit("several_reviewers").alias("problem"))
    return reduce(DataFrame.unionByName, [repeated, barred, by_group, by_text, blank, reviewers])


def merge(batches: dict[str, dict[str, DataFrame]], quarantined: DataFrame, rules: DataFrame | None = None) -> dict[str, DataFrame]:
    """Multi-batch merge (C-08). Each batch has ``queue``, ``decisions`` and the stored ``exported`` rows.

    Every export is derived again from its evidence and must equal the stored rows, before the batches meet.
    """
    parts, rejected = [], []
    for batch_id, batch in batches.items():
        fresh = export(batch["queue"], batch["decisions"], quarantined, rules)
        require_empty(row_differences(fresh["accepted"], batch["exported"]).select("id", "side"), f"{batch_id}: stored export differs")
        parts.append(fresh["accepted"].withColumn("batch_id", F.lit(batch_id)))
        rejected.append(fresh["rejected"].withColumn("batch_id", F.lit(batch_id)))
    merged = cut_lineage(reduce(DataFrame.unionByName, parts))
    require_empty(merge_problems(merged, quarantined), "merge blocked")
    if merged.select("split").distinct().count() < 2:
        raise CheckFailed("merged corpus needs both splits")
    registry = merged.select("batch_id", "id", "source_record_id", "problem_id", "split", "source_record_sha256", "qc")
    return {"merged": merged.drop("batch_id"), "registry": registry, "rejected": reduce(DataFrame.unionByName, rejected),
            "supervision": supervision_summary(merged), "manifest": merge_manifest(merged)}


def merge_manifest(merged: DataFrame) -> DataFrame:
    """Counters of the merged corpus, one row (A-15)."""
    return merged.select("id", "split", "problem_id", F.sha2(normalized_text(F.col("source_problem")), 256).alias("_t")).agg(
        F.count(F.lit(1)).alias("accepted_records"), F.count_if(F.col("split") == "train").alias("train_records"),
        F.count_if(F.col("split") == "dev").alias("dev_records"), F.count_distinct("problem_id").alias("source_problem_groups"),
        F.count_distinct("_t").alias("normalized_source_problem_groups"))


def corpus_problems(corpus: DataFrame, reviewer: str, expected: dict[str, int], language: str = "ar") -> DataFrame:
    """Loader checks (C-09): stage, language, reviewer, supervision, unique ids, counts, no overlap."""
    rows = corpus.select(F.col("id").alias("key"), first_reason([
        (~F.coalesce((F.col("stage") == "human_qc_accepted") & (F.col("language") == language), F.lit(False)), "not_accepted"),
        (~F.coalesce((F.col("qc.decision") == "accept") & (F.col("qc.reviewer") == reviewer), F.lit(False)), "qc_identity"),
        (~supervision_valid(F.col("step_labels"), F.col("supervision_mask")), "no_binary_supervision"),
    ]).alias("problem")).where("problem IS NOT NULL")
    sound = corpus.select(F.col("id").alias("key"), staged_problem(problem="source_problem").alias("problem")).where("problem IS NOT NULL")
    doubled = corpus.groupBy(F.col("id").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit("duplicate_id").alias("problem"))
    leaks = leaking_groups(corpus, "problem_id", "split").select(F.col("problem_id").alias("key"), F.lit("split_overlap").alias("problem"))
    counts = corpus.agg(*[F.count_if(F.col("split") == s).alias(s) for s in expected]).select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("key"), (F.col(s) != n).alias("bad")) for s, n in expected.items()]))) \
        .where("bad").select("key", F.lit("split_count").alias("problem"))
    return reduce(DataFrame.unionByName, [rows, sound, doubled, leaks, counts])


def revision_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Changed cells between two queue versions (C-22): (key, field, old_value, new_value). Unchanged cells are not emitted."""
    old, new = differing_parts(old.select(key, *fields), new.select(key, *fields), [key])  # unchanged records are not exchanged
    a = old.select(key, *[F.to_json(F.struct(F.col(f).alias("v"))).alias(f"_a{i}") for i, f in enumerate(fields)], F.lit(1).alias("_ina"))
    b = new.select(key, *[F.to_json(F.struct(F.col(f).alias("v"))).alias(f"_b{i}") for i, f in enumerate(fields)], F.lit(1).alias("_inb"))
    cells = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_a{i}").alias("old_value"), F.col(f"_b{i}").alias("new_value"))
                               for i, f in enumerate(fields)]), lambda c: ~c["old_value"].eqNullSafe(c["new_value"]))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_ina").isNull(), "added").when(F.col("_inb").isNull(), "removed")
                                               .otherwise("changed").alias("change"), F.inline(cells))


def revision_summary(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Records changed, unchanged, added, removed, one row."""
    a = old.select(key, F.sha2(F.to_json(F.struct(*fields)), 256).alias("_a"))
    b = new.select(key, F.sha2(F.to_json(F.struct(*fields)), 256).alias("_b"))
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("_a") == F.col("_b")).alias("unchanged"), F.count_if(F.col("_a") != F.col("_b")).alias("changed"),
        F.count_if(F.col("_a").isNull()).alias("added"), F.count_if(F.col("_b").isNull()).alias("removed"))


def batch_audit(batch: DataFrame, prior_ids: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Audit of a selected batch (C-23): sizes, supervision, overlap with prior batches, quarantined rows."""
    marked = batch.join(prior_ids.select("id").distinct().withColumn("_p", F.lit(1)), "id", "left") \
        .join(quarantined.select("id").distinct().withColumn("_q", F.lit(1)), "id", "left")
    supervised = F.size(F.filter("supervision_mask", lambda m: m == 1))
    return marked.groupBy("split").agg(
        F.count(F.lit(1)).alias("records"), F.sum(F.size("steps")).alias("steps"), F.sum(supervised).alias("supervised_steps"),
        (F.sum(F.size("steps")) - F.sum(supervised)).alias("masked_steps"), F.count("_p").alias("prior_overlap"),
        F.count("_q").alias("quarantined_selected"))
