"""Sampling and splitting on documents and conversations."""
from pyspark.sql import functions as F

from evalspark.bindings.base import TRAJ, query, spread, table, trajectories
from evalspark.functions.digests import group_key, seeded
from evalspark.operators import ranges, sampling as S

SEED = 42
KEYS = """keys AS (SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS problem_id FROM documents)"""
SPLIT = f"CASE WHEN sha256('{SEED}:split:' || problem_id) < '33333333333334' || repeat('0', 50) THEN 'dev' ELSE 'train' END"


def keyed(spark, d):
    return spread(table(spark, d, "documents", ["doc_id", "text"]), "doc_id").select("doc_id", group_key(F.col("text"), unicode_form=False).alias("problem_id"))


@query("w06_group_reservoir", f"""WITH {KEYS} SELECT problem_id, sha256('{SEED}:reservoir:' || problem_id) AS priority FROM (SELECT DISTINCT problem_id FROM keys) ORDER BY priority LIMIT 100""")
def w06(spark, d):
    return S.group_reservoir(keyed(spark, d), "problem_id", 100, SEED).select("problem_id", "priority")


@query("w06_anchored_reservoir", f"""WITH {KEYS}, anchors AS (SELECT DISTINCT problem_id FROM keys WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)), g AS (SELECT DISTINCT problem_id FROM keys)
SELECT problem_id, problem_id IN (SELECT problem_id FROM anchors) AS anchored FROM g ORDER BY 2 DESC, sha256('{SEED}:reservoir:' || problem_id) LIMIT (SELECT count(*) + 20 FROM anchors)""")
def w06b(spark, d):
    rows = keyed(spark, d)
    anchors = rows.join(table(spark, d, "labels", ["doc_id", "toxic"]).where("toxic = 1"), "doc_id", "left_semi").select("problem_id", F.lit("dev").alias("split")).distinct()
    return S.group_reservoir(rows, "problem_id", anchors.count() + 20, SEED, anchors).select("problem_id", "anchored")


@query("w07_ranked_group_sample", f"""WITH {KEYS}, k AS (SELECT problem_id, sha256('{SEED}:' || problem_id) AS p FROM (SELECT DISTINCT problem_id FROM keys) ORDER BY p LIMIT 65), r AS (SELECT *, row_number() OVER (ORDER BY p) AS rank FROM k)
SELECT problem_id, rank, CASE WHEN rank <= greatest(1, least(64, round_even(65 * 0.3, 0))) THEN 'dev' ELSE 'train' END AS split FROM r""")
def w07(spark, d):
    return S.ranked_group_sample(keyed(spark, d), "problem_id", 65, SEED, 0.3).select("problem_id", F.col("rank").cast("bigint").alias("rank"), "split")


@query("w08_collect_groups", f"""WITH {KEYS}, s AS (SELECT problem_id FROM (SELECT DISTINCT problem_id FROM keys) ORDER BY sha256('{SEED}:reservoir:' || problem_id) LIMIT 100)
SELECT doc_id, problem_id, {SPLIT} AS split FROM keys WHERE problem_id IN (SELECT problem_id FROM s)""")
def w08(spark, d):
    rows = keyed(spark, d)
    return S.collect_groups(rows, S.group_reservoir(rows, "problem_id", 100, SEED), "problem_id", SEED, 0.2).select("doc_id", "problem_id", "split")


@query("w09_threshold_split", f"WITH {KEYS} SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN 'train' ELSE {SPLIT} END AS split FROM keys")
def w09(spark, d):
    anchored = F.when(F.col("doc_id") % 40 == 0, F.lit("train"))
    return keyed(spark, d).select("doc_id", S.threshold_split(F.col("problem_id"), SEED, 0.2, anchored).alias("split"))


@query("w10_stratified_pick", f"""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS t FROM c), i AS (SELECT lang, n, floor(n * 77 / t) AS base, (n * 77) % t AS rest FROM c, t),
 a AS (SELECT lang, base + (row_number() OVER (ORDER BY rest DESC, lang) <= 77 - (SELECT sum(base) FROM i))::INT AS quota FROM i),
 r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('{SEED}:' || doc_id)) AS rk FROM documents)
SELECT doc_id, lang, CASE WHEN rk <= quota THEN 'dev' ELSE 'train' END AS split FROM r JOIN a USING (lang)""")
def w10(spark, d):
    return S.stratified_pick(table(spark, d, "documents", ["doc_id", "lang"]), "doc_id", "lang", 77, SEED)


@query("w11_sample_unused", f"""SELECT doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1) ORDER BY sha256('{SEED}:sample:' || doc_id) LIMIT 200""")
def w11(spark, d):
    used = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return S.sample_unused(table(spark, d, "documents", ["doc_id"]), "doc_id", 200, SEED, used)


SIG = """'length:' || CASE WHEN n <= 4 THEN 'short' WHEN n <= 12 THEN 'medium' ELSE 'long' END || '/first_error:' ||
 CASE WHEN first_error IS NULL THEN 'none' WHEN first_error <= 4 THEN 'early' WHEN first_error <= 12 THEN 'middle' ELSE 'late' END || '/neutral:' || CASE WHEN list_contains(ratings, 0) THEN 'True' ELSE 'False' END"""


# The greedy choice step by step: the best head left of the current variant, until none adds a label; then the other variant.
def greedy_sql(keep: str, train: int, dev: int) -> str:
    """firsts(split, id, pick_order) and rests(split, id, variant, quota, k, rk) of the rows under a condition, for quotas of a variant."""
    return f"""WITH RECURSIVE {TRAJ}, s AS (SELECT doc_id::VARCHAR AS id, split, variant, string_split({SIG}, '/') AS labels, sha256('{SEED}:' || doc_id) AS priority FROM traj WHERE {keep}),
 quotas(split, quota) AS (VALUES ('train', {train}), ('dev', {dev})), heads AS (SELECT split, variant, labels, min(priority) AS priority, arg_min(id, priority) AS id FROM s GROUP BY ALL),
 lists AS (SELECT split, quota, list(struct_pack(p := priority, i := id, l := labels)) FILTER (variant = 'correct') AS h0, list(struct_pack(p := priority, i := id, l := labels)) FILTER (variant = 'incorrect') AS h1
  FROM heads JOIN quotas USING (split) GROUP BY ALL),
 steps(split, quota, h0, h1, turn, seen, picks, best) AS (SELECT split, quota, h0, h1, 0, []::VARCHAR[], [[], []]::VARCHAR[][], NULL::STRUCT(g BIGINT, p VARCHAR, i VARCHAR, l VARCHAR[]) FROM lists
  UNION ALL SELECT split, quota, h0, h1, CASE WHEN b IS NULL THEN turn + 1 ELSE turn END, CASE WHEN b IS NULL THEN seen ELSE list_concat(seen, b.l) END,
   CASE WHEN b IS NULL THEN picks WHEN turn = 0 THEN [list_append(picks[1], b.i), picks[2]] ELSE [picks[1], list_append(picks[2], b.i)] END, b
  FROM (SELECT *, CASE WHEN len(picks[turn + 1]) < quota THEN list_sort(list_filter(list_transform(CASE WHEN turn = 0 THEN h0 ELSE h1 END,
    lambda x: struct_pack(g := -len(list_filter(list_distinct(x.l), lambda y: NOT list_contains(seen, y))), p := x.p, i := x.i, l := x.l)), lambda x: x.g < 0))[1] END AS b FROM steps WHERE turn < 2)),
 done AS (SELECT split, quota, picks FROM steps WHERE turn = 2),
 firsts AS (SELECT split, id, quota * t + n AS pick_order FROM (SELECT split, quota, t, unnest(picks[t + 1]) AS id, unnest(range(1, len(picks[t + 1]) + 1)) AS n FROM done, (VALUES (0), (1)) v(t))),
 rests AS (SELECT split, id, variant, quota, len(picks[CASE variant WHEN 'correct' THEN 1 ELSE 2 END]) AS k, row_number() OVER (PARTITION BY split, variant ORDER BY priority) AS rk FROM s JOIN done USING (split) WHERE (split, id) NOT IN (SELECT (split, id) FROM firsts))"""


CHOICE = """SELECT f.split, f.id, variant, f.pick_order::INT AS pick_order FROM firsts f JOIN s ON s.id = f.id
UNION ALL SELECT split, id, variant, (rk + k + CASE variant WHEN 'correct' THEN 0 ELSE quota END)::INT FROM rests WHERE rk <= quota - k"""


@query("w12_greedy_coverage", f"{greedy_sql('true', 8, 4)} {CHOICE}")
def w12(spark, d):
    rows = trajectories(spark, d).withColumn("id", F.col("doc_id").cast("string"))
    return S.greedy_coverage(rows, {"train": 16, "dev": 8}, SEED)


@query("w12_coverage_candidates", f"""WITH {TRAJ}, s AS (SELECT doc_id, split, variant, {SIG} AS signature FROM traj),
 r AS (SELECT *, row_number() OVER (PARTITION BY split, variant, signature ORDER BY sha256('{SEED}:' || doc_id)) AS rk FROM s) SELECT doc_id, split, variant, signature FROM r WHERE rk <= CASE split WHEN 'train' THEN 8 ELSE 4 END""")
def w12b(spark, d):
    rows = trajectories(spark, d).withColumn("id", F.col("doc_id").cast("string"))
    quota = F.when(F.col("split") == "train", 8).otherwise(4)
    return S.coverage_candidates(rows, quota, SEED, limit=8).select("doc_id", "split", "variant", "signature")


@query("u05_coverage_of_batch", f"""WITH {TRAJ}, s AS (SELECT split, unnest(string_split({SIG}, '/')) AS label FROM traj) SELECT split, string_agg(DISTINCT label, ',' ORDER BY label) AS coverage FROM s GROUP BY 1""")
def u05(spark, d):
    from evalspark.functions.steps import coverage_labels
    rows = trajectories(spark, d).select("split", F.explode(coverage_labels(F.size("steps"), F.col("first_error_step"), F.col("source_step_ratings"))).alias("label"))
    # Nine labels exist at most, so the set per split is bounded.
    return rows.groupBy("split").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("coverage"))


@query("digest_rank_in_group", f"SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('{SEED}:' || doc_id)) AS digest_rank FROM documents")
def digest_rank(spark, d):
    rows = table(spark, d, "documents", ["doc_id", "source"]).withColumn("h", seeded(SEED, F.col("doc_id")))
    return ranges.digest_ranks(rows, "h", ["source"]).select("doc_id", "source", F.col("digest_rank").cast("bigint").alias("digest_rank"))
