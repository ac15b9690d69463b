"""Sources, predicates, sets and ordering on the driver's tables."""
from pyspark.sql import functions as F

from evalspark.bindings.base import LONG, PAIRS, RESPONSES, SETS, exclusion_sets, query, responses, results_long, scratch, shown, spread, table
from evalspark.bindings.pairs import m1_pairs
from evalspark.operators import checks, idsets, pairs as P, sampling, scores as A, snapshots
from evalspark.plans import scoring
from evalspark.sources import committed, files, line_ranges, readers, sinks, strict_json

# ------------------------------------------------------------------ sources


@query("s01_json_lines", "SELECT event_id, (props->>'k')::INT AS k, event_type FROM events")
def s01(spark, d):
    """Written as JSON lines with a blank line after each, read back."""
    path = scratch(spark, "jsonl")
    rows = table(spark, d, "events", ["event_id", "props", "event_type"]).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type")
    rows.select(F.concat(F.to_json(F.struct("*")), F.lit("\n  ")).alias("value")).write.text(path)
    return readers.read_jsonl(spark, path, "event_id BIGINT, k INT, event_type STRING")


@query("s02_csv_cells", """SELECT item_id, text, 'say "' || item_id || '"' AS quoted FROM benchmark""")
def s02(spark, d):
    """Cells with quotes and line breaks, written and read back."""
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, d, "benchmark").select("item_id", "text", F.concat(F.lit('say "'), F.col("item_id").cast("string"), F.lit('"')).alias("quoted")), path)
    return readers.read_csv(spark, path, "item_id BIGINT, text STRING, quoted STRING")


@query("s03_multi_file_union", """WITH u AS (SELECT 'labels' AS source_file, doc_id, NULL AS lang FROM labels UNION ALL SELECT 'documents', doc_id, lang FROM documents)
SELECT source_file, count(*) AS n_rows, count(lang) AS n_lang FROM u GROUP BY 1""")
def s03(spark, d):
    paths = {name: scratch(spark, name) for name in ("labels", "documents")}
    sinks.write_csv(table(spark, d, "labels", ["doc_id"]), paths["labels"])
    sinks.write_csv(table(spark, d, "documents", ["doc_id", "lang"]), paths["documents"])
    return readers.read_union(spark, paths).groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"), F.count("lang").alias("n_lang"))


@query("s04_numbered_lines", """WITH t AS (SELECT user_id % 4 AS k, event_type || ':' || event_id AS line, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS line_number,
  sum(octet_length(encode(event_type || ':' || event_id)) + 1) OVER (PARTITION BY user_id % 4 ORDER BY event_id)::BIGINT AS bytes_through FROM events)
SELECT k::INT AS k, line, line_number, bytes_through FROM t WHERE line_number <= 900 AND bytes_through <= 10000""")
def s04b(spark, d):
    """Four text files in event order; lines numbered from their file splits, cut by rows and bytes."""
    path = scratch(spark, "lines")
    rows = table(spark, d, "events", ["event_id", "user_id", "event_type"]).select("event_id", (F.col("user_id") % 4).alias("k"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("value"))
    rows.repartition(4, "k").sortWithinPartitions("k", "event_id").select("k", "value").write.partitionBy("k").text(path)
    lines = readers.bounded_prefix(readers.numbered_lines(spark, path), 900, 10_000)
    return lines.select(F.regexp_extract("file", r"/k=(\d+)/", 1).cast("int").alias("k"), F.col("value").alias("line"), F.col("line_number").cast("bigint").alias("line_number"), "bytes_through")


@query("s04_file_prefix", """WITH t AS (SELECT user_id % 4 AS k, event_type || ':' || event_id AS line, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS line_number,
  sum(octet_length(encode(event_type || ':' || event_id)) + 1) OVER (PARTITION BY user_id % 4 ORDER BY event_id)::BIGINT AS bytes_through FROM events)
SELECT k::INT AS k, line, line_number, bytes_through - octet_length(encode(line)) - 1 AS first_byte, bytes_through FROM t WHERE line_number <= 700 AND bytes_through <= 11000""")
def s04c(spark, d):
    """The same files read by byte ranges: only ranges before the cut are counted and scanned."""
    path = scratch(spark, "lines")
    rows = table(spark, d, "events", ["event_id", "user_id", "event_type"]).select("event_id", (F.col("user_id") % 4).alias("k"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("value"))
    rows.repartition(4, "k").sortWithinPartitions("k", "event_id").select("k", "value").write.partitionBy("k").text(path)
    lines = line_ranges.file_prefix(spark, path, 700, 11_000, range_bytes=4096)
    return lines.select(F.regexp_extract("file", r"/k=(\d+)/", 1).cast("int").alias("k"), F.col("value").alias("line"), "line_number", "first_byte", "bytes_through")


PREFIX_ROWS, PREFIX_BYTES = 4000, 200_000


@query("s04_bounded_prefix", f"""WITH t AS (SELECT event_id, octet_length(encode(event_type || ':' || props)) + 1 AS n_bytes, row_number() OVER (ORDER BY event_id) AS line_number,
  sum(octet_length(encode(event_type || ':' || props)) + 1) OVER (ORDER BY event_id)::BIGINT AS bytes_through FROM events)
SELECT event_id, n_bytes::BIGINT AS n_bytes, line_number, bytes_through FROM t WHERE line_number <= {PREFIX_ROWS} AND bytes_through <= {PREFIX_BYTES}""")
def s04(spark, d):
    rows = table(spark, d, "events", ["event_id", "event_type", "props"]).select("event_id", F.concat_ws(":", "event_type", "props").alias("line"))
    return readers.ordered_prefix(rows, "event_id", "line", PREFIX_ROWS, PREFIX_BYTES).select("event_id", "n_bytes", F.col("line_number").cast("bigint").alias("line_number"), "bytes_through")


@query("s05_strict_json", """SELECT event_id, event_id % 6 IN (0, 5) AS accepted, CASE event_id % 6 WHEN 0 THEN NULL WHEN 5 THEN NULL WHEN 3 THEN 'not_object' ELSE 'malformed' END AS problem FROM events""")
def s05(spark, d):
    i = F.col("event_id") % 6
    line = F.when(i == 1, F.concat("props", F.lit(" trailing"))).when(i == 2, F.lit('{"k": 1, "k": 2}')).when(i == 3, F.concat(F.lit("["), "props", F.lit("]"))) \
        .when(i == 4, F.lit('{"k": NaN}')).when(i == 5, F.concat(F.lit("  "), "props", F.lit("\n"))).otherwise(F.col("props"))
    rows = spread(table(spark, d, "events", ["event_id", "props"]), "event_id").select("event_id", line.alias("line"))
    return rows.select("event_id", strict_json.strict_object(F.col("line")).isNotNull().alias("accepted"), strict_json.strict_problem(F.col("line")).alias("problem"))


@query("s06_file_digests")
def s06(spark, d):
    return files.file_digests(spark, d, "*.parquet").select("file_name", "n_bytes", "sha256")


@query("s07_manifest_mismatches")
def s07(spark, d):
    actual = files.file_digests(spark, d, "*.parquet")
    pinned = actual.select("file_name", F.when(F.col("file_name") == "labels.parquet", F.sha2(F.col("sha256"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return files.manifest_mismatches(actual, pinned)


REGION_FILES = "r AS (SELECT n_regionkey::INT AS k, string_agg(n_name || chr(10), '' ORDER BY n_name) AS t FROM nation GROUP BY 1)"


def region_files(spark, d):
    """A text file a region; returns its folder."""
    path = scratch(spark, "files")
    names = table(spark, d, "nation", ["n_name", "n_regionkey"]).select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("value"))
    names.repartition(1).sortWithinPartitions("k", "value").write.partitionBy("k").text(path)
    return path


def region_digests(spark, path):
    return files.file_digests(spark, path, "part-*").select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("int").alias("k"), "n_bytes", "sha256")


@query("s06_text_digests", f"WITH {REGION_FILES} SELECT k, strlen(t) AS n_bytes, sha256(t) AS sha256 FROM r")
def s06b(spark, d):
    return region_digests(spark, region_files(spark, d))


@query("s07_text_mismatches", f"""WITH {REGION_FILES}, m AS (SELECT k, CASE WHEN k = 2 THEN sha256('other') ELSE sha256(t) END AS expected FROM r UNION ALL SELECT 9, sha256('gone'))
SELECT k, expected, sha256(t) AS actual, CASE WHEN t IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM m LEFT JOIN r USING (k) WHERE sha256(t) IS DISTINCT FROM expected""")
def s07b(spark, d):
    """A pinned file that differs and one that is not there."""
    actual = region_digests(spark, region_files(spark, d))
    names = table(spark, d, "nation", ["n_name", "n_regionkey"]).groupBy(F.col("n_regionkey").cast("int").alias("k")).agg(F.array_sort(F.collect_list("n_name")).alias("names"))  # a few names a region
    pinned = names.select("k", F.sha2(F.when(F.col("k") == 2, "other").otherwise(F.concat(F.array_join("names", "\n"), F.lit("\n"))), 256).alias("sha256"))
    pinned = pinned.unionAll(spark.range(1).select(F.lit(9).alias("k"), F.sha2(F.lit("gone"), 256)))
    return files.manifest_mismatches(actual, pinned, "k")


@query("s08_digest_changes", """WITH r AS (SELECT r_regionkey AS k, string_agg(n_name || chr(10), '' ORDER BY n_name) AS was FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
 f AS (SELECT k, was, CASE WHEN k = 1 THEN NULL WHEN k % 2 = 0 THEN replace(was, 'A', 'a') ELSE was END AS now FROM r UNION ALL SELECT 9, NULL, 'late' || chr(10))
SELECT k::INT AS k, CASE WHEN was IS NULL THEN 'appeared' WHEN now IS NULL THEN 'vanished' ELSE 'changed' END AS problem, sha256(was) AS before, sha256(now) AS after FROM f WHERE was IS DISTINCT FROM now""")
def s08(spark, d):
    """A file a region; while the job runs some are rewritten, one goes and one comes."""
    path = scratch(spark, "inputs")
    nations = table(spark, d, "nation", ["n_name", "n_regionkey"])

    def write(rows):
        rows.repartition(1).sortWithinPartitions("k", "value").write.mode("append").partitionBy("k").text(path)
    write(nations.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("value")))
    digest = lambda: files.file_digests(spark, path, "part-*").select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("int").alias("k"), "sha256")
    seen = scratch(spark, "digests")
    digest().write.parquet(seen)
    files.remove_below(path, [f"k={k}" for k in (0, 1, 2, 4)])
    write(nations.where("n_regionkey % 2 = 0").select(F.col("n_regionkey").alias("k"), F.replace("n_name", F.lit("A"), F.lit("a")).alias("value")))
    write(spark.range(1).select(F.lit(9).alias("k"), F.lit("late").alias("value")))
    return files.digest_changes(spark.read.parquet(seen), digest(), "k").select("k", "problem", "before", "after")


@query("s09_json_line_sink", """SELECT doc_id, '{"doc_id":' || doc_id || ',"quality":' || quality || ',"reviewer":null,"toxic":' || toxic || '}' AS line FROM labels""")
def s09(spark, d):
    path = scratch(spark, "jsonl")
    sinks.write_jsonl(table(spark, d, "labels").withColumn("reviewer", F.lit(None).cast("string")), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.doc_id").cast("bigint").alias("doc_id"), F.col("value").alias("line"))


@query("s10_refused_overwrite", """SELECT sink, true AS refused, n_rows FROM (SELECT count(*) AS n_rows FROM labels), (VALUES ('csv'), ('jsonl'), ('table')) t(sink)""")
def s10(spark, d):
    """Every sink twice to one path: the second write is refused and the first one's rows stay."""
    rows, out = table(spark, d, "labels"), None
    for sink, write, read in (("csv", sinks.write_csv, lambda p: readers.read_csv(spark, p)), ("jsonl", sinks.write_jsonl, spark.read.text), ("table", sinks.write_table, spark.read.parquet)):
        path = scratch(spark, sink)
        write(rows, path)
        try:
            write(rows.limit(1), path)
            refused = False
        except Exception as error:
            if "PATH_ALREADY_EXISTS" not in str(error):
                raise
            refused = True
        part = read(path).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(sink).alias("sink"), F.lit(refused).alias("refused"), "n_rows")
        out = part if out is None else out.unionAll(part)
    return out


@query("s10_committed_lines", """SELECT i AS attempt, i = 1 AS refused, n_rows, n_rows AS recorded, 0::BIGINT AS staging FROM (SELECT count(*) AS n_rows FROM labels), range(2) t(i)""")
def s10b(spark, d):
    """Written twice to one path: the second job is refused when it commits, leaves nothing, and the first one's rows stay."""
    rows, path, out = table(spark, d, "labels"), scratch(spark, "committed"), None
    for attempt in range(2):
        try:
            committed.write_lines(rows if attempt == 0 else rows.limit(1), path)
            refused = False
        except Exception as error:
            if "PATH_ALREADY_EXISTS" not in str(error):
                raise
            refused = True
        part = spark.read.text(path).agg(F.lit(attempt).cast("bigint").alias("attempt"), F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n_rows"),
                                         F.lit(committed.committed_rows(path)).cast("bigint").alias("recorded"), F.lit(committed.clear_staging(spark, path)).cast("bigint").alias("staging"))
        out = part if out is None else out.unionAll(part)
    return out


@query("s11_committed_splits", """SELECT CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split, '{"doc_id":' || doc_id || ',"split":"' || CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END || '"}' AS line FROM documents""")
def s11b(spark, d):
    path = scratch(spark, "splits")
    committed.write_lines(table(spark, d, "documents", ["doc_id"]).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train")), path, "split")
    return spark.read.text(path).select("split", F.col("value").alias("line"))


@query("s11_split_counts", "SELECT CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split, count(*) AS n_rows FROM documents GROUP BY 1")
def s11(spark, d):
    path = scratch(spark, "splits")
    sinks.write_table(table(spark, d, "documents", ["doc_id"]).withColumn("split", F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train")), path, "split")
    return sinks.split_counts(spark.read.parquet(path))


@query("s12_csv_lines", "SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation UNION ALL SELECT 'n_nationkey,n_name,n_regionkey'")
def s12(spark, d):
    path = scratch(spark, "csv")
    sinks.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("s13_bilingual_configs", """WITH a AS (SELECT doc_id, text FROM documents WHERE lang <> 'de'), b AS (SELECT doc_id, source FROM documents WHERE lang <> 'fr')
SELECT coalesce(a.doc_id, b.doc_id) AS source_index, a.text AS question_a, b.source AS question_b FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def s13(spark, d):
    docs = table(spark, d, "documents", ["doc_id", "text", "source", "lang"]).withColumn("answer", F.lit(""))
    b = docs.where("lang <> 'fr'").select("doc_id", F.col("source").alias("text"), "answer")
    return readers.bilingual_configs(docs.where("lang <> 'de'"), b, "doc_id", "text", "answer").select("source_index", "question_a", "question_b")


@query("s14_side_table", """SELECT e.event_id, n.note FROM events e LEFT JOIN (VALUES ('error', 'check by hand'), ('signup', 'first visit')) n(event_type, note) USING (event_type)""")
def s14(spark, d):
    notes = readers.literal_table(spark, [("error", "check by hand"), ("signup", "first visit")], "event_type STRING, note STRING")
    return table(spark, d, "events", ["event_id", "event_type"]).join(notes, "event_type", "left").select("event_id", "note")


# ------------------------------------------------------------------ predicates


@query("p01_required_columns", """SELECT column_name AS missing FROM (VALUES ('absent'), ('doc_id'), ('rating')) t(column_name)
 WHERE column_name NOT IN ('doc_id', 'quality', 'toxic') AND (SELECT count(*) FROM labels) > 0""")
def p01(spark, d):
    labels = table(spark, d, "labels")
    gone = checks.missing_columns(labels, ["doc_id", "rating", "absent"])
    return labels.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.explode(F.array(*[F.lit(c) for c in gone])).alias("missing"))


@query("p02_column_resolution", "SELECT o_orderkey AS problem_id, o_totalprice AS score FROM orders")
def p02(spark, d):
    return checks.rename_resolved(table(spark, d, "orders", ["o_orderkey", "o_totalprice"]), {"problem_id": ["id", "O_ORDERKEY"], "score": ["final", "o_totalprice"]})


@query("p03_normalized_key", "SELECT o_orderkey, lower(trim('  ' || o_orderpriority || ' ')) AS priority FROM orders")
def p03(spark, d):
    return table(spark, d, "orders", ["o_orderkey", "o_orderpriority"]).select("o_orderkey", checks.normalized_key(F.concat(F.lit("  "), "o_orderpriority", F.lit(" "))).alias("priority"))


@query("p04_strict_cast", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def p04(spark, d):
    return table(spark, d, "events", ["event_id", "props"]).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("p05_lenient_cast", """SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1 + o_orderkey % 2) AS INT) AS digit, coalesce(try_cast(substr(o_orderpriority, 1, 1 + o_orderkey % 2) AS INT), 0) AS digit_or_zero FROM orders""")
def p05(spark, d):
    raw = F.substr("o_orderpriority", F.lit(1), (1 + F.col("o_orderkey") % 2).cast("int"))
    return table(spark, d, "orders", ["o_orderkey", "o_orderpriority"]).select("o_orderkey", checks.lenient_int(raw).alias("digit"), checks.lenient_int(raw, 0).alias("digit_or_zero"))


@query("p06_domain_check", "SELECT event_type, count(*) AS n_rows FROM events WHERE event_type NOT IN ('click', 'view') OR event_type IS NULL GROUP BY 1")
def p06(spark, d):
    return checks.outside_domain(table(spark, d, "events", ["event_type"]), "event_type", ["click", "view"])


@query("p07_id_gaps", """WITH a AS (SELECT DISTINCT doc_id AS id FROM labels), e AS (SELECT unnest(range((SELECT min(doc_id) + 5 FROM documents), (SELECT max(doc_id) + 5 FROM documents))) AS id)
SELECT coalesce(a.id, e.id) AS id, CASE WHEN a.id IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM a FULL JOIN e ON a.id = e.id WHERE a.id IS NULL OR e.id IS NULL""")
def p07(spark, d):
    """Labels against the range of the documents' ids, moved a little so that some labels lie outside."""
    low, high = table(spark, d, "documents", ["doc_id"]).agg(F.min("doc_id"), F.max("doc_id")).first()
    return checks.id_gaps(table(spark, d, "labels", ["doc_id"]), "doc_id", low + 5, high + 4)


@query("p07_sparse_gap_ranges", """WITH a AS (SELECT DISTINCT doc_id * doc_id * 10007 + doc_id % 3 AS id FROM documents WHERE doc_id % 4 < 3), i AS (SELECT id FROM a WHERE id BETWEEN 100 AND 1000000000000),
 g AS (SELECT id + 1 AS first_id, lead(id, 1, 1000000000001) OVER (ORDER BY id) - 1 AS last_id FROM i UNION ALL SELECT 100, (SELECT coalesce(min(id), 1000000000001) - 1 FROM i))
SELECT first_id, last_id, last_id - first_id + 1 AS n_ids, 'missing' AS problem FROM g WHERE first_id <= last_id UNION ALL SELECT id, id, 1, 'unexpected' FROM a WHERE id NOT BETWEEN 100 AND 1000000000000""")
def p07b(spark, d):
    """A range of 10^12 ids of which few are there."""
    ids = table(spark, d, "documents", ["doc_id"]).where("doc_id % 4 < 3").select((F.col("doc_id") * F.col("doc_id") * 10007 + F.col("doc_id") % 3).alias("id"))
    return idsets.id_gap_ranges(ids, "id", 100, 10**12)


@query("p07_dense_gap_ranges", """WITH a AS (SELECT DISTINCT event_id AS id FROM events WHERE event_id % 97 > 3 AND event_id % 1000 < 980), b AS (SELECT min(event_id) - 5 AS low, max(event_id) + 5 AS high FROM events),
 g AS (SELECT id + 1 AS first_id, lead(id, 1, (SELECT high + 1 FROM b)) OVER (ORDER BY id) - 1 AS last_id FROM a UNION ALL SELECT low, (SELECT min(id) - 1 FROM a) FROM b)
SELECT first_id, last_id, last_id - first_id + 1 AS n_ids, 'missing' AS problem FROM g WHERE first_id <= last_id""")
def p07c(spark, d):
    """Bitmaps: most ids are there."""
    ids = table(spark, d, "events", ["event_id"])
    low, high = ids.agg(F.min("event_id") - 5, F.max("event_id") + 5).first()
    return idsets.id_gap_ranges(ids.where("event_id % 97 > 3 AND event_id % 1000 < 980"), "event_id", low, high)


@query("p08_grid_gaps", """WITH k AS (SELECT DISTINCT conv_id FROM conversations), r(role) AS (VALUES ('system'), ('user'), ('assistant'))
SELECT conv_id, role FROM k, r EXCEPT SELECT conv_id, role FROM conversations""")
def p08(spark, d):
    return checks.grid_gaps(table(spark, d, "conversations", ["conv_id", "role"]), "conv_id", "role", ["system", "user", "assistant"])


@query("p09_expected_counts", """WITH c AS (SELECT count(*) AS n, count_if(o_orderstatus = 'F') AS f, count_if(o_totalprice < 0) AS neg FROM orders)
SELECT 'rows' AS check_name, 15000::BIGINT AS expected, n::BIGINT AS actual, n = 15000 AS ok FROM c UNION ALL SELECT 'status_f', 1, f::BIGINT, f = 1 FROM c UNION ALL SELECT 'negative', 0, neg::BIGINT, neg = 0 FROM c""")
def p09(spark, d):
    return checks.expectation_table(table(spark, d, "orders", ["o_orderstatus", "o_totalprice"]), {
        "rows": (F.lit(True), 15000), "status_f": (F.col("o_orderstatus") == "F", 1), "negative": (F.col("o_totalprice") < 0, 0)})


@query("p10_duplicate_keys", "SELECT user_id, event_type, count(*) AS n_rows FROM events GROUP BY ALL HAVING count(*) > 1")
def p10(spark, d):
    return checks.duplicate_keys(table(spark, d, "events", ["user_id", "event_type"]), ["user_id", "event_type"])


@query("p11_blank_counts", "SELECT count_if(trim(replace(lang, 'en', ' ')) = '')::BIGINT AS blank_lang, count_if(trim(source) = '')::BIGINT AS blank_source FROM documents")
def p11(spark, d):
    docs = table(spark, d, "documents", ["lang", "source"]).withColumn("lang", F.replace("lang", F.lit("en"), F.lit(" ")))
    return checks.blank_counts(docs, ["lang", "source"])


@query("p17_narrow_and_rename", "SELECT doc_id AS problem_id, quality AS a_correct FROM labels")
def p17(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("problem_id"), F.col("quality").alias("a_correct"))


# Flags of a cheap kind, so that these rows do not depend on the extractor.
FLAGS = f"""{RESPONSES}, scored AS (SELECT problem_id, language, status, (problem_id % 3 = 0 OR generated_response IS NULL)::INT AS needs_manual_review,
  (o_custkey % 4 > 0)::INT AS is_correct, o_custkey FROM responses)"""


def flagged(spark, d):
    return responses(spark, d).select("problem_id", "language", "status", ((F.col("problem_id") % 3 == 0) | F.col("generated_response").isNull()).cast("int").alias("needs_manual_review"),
                                      (F.col("o_custkey") % 4 > 0).cast("int").alias("is_correct"), "o_custkey", "model")


@query("p19_flagged_rows", f"WITH {FLAGS} SELECT problem_id, language FROM scored WHERE needs_manual_review = 1")
def p19(spark, d):
    return flagged(spark, d).where("needs_manual_review = 1").select("problem_id", "language")


@query("p20_semantic_list", f"WITH {FLAGS} SELECT problem_id, language FROM scored WHERE language = 'arabic' AND is_correct = 1")
def p20(spark, d):
    return flagged(spark, d).where("language = 'arabic' AND is_correct = 1").select("problem_id", "language")


@query("p21_success_filter", f"WITH {FLAGS} SELECT language, count(*) AS n_planned, count_if(status = 'success')::BIGINT AS n_success, round(avg(is_correct) FILTER (status = 'success'), 6) AS accuracy FROM scored GROUP BY 1")
def p21(spark, d):
    ok = F.col("status") == "success"
    return shown(flagged(spark, d).groupBy("language").agg(F.count(F.lit(1)).alias("n_planned"), F.count_if(ok).alias("n_success"), F.avg(F.when(ok, F.col("is_correct"))).alias("accuracy")))


@query("p22_exact_set_gate", f"""WITH {FLAGS}, s AS (SELECT DISTINCT problem_id, language FROM scored WHERE needs_manual_review = 1 AND is_correct = 1),
 e AS (SELECT DISTINCT problem_id, language FROM scored WHERE needs_manual_review = 1 AND status = 'success')
SELECT problem_id, language, CASE WHEN l IS NULL THEN 'only_expected' ELSE 'only_scored' END AS side FROM (SELECT *, 1 AS l FROM s) FULL JOIN (SELECT *, 1 AS r FROM e) USING (problem_id, language) WHERE l IS NULL OR r IS NULL""")
def p22(spark, d):
    rows = flagged(spark, d)
    return scoring.flagged_correct_problems(rows, rows.where("needs_manual_review = 1 AND status = 'success'"), ["problem_id", "language"])


# ------------------------------------------------------------------ sets


@query("u01_union", "SELECT doc_id, 'labels' AS part FROM labels UNION ALL SELECT doc_id, 'documents' FROM documents")
def u01(spark, d):
    return table(spark, d, "labels", ["doc_id"]).withColumn("part", F.lit("labels")).unionByName(table(spark, d, "documents", ["doc_id"]).withColumn("part", F.lit("documents")))


@query("u02_intersection", "SELECT doc_id FROM (SELECT doc_id FROM labels WHERE quality = 0 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)")
def u02(spark, d):
    labels = table(spark, d, "labels")
    return labels.where("quality = 0").select("doc_id").intersect(labels.where("toxic = 1").select("doc_id"))


@query("u03_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u03(spark, d):
    return table(spark, d, "documents", ["doc_id"]).subtract(table(spark, d, "labels", ["doc_id"]))


@query("u04_exclusion_union", f"WITH {SETS} SELECT scenario, id FROM excl")
def u04(spark, d):
    from evalspark.bindings.base import SCENARIOS
    return P.compose_exclusions(exclusion_sets(spark, d), SCENARIOS).select("scenario", "id")


@query("u06_snapshot_comparison", """WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderstatus <> 'P')
SELECT *, 'only_left' AS side FROM (SELECT o_orderkey, o_orderstatus FROM orders EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'only_right' FROM (SELECT * FROM b EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM orders)""")
def u06(spark, d):
    a = table(spark, d, "orders", ["o_orderkey", "o_orderstatus"])
    b = a.where("o_orderstatus <> 'P'").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 1000 == 1, "X").otherwise(F.col("o_orderstatus")))
    return snapshots.row_differences(a, b, ["o_orderkey"])


@query("u06_digest_tree", """WITH o AS (SELECT count(*) AS n, count_if(o_orderkey = (SELECT min(o_orderkey) FROM orders)) AS m FROM orders)
SELECT level::INT AS level, n AS rows_left, n + m AS rows_right, 1::BIGINT AS n_unequal FROM o, range(4) t(level)""")
def u06b(spark, d):
    """One row repeated: one node a level differs, and so the second scan reads one leaf."""
    a = table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"])
    first = a.agg(F.min("o_orderkey")).scalar()
    return snapshots.tree_counts(a, a.unionAll(a.where(F.col("o_orderkey") == first)), ["o_orderkey"]).drop("n_nodes")


# ------------------------------------------------------------------ counts and order


@query("a14_value_counts", "SELECT lang, count(*) AS n_rows FROM documents GROUP BY 1")
def a14(spark, d):
    return A.value_counts(table(spark, d, "documents", ["lang"]), "lang")


@query("a15_distinct_counts", "SELECT count(DISTINCT doc_id) AS n_rows, count(DISTINCT text) AS n_texts, count(DISTINCT source) AS n_sources FROM documents")
def a15(spark, d):
    return table(spark, d, "documents", ["doc_id", "text", "source"]).agg(F.count_distinct("doc_id").alias("n_rows"), F.count_distinct("text").alias("n_texts"), F.count_distinct("source").alias("n_sources"))


@query("a16_token_totals", f"""WITH {RESPONSES}, t AS (SELECT language, CASE WHEN problem_id % 5 = 0 THEN '' ELSE (length(coalesce(generated_response, '')))::VARCHAR END AS tokens FROM responses)
SELECT language, round(sum(try_cast(tokens AS DOUBLE)), 6) AS total_tokens, count(try_cast(tokens AS DOUBLE)) AS n_tokens FROM t GROUP BY 1""")
def a16(spark, d):
    rows = responses(spark, d).select("language", F.when(F.col("problem_id") % 5 == 0, "").otherwise(F.length(F.coalesce("generated_response", F.lit(""))).cast("string")).alias("tokens"))
    return shown(A.token_totals(rows, ["tokens"], ["language"]))


@query("a26_failure_listing", f"WITH {FLAGS} SELECT language, CASE WHEN needs_manual_review = 1 THEN 'flagged' ELSE 'wrong_number' END AS error_type, count(*) AS n_rows FROM scored WHERE is_correct = 0 GROUP BY ALL")
def a26(spark, d):
    wrong = flagged(spark, d).where("is_correct = 0").withColumn("error_type", F.when(F.col("needs_manual_review") == 1, "flagged").otherwise("wrong_number"))
    return wrong.groupBy("language", "error_type").agg(F.count(F.lit(1)).alias("n_rows"))


@query("w01_latest_per_key", """SELECT user_id, event_type, max(event_id) AS event_id, round(arg_max(value, event_id), 6) AS value, count(*) AS n_versions FROM events GROUP BY ALL""")
def w01(spark, d):
    return shown(P.latest_per_key(table(spark, d, "events", ["user_id", "event_type", "event_id", "value"]), ["user_id", "event_type"], [F.col("event_id")]))


@query("w01_first_per_key", """SELECT text, min(doc_id) AS doc_id, count(*) AS n_versions FROM documents GROUP BY text""")
def w01b(spark, d):
    return P.first_per_key(table(spark, d, "documents", ["text", "doc_id"]), ["text"], [F.col("doc_id")])


@query("w13_display_order", f"WITH {LONG} SELECT problem_id, model, language, is_correct FROM long ORDER BY problem_id, CASE WHEN language = 'english' THEN 0 ELSE 1 END, language")
def w13(spark, d):
    return sampling.display_order(results_long(spark, d), "problem_id", "language", "english").select("problem_id", "model", "language", "is_correct")


@query("w14_alternating_plan", """SELECT doc_id, (t - 1)::INT AS turn, CASE WHEN (doc_id % 2 = 1) = (t = 1) THEN 'english' ELSE 'arabic' END AS language FROM labels, generate_series(1, 2) g(t)""")
def w14(spark, d):
    return sampling.alternating_plan(table(spark, d, "labels", ["doc_id"]), "doc_id", "english", "arabic")


@query("w15_first_mismatches", f"WITH {PAIRS} SELECT problem_id, a AS a_correct, b AS b_correct FROM pairs WHERE model = 'm1' AND a <> b ORDER BY problem_id LIMIT 20")
def w15(spark, d):
    return m1_pairs(spark, d).where("a_correct <> b_correct").orderBy("problem_id").limit(20).select("problem_id", "a_correct", "b_correct")


@query("w04_position_numbering", "SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) + 100 AS position FROM documents WHERE lang <> 'en'")
def w04(spark, d):
    from evalspark.operators.ranges import numbered
    return numbered(table(spark, d, "documents", ["doc_id", "lang"]).where("lang <> 'en'"), "doc_id", "position", 101).select("doc_id", "lang", F.col("position").cast("bigint").alias("position"))
