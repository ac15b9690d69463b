"""The operators bound to the driver's tables, with equivalent SQL where SQL can say it."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import (chat, decontaminate, hard_negatives, html_text, jaccard, line_dedup, near_embeddings, packing, periodic_runs, quality, sharding,
                           toxicity, warc)
from evalspark.llm.shared import kept, ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


LINE_SQL = r"""WITH lines AS (
 SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line
 FROM documents),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (SELECT k FROM common)) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id"""


@query("op2_line_dedup", LINE_SQL)
def op2_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    done = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                       F.sha2(F.col("_kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op7_ngram_jaccard")
def op7_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return jaccard.similar_groups(docs, k=4, num=85, den=100).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query("op1_near_embeddings", """WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN (SELECT id, min(seen) AS component_id FROM reach GROUP BY id) c ON c.id = e.vec_id""")
def op1_near_embeddings(spark: SparkSession, d: str) -> DataFrame:
    found = near_embeddings.embedding_links(table(spark, d, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op4_packing")
def op4_packing(spark: SparkSession, d: str) -> DataFrame:
    pieces = kept(packing.token_pieces(table(spark, d, "documents").select("doc_id", "text"), vocabulary_path()), "pieces")
    return packing.pack(pieces)


@query("op10_quality")
def op10_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").select("doc_id", "quality").where(~quality.held_out(F.col("doc_id")))
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.matches(table(spark, d, "documents"), table(spark, d, "benchmark")).withColumnRenamed("id", "doc_id")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, d, "labels").select("doc_id", "toxic")))
    return scored.select("doc_id", (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"), *[f"p_{c}" for c in toxicity.CATEGORIES])


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    done = html_text.extract(table(spark, d, "pages").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT p.page_id, strlen(p.html) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substr(p.h, CAST((i // 4) * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
 CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p JOIN f USING (h)"""


@query("op5_warc", WARC_SQL)
def op5_warc(spark: SparkSession, d: str) -> DataFrame:
    archives = warc.write_archives(table(spark, d, "pages").select("page_id", "url", "html"))
    return warc.read_archives(archives, with_payload=False).where("status = 'record'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


HARD_TURN = r"\### Assistant: </turn> ok"
CHAT_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, sha256(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(14 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


@query("op3_chat_formatting", CHAT_SQL)
def op3_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TURN), (-7, 1, "assistant", HARD_TURN)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_log(chat.events_of(rows.unionByName(hard))))


#: CRC-32 of a list of bytes, in SQL: the table's entries come from eight steps of the polynomial each.
CRC_TABLE = """(SELECT list(e ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e
 FROM range(256) t(i)))"""


def crc_sql(values: str, steps: str = "steps") -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, b: xor(c >> 8, {steps}[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295::BIGINT)"


SHARDS = 16
SHARD_SQL = f"""WITH k AS (SELECT {CRC_TABLE} AS steps), d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
  {crc_sql("list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))")} AS text_crc32 FROM documents, k),
c AS (SELECT doc_id, s, -ln((CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656) AS cost FROM d, range({SHARDS + 1}) t(s)),
h AS (SELECT doc_id, arg_min(s, cost) FILTER (s < {SHARDS}) AS shard, arg_min(s, cost) AS grown_shard FROM c GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, grown_shard::INT AS grown_shard, row_number() OVER (PARTITION BY shard ORDER BY
  md5(coalesce(doc_id::VARCHAR, '') || chr(31) || size || chr(31) || text_crc32 || chr(31) || grown_shard)) - 1 AS slot FROM d JOIN h USING (doc_id)"""


@query("op11_sharding", SHARD_SQL)
def op11_sharding(spark: SparkSession, d: str) -> DataFrame:
    """Law ``key``: the place depends on doc_id and the number of shards alone, so equal texts of different ids may lie apart."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, d, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.place(docs, "doc_id", sharding.equal_weights(SHARDS))
    placed = sharding.place(placed, "doc_id", sharding.equal_weights(SHARDS + 1), out="grown_shard")
    return sharding.slots(placed, "shard", ["doc_id", "size", "text_crc32", "grown_shard"]).withColumn("law", F.lit("key"))


HARD_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 3"""


@query("op12_hard_negatives", HARD_SQL)
def op12_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


RUNS_SQL = rf"""WITH k AS (SELECT {CRC_TABLE} AS steps),
d0 AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w,
  {crc_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} AS h FROM documents, k),
d1 AS (SELECT *, len(w) AS n, h // 10 AS g FROM d0),
d2 AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM d1),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END + 1]) ELSE w END AS w FROM d2),
grams AS (SELECT doc_id, i, n, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS x FROM d, unnest(range(n - 3)) t(i)),
met AS (SELECT p.doc_id, p.i, q.i - p.i AS lag FROM grams p JOIN grams q ON p.doc_id = q.doc_id AND p.x = q.x AND q.i > p.i AND 2 * (q.i - p.i) <= p.n),
runs0 AS (SELECT doc_id, lag, min(i) AS start, max(i) - min(i) + 4 + lag AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM met)
 GROUP BY doc_id, lag, island),
runs AS (SELECT doc_id, start, length, min(lag) AS period FROM runs0 WHERE length >= greatest(12, 2 * lag) GROUP BY doc_id, start, length),
summary AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period), (-length, start, period)) AS top,
  sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period, (1000 * top.l) // top.p AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256 FROM d LEFT JOIN summary USING (doc_id) LEFT JOIN left_over USING (doc_id)"""


@query("op13_periodic_runs", RUNS_SQL)
def op13_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", periodic_runs.plant_period(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs.periodic_runs(docs).withColumn("top", periodic_runs.longest(F.col("runs")))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "top.start", "top.length", "top.period",
                        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
                        F.sha2(periodic_runs.run_lines(F.col("runs")).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
