"""Registry, base frames and the matching SQL fragments."""
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.functions.numbers import WIDE_BLANKS
from evalspark.session import ensure_checkpoint_dir
from evalspark.sources.readers import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL; no SQL means a rows-only check next to our own tests."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; 0.0 is added so that a negative zero prints like zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for what a query writes and reads again."""
    folder = ensure_checkpoint_dir(spark)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- paired outcomes
SIDES = ("arabic", "english")
MODELS = ("m1", "m2")


def results_long(spark: SparkSession, d: str) -> DataFrame:
    """Long results: model m1 from labels (toxic, quality), model m2 from the documents behind them."""
    labels = table(spark, d, "labels", ["doc_id", "quality", "toxic"])
    docs = table(spark, d, "documents", ["doc_id", "lang", "n_chars"])
    joined = labels.join(docs, "doc_id", "left")
    m2 = F.when(F.col("lang").isNotNull(), F.lit("m2"))
    cells = F.array(*[F.struct(m.alias("model"), F.lit(s).alias("language"), v.cast("int").alias("is_correct")) for m, s, v in (
        (F.lit("m1"), "arabic", F.col("toxic")), (F.lit("m1"), "english", F.col("quality")),
        (m2, "arabic", F.col("lang") == "en"), (m2, "english", F.col("n_chars") > 1000))])
    return joined.select(F.col("doc_id").alias("problem_id"), F.inline(cells)).where(F.col("model").isNotNull())


LONG = """long AS (
 SELECT doc_id AS problem_id, 'm1' AS model, 'arabic' AS language, toxic AS is_correct FROM labels
 UNION ALL SELECT doc_id, 'm1', 'english', quality FROM labels
 UNION ALL SELECT l.doc_id, 'm2', 'arabic', (d.lang = 'en')::INT FROM labels l JOIN documents d USING (doc_id)
 UNION ALL SELECT l.doc_id, 'm2', 'english', (d.n_chars > 1000)::INT FROM labels l JOIN documents d USING (doc_id))"""
PAIRS = LONG + """, pairs AS (
 SELECT model, problem_id, max(is_correct) FILTER (language = 'arabic') AS a, max(is_correct) FILTER (language = 'english') AS b
 FROM long GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)"""
WIDE = LONG + """, wide0 AS (
 SELECT problem_id, max(is_correct) FILTER (model='m1' AND language='arabic') AS m1_a, max(is_correct) FILTER (model='m1' AND language='english') AS m1_b,
  max(is_correct) FILTER (model='m2' AND language='arabic') AS m2_a, max(is_correct) FILTER (model='m2' AND language='english') AS m2_b
 FROM long GROUP BY ALL), wide AS (
 SELECT *, m1_b-m1_a AS gap_1, m2_b-m2_a AS gap_2, (m2_b-m2_a)-(m1_b-m1_a) AS gap_difference FROM wide0
 WHERE m1_a IS NOT NULL AND m1_b IS NOT NULL AND m2_a IS NOT NULL AND m2_b IS NOT NULL)"""

SCENARIOS = {"full": [], "no_fr": ["fr"], "no_fr_src1": ["fr", "src1"], "strict": ["fr", "src1", "long"]}


def exclusion_sets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", ["doc_id", "lang", "source", "n_chars"])
    sets = F.filter(F.array(F.when(F.col("lang") == "fr", "fr"), F.when(F.col("source") == "src1", "src1"),
                            F.when(F.col("n_chars") > 4000, "long")), lambda x: x.isNotNull())
    return docs.select(F.explode(sets).alias("set_name"), F.col("doc_id").alias("id"))


SETS = """sets AS (
 SELECT 'fr' AS set_name, doc_id AS id FROM documents WHERE lang = 'fr'
 UNION ALL SELECT 'src1', doc_id FROM documents WHERE source = 'src1'
 UNION ALL SELECT 'long', doc_id FROM documents WHERE n_chars > 4000),
 plan(scenario, set_name) AS (VALUES ('no_fr','fr'), ('no_fr_src1','fr'), ('no_fr_src1','src1'), ('strict','fr'), ('strict','src1'), ('strict','long')),
 names(scenario) AS (VALUES ('full'), ('no_fr'), ('no_fr_src1'), ('strict')),
 excl AS (SELECT DISTINCT scenario, id FROM plan JOIN sets USING (set_name))"""


# ---------------------------------------------------------------- scores
def scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", ["event_id", "user_id", "event_type", "value"]).select(
        F.col("event_id"), F.col("user_id").alias("problem_id"), F.col("event_type").alias("category"), F.col("value").alias("score"),
        (F.col("event_type") == "click").cast("int").alias("label"))


SCORES = """scores AS (SELECT event_id, user_id AS problem_id, event_type AS category, value AS score,
 (event_type = 'click')::INT AS label FROM events)"""


# ---------------------------------------------------------------- stored responses
def responses(spark: SparkSession, d: str) -> DataFrame:
    """Response texts of twelve shapes derived from orders: one row per (problem, language)."""
    return responses_of(spread(table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]), "o_orderkey"))


def responses_of(o: DataFrame) -> DataFrame:
    """Row-local, so it also runs on a stream of orders."""
    base = o.selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "o_orderkey div 2 AS problem_id",
                        "CASE WHEN o_orderkey % 2 = 0 THEN 'english' ELSE 'arabic' END AS language",
                        "cast((o_orderkey div 2 + 5 * (o_orderkey % 2)) % 12 AS int) AS shape",
                        "cast(round(o_totalprice * 100) AS bigint) AS cents")
    base = base.selectExpr("*", "cents div 100 AS whole", "concat(cast(cents div 100 AS string), '.', lpad(cast(cents % 100 AS string), 2, '0')) AS txt")
    base = base.selectExpr(
        "*", "CASE WHEN whole >= 1000 THEN concat(cast(whole div 1000 AS string), ',', lpad(cast(whole % 1000 AS string), 3, '0')) ELSE cast(whole AS string) END AS grouped",
        "translate(cast(whole AS string), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS eastern", "translate(cast(whole AS string), '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS persian")
    s = F.col("shape")
    text = F.when(s == 0, F.concat(F.lit("We add the items. FINAL\u202fANSWER:\xa0"), "txt", F.lit(" after 5 days"))) \
        .when(s == 1, F.concat(F.lit("It takes 3 steps.\nfinal  answer :  "), "grouped")) \
        .when(s == 2, F.concat(F.lit("الإجابة\u3000النهائية:\u2009"), "eastern")) \
        .when(s == 3, F.concat(F.lit("FINAL ANSWER: "), F.col("whole").cast("string"), F.lit(" and later FINAL ANSWER: "), (F.col("whole") + 1).cast("string"))) \
        .when(s == 4, F.concat(F.lit("so \\boxed{ "), "txt", F.lit("} is it"))) \
        .when(s == 5, F.concat(F.lit("about "), F.col("whole").cast("string"), F.lit(" of 6/25"))) \
        .when(s == 6, F.lit("no number here")) \
        .when(s == 7, F.concat(F.lit("FINAL ANSWER: $"), "grouped")) \
        .when(s == 8, F.concat(F.lit("FINAL ANSWER: The final answer is "), F.col("whole").cast("string"), F.lit(". Therefore, the answer is "), F.col("whole").cast("string"))) \
        .when(s == 9, F.concat(F.lit("إذن، الإجابة هي "), "persian", F.lit(" والجواب هو "), "persian")) \
        .when(s == 10, F.concat(F.lit("FINALANSWER: -.5 or "), "grouped", F.lit(".50")))
    gold = F.when(F.col("o_custkey") % 7 == 0, (F.col("whole") + 1).cast("string")).when(s.isin(0, 4), F.col("txt")).otherwise(F.col("whole").cast("string"))
    return base.select(
        "problem_id", "language", F.concat(F.lit("m"), (F.col("problem_id") % 3).cast("string")).alias("model"),
        text.alias("generated_response"), gold.alias("gold_answer"),
        F.when(F.col("o_orderstatus") == "P", "length").otherwise("stop").alias("finish_reason"),
        F.when(F.col("o_custkey") % 11 == 0, "error").otherwise("success").alias("status"), "o_custkey", "txt", "grouped", "eastern")


RESPONSES = r"""resp0 AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderkey // 2 AS problem_id,
  CASE WHEN o_orderkey % 2 = 0 THEN 'english' ELSE 'arabic' END AS language, (o_orderkey // 2 + 5 * (o_orderkey % 2)) % 12 AS shape,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
 resp1 AS (SELECT *, cents // 100 AS whole, (cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS txt FROM resp0),
 resp2 AS (SELECT *, CASE WHEN whole >= 1000 THEN (whole // 1000)::VARCHAR || ',' || lpad((whole % 1000)::VARCHAR, 3, '0') ELSE whole::VARCHAR END AS grouped,
  translate(whole::VARCHAR, '0123456789', '٠١٢٣٤٥٦٧٨٩') AS eastern, translate(whole::VARCHAR, '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS persian FROM resp1),
 responses AS (SELECT problem_id, language, 'm' || (problem_id % 3)::VARCHAR AS model,
  CASE shape WHEN 0 THEN 'We add the items. FINAL' || chr(8239) || 'ANSWER:' || chr(160) || txt || ' after 5 days'
   WHEN 1 THEN 'It takes 3 steps.' || chr(10) || 'final  answer :  ' || grouped
   WHEN 2 THEN 'الإجابة' || chr(12288) || 'النهائية:' || chr(8201) || eastern
   WHEN 3 THEN 'FINAL ANSWER: ' || whole || ' and later FINAL ANSWER: ' || (whole + 1)
   WHEN 4 THEN 'so \boxed{ ' || txt || '} is it' WHEN 5 THEN 'about ' || whole || ' of 6/25' WHEN 6 THEN 'no number here'
   WHEN 7 THEN 'FINAL ANSWER: $' || grouped
   WHEN 8 THEN 'FINAL ANSWER: The final answer is ' || whole || '. Therefore, the answer is ' || whole
   WHEN 9 THEN 'إذن، الإجابة هي ' || persian || ' والجواب هو ' || persian
   WHEN 10 THEN 'FINALANSWER: -.5 or ' || grouped || '.50' END AS generated_response,
  CASE WHEN o_custkey % 7 = 0 THEN (whole + 1)::VARCHAR WHEN shape IN (0, 4) THEN txt ELSE whole::VARCHAR END AS gold_answer,
  CASE WHEN o_orderstatus = 'P' THEN 'length' ELSE 'stop' END AS finish_reason,
  CASE WHEN o_custkey % 11 = 0 THEN 'error' ELSE 'success' END AS status, o_custkey, txt, grouped, eastern FROM resp2)"""


# SQL text of number rules, as fragments.
def sql_digits(x: str) -> str:
    return f"translate({x}, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789')"


def sql_text(x: str) -> str:
    """Digits and blanks of Unicode as ASCII."""
    wide = " || ".join(f"chr({ord(c)})" for c in WIDE_BLANKS)
    return f"translate({sql_digits(x)}, {wide}, '{' ' * len(WIDE_BLANKS)}')"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_canon(x: str) -> str:
    """Canonical text of a parsable number through DECIMAL: an independent route to the same text."""
    return (f"(SELECT CASE WHEN d = 0 THEN '0' ELSE regexp_replace(regexp_replace(d::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') END "
            f"FROM (SELECT try_cast({x} AS DECIMAL(38,10)) AS d))")


SQL_PARSABLE = r"'^[-+]?(?:\d+\.?\d*|\.\d+)$'"


def sql_norm(x: str, percent: bool = False) -> str:
    """Decimal variant."""
    marks = ",٬$" + ("%" if percent else "")
    cleaned = sql_strip(f"translate({sql_strip(sql_digits(x))}, '٫{marks}', '.')")
    return f"(SELECT CASE WHEN regexp_matches(t, {SQL_PARSABLE}) THEN {sql_canon('t')} ELSE t END FROM (SELECT {cleaned} AS t))"


# ---------------------------------------------------------------- trajectories from documents
def trajectories(spark: SparkSession, d: str) -> DataFrame:
    """Documents as staged trajectories: lines are steps, ratings from line lengths, cut after the first -1."""
    docs = spread(table(spark, d, "documents", ["doc_id", "text", "lang", "source"]), "doc_id")
    lines = F.split("text", "\n", -1)
    rated = docs.withColumn("_all", lines).withColumn("_r", F.transform("_all", lambda s: (F.length(s) % 3 - 1).cast("int")))
    first = F.array_position("_r", F.lit(-1)).cast("int")
    cut = rated.withColumn("_first", first).withColumn("_n", F.when(F.col("_first") > 0, F.col("_first")).otherwise(F.size("_all")))
    ratings = F.slice("_r", 1, F.col("_n"))
    return cut.select(
        "doc_id", "lang", "source", "text", F.slice("_all", 1, F.col("_n")).alias("steps"), ratings.alias("source_step_ratings"),
        F.transform(ratings, lambda r: F.when(r == 1, 1).when(r == -1, 0)).alias("step_labels"),
        F.transform(ratings, lambda r: (r != 0).cast("int")).alias("supervision_mask"),
        F.nullif(F.col("_first"), F.lit(0)).alias("first_error_step"),
        F.when(F.col("_first") > 0, "incorrect").otherwise("correct").alias("variant"),
        (F.col("doc_id") % 4).cast("int").alias("generation"),
        F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("train").alias("split"))


TRAJ = """traj0 AS (SELECT doc_id, lang, source, text, string_split(text, chr(10)) AS all_steps FROM documents),
 traj1 AS (SELECT *, list_transform(all_steps, lambda s: CAST(length(s) % 3 - 1 AS INT)) AS all_ratings FROM traj0),
 traj2 AS (SELECT *, coalesce(list_position(all_ratings, -1), 0) AS fe FROM traj1),
 traj3 AS (SELECT *, CASE WHEN fe > 0 THEN fe ELSE len(all_steps) END AS n FROM traj2),
 traj AS (SELECT doc_id, lang, source, text, n, all_steps[1:n] AS steps, all_ratings[1:n] AS ratings, nullif(fe, 0) AS first_error,
  CASE WHEN fe > 0 THEN 'incorrect' ELSE 'correct' END AS variant, CAST(doc_id % 4 AS INT) AS generation,
  CASE WHEN doc_id % 5 = 0 THEN 'dev' ELSE 'train' END AS split FROM traj3)"""


# ---------------------------------------------------------------- exact resampling
#: From vals(g, a, c), the counted outcomes of each group: limits(g, n, ci_low, ci_high), by convolving one draw after the other.
LIMITS = """shares AS (SELECT g, a, c / sum(c) OVER (PARTITION BY g) AS p, sum(c) OVER (PARTITION BY g) AS n FROM vals),
 conv(g, k, s, p) AS (SELECT DISTINCT g, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE FROM shares
  UNION ALL SELECT conv.g, k + 1, s + a, sum(conv.p * shares.p) FROM conv JOIN shares ON conv.g = shares.g AND k < n GROUP BY conv.g, k, s + a),
 ends AS (SELECT conv.g, n, s, sum(p) OVER (PARTITION BY conv.g ORDER BY s) AS upto FROM conv JOIN (SELECT DISTINCT g, n FROM shares) m ON m.g = conv.g AND k = n),
 limits AS (SELECT g, any_value(n)::BIGINT AS n, min(s) FILTER (upto >= 0.025 - 1e-13) / any_value(n) AS ci_low, min(s) FILTER (upto >= 0.975 - 1e-13) / any_value(n) AS ci_high FROM ends GROUP BY g)"""

#: From sizes(g, a, c) with a > 0 and seen(g, x): signs(g, sign_p), the chance that the sizes with random signs sum to |x| or more, by a full period of frequencies.
SIGNS = """spans AS (SELECT g, sum(a * c)::BIGINT AS span FROM sizes GROUP BY g),
 waves AS (SELECT g, k, span, 2 * pi() * k / (2 * span + 1) AS t FROM spans, unnest(range(1, span + 1)) u(k)),
 factors AS (SELECT w.g, k, t, span, product(pow(cos(a * t), c)) AS f FROM waves w JOIN sizes ON sizes.g = w.g GROUP BY ALL),
 inside AS (SELECT f.g, (any_value(2 * abs(x) - 1) + 2 * sum(f * sin((abs(x) - 0.5) * t) / sin(t / 2))) / any_value(2 * span + 1) AS p FROM factors f JOIN seen ON seen.g = f.g GROUP BY f.g),
 signs AS (SELECT seen.g, CASE WHEN x = 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - p)) END AS sign_p FROM seen LEFT JOIN inside USING (g))"""
