"""A corpus from documents to training sequences: quality, shared lines, near copies, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of documents, with ``text``
and ``n_chars`` as changed. Near copies and passages are told by content (64-bit hashes of id and text), so that rows without doc_id or with a shared one are
linked and matched each by its own text.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import decontaminate, jaccard, line_dedup, packing, quality
from evalspark.llm.queries import table, vocabulary_path
from evalspark.llm.shared import kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_QUALITY, LINE_DOCS, SHINGLE_WORDS, SIMILARITY = 0.7, 10, 5, (80, 100)
#: Keys up to which they go to the texts by broadcast (some 32 bytes each).
SENT = 1_500_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from ``labels``, does not reject."""
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), weights, out="_score").where(F.col("_score") >= MIN_QUALITY).select(*COLUMNS)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least LINE_DOCS documents go from every document."""
    done = line_dedup.apply_bitmaps(docs.select(*COLUMNS), line_dedup.keep_bitmaps(docs, min_docs=LINE_DOCS))
    text = F.when(F.col("_n_dropped") > 0, F.col("_kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("_n_dropped") > 0, F.char_length("_kept_text").cast("bigint")).otherwise(F.col("n_chars"))
    return done.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows linked by similar shingle sets, the one of smallest doc_id (rows without one come last); of equal rows one."""
    keyed = docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("_key"))
    groups = jaccard.similar_groups(keyed.select(F.col("_key").alias("doc_id"), "text"), k=SHINGLE_WORDS, num=SIMILARITY[0], den=SIMILARITY[1])
    rows = kept(groups.where("n_shingles > 0").groupBy(F.col("id").alias("_key"), "component").agg(F.count(F.lit(1)).alias("n")), "groups")
    many = rows.groupBy("component").agg(F.count(F.lit(1)).alias("keys")).where("keys > 1").select("component")
    members = kept(keyed.select("_key", "doc_id").join(rows.join(many, "component").select("_key", "component"), "_key").distinct(), "members")
    first = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("_first"))
    others = kept(members.join(first, "component").where("_key <> _first").select("_key"), "others")
    left = keyed.join(F.broadcast(others) if others.count() <= SENT else others, "_key", "left_anti")  # else the texts are shuffled
    repeated = kept(rows.where("n > 1").select("_key"), "repeated")
    if repeated.isEmpty():
        return left.select(*COLUMNS)
    one = left.join(repeated, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return left.join(repeated, "_key", "left_anti").select(*COLUMNS).unionAll(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of ``benchmark`` within its budget of word edits."""
    texts = table(spark, sf_dir, "benchmark").select(F.xxhash64("text").alias("item_id"), "text")  # every text counts, whatever its id
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("_key"))
    hits = kept(decontaminate.matches(keyed, texts, id_col="_key").select(F.col("id").alias("_key")).distinct(), "hits")
    return keyed.join(hits, "_key", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(kept(packing.token_pieces(docs, vocabulary_path()), "pieces"))


STAGES = [("quality", keep_quality), ("shared_lines", drop_shared_lines), ("near_copies", keep_one_of_near_copies),
          ("decontamination", drop_contaminated), ("packing", pack_sequences)]

#: A learned classifier and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
