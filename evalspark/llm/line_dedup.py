"""Removal of lines that many documents share, in DataFrame functions only.

Lines become two 64-bit hashes of their key (trimmed of ASCII blanks, A-Z lower-cased). The hashes are cut into ranges with a
secondary sort by document and position; a scan in that order finds where a hash, and where a document of that hash, first
occurs. A salt taken from the document is part of the range key, so that a line which a third of all documents carry spreads over
``salts`` ranges; per range only counts and the first place remain. What comes back per document is the run-length form of a keep
bitmap, not text.

Defined results: a null or empty text is one empty line, whose key of no code points is never dropped. Rows equal in id and text
are one document and each comes back; rows that share an id only are documents of their own; a null id is an id like any other.
Other columns pass through untouched.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.shared import kept

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def folded(text: Column) -> Column:
    """Text with A-Z lower-cased; lower() agrees with that rule on ASCII text and is the faster of the two."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_row"), F.col(text_col).alias("_text"))


def line_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1, salts: int = 64) -> DataFrame:
    """One row per line with a key of at least ``min_chars`` code points, in ranges of the hash, by document and position.

    ``first_here`` marks the first place in its (hash, salt) range, ``new_doc`` the first place of a document in it.
    """
    lines = _identified(docs, id_col, text_col).select("_id", "_row", F.posexplode(lines_of(folded(F.col("_text")))).alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANKS))
    hashed = lines.select("_id", "_row", "pos", F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"),
                          F.char_length(key).alias("n")).where(F.col("n") >= min_chars)
    # Written, so that finding the range limits does not read the texts a second time.
    written = kept(hashed.select("_id", "_row", "pos", "h", "g", F.pmod(F.col("_row"), F.lit(salts)).cast("int").alias("salt")), "lines")
    ranged = written.repartitionByRange("h", "g", "salt")
    order = Window.partitionBy("h", "g", "salt").orderBy("_id", "_row", "pos")
    before = F.lag(F.struct("_id", "_row")).over(order)
    return ranged.select("*", before.alias("_before")).select(
        "_id", "_row", "pos", "h", "g", "salt", F.col("_before").isNull().alias("first_here"),
        (F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.struct("_id", "_row"))).alias("new_doc"))


def line_totals(places: DataFrame) -> DataFrame:
    """Per line hash: in how many documents it occurs, and its first place."""
    by_range = places.groupBy("h", "g", "salt").agg(
        F.count_if("new_doc").alias("n"), F.min(F.when(F.col("first_here"), F.struct("_id", "_row", "pos"))).alias("first"))
    return by_range.groupBy("h", "g").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1,
                 keep_first: bool = False, salts: int = 64) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: (_id, _row, drops), drops sorted runs (first, last) of dropped lines.

    Lines found in at least ``min_docs`` documents go everywhere; with ``keep_first`` their first occurrence stays. A document
    that is not returned keeps all its lines.
    """
    places = line_places(docs, id_col, text_col, min_chars, salts)
    common = line_totals(places).where(F.col("n_docs") >= min_docs).select("h", "g", "first")
    hits = places.join(common, ["h", "g"])
    if keep_first:
        hits = hits.where(~F.col("first").eqNullSafe(F.struct("_id", "_row", "pos")))
    dropped = hits.groupBy("_id", "_row").agg(F.sort_array(F.collect_set("pos")).alias("d"))
    starts = F.filter("d", lambda p, i: (i == 0) | (F.try_element_at("d", F.when(i > 0, i).otherwise(1)) != p - 1))
    ends = F.filter("d", lambda p, i: (i == F.size("d") - 1) | (F.coalesce(F.get("d", i + 1), F.lit(-1)) != p + 1))
    return dropped.select("_id", "_row", F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.struct(
        r["s"].alias("first"), r["e"].alias("last"))).alias("drops"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``_kept_text``, ``_n_lines`` and ``_n_dropped``; rows without a bitmap keep their text as it is."""
    keys = docs.withColumn("_own_row", F.xxhash64(id_col, text_col))
    maps = bitmaps.select(F.col("_id").alias("_map_id"), F.col("_row").alias("_map_row"), F.col("drops").alias("_map_drops"))
    same = F.col(id_col).eqNullSafe(F.col("_map_id")) & (F.col("_own_row") == F.col("_map_row"))
    joined = keys.join(maps, same, "left")
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_lines = (F.regexp_count(text, F.lit("\n")) + 1).cast("long")
    n_dropped = F.coalesce(F.aggregate("_map_drops", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1), F.lit(0)).cast("long")
    lines = lines_of(F.col(text_col))
    after = F.concat(F.array(F.lit(-1)), F.transform("_map_drops", lambda r: r["last"]))
    until = F.concat(F.transform("_map_drops", lambda r: r["first"]), F.array(n_lines.cast("int")))
    runs = F.filter(F.zip_with(after, until, lambda a, b: F.struct((a + 2).alias("at"), (b - a - 1).alias("n"))), lambda r: r["n"] > 0)
    some = F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["at"], r["n"]))), "\n")
    return joined.withColumns({"_n_lines": n_lines, "_n_dropped": n_dropped,
                               "_kept_text": F.when(F.col("_map_drops").isNull(), text).otherwise(some)}).drop("_own_row", "_map_id", "_map_row", "_map_drops")
