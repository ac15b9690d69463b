"""Sets of whole-number ids as containers of 32,768 neighbours (P-07, J-08, W-11).

Dense ids become one bitmap a container (one bit an id, built on the map side), sparse ids an array of at most 32,768 numbers; either way the cost follows the ids
that are there, never the width of the range. Gaps are ranges: a gap is told by the id before it and the next one, which lies in the same container or is
the first of the next one present. Containers find that one through two coarser levels of 32,768 each, so no window holds more than that many rows.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 15
DENSE = 64              # ids are dense when the range is at most so many times their number
IDS_AT_ONCE = 1 << 16


def _container(c: Column) -> Column:
    return F.shiftright(c, 15)


def containers(ids: DataFrame, key: str, by: list[str] | None = None, dense: bool | None = None) -> DataFrame:
    """(by, c, first, last, bits, members): one row a container and group; ``bits`` for dense sets, ``members`` for sparse ones.

    ``dense`` None decides by one aggregate of the column.
    """
    by = by or []
    own = ids.select(*by, F.col(key).cast("bigint").alias("id")).where("id IS NOT NULL")
    if dense is None:
        n, low, high = own.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
        dense = bool(n) and (high - low) // DENSE <= n
    bits = F.bitmap_construct_agg(F.pmod("id", F.lit(WIDTH))) if dense else F.lit(None).cast("binary")
    members = F.lit(None).cast("array<bigint>") if dense else F.collect_set("id")
    return own.groupBy(*by, _container(F.col("id")).alias("c")).agg(F.min("id").alias("first"), F.max("id").alias("last"), bits.alias("bits"), members.alias("members"))


def _ids(c: int, bits: bytes | None, members) -> np.ndarray:
    if bits is None:
        return np.sort(np.asarray(members if members is not None else [], dtype=np.int64))
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) + np.int64(c) * WIDTH


def gap_ranges(ids: DataFrame, key: str, low: int, high: int, dense: bool | None = None) -> DataFrame:
    """(first_id, last_id) of the ids that are not there between ``low`` and ``high``, neighbours joined to the longest ranges."""
    spark = ids.sparkSession
    inside = containers(ids.where(F.col(key).between(low, high)), key, dense=dense)
    up = inside.groupBy(_container(F.col("c")).alias("u")).agg(F.min("first").alias("u_first"))
    top = up.groupBy(_container(F.col("u")).alias("t")).agg(F.min("u_first").alias("t_first"))
    # Ids of 63 bits make at most 2**18 rows of the coarsest level.
    top = top.select("t", F.lead("t_first").over(Window.partitionBy(F.lit(0)).orderBy("t")).alias("t_next"))
    up = up.withColumn("t", _container(F.col("u"))).join(top, "t").select("u", F.coalesce(F.lead("u_first").over(Window.partitionBy("t").orderBy("u")), "t_next").alias("u_next"))
    linked = inside.withColumn("u", _container(F.col("c"))).join(up, "u")
    following = F.coalesce(F.lead("first").over(Window.partitionBy("u").orderBy("c")), "u_next", F.lit(high).cast("bigint") + 1)

    def gaps(batches):
        for batch in batches:
            for c, bits, members, then in zip(*[col.to_pylist() for col in batch.columns]):
                here = np.append(_ids(c, bits, members), then)
                at = np.flatnonzero(np.diff(here) > 1)
                yield pa.RecordBatch.from_arrays([pa.array(here[at] + 1), pa.array(here[at + 1] - 1)], ["first_id", "last_id"])
    found = linked.select("c", "bits", "members", following.alias("following")).mapInArrow(gaps, "first_id bigint, last_id bigint")
    lead = inside.agg(F.coalesce(F.min("first"), F.lit(high).cast("bigint") + 1).alias("m")).select(F.lit(low).cast("bigint").alias("first_id"), (F.col("m") - 1).alias("last_id"))
    return found.unionAll(lead.where("first_id <= last_id"))


def id_gap_ranges(ids: DataFrame, key: str, low: int, high: int, dense: bool | None = None) -> DataFrame:
    """(first_id, last_id, n_ids, problem): ranges missing from low..high, and every id outside it as a range of one (P-07)."""
    missing = gap_ranges(ids, key, low, high, dense).withColumn("problem", F.lit("missing"))
    odd = ids.select(F.col(key).cast("bigint").alias("first_id")).where((F.col("first_id") < low) | (F.col("first_id") > high)).distinct()
    return missing.unionByName(odd.select("first_id", F.col("first_id").alias("last_id"), F.lit("unexpected").alias("problem"))) \
        .select("first_id", "last_id", (F.col("last_id") - F.col("first_id") + 1).alias("n_ids"), "problem")


def single_ids(ranges: DataFrame, first: str = "first_id", last: str = "last_id", out: str = "id") -> DataFrame:
    """Ranges as rows of one id; a long range is cut first, so that no array is long."""
    cut = ranges.withColumn("_at", F.explode(F.sequence(F.col(first), F.col(last), F.lit(IDS_AT_ONCE).cast("bigint"))))
    return cut.withColumn(out, F.explode(F.sequence("_at", F.least(F.col("_at") + IDS_AT_ONCE - 1, F.col(last))))).drop("_at", first, last)


def ids_without(left: DataFrame, right: DataFrame, key: str, by: list[str] | None = None, dense: bool | None = None) -> DataFrame:
    """(by, key): ids of ``left`` that ``right`` lacks, by group (J-08, W-11). Containers meet, not ids."""
    by = by or []
    a = containers(left, key, by, dense).drop("first", "last")
    b = containers(right, key, by, dense).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("c").alias("_c"), F.col("bits").alias("_bits"), F.col("members").alias("_members"))
    same = F.col("c") == F.col("_c")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = a.join(b, same, "left").select(*by, "c", "bits", "members", "_bits", "_members")

    def rest(batches):
        for batch in batches:
            cells = [col.to_pylist() for col in batch.columns[len(by):]]
            for i, (c, bits, members, other, others) in enumerate(zip(*cells)):
                left_over = np.setdiff1d(_ids(c, bits, members), _ids(c, other, others), assume_unique=True)
                if len(left_over):
                    groups = [pa.concat_arrays([batch.column(g).slice(i, 1)]).take(pa.array(np.zeros(len(left_over), np.int64))) for g in range(len(by))]
                    yield pa.RecordBatch.from_arrays([*groups, pa.array(left_over)], [*by, "id"])
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    return met.mapInArrow(rest, "".join(f"`{c}` {kinds[c]}, " for c in by) + "id bigint").withColumnRenamed("id", key)
