"""Comparison of two snapshots by a tree of digests (J-14, U-06, C-22).

Rows fall into leaves by the hash of their key. A leaf's digest is the number of its rows and sums of two 64-bit row hashes: independent of order, with
multiplicity, added up on the map side. Inner nodes add up their children. Only rows of leaves that differ are compared with each other; equal
snapshots exchange digests and nothing else, and a stored tree stands in for its snapshot.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF_BITS, FAN_BITS = 12, 4     # 4,096 leaves, 16 children a node
WORDS = ["n", "d0", "d1", "d2", "d3"]


def _shown(columns: list[str]) -> list[Column]:
    """Hashes skip nulls; the flags say where they were."""
    return [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]


def leaf_of(keys: list[str], bits: int = LEAF_BITS) -> Column:
    return F.pmod(F.xxhash64(*_shown(keys)), F.lit(1 << bits)).cast("int")


def leaf_digests(df: DataFrame, keys: list[str], bits: int = LEAF_BITS) -> DataFrame:
    """(leaf, n, d0..d3); halves of the hashes are summed, so that a sum holds for 2**31 rows of a leaf."""
    seen = _shown(sorted(df.columns))
    hashed = df.select(leaf_of(keys, bits).alias("leaf"), F.xxhash64(*seen).alias("a"), F.xxhash64(F.lit("second"), *seen).alias("b"))
    low = lambda c: F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    high = lambda c: F.sum(F.shiftrightunsigned(c, 32))
    return hashed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), low("a").alias("d0"), high("a").alias("d1"), low("b").alias("d2"), high("b").alias("d3"))


def digest_tree(df: DataFrame, keys: list[str], bits: int = LEAF_BITS) -> DataFrame:
    """(level, node, n, d0..d3) from the root (level 0) to the leaves. A few thousand rows that can be kept with a snapshot.

    Sums of inner nodes are taken modulo 2**60.
    """
    leaves = leaf_digests(df, keys, bits)
    levels = -(-bits // FAN_BITS)
    path = F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright("leaf", max(0, bits - level * FAN_BITS)).alias("node")) for level in range(levels + 1)])
    small = [F.pmod(F.sum(F.col(w).cast("decimal(38,0)")), F.lit(1 << 60).cast("decimal(38,0)")).cast("bigint").alias(w) for w in WORDS]
    return leaves.withColumn("at", F.explode(path)).groupBy("at.level", "at.node").agg(*small)


def unequal_nodes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(level, node) whose digests differ between two trees or are in one of them only; below equal nodes nothing differs."""
    left, right = (t.select("level", "node", F.struct(*WORDS).alias(name)) for t, name in ((a, "l"), (b, "r")))
    return left.join(right, ["level", "node"], "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select("level", "node")


def _unequal_leaves(left: DataFrame, right: DataFrame, keys: list[str], bits: int) -> DataFrame:
    a, b = (leaf_digests(t, keys, bits).select("leaf", F.struct(*WORDS).alias(name)) for t, name in ((left, "l"), (right, "r")))
    return a.join(b, "leaf", "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select("leaf")


def differing_parts(left: DataFrame, right: DataFrame, keys: list[str] | None = None, bits: int = LEAF_BITS) -> tuple[DataFrame, DataFrame]:
    """Both tables reduced to the leaves that differ; rows of a key stay together. The leaves are at most 2**bits numbers, so they are sent to the rows."""
    keys = keys or left.columns
    leaves = F.broadcast(_unequal_leaves(left, right.select(*left.columns), keys, bits))
    return tuple(t.select(*left.columns, leaf_of(keys, bits).alias("leaf")).join(leaves, "leaf", "left_semi").drop("leaf") for t in (left, right))


def row_differences(left: DataFrame, right: DataFrame, keys: list[str] | None = None, bits: int = LEAF_BITS) -> DataFrame:
    """Rows in one table only, with multiplicity."""
    a, b = differing_parts(left, right, keys, bits)
    return a.exceptAll(b).withColumn("side", F.lit("only_left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_right")))


def tree_counts(left: DataFrame, right: DataFrame, keys: list[str], bits: int = LEAF_BITS) -> DataFrame:
    """(level, n_nodes, n_unequal, rows_left, rows_right): how far a difference reaches, from the two trees alone."""
    a, b = digest_tree(left, keys, bits), digest_tree(right, keys, bits)
    both = a.select("level", "node", F.struct(*WORDS).alias("l")).join(b.select("level", "node", F.struct(*WORDS).alias("r")), ["level", "node"], "full_outer")
    return both.groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(~F.col("l").eqNullSafe(F.col("r"))).alias("n_unequal"),
                                     F.coalesce(F.sum("l.n"), F.lit(0)).alias("rows_left"), F.coalesce(F.sum("r.n"), F.lit(0)).alias("rows_right"))
