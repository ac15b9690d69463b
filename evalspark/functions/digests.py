"""Group keys, record digests and order-independent table digests (F-18..F-20)."""
import json
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGEST_PATTERN = "^[0-9a-f]{64}$"


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def seeded(seed, *parts) -> Column:
    """Digest of ``seed:part:part…``; hex order equals integer order."""
    cells = [p if isinstance(p, Column) else F.lit(str(p)) for p in (seed, *parts)]
    return sha(F.concat_ws(":", *[c.cast("string") for c in cells]))


def collapse_space(c: Column) -> Column:
    """Trim and one blank per white-space run; single blanks, the common case, are not even matched."""
    return F.btrim(F.regexp_replace(c, r"[^\S ]\s*| \s+", " "))


# Plain UDFs get 100 rows at a time, Arrow ones 10,000: whole texts of that many rows would have to fit into each Python worker.
@F.udf(T.StringType(), useArrow=False)
def _nfkc_collapsed(text: str | None) -> str | None:
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).split())


def normalized_text(c: Column) -> Column:
    """NFKC plus white-space collapse. Pure ASCII texts never leave the JVM: a null is shipped for them."""
    ascii_only = c.rlike(r"^[\x00-\x1B\x20-\x7F]*$")
    return F.coalesce(F.when(ascii_only, collapse_space(c)), _nfkc_collapsed(F.when(~ascii_only, c)))


def group_key(c: Column, unicode_form: bool = True) -> Column:
    """Problem group key (F-18). ``unicode_form=False`` leaves out NFKC."""
    return sha(normalized_text(c) if unicode_form else collapse_space(c))


def sorted_fields(c: Column, dtype: T.DataType) -> Column:
    """The same value with struct fields in name order at every level."""
    if isinstance(dtype, T.StructType):
        inner = F.struct(*[sorted_fields(c[f.name], f.dataType).alias(f.name)
                           for f in sorted(dtype.fields, key=lambda f: f.name)])
        return F.when(c.isNotNull(), inner)
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, (T.StructType, T.ArrayType)):
        return F.transform(c, lambda x: sorted_fields(x, dtype.elementType))
    return c


def canonical_json(df: DataFrame, column: str | None = None) -> Column:
    """Compact JSON with sorted keys and explicit nulls of one struct column, or of the whole row."""
    if column:
        value = sorted_fields(F.col(column), df.schema[column].dataType)
    else:
        value = F.struct(*[sorted_fields(F.col(f.name), f.dataType).alias(f.name)
                           for f in sorted(df.schema.fields, key=lambda f: f.name)])
    return F.to_json(value, {"ignoreNullFields": "false"})


def canonical_digest(df: DataFrame, column: str | None = None) -> Column:
    """Digest that binds a record to its exact content (F-19)."""
    return sha(canonical_json(df, column))


@F.udf(T.StringType(), useArrow=False)
def reserialized(line: str | None) -> str | None:
    """A raw JSON line with keys sorted and ``", "`` / ``": "`` separators, unknown keys kept (F-20)."""
    return None if line is None else json.dumps(json.loads(line), sort_keys=True, ensure_ascii=False)


def raw_row_id(line: Column, prefix: str = "trace_") -> Column:
    return F.concat(F.lit(prefix), sha(reserialized(line)))


def digest_limbs(digest: Column) -> list[Column]:
    """A 64-hex digest as four unsigned 64-bit numbers."""
    return [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)") for i in range(4)]


def table_digest(digest: Column, count_name: str = "n_rows", name: str = "table_sha256") -> list[Column]:
    """Order-independent digest of a set of rows, as columns for ``agg``.

    The row digests are added limb by limb, so the work is a plain partial aggregation: no row order,
    no single task that reads everything. Same rows in any order and partitioning give the same value.
    """
    sums = [F.coalesce(F.sum(x), F.lit(0).cast("decimal(38,0)")).cast("string") for x in digest_limbs(digest)]
    return [F.count(digest).alias(count_name),
            sha(F.concat_ws(":", F.count(digest).cast("string"), *sums)).alias(name)]
