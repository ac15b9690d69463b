"""Strict JSON acceptance (S-05).

VARIANT parsing already refuses duplicate keys, NaN and Infinity, but takes text after the value. A value
that spans the whole line is the only one whose last character closes the object it opened, which a second
parse of the text in brackets proves: ``[{...} x]`` is no JSON array.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import is_filled


def strict_object(line: Column) -> Column:
    """VARIANT of a JSON object line, null for anything a strict reader refuses."""
    trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")
    whole = F.try_parse_json(F.concat(F.lit("["), trimmed, F.lit("]"))).isNotNull()
    object_like = trimmed.startswith("{") & trimmed.endswith("}")
    value = F.try_parse_json(trimmed)
    # Two objects side by side ("{} , {}") pass both tests as one array; its size tells.
    single = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), trimmed, F.lit("]"))), "$[1]", "string").isNull()
    return F.when(object_like & whole & single & F.schema_of_variant(value).startswith("OBJECT"), value)


def strict_problem(line: Column) -> Column:
    """Why a line is refused: ``not_object`` (valid JSON of another kind) or ``malformed``; null when accepted."""
    trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")
    listed = F.try_parse_json(F.concat(F.lit("["), trimmed, F.lit("]")))
    return F.when(strict_object(line).isNotNull(), None).when(listed.isNotNull() & F.try_parse_json(trimmed).isNotNull()
                                                              & ~trimmed.startswith("{"), "not_object").otherwise("malformed")
