"""Validity checks, array/text codecs and prompt text (F-28..F-30)."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.digests import DIGEST_PATTERN
from evalspark.functions.numbers import BLANK_CLASS


def is_iso_date(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(), F.lit(False))


def is_digest(c: Column) -> Column:
    return F.coalesce(c.rlike(DIGEST_PATTERN), F.lit(False))


def is_filled(c: Column) -> Column:
    """Holds something besides white space, of Unicode as well."""
    return F.coalesce(c.rlike(f"[^{BLANK_CLASS}]"), F.lit(False))


def scores_to_text(scores: Column, digits: int = 4) -> Column:
    """Blank-joined fixed-point text, the form used in CSV results."""
    return F.array_join(F.transform(scores, lambda s: F.format_string(f"%.{digits}f", s)), " ")


def text_to_scores(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, " ", -1), lambda s: s != ""), lambda s: s.cast("double"))


def joined(values: Column, sep: str = "|") -> Column:
    return F.array_join(values, sep)


def split_joined(text: Column, sep: str = r"\|") -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, sep, -1))


def array_to_json(values: Column) -> Column:
    return F.to_json(values)


def json_to_array(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def with_prompt(df: DataFrame, templates: dict[str, str], language: str, question: str, out: str = "prompt") -> DataFrame:
    """Prompt per language: the template's ``{question}`` is replaced. Unknown languages give null."""
    prompt = F.lit(None).cast("string")
    for name, template in templates.items():
        prompt = F.when(F.col(language) == name,
                        F.replace(F.lit(template), F.lit("{question}"), F.col(question))).otherwise(prompt)
    return df.withColumn(out, prompt)
