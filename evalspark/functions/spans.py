"""Protected spans, placeholders and script checks (F-13..F-17)."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.numbers import number_sequence
from evalspark.functions.text import is_filled

# Fixed values. Display math, inline math (escaped dollars allowed), bracket math, diagram markers.
PROTECTED = r"(?s)(\$\$.*?\$\$|\$[^$\\]*(?:\\.[^$\\]*)*\\?\$|\\\[.*?\\\]|\[\*\s*\{.*?\}\s*\])"
TOKEN = r"<M(\d+)>"
ARABIC_BLOCK = r"[\x{0600}-\x{06FF}]"


def protected_spans(c: Column) -> Column:
    """Spans in order. Every kind of span holds a dollar sign or a bracket, so most texts skip the pattern."""
    return F.when(c.contains("$") | c.contains("["), F.regexp_extract_all(c, F.lit(PROTECTED), F.lit(1))) \
        .when(c.isNotNull(), F.array().cast("array<string>"))


def has_arabic(c: Column) -> Column:
    return c.rlike(ARABIC_BLOCK)


def _interleave(pieces: Column, fill: Column) -> Column:
    """pieces[0] fill[0] pieces[1] fill[1] … as one text."""
    return F.array_join(F.zip_with(pieces, fill, lambda p, f: F.concat(
        F.coalesce(p, F.lit("")), F.coalesce(f, F.lit("")))), "")


def to_template(c: Column) -> Column:
    """Spans replaced by ``<M0>``, ``<M1>``, … in order (F-15)."""
    tokens = F.transform(protected_spans(c), lambda _, i: F.concat(F.lit("<M"), i.cast("string"), F.lit(">")))
    return _interleave(F.split(c, PROTECTED, -1), tokens)


def draft_tokens(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1)), lambda x: x.try_cast("int"))


def tokens_in_order(draft: Column, spans: Column) -> Column:
    """Tokens are exactly 0..n-1 in order."""
    return draft_tokens(draft) == F.transform(spans, lambda _, i: i)


def fill_template(draft: Column, spans: Column) -> Column:
    """Placeholders replaced by the spans, position by position; valid once the tokens are in order."""
    return _interleave(F.split(draft, TOKEN, -1), spans)


def restore_problem(source: Column, draft: Column) -> Column:
    """Name of the first broken preservation rule, null when the draft restores cleanly (F-14)."""
    spans = protected_spans(source)
    return placed_problem(source, draft, spans, fill_template(draft, spans))


def placed_problem(source: Column, draft: Column, spans: Column, restored: Column) -> Column:
    """The same with the spans and the restored text already at hand."""
    return F.when(~is_filled(draft), "empty_translation") \
        .when(~tokens_in_order(draft, spans), "protected_tokens_mismatch") \
        .when(protected_spans(restored) != spans, "protected_spans_changed") \
        .when(number_sequence(source) != number_sequence(restored), "numeric_sequence_changed") \
        .when(~has_arabic(restored), "no_arabic_text")


def restored_text(source: Column, draft: Column) -> Column:
    return fill_template(draft, protected_spans(source))


def recheck_problem(source: Column, translated: Column) -> Column:
    """The same rules on a text whose spans are already filled in (used again at export)."""
    return F.when(~is_filled(translated), "empty_translation") \
        .when(protected_spans(source) != protected_spans(translated), "protected_spans_changed") \
        .when(number_sequence(source) != number_sequence(translated), "numeric_sequence_changed") \
        .when(~has_arabic(translated), "no_arabic_text")


def apply_rules(text: Column, rules: Column) -> Column:
    """Comparison copy: ordered literal replacements from an array of (find, repl) (F-17).

    ``rules`` comes from a left join on (record, step); null means no approved change.
    """
    return F.aggregate(F.coalesce(rules, F.array().cast("array<struct<find:string,repl:string>>")), text,
                       lambda acc, r: F.replace(acc, r["find"], r["repl"]))
