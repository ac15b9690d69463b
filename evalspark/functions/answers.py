"""Final-answer extraction from stored responses (F-06..F-10).

Each extractor is a DataFrame step: the regular expressions run once into helper columns, the
verdict reads them. Nothing leaves whole-stage code generation.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.numbers import (
    DOTTED_NUMBER, GROUPED_NUMBER, LOOSE_NUMBER, SIGNED_NUMBER,
    drop_chars, normalize_decimal, normalize_float_text, plain_text,
)

# Marker phrases.
ENGLISH_MARKER = r"FINAL\s+ANSWER"
ARABIC_MARKER = r"الإجابة\s+النهائية"
DOLLAR = r"(?:\$|\\?\$)?\s*"
REPARSE_PATTERNS = (
    ("boxed", rf"(?iu)\\boxed\s*\{{\s*({GROUPED_NUMBER})\s*\}}"),
    ("english_final_phrase", rf"(?iu)FINAL\s+ANSWER\s*:\s*(?:THE\s+FINAL\s+ANSWER\s+IS\s*)?{DOLLAR}({GROUPED_NUMBER})"),
    ("english_final_phrase", rf"(?iu)The\s+final\s+answer\s+is\s*{DOLLAR}({GROUPED_NUMBER})"),
    ("english_final_phrase", rf"(?iu)Therefore[,:\s]+(?:the\s+answer\s+is\s*)?{DOLLAR}({GROUPED_NUMBER})"),
    ("arabic_final_phrase", rf"الإجابة\s+النهائية\s*[:：]?\s*({GROUPED_NUMBER})"),
    ("arabic_final_phrase", rf"الجواب\s+النهائي\s*[:：]?\s*({GROUPED_NUMBER})"),
    ("arabic_final_phrase", rf"الإجابة\s+هي\s*[:：]?\s*({GROUPED_NUMBER})"),
    ("arabic_final_phrase", rf"الجواب\s+هو\s*[:：]?\s*({GROUPED_NUMBER})"),
    ("arabic_final_phrase", rf"إذن[,،:\s]+(?:الإجابة\s+هي\s*)?({GROUPED_NUMBER})"),
)


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _last(c: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(_all(c, pattern, group), F.lit(-1))


def _prepared(df: DataFrame, response: str, full_separators: bool) -> DataFrame:
    text = plain_text(F.coalesce(F.col(response), F.lit("")))
    if full_separators:
        text = F.translate(text, "٬٫", ",.")
    return df.withColumn("_t", text)


def extract_first_marker(df: DataFrame, response: str, out: str = "extracted", full_separators: bool = False) -> DataFrame:
    """Extractor A: the first requested marker wins, disagreeing markers are flagged.

    Falls back to the last boxed number, then to the last number; both are flagged. Adds
    ``out`` = struct(answer, method, needs_review, reason, all_answers).
    ``full_separators`` maps the Arabic separators before matching; by default only digits are mapped.
    """
    marker = rf"(?iu)({ENGLISH_MARKER}|{ARABIC_MARKER})\s*:\s*({GROUPED_NUMBER})"
    t, explicit = F.col("_t"), F.size("_m") > 0
    # The fallbacks run only where no marker was found.
    staged = _prepared(df, response, full_separators) \
        .withColumn("_m", F.transform(_all(t, marker, 2), lambda v: normalize_decimal(v))) \
        .withColumn("_k", F.when(explicit, F.regexp_extract(t, marker, 1))) \
        .withColumn("_b", F.when(~explicit & t.contains("\\boxed"), _last(t, rf"\\boxed\s*\{{\s*({GROUPED_NUMBER})\s*\}}"))) \
        .withColumn("_n", F.when(~explicit & F.col("_b").isNull(), _last(t, f"({GROUPED_NUMBER})"))) \
        .withColumn("_f", normalize_decimal(F.coalesce("_b", "_n")))
    conflict = F.size(F.array_distinct("_m")) > 1
    boxed, number = F.col("_b").isNotNull(), F.col("_n").isNotNull()
    verdict = F.struct(
        F.coalesce(F.try_element_at("_m", F.lit(1)), F.col("_f")).alias("answer"),
        F.when(explicit, F.when(F.lower("_k").startswith("final"), "english_final_marker").otherwise("arabic_final_marker"))
        .when(boxed, "boxed").when(number, "last_number_fallback").otherwise("no_number").alias("method"),
        F.when(explicit, conflict.cast("int")).otherwise(F.lit(1)).alias("needs_review"),
        F.when(explicit, F.when(conflict, "conflicting_explicit_final_answers").otherwise(""))
        .when(boxed, "no_requested_final_marker").when(number, "fallback_extraction")
        .otherwise("no_numeric_answer").alias("reason"),
        F.when(explicit, F.array_join("_m", "|")).when(boxed, F.col("_f")).otherwise("").alias("all_answers"),
    )
    return staged.withColumn(out, verdict).drop("_t", "_m", "_k", "_b", "_n", "_f")


def extract_last_marker(df: DataFrame, response: str, out: str = "extracted") -> DataFrame:
    """Extractor B: last English marker, else last Arabic marker, else last boxed, else last number."""
    t = F.col("_t")
    picks = [
        ("english_final_marker", _last(t, rf"(?iu){ENGLISH_MARKER}\s*:\s*({LOOSE_NUMBER})")),
        ("arabic_final_marker", _last(t, rf"{ARABIC_MARKER}\s*:\s*({LOOSE_NUMBER})")),
        ("boxed", _last(t, rf"\\boxed\s*\{{\s*({LOOSE_NUMBER})\s*\}}")),
        ("last_number_fallback", _last(t, f"({LOOSE_NUMBER})")),
    ]
    return _pick_first(_prepared(df, response, False), picks, "no_number", normalize_decimal, out)


def extract_labelled(df: DataFrame, response: str, out: str = "extracted") -> DataFrame:
    """Extractor D: last ``FINAL ANSWER:`` with an optional dollar sign, else last number."""
    t = F.col("_t")
    picks = [
        ("explicit_final", _last(t, rf"(?iu)FINAL ANSWER\s*:\s*\$?\s*({SIGNED_NUMBER})")),
        ("last_number", _last(t, f"({SIGNED_NUMBER})")),
    ]
    return _pick_first(_prepared(df, response, False), picks, "none", normalize_float_text, out)


def extract_dotted(df: DataFrame, response: str, out: str = "extracted") -> DataFrame:
    """Extractor E: also accepts ``.5`` and ``FINALANSWER``; the number text is kept, commas dropped."""
    t = F.col("_t")
    picks = [
        ("explicit_final", _last(t, rf"(?iu)FINAL\s*ANSWER\s*:\s*({DOTTED_NUMBER})")),
        ("last_number", _last(t, f"({DOTTED_NUMBER})")),
    ]
    return _pick_first(_prepared(df, response, False), picks, "none", lambda c: drop_chars(c, ","), out)


def _pick_first(df: DataFrame, picks, none_name: str, clean, out: str) -> DataFrame:
    """First non-null pick in order; a later pattern runs only where the earlier ones found nothing."""
    names = [f"_p{i}" for i in range(len(picks))]
    for i, (name, (_, expr)) in enumerate(zip(names, picks)):
        df = df.withColumn(name, expr if i == 0 else F.when(F.coalesce(*names[:i], F.lit(None)).isNull(), expr))
    method = F.lit(none_name)
    for name, (label, _) in reversed(list(zip(names, picks))):
        method = F.when(F.col(name).isNotNull(), F.lit(label)).otherwise(method)
    return df.withColumn(out, F.struct(clean(F.coalesce(*names)).alias("answer"), method.alias("method"))) \
        .drop("_t", *names)


def _scan_pattern() -> str:
    """Zero-width match wherever a family begins, with one optional group for each family's number.

    The first letters rule out most places; then any family must match; then each one gets its chance to capture. No family can begin inside its own
    match, so looking at every place finds what separate scans find.
    """
    families = [f"(?iu:{p.removeprefix('(?iu)')})" if p.startswith("(?iu)") else p for _, p in REPARSE_PATTERNS]
    bare = [p.replace(f"({GROUPED_NUMBER})", f"(?:{GROUPED_NUMBER})") for p in families]
    return r"(?=[\\FfTtاإ])(?=" + "|".join(bare) + ")" + "".join(f"(?=(?:{p})?)" for p in families)


# Marks of the rewritten text: a place, the families' numbers there, the text that goes on.
PLACE, NEXT, TEXT = "\x01", "\x02", "\x03"


def marked_candidates(text: Column) -> tuple[Column, Column]:
    """(pieces, reader): the text cut before every place where a family begins, in one pass; ``reader`` turns the pieces into candidates (value, label).

    Candidates come in order of place, then of family; equal values of one place count once. Linear in the matches: their order is that of the pieces.
    """
    clean = F.translate(text, PLACE + NEXT + TEXT, "\x04\x04\x04")  # no family's match holds such a character
    numbers = NEXT.join(f"${k}" for k in range(1, len(REPARSE_PATTERNS) + 1))
    pieces = F.split(F.regexp_replace(clean, F.lit(_scan_pattern()), F.lit(PLACE + numbers + TEXT)), PLACE, -1)
    labels = F.array(*[F.lit(label) for label, _ in REPARSE_PATTERNS])

    def of_place(piece: Column) -> Column:
        found = F.filter(F.transform(F.split(F.substring_index(piece, TEXT, 1), NEXT, -1), lambda v, k: F.when(
            v != "", F.struct(normalize_decimal(v, drop_percent=True).alias("value"), F.get(labels, k).alias("label")))), lambda c: c.isNotNull())
        return F.when(F.size(found) < 2, found).otherwise(F.filter(found, lambda c, i: ~F.exists(F.slice(found, 1, i), lambda d: d["value"] == c["value"])))
    return pieces, lambda cut: F.flatten(F.transform(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0))), of_place))


def extract_reparsed(df: DataFrame, response: str, out: str = "extracted") -> DataFrame:
    """Extractor C (re-parser): boxed, English and Arabic phrase families in order of position.

    Candidates equal in position and value count once; the first wins; different values are flagged.
    """
    df = _prepared(df, response, False)
    pieces, reader = marked_candidates(F.col("_t"))
    df = df.withColumn("_s", pieces).withColumn("_u", F.when(F.size("_s") > 1, reader(F.col("_s"))).otherwise(F.array().cast("array<struct<value:string,label:string>>")))
    explicit = F.size("_u") > 0
    df = df.withColumn("_v", F.transform("_u", lambda x: x["value"])).withColumn(
        "_n", F.when(~explicit, normalize_decimal(_last(F.col("_t"), f"({GROUPED_NUMBER})"), drop_percent=True)))
    conflict, number = F.size(F.array_distinct("_v")) > 1, F.col("_n").isNotNull()
    verdict = F.struct(
        F.coalesce(F.try_element_at("_v", F.lit(1)), F.col("_n")).alias("answer"),
        F.when(explicit, F.try_element_at("_u", F.lit(1))["label"])
        .when(number, "last_number_fallback").otherwise("no_number").alias("method"),
        F.when(explicit, conflict.cast("int")).otherwise(F.lit(1)).alias("needs_review"),
        F.when(explicit, F.when(conflict, "conflicting_explicit_answers").otherwise(""))
        .when(number, "fallback_extraction").otherwise("no_numeric_answer").alias("reason"),
        F.when(explicit, F.array_join("_v", "|")).otherwise("").alias("all_answers"),
    )
    return df.withColumn(out, verdict).drop("_t", "_s", "_u", "_v", "_n")


def flag_truncated(needs_review: Column, reason: Column, finish: Column) -> tuple[Column, Column]:
    """Length-terminated generations always need review; the reason is appended (F-10)."""
    cut = F.coalesce(finish == "length", F.lit(False))
    return (F.when(cut, F.lit(1)).otherwise(needs_review),
            F.when(cut, F.concat_ws("|", F.nullif(reason, F.lit("")), F.lit("generation_truncated"))).otherwise(reason))
