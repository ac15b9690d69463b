"""Digit mapping, number normalisation and numeric comparison (F-01..F-05, F-11, F-12)."""
from pyspark.sql import Column
from pyspark.sql import functions as F

# Digit glyphs, separators, number patterns.
ARABIC_INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"
# Blanks of Unicode beyond the six of ASCII.
WIDE_BLANKS = ("\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
#: Inside of a character class of regular expressions: every blank.
BLANK_CLASS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ARABIC_THOUSANDS = "٬"
ARABIC_DECIMAL = "٫"
GROUPED_NUMBER = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
LOOSE_NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"
SIGNED_NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
DOTTED_NUMBER = r"[-+]?(?:\d[\d,]*\.?\d*|\.\d+)"
PLAIN_NUMBER = r"\d+(?:\.\d+)?"
MARKED_NUMBER = r"-?\d+(?:\.\d+)?"
PARSABLE = r"^[-+]?(?:\d+\.?\d*|\.\d+)$"


def ascii_digits(c: Column) -> Column:
    """Arabic-Indic and Persian digits to ASCII."""
    return F.translate(c, ARABIC_INDIC_DIGITS + PERSIAN_DIGITS, ASCII_DIGITS * 2)


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space."""
    return F.btrim(c, F.lit(" \t\n\r\f\x0b" + WIDE_BLANKS))


def plain_text(c: Column) -> Column:
    """ASCII digits and plain blanks, character by character, so that positions stay."""
    return F.translate(c, ARABIC_INDIC_DIGITS + PERSIAN_DIGITS + WIDE_BLANKS, ASCII_DIGITS * 2 + " " * len(WIDE_BLANKS))


def drop_chars(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def is_number(c: Column) -> Column:
    return c.rlike(PARSABLE)


def canonical_number(c: Column) -> Column:
    """Canonical decimal text: no plus sign, no padding zeros, no sign for zero; other text is unchanged.

    Works on the text, so there is no precision limit. Every step reads its input once and leaves text that
    is no number alone, so there is no CASE that repeats the input: nested uses stay small in generated code.
    """
    t = F.regexp_replace(c, r"^(?=[-+]?(?:\d+\.?\d*|\.\d+)$)\+?(-?)0*(?=\d|\.\d)", "$1")
    t = F.regexp_replace(t, r"^(-?)(?=\.\d+$)", "$10")                      # ".5" to "0.5"
    t = F.regexp_replace(t, r"^(-?\d+)(?:\.0*|(\.\d*?)0*)$", "$1$2")       # "1.50" to "1.5", "1.00" to "1"
    return F.regexp_replace(t, "^-0$", "0")


def canonical_integral(c: Column) -> Column:
    """The same for integral numbers only; ``3.50`` and ``n/a`` stay as they are."""
    t = F.regexp_replace(c, r"^(?=[-+]?(?:\d+(?:\.0*)?|\.0+)$)\+?(-?)0*(?=\d|\.\d)", "$1")
    t = F.regexp_replace(t, r"^(-?)(?=\.0+$)", "$10")
    return F.regexp_replace(F.regexp_replace(t, r"^(-?\d+)\.0*$", "$1"), "^-0$", "0")


def clean_decimal(c: Column, drop_percent: bool = False) -> Column:
    """Digits mapped, grouping and currency marks dropped, Arabic decimal sign replaced: one pass, one trim."""
    marks = "," + ARABIC_THOUSANDS + "$" + ("%" if drop_percent else "")
    return strip(F.translate(c, ARABIC_INDIC_DIGITS + PERSIAN_DIGITS + ARABIC_DECIMAL + marks, ASCII_DIGITS * 2 + "."))


def normalize_decimal(c: Column, drop_percent: bool = False) -> Column:
    """Decimal variant (F-02): canonical number text, or the cleaned text when it is no number."""
    return canonical_number(clean_decimal(c, drop_percent))


def normalize_integral(c: Column) -> Column:
    """Float variant (F-03): integral values become integer text, other text is kept (``3.50`` stays)."""
    marks = "," + ARABIC_THOUSANDS + "$ "
    return canonical_integral(strip(F.translate(c, ARABIC_INDIC_DIGITS + PERSIAN_DIGITS + ARABIC_DECIMAL + marks, ASCII_DIGITS * 2 + ".")))


def normalize_float_text(c: Column) -> Column:
    """Float variant that also canonicalises fractions (``3.50`` becomes ``3.5``)."""
    return canonical_number(F.translate(strip(c), ",", ""))


def number_or_null(c: Column) -> Column:
    """Canonical number text, null for other text."""
    return F.nullif(F.regexp_extract(canonical_number(c), r"^-?\d+(?:\.\d+)?$", 0), F.lit(""))


def normalize_currency(c: Column) -> Column:
    """Currency variant (F-04): marks dropped; null when the rest is no number."""
    return number_or_null(strip(drop_chars(c, ",$€£%")))


def marked_answer(c: Column) -> Column:
    """Last number after the last ``####`` marker, currency marks dropped; null when there is none."""
    t = F.element_at(F.split(drop_chars(c, ",$£€"), "####"), -1)
    return canonical_number(F.try_element_at(F.regexp_extract_all(t, F.lit(f"({MARKED_NUMBER})"), F.lit(1)), F.lit(-1)))


def numeric_equal(predicted: Column, expected: Column, mode: str = "decimal_text") -> Column:
    """Numeric equality; a null prediction is never equal.

    ``decimal_text``   compare numbers, else the cleaned texts
    ``decimal_strict`` false when either side is no number
    ``float_text``     double comparison, else trimmed texts
    ``currency``       currency variant on both sides, false when either is no number
    """
    if mode == "decimal_text":
        same = normalize_decimal(predicted) == normalize_decimal(expected)
    elif mode == "decimal_strict":
        same = number_or_null(strip(predicted)) == number_or_null(strip(expected))
    elif mode == "float_text":
        p, e = strip(predicted), strip(expected)
        same = F.coalesce(number_or_null(p).try_cast("double") == number_or_null(e).try_cast("double"), p == e)
    elif mode == "currency":
        same = normalize_currency(predicted) == normalize_currency(expected)
    else:
        raise ValueError(f"unknown comparison mode: {mode}")
    return F.coalesce(same, F.lit(False))


def numbers_in(c: Column) -> Column:
    """All numbers in a text, normalised (F-11). Arabic separators are mapped before matching."""
    t = F.translate(ascii_digits(c), ARABIC_THOUSANDS + ARABIC_DECIMAL, ",.")
    return F.transform(F.regexp_extract_all(t, F.lit(f"({LOOSE_NUMBER})"), F.lit(1)), lambda v: normalize_integral(v))


def same_numbers(a: Column, b: Column) -> Column:
    """Sorted multiset comparison of the numbers of two texts."""
    return F.array_sort(numbers_in(a)) == F.array_sort(numbers_in(b))


def number_sequence(c: Column) -> Column:
    """Unsigned numbers in order of appearance, as text (F-12)."""
    return F.regexp_extract_all(c, F.lit(f"({PLAIN_NUMBER})"), F.lit(1))


def same_number_sequence(a: Column, b: Column) -> Column:
    return number_sequence(a) == number_sequence(b)
