"""Answers, numbers, spans, digests, steps."""
import hashlib
import json
import math
import re
import unicodedata
from decimal import Decimal, InvalidOperation

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evalspark.functions import answers, digests, numbers as N, spans, steps as S
from evalspark.plans import scoring


def texts(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, {name} STRING")


def test_canonical_numbers(spark):
    values = ["0", "-0", "+0", "00", "0.0", "-0.00", ".5", "-.5", "+.5", "5.", "05", "+05", "-05", "007.50", "100", "1000.00", "-12.340",
              "+7.0", "0.050", "9" * 60 + ".10", "+.0", "-.0", "0.", "10.0", "n/a", "", ".", "1.2.3", "-", "1e3x", "-.5a"]
    got = [r.c for r in texts(spark, values).select("i", N.canonical_number(F.col("t")).alias("c")).orderBy("i").collect()]

    def expected(v):
        try:
            n = Decimal(v)
        except InvalidOperation:
            return v
        if n == n.to_integral_value():
            return str(int(n))
        return format(n, "f").rstrip("0")
    assert got == [expected(v) for v in values]


CASES = {
    "FINAL ANSWER: 18": ("18", "english_final_marker", 0, ""),
    "الإجابة النهائية: ٤٥": ("45", "arabic_final_marker", 0, ""),
    "FINAL ANSWER: 3 and final answer: 4": ("3", "english_final_marker", 1, "conflicting_explicit_final_answers"),
    "FINAL ANSWER: 1,200.0 or FINAL ANSWER: 1200": ("1200", "english_final_marker", 0, ""),
    r"so \boxed{7}": ("7", "boxed", 1, "no_requested_final_marker"),
    "about 12 or 13": ("13", "last_number_fallback", 1, "fallback_extraction"),
    "it is 6/25": ("25", "last_number_fallback", 1, "fallback_extraction"),
    "none": (None, "no_number", 1, "no_numeric_answer"),
    "FINAL ANSWER: $18": ("18", "last_number_fallback", 1, "fallback_extraction"),
    "FINAL ANSWER: 1٬234": ("1", "english_final_marker", 0, ""),
}


def test_first_marker_cases(spark):
    out = answers.extract_first_marker(texts(spark, list(CASES) + [None]), "t", "x").orderBy("i").collect()
    for (text, want), r in zip(CASES.items(), out):
        assert (r.x.answer, r.x.method, r.x.needs_review, r.x.reason) == want, text
    assert out[-1].x.method == "no_number"
    full = answers.extract_first_marker(texts(spark, ["FINAL ANSWER: 1٬234"]), "t", "x", full_separators=True).first()
    assert full.x.answer == "1234"


def test_last_marker_and_reparse_variants(spark):
    df = texts(spark, ["FINAL ANSWER: 3 then FINAL ANSWER: 4", "FINAL ANSWER: $1,250.50", "FINALANSWER: .5",
                       r"Therefore, the answer is 5. \boxed{6} الجواب هو 5"])
    b = [r.x.answer for r in answers.extract_last_marker(df, "t", "x").orderBy("i").collect()]
    d = [r.x.answer for r in answers.extract_labelled(df, "t", "x").orderBy("i").collect()]
    e = [r.x.answer for r in answers.extract_dotted(df, "t", "x").orderBy("i").collect()]
    c = [r.x for r in answers.extract_reparsed(df, "t", "x").orderBy("i").collect()]
    assert b == ["4", "1250.5", "5", "6"]
    assert d == ["4", "1250.5", "5", "5"]
    assert e == ["4", "1250.50", ".5", "5"]
    assert (c[1].answer, c[1].needs_review) == ("1250.5", 0)
    assert (c[3].answer, c[3].needs_review, c[3].all_answers) == ("5", 1, "5|6|5")


def test_scoring_flags(spark):
    df = spark.createDataFrame([("FINAL ANSWER: $3.50", "350", "stop"), ("FINAL ANSWER: 1200.0", "1,200", "stop"), ("FINAL ANSWER: 5", "5", "length"), ("so 5", "5", "length")],
                               "generated_response STRING, gold_answer STRING, finish_reason STRING")
    got = [(r.is_correct, r.needs_manual_review, r.review_reason) for r in scoring.score_responses(df).collect()]
    assert got == [(0, 1, "fallback_extraction"), (1, 0, ""), (1, 1, "generation_truncated"), (1, 1, "fallback_extraction|generation_truncated")]


def test_adjudication_policies(spark):
    rows = spark.createDataFrame([(1, "x", 1, 1), (2, "x", 1, 1), (3, "x", 0, 0), (4, "x", 1, 0)], "p INT, language STRING, is_correct INT, needs_manual_review INT")
    dec = spark.createDataFrame([(1, "x", 1), (3, "x", 1)], "p INT, language STRING, manual_correct INT")
    want = {"corrections": [1, 1, 1, 1], "whitelist": [1, 0, 0, 1], "flagged_wrong": [0, 0, 0, 1], "semantic": [1, 0, 1, 1]}
    for policy, values in want.items():
        assert [r.final_correct for r in scoring.adjudicate(rows, dec, ["p", "language"], policy).orderBy("p").collect()] == values
    with pytest.raises(ValueError):
        scoring.replace_rows(rows.withColumn("r", F.lit("x")), rows.limit(1).withColumn("r", F.lit(" ")), ["p", "language"], "r")
    with pytest.raises(ValueError):
        scoring.replace_rows(rows.withColumn("r", F.lit("x")), rows.limit(1).withColumn("p", F.lit(99)).withColumn("r", F.lit("y")), ["p", "language"], "r")


SOURCE = r'Compute $x^2$ and \[y=3\]. [* { id: "5" }] 23'


@pytest.mark.parametrize("draft, problem", [
    ("احسب <M0> و <M1> <M2> 23", None), ("احسب <M0> <M1> 23", "protected_tokens_mismatch"), ("احسب <M1> <M0> <M2> 23", "protected_tokens_mismatch"),
    ("احسب <M0> <M0> <M1> <M2> 23", "protected_tokens_mismatch"), ("احسب <M0> و <M1> <M2> 24", "numeric_sequence_changed"),
    ("Compute <M0> <M1> <M2> 23", "no_arabic_text"), ("  ", "empty_translation"), (None, "empty_translation"), ("احسب <M0> و <M1> <M2> $a$ 23", "protected_spans_changed")])
def test_restore_rules(spark, draft, problem):
    df = spark.createDataFrame([(SOURCE, draft)], "s STRING, d STRING")
    r = df.select(spans.restore_problem(F.col("s"), F.col("d")).alias("p"), spans.restored_text(F.col("s"), F.col("d")).alias("t")).first()
    assert r.p == problem
    if problem is None:
        assert r.t == r'احسب $x^2$ و \[y=3\] [* { id: "5" }] 23'


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab $\\[]*{}1.\n", max_size=30), min_size=1, max_size=30))
def test_spans_equal_the_backtracking_pattern(spark, values):
    plain = re.compile(r"\$\$.*?\$\$|\$(?:\\.|[^$])*\$|\\\[.*?\\\]|\[\*\s*\{.*?\}\s*\]", re.S)
    got = [list(r.x) for r in texts(spark, values).select("i", spans.protected_spans(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [plain.findall(v) for v in values]


def test_template_round_trip(spark):
    df = texts(spark, [SOURCE, "no spans", "$$a$$$b$"])
    r = df.select(F.col("t"), spans.fill_template(spans.to_template(F.col("t")), spans.protected_spans(F.col("t"))).alias("b")).collect()
    assert all(x.t == x.b for x in r)


def test_digests_equal_python(spark):
    values = ["Compute ２ ＋ 2", " a b\t c ", "plain  text", "ﬁne", "a\x1cb"]
    got = [r.k for r in texts(spark, values).select("i", digests.group_key(F.col("t")).alias("k")).orderBy("i").collect()]
    assert got == [hashlib.sha256(" ".join(unicodedata.normalize("NFKC", v).split()).encode()).hexdigest() for v in values]
    df = spark.createDataFrame([("é\n\"q\"", None, [1, None], ("z", 3))], "b STRING, a STRING, c ARRAY<INT>, d STRUCT<y: STRING, x: INT>")
    record = {"b": "é\n\"q\"", "a": None, "c": [1, None], "d": {"y": "z", "x": 3}}
    want = hashlib.sha256(json.dumps(record, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert df.select(digests.canonical_digest(df).alias("h")).first().h == want


def test_table_digest_ignores_order(spark):
    df = spark.range(200).select(F.sha2(F.col("id").cast("string"), 256).alias("h"))
    a = df.agg(*digests.table_digest(F.col("h"))).first()
    assert a == df.repartition(9).orderBy("h").agg(*digests.table_digest(F.col("h"))).first()
    assert a != df.where("h > '1'").agg(*digests.table_digest(F.col("h"))).first()


def test_step_functions(spark):
    df = spark.createDataFrame([([0, 1, -1], [2.0, -1.0, 0.5], ["a\r\nb", "c"])], "r ARRAY<INT>, x ARRAY<DOUBLE>, s ARRAY<STRING>")
    labels, mask = S.labels_from_ratings(F.col("r")), S.mask_from_ratings(F.col("r"))
    r = df.select(labels.alias("l"), mask.alias("m"), S.first_position(F.col("r"), F.lit(-1)).alias("f"), S.supervised_indices(mask).alias("i"),
                  S.supervised_targets(labels, mask).alias("t"), S.masked_bce(F.col("x"), labels, mask).alias("loss"), S.steps_to_text(F.col("s")).alias("txt"),
                  S.first_negative(labels, mask).alias("fn"), S.pair_probability(F.lit(800.0), F.lit(801.0)).alias("p")).first()
    assert (r.l, r.m, r.f, r.i, r.t, r.txt, r.fn) == ([None, 1, 0], [0, 1, 1], 3, [1, 2], [1, 0], "a b\nc", 3)
    assert r.loss == pytest.approx((math.log1p(math.exp(1)) + math.log1p(math.exp(0.5))) / 2)
    assert r.p == pytest.approx(1 / (1 + math.exp(-1)))


def test_python_on_texts_takes_few_rows_at_a_time(spark):
    """Arrow batches of 10,000 whole texts filled the Python workers; plain UDFs get 100 rows."""
    from evalspark.functions import digests
    df = spark.createDataFrame([(1, 'ﬁ  {"b": 1, "a": "é"}'), (2, None), (3, '{"b": 1, "a": "é"}')], "i INT, t STRING")
    out = df.select("i", digests.normalized_text(F.col("t")).alias("n"), digests.raw_row_id(F.when(F.col("i") != 1, F.col("t"))).alias("r"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    want = hashlib.sha256('{"a": "é", "b": 1}'.encode()).hexdigest()
    assert [tuple(r) for r in out.orderBy("i").collect()] == [(1, 'fi {"b": 1, "a": "é"}', None), (2, None, None), (3, '{"b": 1, "a": "é"}', f"trace_{want}")]
