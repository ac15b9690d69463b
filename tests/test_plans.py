"""Plans that run nothing while they are built, and the one-scan re-parser against separate scans."""
import os
import random
import re

import pytest

from evalspark.bindings import QUERIES
from evalspark.functions import answers
from evalspark.operators import ranges

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no dataset")
@pytest.mark.parametrize("name", ["a04_describe", "a20_best_threshold", "a21_roc_auc", "a22_five_numbers", "t03_percentiles", "t09_signed_rank", "t09_signed_rank_p_values",
                                  "t10_rank_sum", "t12_kruskal", "t14_category_comparison", "w02_cumulative_counts", "w03_average_ranks", "s04_bounded_prefix"])
def test_no_job_before_the_query_runs(spark, name):
    context = spark.sparkContext
    QUERIES[name](spark, FOLDER)  # reading a schema for the first time is a job of its own
    context.setJobGroup(f"build {name}", name)
    try:
        QUERIES[name](spark, FOLDER)
        jobs = context.statusTracker().getJobIdsForGroup(f"build {name}")
    finally:
        context.setJobGroup("", "")
    assert len(jobs) <= 2, jobs  # schema footers only


def test_ranges_follow_the_cut_points(spark):
    df = spark.createDataFrame([(float(i % 100),) for i in range(1000)] + [(None,)], "v DOUBLE")
    cut = ranges.in_ranges(df, "v", ranges.range_bounds(df, "v", 5), 5)
    rows = sorted((r["v"], r["_range"]) for r in cut.collect() if r["v"] is not None)
    assert [r for _, r in rows] == sorted(r for _, r in rows) and {r for _, r in rows} == set(range(5))
    sizes = [sum(r == k for _, r in rows) for k in range(5)]
    assert min(sizes) > 150
    assert ranges.in_ranges(df.where("v < 0"), "v", ranges.range_bounds(df.where("v < 0"), "v", 5), 5).count() == 0


def plain_candidates(text):
    """Separate scans of all families, in order of place and family; equal values of one place once."""
    found = []
    for k, (label, pattern) in enumerate(answers.REPARSE_PATTERNS):
        flags = re.I if pattern.startswith("(?iu)") else 0
        found += [(m.start(), k, m.group(1), label) for m in re.finditer(pattern.removeprefix("(?iu)"), text, flags | re.A if not flags else flags)]
    out, seen = [], set()
    for at, _, value, label in sorted(found):
        value = value.replace(",", "").lstrip("+")
        if (at, value) not in seen:
            seen.add((at, value))
            out.append((value, label))
    return out


def test_one_scan_finds_what_separate_scans_find(spark):
    rng = random.Random(6)
    bits = ["FINAL ANSWER: ", "final answer : the final answer is ", "The final answer is $", "Therefore, ", "therefore the answer is ", "\\boxed{", "}", "5", "-12", "1,234", " ", "\n",
            "الإجابة النهائية: ", "الجواب النهائي ", "الإجابة هي ", "الجواب هو ", "إذن، ", "word ", "\x01", "\x02", "\x03", "Therefore, the answer is \\$", "FINAL  ANSWER:THE FINAL ANSWER IS 7"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(1500)] + ["FINAL ANSWER: 1 " * 2000, "", "Therefore, the answer is 5 and \\boxed{6}"]
    rows = answers.extract_reparsed(spark.createDataFrame(list(enumerate(texts)), "i INT, r STRING"), "r", "x").select("i", "x.*").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_candidates(texts[r["i"]])
        assert r["all_answers"] == "|".join(v for v, _ in want), texts[r["i"]]
        if want:
            assert (r["answer"], r["method"], r["needs_review"]) == (*want[0], int(len({v for v, _ in want}) > 1))
