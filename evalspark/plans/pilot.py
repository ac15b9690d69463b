"""Pilot pairs: generation, validation, leak-free split (C-19, C-20)."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators.checks import PILOT_ERROR_TYPES, leaking_groups, pilot_violations, require_empty
from evalspark.operators.sampling import stratified_pick

# Stories of our own for the seven error types (the type names are fixed values): operand ranges (inclusive), derived numbers and step
# texts. ``{x}`` is an operand or a derived number; the label list marks the first wrong step.
TEMPLATES = {
    "arithmetic": {
        "operands": {"a": (50, 90), "b": (11, 24), "c": (6, 19)},
        "derived": {"m": "a - b", "r": "a - b + c", "w": "a - b + c - 3"},
        "problem": "ينتظر في المحطة {a} راكبًا. ركب الحافلة الأولى {b} راكبًا، ثم وصل إلى المحطة {c} راكبًا. ما عدد المنتظرين؟",
        "correct": ["المنتظرون في البداية: {a}.", "بعد الحافلة الأولى: {a} - {b} = {m}.", "بعد وصول الجدد: {m} + {c} = {r}.", "عدد المنتظرين {r}."],
        "wrong": ["المنتظرون في البداية: {a}.", "بعد الحافلة الأولى: {a} - {b} = {m}.", "بعد وصول الجدد: {m} + {c} = {w}.", "عدد المنتظرين {w}."],
        "labels": [1, 1, 0, 0]},
    "operation_substitution": {
        "operands": {"a": (6, 14), "b": (5, 11)},
        "derived": {"r": "a * b", "w": "a + b"},
        "problem": "في القاعة {a} صفوف، وفي الصف الواحد {b} مقاعد. ما عدد المقاعد كلها؟",
        "correct": ["عدد الصفوف {a} ومقاعد الصف {b}.", "العملية المناسبة هي الضرب.", "{a} × {b} = {r}.", "في القاعة {r} مقعدًا."],
        "wrong": ["عدد الصفوف {a} ومقاعد الصف {b}.", "العملية المناسبة هي الجمع.", "{a} + {b} = {w}.", "في القاعة {w} مقعدًا."],
        "labels": [1, 0, 0, 0]},
    "operand_substitution": {
        "operands": {"a": (60, 120), "b": (14, 33)},
        "derived": {"r": "a - b", "x": "b + 5", "w": "a - b - 5"},
        "problem": "يتسع الخزان لماء الري وفيه {a} لترًا، سُحب منها {b} لترًا. كم لترًا يبقى في الخزان؟",
        "correct": ["في الخزان {a} لترًا.", "المسحوب {b} لترًا.", "الباقي: {a} - {b} = {r}.", "يبقى {r} لترًا."],
        "wrong": ["في الخزان {a} لترًا.", "المسحوب {b} لترًا.", "الباقي: {a} - {x} = {w}.", "يبقى {w} لترًا."],
        "labels": [1, 1, 0, 0]},
    "intermediate_corruption": {
        "operands": {"a": (3, 8), "b": (6, 12), "c": (10, 30)},
        "derived": {"m": "a * b", "r": "a * b + c", "x": "a * b + 4", "w": "a * b + 4 + c"},
        "problem": "يخبز الفرن {a} صوانٍ في كل منها {b} فطيرة، وعنده {c} فطيرة من الأمس. كم فطيرة عنده؟",
        "correct": ["خبز اليوم: {a} × {b} = {m}.", "من الأمس: {c}.", "المجموع: {m} + {c} = {r}.", "عنده {r} فطيرة."],
        "wrong": ["خبز اليوم: {a} × {b} = {m}.", "من الأمس: {c}.", "المجموع: {x} + {c} = {w}.", "عنده {w} فطيرة."],
        "labels": [1, 1, 0, 0]},
    "unit_conversion": {
        "operands": {"a": (2, 9), "b": (5, 50)},
        "derived": {"m": "a * 60", "r": "a * 60 + b", "x": "a * 100", "w": "a * 100 + b"},
        "problem": "دامت الرحلة {a} ساعات و{b} دقيقة. كم دقيقة دامت؟",
        "correct": ["في الساعة 60 دقيقة.", "الساعات بالدقائق: {a} × 60 = {m}.", "نزيد الدقائق: {m} + {b} = {r}.", "دامت الرحلة {r} دقيقة."],
        "wrong": ["في الساعة 60 دقيقة.", "الساعات بالدقائق: {a} × 100 = {x}.", "نزيد الدقائق: {x} + {b} = {w}.", "دامت الرحلة {w} دقيقة."],
        "labels": [1, 0, 0, 0]},
    "premature_conclusion": {
        "operands": {"a": (4, 9), "b": (12, 25), "c": (7, 20)},
        "derived": {"m": "a * b", "r": "a * b - c"},
        "problem": "اشترت المدرسة {a} رزم في كل منها {b} دفترًا ووزعت {c} دفترًا. كم دفترًا لم يوزع؟",
        "correct": ["في الرزم: {a} × {b} = {m}.", "وُزع منها {c}.", "{m} - {c} = {r}.", "لم يوزع {r} دفترًا."],
        "wrong": ["في الرزم: {a} × {b} = {m}.", "لم يوزع {m} دفترًا."],
        "labels": [1, 0]},
    "semantic_logical": {
        "operands": {"a": (30, 60), "b": (4, 13)},
        "derived": {"r": "a - b", "w": "a + b"},
        "problem": "عمر الأخت {a} سنة وهي أكبر من أخيها بعدد {b} من السنوات. ما عمر أخيها؟",
        "correct": ["عمر الأخت {a}.", "الأخ أصغر منها بعدد {b}.", "{a} - {b} = {r}.", "عمره {r} سنة."],
        "wrong": ["عمر الأخت {a}.", "الأخ أكبر منها بعدد {b}.", "{a} + {b} = {w}.", "عمره {w} سنة."],
        "labels": [1, 0, 0, 0]},
}


def _operand(seed: int, pair: Column, name: str, low: int, high: int) -> Column:
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), pair.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.lit(low) + F.pmod(draw, F.lit(high - low + 1))


def _padded(number: Column) -> Column:
    """At least four digits; longer numbers keep all of theirs."""
    digits = number.cast("string")
    return F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)


def _filled(text: str, numbers: dict[str, str]) -> Column:
    out = F.lit(text)
    for name in numbers:
        if "{" + name + "}" in text:
            out = F.replace(out, F.lit("{" + name + "}"), F.col(numbers[name]).cast("string"))
    return out


def generate_pairs(pairs: DataFrame, seed: int, pair_number: str = "pair_number") -> DataFrame:
    """Two records per pair number, correct and wrong (C-19).

    The error type cycles over the seven types; operands are digest draws, so every pair is independent of the
    others and of partitioning. Row-local: no shuffle.
    """
    number = F.col(pair_number)
    kind = F.element_at(F.array(*[F.lit(t) for t in PILOT_ERROR_TYPES]),
                        (F.pmod(number - 1, F.lit(len(PILOT_ERROR_TYPES))) + 1).cast("int"))
    base = pairs.select(number.alias("_n"), F.concat(F.lit("ar_pilot_"), _padded(number)).alias("pair_id"), kind.alias("_kind"))
    columns = {name: {x: f"_{name}_{x}" for x in (*spec["operands"], *spec["derived"])} for name, spec in TEMPLATES.items()}
    base = base.withColumns({columns[name][x]: F.when(F.col("_kind") == name, _operand(seed, F.col("_n"), x, low, high))
                             for name, spec in TEMPLATES.items() for x, (low, high) in spec["operands"].items()})
    base = base.withColumns({columns[name][x]: F.expr(" ".join(columns[name].get(token, token) for token in rule.split()))
                             for name, spec in TEMPLATES.items() for x, rule in spec["derived"].items()})
    problem = correct = wrong = labels = None
    for name, spec in TEMPLATES.items():
        here = F.col("_kind") == name
        cells = (_filled(spec["problem"], columns[name]), F.array(*[_filled(t, columns[name]) for t in spec["correct"]]),
                 F.array(*[_filled(t, columns[name]) for t in spec["wrong"]]), F.array(*[F.lit(v) for v in spec["labels"]]))
        problem, correct, wrong, labels = (
            F.when(here, cell) if before is None else before.when(here, cell)
            for before, cell in zip((problem, correct, wrong, labels), cells))
    shaped = base.select("pair_id", "_kind", problem.alias("problem"), correct.alias("_c"), wrong.alias("_w"), labels.alias("_l"))
    rows = F.array(
        F.struct(F.lit("correct").alias("variant"), F.col("_c").alias("steps"), F.transform("_c", lambda _: F.lit(1)).alias("step_labels"),
                 F.lit(None).cast("int").alias("first_error_step"), F.lit(None).cast("string").alias("error_type")),
        F.struct(F.lit("incorrect").alias("variant"), F.col("_w").alias("steps"), F.col("_l").alias("step_labels"),
                 F.array_position("_l", 0).cast("int").alias("first_error_step"), F.col("_kind").alias("error_type")))
    return shaped.select("pair_id", "problem", F.inline(rows)).select(
        F.concat("pair_id", F.when(F.col("variant") == "correct", "_correct").otherwise("_wrong")).alias("id"), "pair_id",
        F.lit("ar").alias("language"), F.lit("synthetic_pilot").alias("source"), "variant", "problem",
        F.array_join("steps", "\n").alias("response"), "step_labels", "first_error_step", "error_type")


def pair_numbers(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(1, count + 1).withColumnRenamed("id", "pair_number")


def pair_problems(records: DataFrame) -> DataFrame:
    """Pairs without exactly one correct and one incorrect record, repeated ids, record violations (C-20)."""
    shape = records.groupBy("pair_id").agg(F.count_if(F.col("variant") == "correct").alias("c"),
                                           F.count_if(F.col("variant") == "incorrect").alias("i"), F.count(F.lit(1)).alias("n"))
    broken = shape.where("c <> 1 OR i <> 1 OR n <> 2").select(F.col("pair_id").alias("id"), F.lit("pair_shape").alias("violation"))
    doubled = records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("violation"))
    return broken.unionByName(doubled).unionByName(pilot_violations(records))


def split_pairs(records: DataFrame, dev_pairs: int, seed: int) -> DataFrame:
    """Stratified leak-free split by error type (C-20): both records of a pair share the split."""
    require_empty(pair_problems(records), "pilot records are not valid")
    kinds = records.where("variant = 'incorrect'").select("pair_id", "error_type")
    picked = stratified_pick(kinds, "pair_id", "error_type", dev_pairs, seed).select("pair_id", "split")
    out = records.join(picked, "pair_id")
    require_empty(leaking_groups(out, "pair_id", "split"), "pair in both splits")
    return out
