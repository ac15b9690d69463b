"""Step arrays: labels, masks, coverage, supervision, scores (W-05, F-21..F-27, A-06)."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.numbers import strip

# Upper bounds of the short and medium classes, early and middle error positions.
SHORT_STEPS, MEDIUM_STEPS = 4, 12
EARLY_ERROR, MIDDLE_ERROR = 4, 12


def first_position(values: Column, wanted) -> Column:
    """1-based position of the first ``wanted``, null when absent (W-05)."""
    return F.nullif(F.array_position(values, wanted), F.lit(0).cast("bigint")).cast("int")


def labels_from_ratings(ratings: Column) -> Column:
    """1 → 1, -1 → 0, neutral → null (F-21)."""
    return F.transform(ratings, lambda r: F.when(r == 1, 1).when(r == -1, 0))


def mask_from_ratings(ratings: Column) -> Column:
    return F.transform(ratings, lambda r: (r != 0).cast("int"))


def steps_to_text(steps: Column) -> Column:
    """One physical line per step; inner line breaks become one blank (F-22)."""
    return F.array_join(F.transform(steps, lambda s: F.regexp_replace(s, r"[\r\n]+", " ")), "\n")


def reviewed_steps_to_text(steps: Column) -> Column:
    """Export form: every inner line break (``\\r\\n`` counts once) becomes one blank."""
    return F.array_join(F.transform(steps, lambda s: F.regexp_replace(s, r"\r\n|\r|\n", " ")), "\n")


def split_steps(text: Column) -> Column:
    return F.split(text, "\n", -1)


def trimmed_lines(text: Column) -> Column:
    """Non-empty trimmed lines (F-23)."""
    lines = F.transform(F.split(text, "\n", -1), lambda s: strip(s))
    return F.filter(lines, lambda s: s != "")


def length_class(n: Column) -> Column:
    return F.when(n <= SHORT_STEPS, "short").when(n <= MEDIUM_STEPS, "medium").otherwise("long")


def error_class(first_error: Column) -> Column:
    return F.when(first_error.isNull(), "none").when(first_error <= EARLY_ERROR, "early") \
        .when(first_error <= MIDDLE_ERROR, "middle").otherwise("late")


def coverage_labels(n_steps: Column, first_error: Column, ratings: Column) -> Column:
    """The three coverage labels of a trajectory (F-24)."""
    neutral = F.when(F.exists(ratings, lambda r: r == 0), "True").otherwise("False")
    return F.array(F.concat(F.lit("length:"), length_class(n_steps)),
                   F.concat(F.lit("first_error:"), error_class(first_error)),
                   F.concat(F.lit("neutral:"), neutral))


def supervised_indices(mask: Column) -> Column:
    """0-based positions of supervised steps (F-25)."""
    return F.filter(F.transform(mask, lambda m, i: F.when(m == 1, i)), lambda i: i.isNotNull())


def supervised_targets(labels: Column, mask: Column) -> Column:
    pairs = F.arrays_zip(labels.alias("label"), mask.alias("mask"))
    return F.transform(F.filter(pairs, lambda p: p["mask"] == 1), lambda p: p["label"])


def supervision_valid(labels: Column, mask: Column) -> Column:
    """At least one supervised step, and every supervised step has a 0/1 target."""
    targets = supervised_targets(labels, mask)
    return (F.size(targets) > 0) & F.forall(targets, lambda t: F.coalesce(t.isin(0, 1), F.lit(False)))


def first_negative(labels: Column, mask: Column) -> Column:
    """1-based position of the first supervised step with target 0, null when there is none."""
    hits = F.zip_with(labels, mask, lambda l, m: F.coalesce(((m == 1) & (l == 0)).cast("int"), F.lit(0)))
    return first_position(hits, F.lit(1))


def logit_to_probability(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def pair_probability(negative: Column, positive: Column) -> Column:
    """Softmax share of the positive logit, computed on the difference so that it cannot overflow."""
    return logit_to_probability(positive - negative)


def flagged_rewards(rewards: Column, flags: Column) -> Column:
    """Rewards at positions whose flag is 1 (step ends)."""
    pairs = F.arrays_zip(rewards.alias("reward"), flags.alias("flag"))
    return F.transform(F.filter(pairs, lambda p: p["flag"] == 1), lambda p: p["reward"])


def masked_bce(logits: Column, labels: Column, mask: Column) -> Column:
    """Mean binary cross entropy with logits over supervised steps (F-27); null when there is none."""
    cells = F.filter(F.arrays_zip(logits.alias("x"), labels.alias("y"), mask.alias("m")), lambda c: c["m"] == 1)
    total = F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + F.greatest(c["x"], F.lit(0.0)) - c["x"] * c["y"]
                        + F.log1p(F.exp(-F.abs(c["x"]))))
    return F.when(F.size(cells) > 0, total / F.size(cells))


def score_summary(scores: Column) -> dict[str, Column]:
    """Trajectory scores from step scores (A-06)."""
    n = F.size(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s)
    return {"num_steps": n, "average_score": F.when(n > 0, total / n),
            "minimum_score": F.array_min(scores), "maximum_score": F.array_max(scores)}
