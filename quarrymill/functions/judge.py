"""Model verdicts: parsing of answers, and what stands in when there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = ("technical_quality", "aesthetic_quality", "face_clarity", "pose_usefulness", "expression_quality", "background_usefulness", "uniqueness", "training_value")


def answer_json(answer: Column) -> Column:
    """The outermost braces of an answer, without code fences; NULL if that is no JSON object."""
    body = F.regexp_extract(F.regexp_replace(answer, r"```(?:json)?\s*", ""), r"(?s)\{.*\}", 0)
    return F.when(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), body)


def judge_parse(answer: Column) -> Column:
    """Scores per dimension and in all (.5 where missing), recommendation and confidence."""
    body = answer_json(answer)
    number = lambda path: F.get_json_object(body, path).try_cast("double")
    scores = [F.coalesce(number(f"$.{d}.score"), F.lit(0.5)).alias(d) for d in DIMENSIONS]
    total = F.coalesce(number("$.composite.score"), F.nullif(number("$.composite"), F.lit(0.0)), F.lit(0.5))
    word = lambda key, default: F.coalesce(F.get_json_object(body, f"$.{key}"), F.lit(default)).alias(key)
    return F.struct(*scores, total.alias("composite"), word("recommendation", "maybe"), word("confidence", "low"), body.isNull().alias("failed"))


def judge_compare_parse(answer: Column) -> Column:
    """Winner A or B, anything else a draw; A without any."""
    winner = F.upper(F.coalesce(F.get_json_object(answer_json(answer), "$.winner"), F.lit("A")))
    return F.when(winner.isin("A", "B"), winner).otherwise("draw")


def judge_fallback(technical: Column, aesthetic: Column, training: Column, composite: Column) -> Column:
    """From the pipeline's scores, where 0 counts as missing (.5); a missing composite is the others' mean."""
    half = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(0.5))
    t, a, v = half(technical), half(aesthetic), half(training)
    total = half(F.coalesce(composite, (t + a + v) / 3))
    verdict = F.when(total >= 0.7, "keep").when(total >= 0.4, "maybe").otherwise("remove")
    return F.struct(total.alias("composite"), verdict.alias("recommendation"))


def judge_compare_fallback(a: Column, b: Column) -> Column:
    half = lambda c: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(0.5))
    a, b = half(a), half(b)
    return F.when(F.abs(a - b) < 0.05, "draw").when(a > b, "A").otherwise("B")
