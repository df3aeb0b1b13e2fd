"""Pairwise evaluation: two answers are judged in both orders, and only a verdict that survives the swap counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_fence
from ..providers import LanguageModel, generated


def judged(pairs: DataFrame, model: LanguageModel) -> DataFrame:
    """pairs: question, answer_a, answer_b; with raw verdicts of both orders."""
    both = pairs.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    first, second = F.when(F.col("turn") == 0, F.col("answer_a")).otherwise(F.col("answer_b")), F.when(F.col("turn") == 0, F.col("answer_b")).otherwise(F.col("answer_a"))
    asked = both.withColumn("prompt", F.concat(F.lit("Which answers better? JSON {\"winner\": \"1\"|\"2\"|\"tie\"}\nQ: "), "question", F.lit("\n1: "), first, F.lit("\n2: "), second))
    return generated(asked, model, json=True)


def verdicts(said: DataFrame, key: str = "question") -> DataFrame:
    """key and winner (A, B or tie) of rows (key, turn 0 or 1, response)."""
    w = F.from_json(strip_fence(F.col("response")), "struct<winner:string>")["winner"]
    side = F.when(w == "1", F.when(F.col("turn") == 0, "A").otherwise("B")).when(w == "2", F.when(F.col("turn") == 0, "B").otherwise("A")).otherwise("tie")
    both = said.select(key, "turn", side.alias("side")).groupBy(key).agg(F.min("side").alias("lo"), F.max("side").alias("hi"), F.count(F.lit(1)).alias("n"))
    return both.select(key, F.when((F.col("lo") == F.col("hi")) & (F.col("n") == 2), F.col("lo")).otherwise("tie").alias("winner"))


def tally(won: DataFrame) -> DataFrame:
    return won.agg(*[F.count_if(F.col("winner") == x).alias(n) for x, n in (("A", "a_wins"), ("B", "b_wins"), ("tie", "ties"))])


def questions(raw: str, most: int) -> list[str]:
    """A JSON list of questions, or else one for each line with a question mark."""
    import json

    try:
        found = [x.strip() for x in json.loads(raw.replace("```json", "").replace("```", "").strip()) if isinstance(x, str)]
    except (ValueError, TypeError):
        found = [x.strip(" -*0123456789.") for x in raw.splitlines() if "?" in x]
    return [x for x in found if x][:most]
