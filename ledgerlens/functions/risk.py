"""Risk tone of a screening result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score bands and level keywords, tested in this order.
RED_SCORE, YELLOW_SCORE = 7, 3
RED_WORDS = ["severe", "high", "critical", "elevated"]
YELLOW_WORDS = ["medium", "moderate", "watch"]
GREEN_WORDS = ["low", "very low", "none", "minimal"]


def _any_word(level: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [level.contains(w) for w in words])


def risk_tone(status: Column, provider: Column, score: Column, level: Column) -> Column:
    """neutral, green, yellow or red."""
    word = F.lower(F.coalesce(level, F.lit("")))
    return (
        F.when(status.isNull() | (status != "ok"), "neutral")
        .when((provider == "elliptic") & (word == "check passed"), "green")
        .when((provider == "trm") & score.isNull() & (F.trim(word) == ""), "green")
        .when(score >= RED_SCORE, "red")
        .when(score >= YELLOW_SCORE, "yellow")
        .when(score.isNotNull(), "green")
        .when(_any_word(word, RED_WORDS), "red")
        .when(_any_word(word, YELLOW_WORDS), "yellow")
        .when(_any_word(word, GREEN_WORDS), "green")
        .otherwise("neutral")
    )
