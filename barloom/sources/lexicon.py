"""Sentiment word lists."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A positive word within three tokens after one of these counts as negative.
NEGATORS = frozenset({"NO", "NOT", "NONE", "NEITHER", "NEVER", "NOBODY", "NOR", "CANNOT", "WITHOUT"})
NEGATION_WINDOW = 3

REQUIRED = ["Word", "Negative", "Positive"]
CATEGORIES = ["Positive", "Negative", "Uncertainty", "Litigious"]

# A dictionary of a language has at most some hundred thousand entries; larger tables are joined instead.
MAX_LITERAL_WORDS = 200_000


@dataclass(frozen=True)
class Lexicon:
    """Word sets small enough to travel inside the plan as hashed literals."""

    positive: frozenset[str]
    negative: frozenset[str]
    uncertainty: frozenset[str] = frozenset()
    litigious: frozenset[str] = frozenset()
    negators: frozenset[str] = field(default=NEGATORS)
    window: int = NEGATION_WINDOW
    name: str = "lm"

    def __len__(self) -> int:
        return len(self.positive) + len(self.negative)


def lexicon_long(raw: DataFrame) -> DataFrame:
    """Master dictionary rows -> (category, word).

    A category column holds the year a word entered the list; a negative year means that it was
    removed and zero that it never was in, so only positive values count.
    """
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"not a master dictionary, missing {missing}")
    present = [c for c in CATEGORIES if c in raw.columns]
    years = raw.select(F.upper("Word").alias("word"), *[F.expr(f"try_cast({c} AS DOUBLE)").alias(c.lower()) for c in present])
    long = years.unpivot("word", [c.lower() for c in present], "category", "year")
    return long.filter(F.col("year") > 0).select("category", "word").distinct()


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return lexicon_long(spark.read.option("header", True).csv(path))


def collect_lexicon(words: DataFrame, **options) -> Lexicon:
    """Bring a word table to the driver as literal sets; refuses tables beyond a dictionary's size."""
    rows = words.select("category", "word").distinct().limit(MAX_LITERAL_WORDS + 1).collect()
    if len(rows) > MAX_LITERAL_WORDS:
        raise ValueError("too many words for literal sets; use score_with_table")
    sets: dict[str, set[str]] = {c.lower(): set() for c in CATEGORIES}
    for row in rows:
        sets.setdefault(row["category"].lower(), set()).add(row["word"].upper())
    return Lexicon(**{k: frozenset(sets[k]) for k in ("positive", "negative", "uncertainty", "litigious")}, **options)
