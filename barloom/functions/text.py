"""Word-list scoring of text as column expressions: no shuffle, one pass over the tokens of a row."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import safe_ratio
from barloom.sources.lexicon import NEGATION_WINDOW, NEGATORS, Lexicon

# Fixed value: what counts as a token.
TOKEN_PATTERN = r"([A-Za-z][A-Za-z'\-]*)"


def tokenize(text: Column) -> Column:
    """Upper-case alphabetic tokens of two or more characters, with outer quotes and dashes removed.

    The length is tested before the outer characters go, so "a-" is a token and "a" is not.
    """
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(1))
    return F.transform(F.filter(found, lambda t: F.length(t) > 1), lambda t: F.btrim(F.upper(t), F.lit("'-")))


def _in(token: Column, words: frozenset[str]) -> Column:
    return token.isin(sorted(words)) if words else F.lit(False)


def score_tokens(tokens: Column, lexicon: Lexicon) -> Column:
    """STRUCT(positive, negative, uncertainty, n_tokens) of a token array.

    The fold carries the distance to the latest negator; within the window a positive word is counted
    as negative. Literal sets of more than a few words become hash lookups in the plan.
    """
    far = 1_000_000

    def step(acc: Column, token: Column) -> Column:
        good = _in(token, lexicon.positive)
        flipped = good & (acc["since"] <= lexicon.window)
        bad = flipped | (~good & _in(token, lexicon.negative))
        return F.struct(
            (acc["positive"] + F.when(good & ~flipped, 1).otherwise(0)).alias("positive"),
            (acc["negative"] + F.when(bad, 1).otherwise(0)).alias("negative"),
            (acc["uncertainty"] + F.when(_in(token, lexicon.uncertainty), 1).otherwise(0)).alias("uncertainty"),
            F.when(_in(token, lexicon.negators), 1).otherwise(F.least(acc["since"] + 1, F.lit(far))).alias("since"),
        )

    start = F.struct(F.lit(0).alias("positive"), F.lit(0).alias("negative"), F.lit(0).alias("uncertainty"), F.lit(far).alias("since"))
    done = F.aggregate(tokens, start, step)
    return F.struct(done["positive"].alias("positive"), done["negative"].alias("negative"),
                    done["uncertainty"].alias("uncertainty"), F.size(tokens).alias("n_tokens"))


def tone(positive: Column, negative: Column) -> Column:
    """(p - n) / (p + n), 0 for text without sentiment words."""
    return F.coalesce(safe_ratio((positive - negative).cast("double"), (positive + negative).cast("double")), F.lit(0.0))


def negativity(negative: Column, n_tokens: Column) -> Column:
    """Share of negative tokens, 0 for empty text."""
    return F.coalesce(safe_ratio(negative.cast("double"), n_tokens.cast("double")), F.lit(0.0))


def with_scores(df: DataFrame, text: Column, lexicon: Lexicon) -> DataFrame:
    """Add positive, negative, uncertainty, n_tokens, tone and negativity."""
    scored = df.withColumn("_tokens", tokenize(text)).withColumn("_score", score_tokens(F.col("_tokens"), lexicon))
    counts = {c: F.col(f"_score.{c}").cast("long") for c in ("positive", "negative", "uncertainty", "n_tokens")}
    return scored.withColumns(counts).drop("_tokens", "_score").withColumns({
        "tone": tone(F.col("positive"), F.col("negative")),
        "negativity": negativity(F.col("negative"), F.col("n_tokens")),
    })


def score_with_table(df: DataFrame, key: str, text: Column, words: DataFrame, negators: frozenset[str] = NEGATORS,
                     window: int = NEGATION_WINDOW) -> DataFrame:
    """The same counts for word tables of any size: tokens are exploded and joined with the table.

    Costs one row per token and a shuffle by `key`, so `with_scores` is preferred for dictionaries.
    """
    flags = words.groupBy(F.col("word").alias("token")).agg(*[
        F.max(F.col("category") == c).alias(f"_{c}") for c in ("positive", "negative", "uncertainty")])
    tokens = df.select(key, F.posexplode_outer(tokenize(text)).alias("pos", "token"))
    hit = tokens.join(flags, "token", "left")
    near = Window.partitionBy(key).orderBy("pos").rowsBetween(-window, -1)
    negated = F.coalesce(F.max(F.col("token").isin(sorted(negators))).over(near), F.lit(False))
    good = F.coalesce("_positive", F.lit(False))
    marked = hit.select(
        key, "pos", (good & ~negated).alias("p"),
        ((good & negated) | (~good & F.coalesce("_negative", F.lit(False)))).alias("n"),
        F.coalesce("_uncertainty", F.lit(False)).alias("u"))
    return marked.groupBy(key).agg(
        F.count_if("p").alias("positive"), F.count_if("n").alias("negative"), F.count_if("u").alias("uncertainty"),
        F.count("pos").alias("n_tokens"))
