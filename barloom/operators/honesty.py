"""How much a Sharpe ratio can be trusted: standard errors, probabilistic and deflated Sharpe ratios.

Formulas: Lo (2002), Bailey and Lopez de Prado (2012, 2014). Sharpe ratios in the per-observation
functions are not annualised.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.normal import EULER_GAMMA, norm_cdf, norm_ppf
from barloom.functions.scalars import safe_ratio

YEAR = 252
INF = float("inf")


def unbiased_skew(skew_pop: Column, n: Column) -> Column:
    return skew_pop * F.sqrt((n * (n - 1)).cast("double")) / (n - 2)


def unbiased_kurtosis(excess_pop: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis; needs four observations."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess_pop + 6))


def _variance_term(sr: Column, skew: Column, kurt: Column) -> Column:
    return F.greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, F.lit(1e-12))


def sharpe_std_error(sr: Column, n: Column, skew: Column, kurt: Column) -> Column:
    return F.when(n < 2, INF).otherwise(F.sqrt(safe_ratio(_variance_term(sr, skew, kurt), (n - 1).cast("double"))))


def probabilistic_sharpe(sr: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """P(true Sharpe > benchmark)."""
    se = sharpe_std_error(sr, n, skew, kurt)
    return F.when((n < 2) | (se == 0), 0.0).otherwise(norm_cdf(safe_ratio(sr - benchmark, se)))


def expected_max_sharpe(n_trials: Column, trial_sd: Column) -> Column:
    """Expected best Sharpe of `n_trials` strategies without skill."""
    n = n_trials.cast("double")
    blend = (1 - EULER_GAMMA) * norm_ppf(1 - 1 / n) + EULER_GAMMA * norm_ppf(1 - 1 / (n * math.e))
    return F.when((n_trials > 1) & (trial_sd > 0), trial_sd * blend).otherwise(0.0)


def min_track_record_length(sr: Column, benchmark: Column, skew: Column, kurt: Column, confidence: float = 0.95) -> Column:
    """Observations until the probabilistic Sharpe reaches `confidence`."""
    z = norm_ppf(F.lit(confidence))
    return F.when(sr <= benchmark, INF).otherwise(1 + _variance_term(sr, skew, kurt) * F.pow(safe_ratio(z, sr - benchmark), F.lit(2.0)))


def min_backtest_years(n_trials: Column, target_annual: Column) -> Column:
    """Years of history below which the best of the trials is expected to reach the target by luck."""
    return F.when((n_trials <= 1) | (target_annual <= 0), 0.0).otherwise(
        safe_ratio(2 * F.ln(F.greatest(n_trials.cast("double"), F.lit(1.0))), target_annual * target_annual))


def with_honesty(moments: DataFrame, year: int = YEAR, n_trials: str | None = None, trial_sd: str | None = None) -> DataFrame:
    """Add the report to aggregated return moments (mean_ret, sd_ret, n_ret, skew_pop, kurt_pop).

    Degenerate series get the defaults. `n_trials` and `trial_sd` name columns with the number and the
    deviation of the annual Sharpes of everything that was tried; they add the deflated part. The
    columns are added in stages so that shared terms are computed once.
    """
    root = math.sqrt(year)
    c = F.col
    zero = F.lit(0.0)
    df = moments.withColumn("_ok", F.coalesce((c("n_ret") >= 3) & (c("sd_ret") > 0), F.lit(False)))
    df = df.withColumns({
        "_sr": F.when(c("_ok"), safe_ratio(c("mean_ret"), c("sd_ret"))).otherwise(0.0),
        "skew": F.when(c("_ok"), unbiased_skew(c("skew_pop"), c("n_ret"))).otherwise(0.0),
        "kurt": F.when(c("_ok"), F.coalesce(unbiased_kurtosis(c("kurt_pop"), c("n_ret")), F.lit(float("nan"))) + 3).otherwise(3.0),
    })
    df = df.withColumn("_se", sharpe_std_error(c("_sr"), c("n_ret"), c("skew"), c("kurt")))
    df = df.withColumns({
        "sharpe_annual": c("_sr") * root,
        "sharpe_se_annual": F.when(c("_ok"), c("_se") * root).otherwise(INF),
        "_z": F.when(c("_ok") & (c("_se") > 0), c("_sr") / c("_se")),
        "min_track_years": F.when(c("_ok"), min_track_record_length(c("_sr"), zero, c("skew"), c("kurt")) / year).otherwise(INF),
    })
    df = df.withColumn("psr_zero", F.when(c("_z").isNotNull(), norm_cdf(c("_z"))).otherwise(0.0))
    if n_trials is not None:
        many = c("_ok") & (c(n_trials) > 1)
        df = df.withColumn("_sr0", F.when(many, expected_max_sharpe(c(n_trials), c(trial_sd) / root)))
        df = df.withColumn("_z", F.when(c("_se") > 0, (c("_sr") - c("_sr0")) / c("_se")))
        df = df.withColumns({
            "expected_max_sharpe_annual": c("_sr0") * root,
            "dsr": F.when(many, F.coalesce(norm_cdf(c("_z")), zero)),
            "min_backtest_years": F.when(many, min_backtest_years(c(n_trials), F.greatest(c("_sr0") * root, F.lit(1e-9)))),
        }).drop("_sr0")
    return df.drop("_ok", "_sr", "_se", "_z")
