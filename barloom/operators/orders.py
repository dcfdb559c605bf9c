"""From target weights and holdings to orders, for all accounts at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import finite_or_null, safe_ratio
from barloom.operators.limits import RiskLimits, apply_limits


def whole(x: Column) -> Column:
    """Truncate toward zero."""
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def price_fallback(needed: DataFrame, quotes: DataFrame, last_close: DataFrame) -> DataFrame:
    """(ticker, price): the broker's quote, else the last known close. NaN is no quote."""
    return needed.select("ticker").distinct().join(quotes.select("ticker", finite_or_null("price").alias("_quote")), "ticker", "left").join(
        last_close.select("ticker", finite_or_null("price").alias("_close")), "ticker", "left"
    ).select("ticker", F.coalesce("_quote", "_close").alias("price"), F.col("_quote").isNull().alias("stale"))


def current_weights(holdings: DataFrame, prices: DataFrame, accounts: DataFrame) -> DataFrame:
    """Market value over equity per holding; 0 without a price, and everywhere when there is no equity."""
    return holdings.join(prices.select("ticker", "price"), "ticker", "left").join(accounts.select("account", "equity"), "account").select(
        "account", "ticker", F.coalesce(safe_ratio(F.col("quantity") * F.col("price"), F.col("equity")), F.lit(0.0)).alias("current_w"))


def order_diff(targets: DataFrame, holdings: DataFrame, prices: DataFrame, accounts: DataFrame,
               min_trade_notional: float = 1.0, min_trade_weight: float = 0.002, fractional: bool = True) -> DataFrame:
    """Orders that move each account from its holdings to its targets.

    Dust below `min_trade_notional` is skipped, and so are moves below `min_trade_weight` of equity
    unless they close the position. Names without a usable price are left alone.
    """
    both = targets.select("account", "ticker", finite_or_null("weight").alias("weight")).join(
        holdings.select("account", "ticker", finite_or_null("quantity").alias("quantity")), ["account", "ticker"], "full"
    ).na.fill(0.0, ["weight", "quantity"])
    priced = both.join(prices.select("ticker", finite_or_null("price").alias("price")), "ticker").filter(F.col("price") > 0)
    sized = priced.join(accounts.select("account", "equity"), "account")
    goal = F.col("weight") * F.col("equity") / F.col("price")
    sized = sized.withColumn("_delta", (goal if fractional else whole(goal)) - F.col("quantity"))
    notional = F.abs("_delta") * F.col("price")
    closing = (F.col("weight") == 0) & (F.col("quantity") != 0)
    size = F.abs("_delta") if fractional else whole(F.abs("_delta"))
    worth = (notional >= min_trade_notional) & (closing | (notional >= min_trade_weight * F.col("equity")))
    return sized.filter(worth).select(
        "account", "ticker", F.when(F.col("_delta") > 0, "buy").otherwise("sell").alias("side"),
        size.alias("quantity"), "price", "equity", F.col("weight").alias("target_w"),
    ).filter(F.col("quantity") > 0)


def cap_buys(orders: DataFrame, accounts: DataFrame, buffer: float = 0.005) -> DataFrame:
    """Scale an account's buys so that they fit in cash plus sale proceeds less a buffer of equity.

    The totals are pre-aggregated per account and joined back, so one huge account is no hot group.
    """
    value = F.col("quantity") * F.coalesce("price", F.lit(0.0))
    totals = orders.groupBy("account").agg(
        F.sum(F.when(F.col("side") == "buy", value).otherwise(0.0)).alias("_buys"),
        F.sum(F.when(F.col("side") == "sell", value).otherwise(0.0)).alias("_sells"))
    funds = totals.join(accounts.select("account", "cash", F.col("equity").alias("_equity")), "account")
    room = F.col("cash") + F.col("_sells") - buffer * F.col("_equity")
    scale = F.when((F.col("_buys") <= room) | (F.col("_buys") <= 0), 1.0).otherwise(F.greatest(room, F.lit(0.0)) / F.col("_buys"))
    scaled = orders.join(funds.select("account", scale.alias("_scale")), "account").withColumn(
        "quantity", F.when(F.col("side") == "buy", F.col("quantity") * F.col("_scale")).otherwise(F.col("quantity")))
    return scaled.filter((F.col("side") == "sell") | (F.col("quantity") > 0)).drop("_scale")


def volume_cap(orders: DataFrame, share: float = 0.05) -> DataFrame:
    """Add `filled`: the order limited to a share of the bar's volume; unknown or zero volume does not limit."""
    cap = F.lit(share) * F.col("volume")
    return orders.withColumn("filled", F.when(F.col("volume") > 0, F.least(F.col("quantity"), cap)).otherwise(F.col("quantity")))


def rebalance_plan(targets: DataFrame, holdings: DataFrame, quotes: DataFrame, last_close: DataFrame, accounts: DataFrame,
                   limits: RiskLimits = RiskLimits(), due: DataFrame | None = None, exposure: DataFrame | None = None,
                   min_trade_notional: float = 1.0, min_trade_weight: float = 0.002, fractional: bool = True,
                   buffer: float = 0.005) -> DataFrame:
    """Today's order list per account, sells first.

    `due` lists the accounts whose schedule asks for a rebalance today; `exposure` (account, scale)
    comes from the drawdown budget.
    """
    if due is not None:
        accounts = accounts.join(due.select("account"), "account", "left_semi")
        targets = targets.join(due.select("account"), "account", "left_semi")
        holdings = holdings.join(due.select("account"), "account", "left_semi")
    limited = apply_limits(targets, limits, ["account"])
    if exposure is not None:
        limited = limited.join(exposure.select("account", "scale"), "account", "left").withColumn(
            "weight", F.col("weight") * F.coalesce("scale", F.lit(1.0)))
    limited = limited.filter(F.col("weight") != 0)
    needed = limited.select("ticker").unionByName(holdings.select("ticker"))
    prices = price_fallback(needed, quotes, last_close)
    orders = cap_buys(order_diff(limited, holdings, prices, accounts, min_trade_notional, min_trade_weight, fractional), accounts, buffer)
    if not fractional:
        orders = orders.withColumn("quantity", whole(F.col("quantity"))).filter(F.col("quantity") > 0)
    held = current_weights(holdings, prices, accounts)
    queue = Window.partitionBy("account").orderBy(F.desc("side"), "ticker")
    return orders.join(held, ["account", "ticker"], "left").select(
        "account", F.row_number().over(queue).cast("long").alias("submit_no"), "ticker", "side", F.round("quantity", 4).alias("quantity"),
        F.col("price").alias("est_price"), F.round(F.col("quantity") * F.col("price"), 2).alias("est_notional"),
        F.round(F.coalesce("current_w", F.lit(0.0)), 4).alias("current_w"), F.round("target_w", 4).alias("target_w"))
