"""Market-shaped tables derived from the driver's star schema, once for Spark and once as SQL.

Suppliers play tickers: a supplier's daily discounts make its returns, so the panel grows with the
supplier table and the aggregation below it with the line items. Both forms give equal rows.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.scalars import per_day
from barloom.operators import panel as P
from barloom.session import BY_TICKER, cut_lineage
from barloom.sources import bars as B

MARKET = "SUPPLIER#000000001"
NAMES_PER_TASK = 128   # with ten years of days some quarter of a million rows


class Market:
    """The derived tables of one data folder. Every property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set(*BY_TICKER)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def documents(self) -> DataFrame:
        """Documents, spread over the cores when the file offers fewer splits than there are."""
        docs = self.table("documents")
        cores = self.spark.sparkContext.defaultParallelism
        return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)

    @cached_property
    def parts(self) -> int:
        """Partitions of the panel. Names are few bytes until each becomes a row for every day, so a number of partitions that
        suits the size of the shuffle lets a task's panel grow with the names; this one grows with them itself."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.table("supplier").count() // NAMES_PER_TASK))

    @cached_property
    def days(self) -> DataFrame:
        """Weekdays with line items, numbered."""
        days = self.table("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
        return B.trading_index(days.filter(F.weekday("date") < 5))

    @cached_property
    def bars(self) -> DataFrame:
        lines = self.table("lineitem").groupBy(
            F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("date")
        ).agg(
            (F.floor(F.sum(F.round(F.col("l_discount") * 100).cast("long")) * F.lit(100.0) / F.count("*")) - 500).alias("r_bp"),
            (F.floor(F.sum(F.round(F.col("l_tax") * 100).cast("long")) * F.lit(10.0) / F.count("*")) - 40).alias("gap_bp"),
            F.sum("l_quantity").cast("long").alias("vol"),
        )
        # a name's days with line items, and one row before all days; each then emits the days up to the next one
        last = self.days.agg(F.max("bar_idx")).scalar()
        names = self.table("supplier").select(F.col("s_suppkey").alias("k"), F.upper("s_name").alias("ticker"))
        events = lines.join(per_day(self.days.select("bar_idx", "date")), "date").drop("date").join(names, "k")
        before = names.withColumns({"bar_idx": F.lit(-1).cast("long"), **{c: F.lit(None).cast("long") for c in ("r_bp", "gap_bp", "vol")}})
        in_order = Window.partitionBy("ticker", "k").orderBy("bar_idx")
        placed = events.unionByName(before).repartition(self.parts, "ticker").withColumns({
            "total": F.sum(F.coalesce("r_bp", F.lit(0))).over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
            "own": F.col("bar_idx"), "from": F.greatest("bar_idx", F.lit(0)), "to": F.coalesce(F.lead("bar_idx").over(in_order) - 1, last),
        }).filter(F.col("from") <= F.col("to"))
        cells = placed.select("ticker", "k", "total", "own", "gap_bp", "vol", F.explode(F.sequence("from", "to")).alias("bar_idx"))
        here = F.col("own") == F.col("bar_idx")
        price = cells.join(per_day(self.days.select("bar_idx", "date")), "bar_idx").withColumns({
            "c": F.lit(100.0) * F.exp(F.col("total") / F.lit(10000.0)),
            "gap_bp": F.coalesce(F.when(here, F.col("gap_bp")), F.lit(0)),
            "vol": F.coalesce(F.when(here, F.col("vol")), F.lit(10)),
        })
        hole = (
            ((F.col("k") % 5 == 4) & (F.col("bar_idx") < 300))
            | ((F.col("k") % 100 == 3) & (F.col("bar_idx") > 1500))
            | ((F.col("k") % 100 == 7) & (F.col("bar_idx") % 50 == 0))
        )
        return price.filter(~hole).select(
            "ticker", "date",
            F.round(F.col("c") * (1 + F.col("gap_bp") / F.lit(10000.0)), 4).alias("open"),
            F.round(F.col("c") * 1.005, 4).alias("high"),
            F.round(F.col("c") * 0.995, 4).alias("low"),
            F.round("c", 4).alias("close"),
            F.col("vol").cast("double").alias("volume"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        return B.align_panel(self.bars, calendar=self.days)

    @cached_property
    def sectors(self) -> DataFrame:
        """Suppliers by region; every tenth one is left unmapped."""
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("supplier").filter(F.col("s_suppkey") % 10 != 0).join(
            nation, F.col("s_nationkey") == F.col("n_nationkey")
        ).select(F.upper("s_name").alias("ticker"), F.col("r_name").alias("sector"))

    @cached_property
    def membership(self) -> DataFrame:
        """The 60 % of suppliers with the largest revenue in each quarter."""
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        revenue = self.table("lineitem").groupBy(
            F.trunc("l_shipdate", "quarter").alias("date"), F.col("l_suppkey")
        ).agg(F.sum(cents).alias("cents")).join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        quarter = Window.partitionBy("date")
        return revenue.withColumns({
            "rk": F.row_number().over(quarter.orderBy(F.desc("cents"), "s_name")), "n": F.count("*").over(quarter),
        }).filter(F.col("rk") * 10 <= F.col("n") * 6).select("date", F.upper("s_name").alias("ticker"))

    @cached_property
    def raw_news(self) -> DataFrame:
        """Documents as articles: created on the day of an order, tagged with the suppliers of that order."""
        tags = self.table("lineitem").join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
            "l_orderkey").agg(F.array_sort(F.collect_set("s_name")).alias("symbols"))
        placed = self.documents().join(self.table("orders"), F.col("doc_id") == F.col("o_orderkey"))
        return placed.join(tags, F.col("doc_id") == F.col("l_orderkey"), "left").select(
            F.col("doc_id").alias("id"),
            F.expr("timestampadd(MINUTE, CAST((doc_id * 37) % 1440 AS INT), o_orderdate)").alias("created_at"),
            F.expr("substr(text, 1, 80)").alias("headline"), F.expr("substr(text, 81)").alias("summary"),
            F.col("source"), F.col("lang"), "symbols",
        )

    @cached_property
    def targets(self) -> DataFrame:
        """Target weights per customer account: suppliers of its open orders, by value."""
        lines = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter(
            (F.col("o_orderstatus") == "O") & (F.col("l_suppkey") % 4 != 3)
        ).join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        held = lines.groupBy(F.col("o_custkey").alias("account"), F.upper("s_name").alias("ticker")).agg(
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
        total = held.groupBy("account").agg(F.sum("cents").alias("total"))
        return held.join(total, "account").select(
            "account", "ticker",
            (F.lit(0.95).cast("double") * (F.col("cents").cast("double") / F.col("total").cast("double"))).alias("weight"),
        )

    @cached_property
    def holdings(self) -> DataFrame:
        """Shares per customer account: quantity bought in finished orders."""
        lines = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter(
            (F.col("o_orderstatus") == "F") & (F.col("l_suppkey") % 4 != 1)
        ).join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        return lines.groupBy(F.col("o_custkey").alias("account"), F.upper("s_name").alias("ticker")).agg(
            F.sum("l_quantity").alias("quantity"))

    @cached_property
    def last_close(self) -> DataFrame:
        return self.bars.groupBy("ticker").agg(F.max_by("close", "date").alias("price"))

    @cached_property
    def accounts(self) -> DataFrame:
        """Equity and cash per customer account."""
        return self.table("customer").select(
            F.col("c_custkey").alias("account"),
            (F.lit(20000.0) + F.col("c_acctbal")).alias("equity"),
            (F.col("c_acctbal") * 0.5).alias("cash"),
            F.when(F.col("c_custkey") % 7 != 0, F.lit(20500.0)).alias("last_equity"),
        )

    @cached_property
    def fills(self) -> DataFrame:
        supplier = self.table("supplier").select("s_suppkey", F.upper("s_name").alias("ticker"))
        return self.table("lineitem").join(
            self.table("part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")
        ).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
            F.when(F.col("l_linestatus") == "F", "paper").otherwise("live").alias("broker"),
            F.to_date("l_shipdate").alias("as_of"), "ticker",
            F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
            F.when(F.col("l_discount") >= 0.095, "rejected").when(F.col("l_tax") >= 0.075, "partially_filled").otherwise("filled").alias("status"),
            F.when(F.col("l_discount") >= 0.095, 0.0).otherwise(F.col("l_quantity")).alias("filled_quantity"),
            (F.col("p_retailprice") * (1 + (F.col("l_tax") - 0.04) / 100)).alias("filled_price"),
            F.col("p_retailprice").alias("modelled_price"),
        )

    @cached_property
    def trades(self) -> DataFrame:
        """Line items as fills of a supplier's account in a brand; `seq` orders one day's fills of one name."""
        day = Window.partitionBy("l_suppkey", "p_brand", F.to_date("l_shipdate")).orderBy(
            "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
        return self.table("lineitem").join(
            self.table("part").select("p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")
        ).select(
            F.col("l_suppkey").alias("account"), F.col("p_brand").alias("ticker"), F.to_date("l_shipdate").alias("date"),
            F.row_number().over(day).cast("long").alias("seq"),
            F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
            F.col("l_quantity").alias("quantity"),
            (F.col("p_retailprice") * (1 + F.col("l_discount"))).alias("price"),
            F.col("l_tax").alias("commission"),
        )

    @cached_property
    def guard_log(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("account"), F.col("event_id").alias("seq"), F.to_date("ts").alias("as_of"),
            (F.col("event_type") != "error").alias("passed"),
        )

    @cached_property
    def marked(self) -> DataFrame:
        return P.with_mark(self.grid)

    def materialise(self) -> None:
        """Store the marked panel once, for jobs that read it for signals, fills and valuation."""
        self.days = cut_lineage(self.days)
        self.marked = self.grid = cut_lineage(P.with_mark(B.align_panel(self.bars, calendar=self.days))).repartition(self.parts, "ticker")


# ---- the same tables as SQL: name -> (depends on, select) ---------------------------------------
CTES: dict[str, tuple[list[str], str]] = {
    "cal": ([], """
        SELECT date, row_number() OVER (ORDER BY date) - 1 AS bar_idx, count(*) OVER () AS n_bars
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) t WHERE isodow(date) < 6"""),
    "lines": ([], """
        SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS date,
               CAST(floor(sum(CAST(round(l_discount*100) AS BIGINT)) * 100.0::DOUBLE / count(*)) AS BIGINT) - 500 AS r_bp,
               CAST(floor(sum(CAST(round(l_tax*100) AS BIGINT)) * 10.0::DOUBLE / count(*)) AS BIGINT) - 40 AS gap_bp,
               CAST(sum(l_quantity) AS BIGINT) AS vol
        FROM lineitem GROUP BY ALL"""),
    "bars": (["cal", "lines"], """
        SELECT ticker, date, round(c * (1 + gap_bp / 10000.0::DOUBLE), 4) AS open, round(c * 1.005::DOUBLE, 4) AS high,
               round(c * 0.995::DOUBLE, 4) AS low, round(c, 4) AS close, CAST(vol AS DOUBLE) AS volume
        FROM (SELECT s_suppkey AS k, upper(s_name) AS ticker, cal.date, bar_idx, coalesce(gap_bp, 0) AS gap_bp, coalesce(vol, 10) AS vol,
                     100.0::DOUBLE * exp(sum(coalesce(r_bp, 0)) OVER (PARTITION BY s_suppkey ORDER BY bar_idx) / 10000.0::DOUBLE) AS c
              FROM supplier CROSS JOIN cal LEFT JOIN lines ON lines.k = s_suppkey AND lines.date = cal.date) px
        WHERE NOT ((k % 5 = 4 AND bar_idx < 300) OR (k % 100 = 3 AND bar_idx > 1500) OR (k % 100 = 7 AND bar_idx % 50 = 0))"""),
    "grid": (["cal", "bars"], """
        SELECT t.ticker, cal.date, cal.bar_idx, open, high, low, close, volume
        FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN cal LEFT JOIN bars ON bars.ticker = t.ticker AND bars.date = cal.date"""),
    "sectors": ([], """
        SELECT upper(s_name) AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 10 <> 0"""),
    "membership": ([], """
        SELECT date, ticker FROM (
          SELECT date, upper(s_name) AS ticker, row_number() OVER (PARTITION BY date ORDER BY cents DESC, s_name) AS rk, count(*) OVER (PARTITION BY date) AS n
          FROM (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, l_suppkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents
                FROM lineitem GROUP BY ALL) q JOIN supplier ON l_suppkey = s_suppkey) r WHERE rk * 10 <= n * 6"""),
    "member_grid": (["grid", "membership"], """
        SELECT g.*, m.ticker IS NOT NULL AS member FROM (
          SELECT grid.*, (SELECT max(date) FROM membership s WHERE s.date <= grid.date) AS snapshot FROM grid) g
        LEFT JOIN membership m ON m.date = g.snapshot AND m.ticker = g.ticker"""),
    "marked": (["grid"], """
        SELECT *, coalesce(open, lag(mark) OVER (PARTITION BY ticker ORDER BY bar_idx)) AS fill_ref FROM (
          SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mark
          FROM grid) g"""),
    "raw_news": ([], """
        SELECT doc_id AS id, o_orderdate + to_minutes(CAST((doc_id * 37) % 1440 AS INTEGER)) AS created_at,
               substr(text, 1, 80) AS headline, substr(text, 81) AS summary, source, lang, symbols
        FROM documents JOIN orders ON o_orderkey = doc_id LEFT JOIN (
          SELECT l_orderkey, list_sort(list(DISTINCT s_name)) AS symbols FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey) t
        ON l_orderkey = doc_id"""),
    "targets": ([], """
        SELECT account, ticker, 0.95::DOUBLE * (CAST(cents AS DOUBLE) / CAST(sum(cents) OVER (PARTITION BY account) AS DOUBLE)) AS weight FROM (
          SELECT o_custkey AS account, upper(s_name) AS ticker, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
          WHERE o_orderstatus = 'O' AND l_suppkey % 4 <> 3 GROUP BY ALL) h"""),
    "holdings": ([], """
        SELECT o_custkey AS account, upper(s_name) AS ticker, sum(l_quantity) AS quantity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
        WHERE o_orderstatus = 'F' AND l_suppkey % 4 <> 1 GROUP BY ALL"""),
    "last_close": (["bars"], "SELECT ticker, max_by(close, date) AS price FROM bars GROUP BY ticker"),
    "accounts": ([], """
        SELECT c_custkey AS account, 20000.0::DOUBLE + c_acctbal AS equity, c_acctbal * 0.5::DOUBLE AS cash,
               CASE WHEN c_custkey % 7 <> 0 THEN 20500.0::DOUBLE END AS last_equity FROM customer"""),
    "fills": ([], """
        SELECT CASE WHEN l_linestatus = 'F' THEN 'paper' ELSE 'live' END AS broker, CAST(l_shipdate AS DATE) AS as_of, upper(s_name) AS ticker,
               CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
               CASE WHEN l_discount >= 0.095 THEN 'rejected' WHEN l_tax >= 0.075 THEN 'partially_filled' ELSE 'filled' END AS status,
               CASE WHEN l_discount >= 0.095 THEN 0.0::DOUBLE ELSE l_quantity END AS filled_quantity,
               p_retailprice * (1 + (l_tax - 0.04::DOUBLE) / 100) AS filled_price, p_retailprice AS modelled_price
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""),
    "trades": ([], """
        SELECT l_suppkey AS account, p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
               row_number() OVER (PARTITION BY l_suppkey, p_brand, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey,
                                  l_extendedprice, l_quantity, l_discount, l_tax) AS seq,
               CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity AS quantity,
               p_retailprice * (1 + l_discount) AS price, l_tax AS commission
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "guard_log": ([], """
        SELECT user_id AS account, event_id AS seq, CAST(ts AS DATE) AS as_of, event_type <> 'error' AS passed FROM events"""),
}


def sql(final: str, *uses: str, recursive: bool = False, **steps: str) -> str:
    """Compose a statement: the named tables, everything they depend on, own steps in order, then the final select."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for name in uses:
        visit(name)
    # a step that refers to itself cannot be materialised, everything a recursion reads should be
    how = lambda n, body: "AS MATERIALIZED" if recursive and f" {n} " not in body else "AS"
    bodies = {**{n: CTES[n][1] for n in order}, **steps}
    parts = [f"{n} {how(n, body)} ({body})" for n, body in bodies.items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + final


def r6(expr: str) -> str:
    """SQL rounding that never yields a negative zero."""
    return f"round({expr}, 6) + 0.0::DOUBLE"


def r6c(col, digits: int = 6):
    """The Spark side of `r6`."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits)
