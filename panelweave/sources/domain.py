"""Domain tables derived from the star-schema tables the queries run on.

Every table is a lazy DataFrame over the whole source: bars, panels, reports, intervals,
source-shaped price tables, instrument dimensions, and session events.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.grid import densify
from panelweave.operators.ordering import numbered

OPEN_DAYS = 90
NUDGE = 1e-10  # off exact halves, so that rounding does not depend on the engine


class Domain:
    """Tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ---- panels

    @cached_property
    def bars(self) -> DataFrame:
        """Monthly bars per supplier, with report-like sums beside the prices."""
        price = F.col("l_extendedprice") / F.col("l_quantity")
        net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        r = lambda c, n: F.round(c + F.lit(NUDGE), 6).alias(n)
        # Grouped by the plain key; the code text is made once per bar.
        sums = self.table("lineitem").groupBy(F.trunc("l_shipdate", "month").alias("date"), "l_suppkey").agg(
            r(F.sum("l_extendedprice") / F.sum("l_quantity"), "close"), r(F.max(price), "high"), r(F.min(price), "low"),
            F.sum("l_quantity").alias("volume"), r(F.sum("l_extendedprice"), "amount"), r(F.sum(net), "net_profit"),
            r(F.sum(net * (1 - F.col("l_tax"))), "cfo"), r(F.sum(F.col("l_extendedprice") * F.col("l_tax")), "debt"),
        )
        code = F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("code")
        return sums.select("date", code, "close", "high", "low", "volume", "amount", "net_profit", "cfo", "debt")

    @cached_property
    def grid(self) -> DataFrame:
        return densify(self.bars)

    def panel(self, *cols: str) -> DataFrame:
        """Dense monthly panel of the named columns only."""
        return densify(self.bars.select("date", "code", *cols))

    def one(self, col: str) -> DataFrame:
        """Dense monthly panel of one column, called ``value``."""
        return densify(self.bars.select("date", "code", F.col(col).alias("value")))

    @cached_property
    def daily(self) -> DataFrame:
        """Daily event value per user."""
        return (
            self.table("events").groupBy(F.col("ts").cast("date").alias("date"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("code"))
            .agg(F.round(F.sum("value"), 6).alias("value"))
        )

    @cached_property
    def industries(self) -> DataFrame:
        s, n = self.table("supplier"), self.table("nation")
        return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code"), F.col("n_name").alias("industry")
        )

    # ---- calendar, reports, intervals

    @cached_property
    def calendar(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()

    @cached_property
    def exchange_calendar(self) -> DataFrame:
        """Source-shaped calendar: text days with the exchange that trades on them."""
        market = F.when(F.col("o_orderstatus") == "F", "SSE").when(F.col("o_orderstatus") == "O", "SZSE").otherwise("HKEX")
        return self.table("orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("trade_days"), market.alias("s_info_exchmarket"))

    @cached_property
    def reports(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("report_period"))
        return self.table("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("code"), "report_period",
            F.col("l_shipdate").cast("date").alias("announcement_date"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value"),
        )

    @cached_property
    def intervals(self) -> DataFrame:
        """Active span per customer; customers active in the last 90 days are still open."""
        o = self.table("orders")
        per = o.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code")).agg(
            F.min("o_orderdate").cast("date").alias("start"), F.max("o_orderdate").cast("date").alias("_last")
        )
        newest = o.agg(F.max("o_orderdate").cast("date")).scalar()
        return per.withColumn("_newest", newest).select(
            "code", "start", F.when(F.col("_last") <= F.date_sub("_newest", OPEN_DAYS), F.col("_last")).alias("end")
        )

    def _segments(self) -> DataFrame:
        return self.table("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"), "c_mktsegment", "c_nationkey")

    @cached_property
    def st_intervals(self) -> DataFrame:
        seg = F.col("c_mktsegment")
        kind = F.when(seg == "AUTOMOBILE", "S").when(seg == "BUILDING", "Y").when(seg == "FURNITURE", "L").otherwise("N")
        return self.intervals.join(self._segments(), "code").select("code", "start", "end", kind.alias("type"))

    @cached_property
    def daily_status(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", -1).when(F.col("o_orderstatus") == "O", 0)
        return self.table("orders").select(
            F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code"), F.col("o_orderdate").cast("date").alias("date"), status.alias("status"), "o_orderkey"
        )

    @cached_property
    def memberships(self) -> DataFrame:
        return self.intervals.join(self._segments(), "code").select(
            F.col("c_mktsegment").alias("index_code"), "code", "start", "end", F.date_add("start", 7).alias("opdate")
        )

    @cached_property
    def industry_spells(self) -> DataFrame:
        ind = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 4, "0"), F.lit("07"), F.lit("99"))
        return self.intervals.join(self._segments(), "code").select("code", ind.alias("ind_code"), F.col("start").alias("entry"), F.col("end").alias("remove"))

    @cached_property
    def industry_codes(self) -> DataFrame:
        """Code list at depth 4 for every nation and at depth 6 for those of one region."""
        n = self.table("nation")
        four = n.select(
            F.rpad(F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), 16, "0").alias("industriescode"), F.col("n_name").alias("industriesname"),
            F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("industriesalias"),
        )
        six = n.filter("n_regionkey = 2").select(
            F.rpad(F.concat(F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), F.lit("07")), 16, "0").alias("industriescode"),
            F.concat(F.lit("SUB "), F.col("n_name")).alias("industriesname"), F.lit("").alias("industriesalias"),
        )
        return four.unionByName(six)

    # ---- source-shaped prices

    @cached_property
    def stock_eod(self) -> DataFrame:
        price = F.col("l_extendedprice") / F.col("l_quantity")
        sums = self.table("lineitem").groupBy("l_suppkey", "l_shipdate").agg(
            F.round(F.sum("l_extendedprice") / F.sum("l_quantity") + F.lit(NUDGE), 4).alias("s_dq_close"), F.round(F.min(price) + F.lit(NUDGE), 4).alias("s_dq_low"),
            F.round(F.max(price) + F.lit(NUDGE), 4).alias("s_dq_high"), F.sum("l_quantity").alias("s_dq_volume"), F.round(F.sum("l_extendedprice") + F.lit(NUDGE), 4).alias("s_dq_amount"),
            (1 + F.max("l_discount")).alias("_f"), (1 - F.max("l_tax")).alias("_b"),
            F.max(F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "N", 2).otherwise(1)).alias("_flag"),
        )
        g = sums.withColumns({
            "s_info_windcode": F.concat((F.lit(600000) + F.col("l_suppkey")).cast("string"), F.lit(".SH")), "trade_dt": F.date_format("l_shipdate", "yyyyMMdd"),
        }).drop("l_suppkey", "l_shipdate")
        up = {f"s_dq_adj{c}": F.col(f"s_dq_{c}") * F.col("_f") for c in ("close", "high", "low", "open", "preclose")}
        return g.withColumns({"s_dq_open": F.col("s_dq_low"), "s_dq_preclose": F.col("s_dq_high")}).withColumns({
            **up, "s_dq_adjclose_backward": F.col("s_dq_close") * F.col("_b"), "s_dq_adjfactor": F.col("_f").cast("string"),
            "s_dq_limit": F.col("s_dq_close") * 1.1, "s_dq_stopping": F.col("s_dq_close") * 0.9,
            "s_dq_tradestatuscode": F.when(F.col("_flag") == 3, "0").when(F.col("_flag") == 2, "-1"),
        }).drop("_f", "_b", "_flag")

    @cached_property
    def index_eod(self) -> DataFrame:
        code = F.when(F.col("l_returnflag") == "A", "000001.SH").when(F.col("l_returnflag") == "N", "399001.SZ").otherwise("900001.BJ")
        sums = self.table("lineitem").groupBy("l_returnflag", "l_shipdate").agg(
            F.round(F.sum("l_extendedprice") / F.sum("l_quantity") + F.lit(NUDGE), 4).alias("s_dq_close"), F.sum("l_quantity").alias("s_dq_volume")
        )
        return sums.select(code.alias("s_info_windcode"), F.date_format("l_shipdate", "yyyyMMdd").alias("trade_dt"), "s_dq_close", "s_dq_volume")

    @cached_property
    def asked_codes(self) -> DataFrame:
        stocks = self.table("supplier").select(F.concat((F.lit(600000) + F.col("s_suppkey")).cast("string"), F.lit(".SH")).alias("code"))
        return stocks.unionByName(self.index_eod.select(F.col("s_info_windcode").alias("code")).distinct())

    @cached_property
    def instrument_tables(self) -> dict[str, DataFrame]:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        code = F.concat((F.lit(600000) + F.col("s_suppkey")).cast("string"), F.when(F.col("s_nationkey") < 10, ".SH").when(F.col("s_nationkey") < 20, ".SZ").otherwise(".BJ"))
        number = F.concat(F.when(F.col("s_nationkey") < 8, "688").when(F.col("s_nationkey") < 14, "300").when(F.col("s_nationkey") < 20, "830").otherwise("600"), F.col("s_suppkey").cast("string"))
        base = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("s_info_windcode", code)
        k4 = F.lpad(F.col("s_nationkey").cast("string"), 6, "0")
        codes = n.select(
            F.concat(F.lpad(F.col("n_nationkey").cast("string"), 6, "0"), F.lit("0" * 10)).alias("industriescode"), F.col("n_name").alias("industriesname"),
            F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("industriesalias"), F.lit(None).cast("string").alias("wind_name_eng"),
        ).unionByName(r.select(
            F.concat(F.lpad((F.col("r_regionkey") + 500).cast("string"), 3, "0"), F.lit("0" * 13)).alias("industriescode"), F.col("r_name").alias("industriesname"),
            F.lit(None).cast("string").alias("industriesalias"), F.upper("r_name").alias("wind_name_eng"),
        ))
        return {
            "description": base.select(
                "s_info_windcode", number.alias("s_info_code"), F.col("s_name").alias("s_info_name"), F.lit("").alias("s_info_listboardname"),
                F.when(F.col("s_acctbal") < 0, 1).otherwise(0).alias("is_delisted"), F.lower("s_name").alias("s_info_pinyin"),
                F.lit("19950102").alias("s_info_listdate"), F.when(F.col("s_acctbal") < 0, "20010101").alias("s_info_delistdate"),
            ),
            "industry": base.select("s_info_windcode", F.concat(k4, F.lit("77")).alias("sec_ind_code"), F.when(F.col("s_acctbal") < 9000, "1").otherwise("0").alias("cur_sign")),
            "sector": base.select("s_info_windcode", F.concat((F.col("n_regionkey") + 500).cast("string"), F.lit("88")).alias("wind_ind_code"), F.lit("1").alias("cur_sign")),
            "industry_codes": codes,
            "ipo": base.filter("s_acctbal > 0").select("s_info_windcode", F.col("s_acctbal").alias("s_ipo_price")),
            "intro": base.select("s_info_windcode", F.concat(F.lit("Office "), F.col("n_name")).alias("s_info_office"), F.col("r_name").alias("s_info_province")),
            "lot": base.filter("s_acctbal > 1000").select("s_info_windcode", F.lit(100).alias("s_info_lot_size")),
        }

    # ---- event log

    @cached_property
    def session_events(self) -> DataFrame:
        """Events numbered 1, 2, … within each user, with a payload of their own values."""
        e = self.table("events").select("user_id", "ts", "event_id", "event_type", "value")
        n = numbered(e, [F.col("ts"), F.col("event_id")], ["user_id"], "sequence")
        return n.select(
            F.col("user_id").alias("session_id"), F.col("sequence"), "event_type", "ts", "event_id",
            F.create_map(F.lit("cart"), F.when(F.col("value") >= 5, F.col("event_id").cast("string")), F.lit("page"), F.col("event_type"), F.lit("total"), F.col("event_id").cast("string")).alias("payload"),
        )


# Rules of the derived sessions: which event may set and which clears which snapshot key, and
# a five-state machine over the five event types.
EVENT_WRITES = {"view": ["page"], "click": ["page", "cart"], "purchase": ["total"], "signup": ["page"]}
EVENT_INVALIDATES = {"purchase": ["cart"], "error": ["page", "cart", "total"], "signup": ["cart"]}
EVENT_STATES = [
    ("created", "view", "browsing"), ("created", "click", "browsing"), ("created", "signup", "member"), ("created", "error", "broken"),
    ("created", "purchase", "buyer"), ("browsing", "view", "browsing"), ("browsing", "click", "browsing"), ("browsing", "signup", "member"),
    ("browsing", "purchase", "buyer"), ("browsing", "error", "broken"), ("member", "view", "member"), ("member", "click", "browsing"),
    ("member", "purchase", "buyer"), ("member", "error", "broken"), ("member", "signup", "member"), ("buyer", "view", "buyer"),
    ("buyer", "click", "browsing"), ("buyer", "error", "broken"), ("buyer", "purchase", "buyer"), ("buyer", "signup", "member"),
    ("broken", "view", "browsing"), ("broken", "click", "browsing"), ("broken", "error", "broken"), ("broken", "signup", "created"),
]
