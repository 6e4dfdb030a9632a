"""Small keyed registries: metric definitions, field aliases, units. Fixed-size tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: metric key, name, category, source table, source column, time role, unit,
# lowest and highest plausible value, review status
METRICS = [
    ("ROE_TTM", "净资产收益率 (TTM)", "profitability", "asharettmhis", "s_fa_roe_ttm", "report_period", "percent", -100.0, 100.0, "reviewed"),
    ("ROA_TTM", "总资产收益率 (TTM)", "profitability", "asharettmhis", "s_fa_roa_ttm", "report_period", "percent", -50.0, 50.0, "reviewed"),
    ("CFO_TO_PROFIT", "现金流对利润比", "profitability", "asharecashflow", "net_cash_flows_oper_act", "report_period", "ratio", -10.0, 10.0, "reviewed"),
    ("PE_TTM", "市盈率 (TTM)", "valuation", "ashareeodderivativeindicator", "s_val_pe_ttm", "observation", "ratio", -1000.0, 1000.0, "reviewed"),
    ("PB", "市净率", "valuation", "ashareeodderivativeindicator", "s_val_pb_new", "observation", "ratio", 0.0, 100.0, "reviewed"),
    ("PS_TTM", "市销率 (TTM)", "valuation", "ashareeodderivativeindicator", "s_val_ps_ttm", "observation", "ratio", 0.0, 500.0, "reviewed"),
    ("REVENUE_YOY", "营业收入同比增长率", "growth", "asharefinancialindicator", "s_fa_yoy_or", "report_period", "percent", -100.0, 500.0, "reviewed"),
    ("NET_PROFIT_YOY", "净利润同比增长率", "growth", "asharefinancialindicator", "s_fa_yoynetprofit", "report_period", "percent", -1000.0, 1000.0, "reviewed"),
    ("OPERATING_PROFIT_YOY", "营业利润同比增长率", "growth", "asharefinancialindicator", "s_fa_yoyop", "report_period", "percent", -1000.0, 1000.0, "reviewed"),
    ("CFO_GROWTH_YOY", "经营活动现金流同比增长率", "growth", "asharefinancialindicator", "s_fa_yoyocf", "report_period", "percent", None, None, "reviewed"),
    ("S_DQ_VOLUME", "成交量", "price_volume", "ashareeodprices", "s_dq_volume", "observation", "hand", None, None, "reviewed"),
    ("FLOAT_MV", "流通市值", "valuation", "ashareeodderivativeindicator", "float_a_shr", "observation", "ten_thousand_share", None, None, "disputed"),
    ("CFO_WRONG_MAPPING", "经营活动现金流（错误映射）", "profitability", "asharecashflow", "net_profit", "report_period", "cny", None, None, "disputed"),
]
METRIC_SCHEMA = (
    "key string, display string, category string, source_table string, source_field string,"
    " time_role string, unit string, low double, high double, review_status string"
)

# fixed values: business term, source table, source column, asset type, frequency
ALIASES = [
    ("开盘价", "ashareeodprices", "s_dq_open", "stock", "daily"),
    ("最高价", "ashareeodprices", "s_dq_high", "stock", "daily"),
    ("最低价", "ashareeodprices", "s_dq_low", "stock", "daily"),
    ("收盘价", "ashareeodprices", "s_dq_close", "stock", "daily"),
    ("后复权开盘价", "ashareeodprices", "s_dq_adjopen", "stock", "daily"),
    ("后复权最高价", "ashareeodprices", "s_dq_adjhigh", "stock", "daily"),
    ("后复权最低价", "ashareeodprices", "s_dq_adjlow", "stock", "daily"),
    ("后复权收盘价", "ashareeodprices", "s_dq_adjclose", "stock", "daily"),
    ("前复权开盘价", "ashareeodprices", "s_dq_adjopen", "stock", "daily"),
    ("前复权最高价", "ashareeodprices", "s_dq_adjhigh", "stock", "daily"),
    ("前复权最低价", "ashareeodprices", "s_dq_adjlow", "stock", "daily"),
    ("前复权收盘价", "ashareeodprices", "s_dq_adjclose_backward", "stock", "daily"),
    ("复权因子", "ashareeodprices", "s_dq_adjfactor", "stock", "daily"),
    ("成交量", "ashareeodprices", "s_dq_volume", "stock", "daily"),
    ("成交额", "ashareeodprices", "s_dq_amount", "stock", "daily"),
    ("换手率", "ashareeodderivativeindicator", "s_dq_turn", "stock", "daily"),
    ("总市值", "ashareeodderivativeindicator", "s_dq_mv", "stock", "daily"),
    ("流通市值", "ashareeodderivativeindicator", "float_a_shr", "stock", "daily"),
    ("市盈率", "ashareeodderivativeindicator", "s_val_pe", "stock", "daily"),
    ("市净率", "ashareeodderivativeindicator", "s_val_pb_new", "stock", "daily"),
    ("市销率", "ashareeodderivativeindicator", "s_val_ps", "stock", "daily"),
    ("净资产收益率", "asharefinancialindicator", "s_fa_roe", "stock", "quarterly"),
    ("总资产收益率", "asharefinancialindicator", "s_fa_roa", "stock", "quarterly"),
    ("营业收入", "ashareincome", "oper_rev", "stock", "quarterly"),
    ("净利润", "asharecashflow", "net_profit", "stock", "quarterly"),
    ("经营活动现金流", "asharecashflow", "net_profit", "stock", "quarterly"),
    ("公告日期", "asharefinancialindicator", "ann_dt", "stock", "quarterly"),
    ("报告期", "asharefinancialindicator", "report_period", "stock", "quarterly"),
    ("行业", "ashareindustriesclass", "wind_ind_code", "stock", "daily"),
    ("指数成分股", "aindexmembers", "s_con_indate", "index", "daily"),
    ("ST", "asharest", "s_type_st", "stock", "daily"),
    ("停牌", "asharetradingsuspension", "s_dq_suspenddate", "stock", "daily"),
]
ALIAS_SCHEMA = "alias string, table string, field string, asset_type string, frequency string"

# fixed values: source units and the multiplier to the base unit
UNIT_FACTORS = [
    ("hand", "share", 100.0), ("cny", "cny", 1.0), ("ten_thousand_cny", "cny", 10_000.0), ("share", "share", 1.0),
    ("ten_thousand_share", "share", 10_000.0), ("ratio", "ratio", 1.0), ("percent", "ratio", 0.01), ("day", "day", 1.0),
]


def registry_df(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def metrics(spark: SparkSession) -> DataFrame:
    return registry_df(spark, METRICS, METRIC_SCHEMA)


def aliases(spark: SparkSession) -> DataFrame:
    return registry_df(spark, ALIASES, ALIAS_SCHEMA)


def to_base_unit(df: DataFrame, value: str, unit: str) -> DataFrame:
    """Value in its base unit; an unknown unit gives NULL rather than a guess."""
    factors = registry_df(df.sparkSession, UNIT_FACTORS, "_u string, base_unit string, _f double")
    return df.join(F.broadcast(factors), F.col(unit) == F.col("_u"), "left").withColumn(
        "base_value", F.col(value) * F.col("_f")
    ).drop("_u", "_f")


def gate(df: DataFrame, registry: DataFrame, key: str = "key") -> DataFrame:
    """May each row's metric be used? The registry has a fixed, small number of rows.

    Unregistered and disputed metrics are refused; unreviewed ones pass with a label.
    """
    reg = registry.select(F.upper("key").alias("_key"), F.col("review_status").alias("status"))
    out = df.join(F.broadcast(reg), F.upper(F.trim(key)) == F.col("_key"), "left").drop("_key")
    allowed = F.col("status").isin("reviewed", "unreviewed")
    return out.withColumns({
        "allowed": F.coalesce(allowed, F.lit(False)),
        "requires_warning": F.coalesce(F.col("status") != "reviewed", F.lit(True)),
        "gate_reason": F.when(F.col("status").isNull(), "unregistered").when(F.col("status") == "disputed", "disputed")
        .when(F.col("status") == "unreviewed", "unreviewed").otherwise("ok"),
    })
