"""Field discovery: schema checks, sample and fill profiles, intents, open questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.text import contains_any
from panelweave.operators.search import merge_tiers

# fixed values: column name -> the time role it can play
COLUMN_ROLES = {
    "trade_dt": "observation", "price_date": "observation", "ann_dt": "announcement",
    "ann_date": "announcement", "report_period": "report_period", "opdate": "as_of",
}
SPARSE_THRESHOLD = 0.5
MAX_SAMPLE_ROWS = 200
# fixed values: shape -> securities and periods to sample
SAMPLE_SIZES = {
    "point_range": (3, 20), "report_period": (3, 8), "announcement_range": (3, 3),
    "static_lookup": (10, 0), "interval_overlap": (3, 3), "cross_section_asof": (3, 2),
}
# fixed values: shape -> the time roles its sample needs, with the columns that can play them
SAMPLE_ROLES = {
    "point_range": [("trade_dt", "price_date", "opdate")],
    "report_period": [("report_period",)],
    "announcement_range": [("ann_dt", "ann_date")],
    "static_lookup": [],
    "interval_overlap": [("s_con_indate", "entry_dt"), ("s_con_outdate", "remove_dt")],
    "cross_section_asof": [("trade_dt", "s_con_indate", "opdate")],
}


def columns_table(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, column, data_type)`` of the given tables, as a schema catalog."""
    rows = [(t.lower(), f.name.lower(), f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table string, column string, data_type string")


def verify_schema(candidates: DataFrame, columns: DataFrame) -> DataFrame:
    """Status per candidate ``(table, field, expected_role)``: the first failed check decides.

    The column catalog has a row per column of the warehouse and is read as a map per table,
    so one left join answers both whether the table and whether the column exists.
    """
    known = columns.groupBy(F.lower("table").alias("_t")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.lower("column"), "data_type"))).alias("_cols")
    )
    c = candidates.withColumns({"table": F.lower(F.trim("table")), "field": F.lower(F.trim("field"))})
    roles = F.create_map(*[F.lit(x) for kv in COLUMN_ROLES.items() for x in kv])
    declared = F.try_element_at(roles, F.col("field"))
    reason = (
        F.when(F.col("_cols").isNull(), "table_not_found")
        .when(~F.map_contains_key("_cols", F.col("field")), "column_not_found")
        .when(F.col("expected_role").isNotNull() & declared.isNotNull() & (declared != F.col("expected_role")), "time_role_mismatch")
        .otherwise("ok")
    )
    out = c.join(known, F.col("table") == F.col("_t"), "left")
    return out.select(*c.columns, reason.alias("status"), F.try_element_at("_cols", F.col("field")).alias("data_type"))


def sample_limit(shape: str) -> int:
    securities, periods = SAMPLE_SIZES[shape]
    return min(MAX_SAMPLE_ROWS, max(securities * max(periods, 1), 10))


def check_sample_roles(shape: str, columns: list[str]) -> None:
    """A sample needs a column for every time role of its shape."""
    for options in SAMPLE_ROLES[shape]:
        if not set(options) & set(columns):
            raise ValueError(f"time_role_invalid: {shape} needs one of {list(options)}")


def profile_sample(df: DataFrame, field: str, shape: str, order: list[str], roles: bool = False) -> DataFrame:
    """Bounded sample of one field: rows, non-missing share, status, up to five values.

    The sample is the feature here. It is the first rows in ``order``, which Spark takes as a
    top-k, so no sort of the table happens. Missing values are kept, so that sparse is seen.
    """
    if field not in df.columns:
        raise ValueError(f"field_invalid: {field}")
    if roles:
        check_sample_roles(shape, df.columns)
    rows = df.orderBy(*order).limit(sample_limit(shape)).select(*order, F.col(field).alias("_v"))
    seen = rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.avg(F.col("_v").isNotNull().cast("double")).alias("non_null_rate"),
        F.array_sort(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct(*order, F.col("_v").cast("string").alias("_v"))))).alias("_s"),
    )
    status = F.when(F.col("row_count") == 0, "no_data_in_sample").when(F.col("non_null_rate") < SPARSE_THRESHOLD, "data_sparse").otherwise("data_present")
    return seen.select(
        F.lit(field).alias("field"), F.lit(shape).alias("shape"), "row_count", F.coalesce("non_null_rate", F.lit(0.0)).alias("non_null_rate"),
        status.alias("status"), F.transform(F.slice("_s", 1, 5), lambda s: s["_v"]).alias("samples"),
    )


def fill_rate(df: DataFrame) -> DataFrame:
    """Non-missing share of every column, from one aggregation."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in df.columns])
    return one.unpivot("_n", df.columns, "field", "filled").select(
        "field", "filled", F.col("_n").alias("rows"), F.coalesce(F.try_divide("filled", "_n"), F.lit(0.0)).alias("fill_rate")
    )


def discover_fields(requests: DataFrame, registry: DataFrame, hits: DataFrame, limit: int = 10) -> DataFrame:
    """Registered field first, then search rows, per requested variable.

    ``requests(query_id, logical_name)``; ``hits(query_id, table, field, score)``.
    """
    reg = F.broadcast(registry.filter("review_status <> 'disputed'").select(F.upper("key").alias("_k"), F.col("source_table").alias("table"), F.col("source_field").alias("field")))
    first = requests.join(reg, F.upper("logical_name") == F.col("_k")).select("query_id", "table", "field", F.lit(1.0).alias("score"))
    return merge_tiers(first, hits, limit=limit)


# ---- intents ---------------------------------------------------------------------------

# fixed values: price words -> field, in order of precedence
PRICE_WORDS = [
    ("收盘价", "close"), ("开盘价", "open"), ("最高价", "high"), ("最低价", "low"), ("成交量", "volume"),
    ("成交额", "total_turnover"), ("昨收", "prev_close"), ("前收盘", "prev_close"), ("涨停价", "limit_up"), ("跌停价", "limit_down"),
]
# fixed values: adjustment words -> adjustment
ADJUST_WORDS = [("后复权", "post"), ("前复权", "pre"), ("不复权", "none")]
# fixed values: other tools and the words that ask for them, in order of precedence
SEMANTIC_WORDS = [
    ("instruments", ["证券基础信息", "股票基础信息", "上市日期"]),
    ("trading_dates", ["交易日列表", "交易日序列", "区间交易日"]),
    ("next_trading_date", ["后一个交易日", "下一个交易日", "向后交易日", "后N个交易日"]),
    ("prev_trading_date", ["前一个交易日", "上一个交易日", "向前交易日", "前N个交易日"]),
    ("st_mask", ["是否ST", "ST状态", "ST股", "风险警示状态"]),
    ("suspended", ["是否停牌", "停牌状态", "停牌股票"]),
    ("get_price", ["行情", "价格", "收盘价", "成交量", "成交额"]),
    ("index_members", ["指数成分", "成分股", "指数成员"]),
    ("market_cap", ["market_cap_3", "总市值因子", "市值暴露", "对数市值", "市值取对数"]),
    ("query_shapes", ["通用 Wind 字段取数", "专用函数未覆盖字段"]),
]


def _first_word(text: Column, words: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for word, meaning in reversed(words):
        out = F.when(F.contains(text, F.lit(word)), meaning).otherwise(out)
    return out


def match_intent(ideas: DataFrame, price_words=PRICE_WORDS, adjust_words=ADJUST_WORDS, semantic_words=SEMANTIC_WORDS) -> DataFrame:
    """Tool, price field and adjustment asked for by each idea; rows that ask for none drop out."""
    text = F.col("text")
    field = _first_word(text, price_words)
    semantic = _first_word(text, [(w, tool) for tool, ws in semantic_words for w in ws])
    out = ideas.withColumns({"field": field, "adjust_type": _first_word(text, adjust_words), "_semantic": semantic})
    out = out.withColumn("tool", F.when(F.col("field").isNotNull(), "get_price").otherwise(F.col("_semantic")))
    # A price request without an adjustment word is for unadjusted prices.
    adjust = F.when(F.col("field").isNotNull(), F.coalesce("adjust_type", F.lit("none")))
    return out.filter("tool is not null").withColumn("adjust_type", adjust).drop("_semantic")


# ---- open questions --------------------------------------------------------------------

# fixed values: per topic the vague wording and the wording that settles it
TOPICS = {
    "profitability_definition": (
        ["盈利质量", "盈利能力", "profitability", "earnings quality"],
        ["roe_ttm", "roa_ttm", "cfo_to_profit", "净资产收益率", "总资产收益率"],
    ),
    "valuation_definition": (
        ["估值", "估值因子", "valuation", "价值因子", "value factor"],
        ["pe_ttm", "pb", "ps_ttm", "市盈率", "市净率"],
    ),
    "growth_definition": (
        ["营收增长", "收入增长", "利润增长", "成长性", "growth factor", "增长因子"],
        ["revenue_yoy", "net_profit_yoy", "operating_profit_yoy", "营收同比", "净利润同比"],
    ),
}
COMPOSITE_WORDS = ["复合因子", "composite factor"]


def blocking_questions(ideas: DataFrame, topics=TOPICS, composite=COMPOSITE_WORDS) -> DataFrame:
    """Questions each idea leaves open.

    ``ideas`` has ``idea`` (the user's words), ``draft`` (the drafted spec's words), ``direction``
    and ``rebalance``. A topic is open if a vague word occurs and no settling word does; the
    user's own words are exempt when they ask for a composite.
    """
    idea, draft = F.lower(F.coalesce("idea", F.lit(""))), F.lower(F.coalesce("draft", F.lit("")))
    asks = []
    for question, (vague, settled) in topics.items():
        in_idea = ~contains_any(idea, composite) & contains_any(idea, vague) & ~contains_any(idea, settled)
        in_draft = contains_any(draft, vague) & ~contains_any(draft, settled)
        asks.append(F.when(in_idea | in_draft, question))
    asks.append(F.when(F.col("direction").isNull(), "direction"))
    blocking = F.array_compact(F.array(*asks))
    optional = F.array_compact(F.array(F.when(F.col("rebalance").isNull(), "rebalance_frequency")))
    return ideas.withColumns({"blocking": blocking, "optional": optional})
