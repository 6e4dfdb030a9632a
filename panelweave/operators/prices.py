"""Daily prices: adjustment, index fallback, suspension filter, factors and market cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.codes import looks_like_index
from panelweave.functions.numeric import lenient_date, natural_log, to_number
from panelweave.operators.grid import densify

# fixed values: field -> source column, unadjusted
PRICE_COLUMNS = {
    "open": "s_dq_open", "high": "s_dq_high", "low": "s_dq_low", "close": "s_dq_close",
    "prev_close": "s_dq_preclose", "volume": "s_dq_volume", "total_turnover": "s_dq_amount",
    "limit_up": "s_dq_limit", "limit_down": "s_dq_stopping",
}
# fixed values: adjusted source columns; the forward kind has a column of its own for close only
POST_COLUMNS = {
    "open": "s_dq_adjopen", "high": "s_dq_adjhigh", "low": "s_dq_adjlow",
    "close": "s_dq_adjclose", "prev_close": "s_dq_adjpreclose",
}
PRE_COLUMNS = {**POST_COLUMNS, "close": "s_dq_adjclose_backward"}
LIMITS = ("limit_up", "limit_down")
CODE, DAY, STATUS = "s_info_windcode", "trade_dt", "s_dq_tradestatuscode"
MARKET_CAP_SCALE = 10_000


def adjust_type_for(column: str) -> str:
    """Adjustment implied by a confirmed source column; columns that are no price have none."""
    if column == PRE_COLUMNS["close"]:
        return "pre"
    return "post" if column in POST_COLUMNS.values() else "none"


def resolve_prices(stock: DataFrame, index: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows for the asked codes from the stock table or, failing that, from the index table.

    Codes that look like an index go to the index table; stock codes without any stock row
    are tried there as well. Missing index columns come out NULL.
    """
    asked = codes.select(F.col("code").alias(CODE)).distinct()
    stocks = stock.join(asked.filter(~looks_like_index(F.col(CODE))), CODE, "left_semi")
    rest = asked.join(stocks.select(CODE).distinct(), CODE, "left_anti")
    indices = index.join(rest, CODE, "left_semi")
    return stocks.withColumn("_source", F.lit("stock")).unionByName(
        indices.withColumn("_source", F.lit("index")), allowMissingColumns=True
    )


def skip_suspended(rows: DataFrame) -> DataFrame:
    """Keep index rows, rows without a status, and rows that traded."""
    status = to_number(F.col(STATUS))
    return rows.filter((F.col("_source") == "index") | status.isNull() | (status == -1))


def get_price(rows: DataFrame, fields: list[str], adjust_type: str = "none", skip: bool = False) -> DataFrame:
    """``(code, date, fields…)`` with the asked adjustment applied to stock rows."""
    unknown = [f for f in fields if f not in PRICE_COLUMNS]
    if unknown:
        raise ValueError(f"unsupported price fields {unknown}")
    maps = {"none": {}, "pre": PRE_COLUMNS, "pre_volume": PRE_COLUMNS, "post": POST_COLUMNS, "post_volume": POST_COLUMNS}
    if adjust_type not in maps:
        raise ValueError(f"unsupported adjust_type {adjust_type!r}")
    if "_source" not in rows.columns:
        rows = rows.withColumn("_source", F.lit("stock"))
    if skip:
        rows = skip_suspended(rows)
    stock = F.col("_source") == "stock"

    def source(column: str) -> Column:
        return to_number(F.col(column)) if column in rows.columns else F.lit(None).cast("double")

    out = []
    for f in fields:
        plain = source(PRICE_COLUMNS[f])
        if f in maps[adjust_type]:
            plain = F.when(stock, source(maps[adjust_type][f])).otherwise(plain)
        elif f in LIMITS and adjust_type != "none":
            ratio = F.try_divide(source("s_dq_adjclose"), F.nullif(source("s_dq_close"), F.lit(0.0)))
            plain = F.when(stock, plain * ratio).otherwise(plain)
        out.append(plain.alias(f))
    return rows.select(F.col(CODE).alias("code"), lenient_date(F.col(DAY)).alias("date"), *out)


def latest_adjfactor(rows: DataFrame, as_of: str) -> DataFrame:
    """Latest known adjustment factor per code up to ``as_of``, in one pre-reduced pass."""
    known = rows.select(
        F.col(CODE).alias("code"), lenient_date(F.col(DAY)).alias("date"), to_number(F.col("s_dq_adjfactor")).alias("factor")
    ).filter(F.col("factor").isNotNull() & (F.col("date") <= F.lit(as_of).cast("date")))
    return known.groupBy("code").agg(F.max_by("factor", "date").alias("factor"), F.max("date").alias("factor_date"))


def market_cap(
    rows: DataFrame, log: bool = False, column: str = "s_val_mv", order: str | None = None, dates: DataFrame | None = None, codes: DataFrame | None = None,
) -> DataFrame:
    """Market value in single currency units, or its logarithm.

    Of several rows for a (date, code) the last by ``order`` counts; without it rows come as they are.
    With ``dates`` (and ``codes``) the result has every cell of the trading calendar, NULL where there is no row.
    """
    value = to_number(F.col(column)) * MARKET_CAP_SCALE
    key = [lenient_date(F.col(DAY)).alias("date"), F.col(CODE).alias("code")]
    cell = (natural_log(value) if log else value).alias("market_cap")
    if order is None:
        out = rows.select(*key, cell)
    else:
        last = rows.select(*key, F.struct(cell).alias("_v"), F.col(order).alias("_o")).groupBy("date", "code").agg(F.max_by("_v", "_o").alias("_v"))
        out = last.select("date", "code", "_v.market_cap")
    return out if dates is None else densify(out, dates, codes)
