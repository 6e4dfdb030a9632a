"""The instrument dimension: one row per security with its looked-up attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.codes import board_type, dashed_date, exchange_of, padded

CODE = "s_info_windcode"


def instruments(t: dict[str, DataFrame], codes: DataFrame | None = None) -> DataFrame:
    """Left joins from the description to its dimensions.

    ``t`` holds description, industry, sector, industry_codes, ipo, intro and lot. Only
    industry_codes is a code list of fixed size; the other sides grow with the number of
    securities and are left to the optimizer, which broadcasts them only when small.
    """
    d = t["description"]
    if codes is not None:
        d = d.join(codes.select(F.col("code").alias(CODE)).distinct(), CODE, "left_semi")
    names = t["industry_codes"]
    industry = t["industry"].filter("cur_sign = '1'").select(CODE, padded(F.col("sec_ind_code"), 6).alias("_ind"))
    sector = t["sector"].filter("cur_sign = '1'").select(CODE, padded(F.col("wind_ind_code"), 3).alias("_sec"))
    by_industry = names.select(
        F.col("industriescode").alias("_ind"), F.col("industriesalias").alias("industry_code"), F.col("industriesname").alias("industry_name")
    )
    by_sector = names.select(
        F.col("industriescode").alias("_sec"), F.col("wind_name_eng").alias("sector_code"), F.col("industriesname").alias("sector_code_name")
    )
    wide = (
        d.join(industry, CODE, "left").join(by_industry, "_ind", "left")
        .join(sector, CODE, "left").join(by_sector, "_sec", "left")
        .join(t["ipo"].select(CODE, F.col("s_ipo_price").cast("double").alias("issue_price")), CODE, "left")
        .join(t["intro"].select(CODE, F.col("s_info_office").alias("office_address"), F.col("s_info_province").alias("province")), CODE, "left")
        .join(t["lot"].select(CODE, F.col("s_info_lot_size").cast("int").alias("round_lot")), CODE, "left")
    )
    delisted = F.coalesce(F.col("is_delisted") == 1, F.lit(False))
    return wide.select(
        F.col(CODE).alias("code"),
        F.col("s_info_name").alias("symbol"),
        F.col("s_info_code").alias("trading_code"),
        exchange_of(F.col(CODE)).alias("exchange"),
        board_type(F.col("s_info_code"), F.coalesce("s_info_listboardname", F.lit(""))).alias("board_type"),
        F.when(delisted, "Delisted").otherwise("Active").alias("status"),
        dashed_date(F.col("s_info_listdate")).alias("listed_date"),
        dashed_date(F.col("s_info_delistdate")).alias("de_listed_date"),
        F.upper("s_info_pinyin").alias("abbrev_symbol"),
        "industry_code", "industry_name", "sector_code", "sector_code_name",
        "issue_price", "office_address", "province", "round_lot",
    )
