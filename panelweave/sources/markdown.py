"""Field lists kept as Markdown. Inputs have a row per file: ``(path, text)``.

Every file is opened into lines by itself, and what a line needs from its file's head (the
table name, the note) is read from the same row, so no window over lines is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators.ordering import spread

# fixed values: module -> asset type
MODULE_ASSET = {
    "中国A股-股票信息": "stock", "中国A股-指数数据": "index", "中国基金-基金信息": "fund",
    "中国债券-债券信息": "bond", "中国债券-资产支持证券": "bond", "期货-股指期货": "futures",
}
# fixed values: part of the source database's name -> market, first match wins
DATABASE_MARKET = [("香港", "hk"), ("A股", "cn_a"), ("债券", "cn_bond"), ("基金", "cn_fund"), ("期货", "cn_futures"), ("美股", "us")]
# fixed values: part of the business key -> frequency, first match wins
KEY_FREQUENCY = [("交易日期", "daily"), ("交易日", "daily"), ("报告期", "quarterly"), ("截止日期", "quarterly"), ("日期", "daily")]
# fixed values: role -> columns that can play it, in order
ROLE_COLUMNS = {
    "observation_date_field": ["trade_dt", "price_date"], "announcement_date_field": ["ann_dt", "ann_date"],
    "report_period_field": ["report_period"],
    "security_code_field": ["s_info_windcode", "f_info_windcode", "b_info_windcode", "wind_code"],
}
# fixed values: shapes of names, types and fill rates in dictionary rows
FIELD = r"[A-Z][A-Z0-9_]{2,}"
TYPE = r"(?i:(?:VARCHAR2|NUMBER|CHAR)\s*\([\d\s,]+\)|\b(?:DATE|CLOB|FLOAT|INTEGER)\b)"
FIELD_AND_TYPE = r"(?i)\b([A-Z][A-Z0-9_]{2,})\s+((?:VARCHAR2|NUMBER|CHAR)\s*\([\d\s,]+\)|DATE|CLOB|FLOAT|INTEGER)(?=$|\s)"
FILL = r"(\d+(?:\.\d+)?)%"
FOLDED = (
    rf"([一-鿿（）()A-Za-z0-9:：\-\s]{{2,20}}?)\s*\b({FIELD})\s+"
    r"((?:VARCHAR2|NUMBER|DATE|CHAR|CLOB|FLOAT|INTEGER)\s*\([\d\s,]+\)|(?:DATE|CLOB))"
)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _blank_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_field_index(files: DataFrame) -> DataFrame:
    """``(path, table, field)`` of a field index.

    A ``### Name（`` header opens a section; the lines below list fields by comma until the next
    header. A header of another shape closes the section. Titles and quotes are skipped.
    """
    sections = files.select("path", F.posexplode(F.split(F.concat(F.lit("\n"), "text"), r"\n[ \t]*(?=### )")).alias("_i", "_s"))
    table = _blank_null(F.lower(F.regexp_extract("_s", r"^### \s*([A-Za-z0-9_]+)\s*[（(]", 1)))
    rows = sections.withColumn("table", table).filter("table is not null").select("path", "_i", "table", F.posexplode(F.split("_s", r"\r?\n")).alias("_j", "_line"))
    body = rows.filter((F.col("_j") > 0) & ~F.trim("_line").rlike("^[#>]"))
    fields = body.select("path", "table", F.explode(F.split("_line", ",")).alias("_f")).select("path", "table", F.lower(F.trim(F.regexp_replace("_f", r"^\s+|\s+$", ""))).alias("field"))
    return fields.filter("field <> ''")


def _first_part(text: Column, parts: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for part, meaning in reversed(parts):
        out = F.when(F.contains(text, F.lit(part)), meaning).otherwise(out)
    return out


def parse_dictionary(files: DataFrame, units: dict[str, str] | None = None) -> DataFrame:
    """Field metadata rows of data-dictionary files; rows that cannot be read are dropped."""
    head = F.regexp_extract("text", r"(?m)^#\s*(.+?)_数据字典\s*$", 1)
    stem = F.split(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), "_")[0]
    note = F.trim(F.regexp_extract("text", r"\*\*注释说明\*\*:\s*(.+)", 1))
    keys = F.regexp_extract(note, r"业务主键：\s*(.+?)(?:\s+所属数据库|$)", 1)
    business = F.filter(F.transform(F.split(keys, ","), lambda k: F.trim(k)), lambda k: k != "")
    assets = F.create_map(*[F.lit(x) for kv in MODULE_ASSET.items() for x in kv])
    per_file = spread(files, "path").select(
        "path", F.lower(F.coalesce(_blank_null(head), stem)).alias("table"), note.alias("note"), business.alias("business_keys"),
        F.try_element_at(assets, F.trim(F.regexp_extract("text", r"\*\*所属模块\*\*:\s*(.+)", 1))).alias("asset_type"),
        _first_part(F.regexp_extract(note, r"所属数据库：\s*(\S+)", 1), DATABASE_MARKET).alias("market"), "text",
    ).withColumn("frequency", _first_part(F.array_join("business_keys", " "), KEY_FREQUENCY))

    lines = F.filter(F.split("text", r"\r?\n"), lambda s: s.startswith("|") & ~s.startswith("|---") & ~F.contains(s, F.lit("序号")))
    out = per_file.select("*", _parse_rows(lines).alias("_rows")).withColumn("_names", F.transform("_rows", lambda r: r["field"]))
    for role, options in ROLE_COLUMNS.items():
        out = out.withColumn(role, F.coalesce(*[F.when(F.array_contains("_names", o), o) for o in options]))
    unit = F.lit(None).cast("string")
    if units:
        unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in units.items() for x in kv]), F.concat_ws(".", "table", "_r.field"))
    # An inner explode would have every row parsed once more, to leave out empty lists before the files are spread.
    return out.withColumn("_r", F.explode_outer("_rows")).filter("_r is not null").select(
        "path", "table", "_r.field", "_r.name", "_r.data_type", "_r.fill_rate", "_r.description", unit.alias("unit"), "asset_type", "frequency", "market",
        "business_keys", "note", F.lit("WDS").alias("metadata_source"), *ROLE_COLUMNS,
    )


def _parse_rows(lines: Column) -> Column:
    """The table rows that have a readable field.

    The field is the first cell after the second that is a name by itself. Failing that, the last
    cell that ends in a name and a type, and failing that, a name and a type anywhere in the line.
    Each step is one pass over the rows and works out what the next ones read, so no pattern is matched twice.
    """
    split = F.transform(lines, lambda s: F.struct(s.alias("line"), _cells(s).alias("cells")))
    wide = F.filter(split, lambda r: F.size(r["cells"]) >= 3)
    placed = F.transform(wide, lambda r: F.struct(*_kept(r, "line", "cells"), _plain_at(r["cells"]).alias("at")))
    merged = F.transform(placed, lambda r: F.struct(*_kept(r, "line", "cells", "at"), F.when(r["at"] == 0, _merged_at(r["cells"])).alias("merged")))
    found = F.transform(merged, lambda r: F.struct(*_kept(r, "line", "cells", "at", "merged"), _field(r).alias("field")))
    readable = F.filter(found, lambda r: r["field"].isNotNull())
    facts = F.transform(readable, lambda r: F.struct(*_kept(r, "field"), _name(r).alias("name"), _own_type(r).alias("own"), _rest(r).alias("rest")))
    chosen = F.transform(facts, lambda r: F.struct(
        *_kept(r, "field", "name", "own", "rest"),
        F.when(r["own"].isNull(), F.try_element_at(F.filter(r["rest"], lambda c: c.rlike(TYPE)), F.lit(1))).alias("typed"),
        F.try_element_at(F.filter(r["rest"], lambda c: c.rlike(FILL)), F.lit(1)).alias("filled"),
        F.filter(F.transform(r["rest"], lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, TYPE, ""), FILL, ""))), lambda w: w != "").alias("words"),
    ))
    return F.transform(chosen, lambda r: F.struct(
        r["field"].alias("field"), r["name"].alias("name"), F.coalesce(r["own"], F.regexp_replace(F.regexp_extract(r["typed"], TYPE, 0), r"\s+", "")).alias("data_type"),
        (F.regexp_extract(r["filled"], FILL, 1).try_cast("double") / 100).alias("fill_rate"), F.coalesce(F.try_element_at(r["words"], F.lit(-1)), F.lit("")).alias("description"),
    ))


def _kept(row: Column, *names: str) -> list[Column]:
    return [row[n].alias(n) for n in names]


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c))


def _plain_at(cells: Column) -> Column:
    """Place of the first cell after the second that is a name; 0 if there is none."""
    at = F.array_position(F.transform(F.slice(cells, F.lit(3), F.size(cells)), lambda c: c.rlike(rf"^{FIELD}$")), True)
    return F.when(at > 0, (at + 2).cast("int")).otherwise(0)


def _merged_at(cells: Column) -> Column:
    """Place of the last cell after the second with a name and a type; 0 if there is none."""
    back = F.array_position(F.reverse(F.transform(F.slice(cells, F.lit(3), F.size(cells)), lambda c: c.rlike(FIELD_AND_TYPE))), True)
    return F.when(back > 0, (F.size(cells) - back + 1).cast("int")).otherwise(0)


def _by_shape(row: Column, plain: Column, merged: Column, folded: Column) -> Column:
    return F.when(row["at"] > 0, plain).when(row["merged"] > 0, merged).otherwise(folded)


def _field(row: Column) -> Column:
    cell = lambda place: F.try_element_at(row["cells"], row[place])
    return F.lower(_by_shape(row, cell("at"), F.regexp_extract(cell("merged"), FIELD_AND_TYPE, 1), _blank_null(F.regexp_extract(row["line"], FOLDED, 2))))


def _name(row: Column) -> Column:
    before = F.array_join(F.slice(row["cells"], F.lit(2), F.greatest(row["at"] - 2, F.lit(0))), " ")
    merged = F.regexp_extract(F.try_element_at(row["cells"], row["merged"]), rf"^(.*?){FIELD_AND_TYPE}", 1)
    return F.trim(_by_shape(row, before, merged, F.regexp_extract(row["line"], FOLDED, 1)))


def _own_type(row: Column) -> Column:
    """The type beside the name, in one cell or folded."""
    merged = F.regexp_extract(F.try_element_at(row["cells"], row["merged"]), FIELD_AND_TYPE, 2)
    return F.regexp_replace(_by_shape(row, F.lit(None).cast("string"), merged, F.regexp_extract(row["line"], FOLDED, 3)), r"\s+", "")


def _rest(row: Column) -> Column:
    """The cells after the field's; none of a folded line."""
    after = lambda place: F.slice(row["cells"], row[place] + 1, F.size(row["cells"]))
    return _by_shape(row, after("at"), after("merged"), F.array().cast("array<string>"))
