"""Catalog files, search, field profiles, intents and open questions.

Parts stand in for catalog entries and requests: their type, brand and name decide the wording.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import fields as fl
from panelweave.operators import search as se
from panelweave.plans.registry import query
from panelweave.sources import markdown as md
from panelweave.sources.registry import aliases, metrics

WORDS = r"\d+\p{L}*|\p{L}+"

# ---- Markdown sources ----------------------------------------------------------------


@query("s12_field_index", """SELECT 'part' || p_partkey AS path, lower(p_type) AS "table", f AS field FROM part,
  LATERAL (SELECT unnest(list_concat(['f' || p_size], string_split(p_name, ' '))) AS f)""", dates="")
def _(d):
    """A small index per part: one good section, one header of another shape, and noise."""
    text = F.concat(
        F.lit("# Index\n> intro, not a field\n"), F.lit("### "), F.col("p_type"), F.lit("（"), F.col("p_brand"), F.lit("）\nF"), F.col("p_size").cast("string"), F.lit(", ,\n"),
        F.upper(F.replace("p_name", F.lit(" "), F.lit(" , "))), F.lit("\n## chapter\n\n### no bracket here\nlost_field, other\n"),
    )
    return md.parse_field_index(d.table("part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("path"), text.alias("text")))


@query("s13_dictionary", """WITH base AS (SELECT p_partkey, lower(p_type) AS t, CASE WHEN p_brand = 'Brand#1' THEN 'stock' WHEN p_brand = 'Brand#2' THEN 'index' END AS asset,
    CASE WHEN p_type = 'SMALL' THEN 'quarterly' ELSE 'daily' END AS freq, CASE WHEN p_type = 'SMALL' THEN 'hk' ELSE 'cn_a' END AS market, p_size FROM part),
  r(k, field, name, dtype, descr) AS (VALUES (1, 's_info_windcode', '代码', 'VARCHAR2(40)', '证券代码'), (2, 'trade_dt', '交易 日期', 'VARCHAR2(8)', ''), (3, 's_dq_close', '收盘', 'NUMBER(20,4)', '元'), (4, 'ann_dt', '公告日期', 'DATE', ''))
  SELECT 'dict/' || p_partkey || '.md' AS path, t AS "table", field, name, dtype AS data_type, CASE WHEN k = 1 THEN p_size / 100.0 END AS fill_rate, descr AS description,
  CASE WHEN field = 's_dq_close' AND t = 'promo' THEN 'cny' END AS unit, asset AS asset_type, freq AS frequency, market, 'trade_dt' AS observation_date_field, 'ann_dt' AS announcement_date_field, 's_info_windcode' AS security_code_field FROM base, r""", nums="fill_rate", dates="")
def _(d):
    """Dictionary files with a plain row, a shifted row, a merged row, a folded row and unreadable ones."""
    module = F.when(F.col("p_brand") == "Brand#1", "中国A股-股票信息").when(F.col("p_brand") == "Brand#2", "中国A股-指数数据").otherwise("其他")
    small = F.col("p_type") == "SMALL"
    note = F.concat(F.lit("业务主键：代码,"), F.when(small, "报告期").otherwise("交易日期"), F.lit(" 所属数据库："), F.when(small, "香港股票库").otherwise("A股数据库"))
    text = F.concat(
        F.lit("# "), F.col("p_type"), F.lit("_数据字典\n\n**所属模块**: "), module, F.lit("\n**注释说明**: "), note,
        F.lit("\n\n| 序号 | 名称 | 字段 | 类型 |\n|---|---|---|---|\n| 1 | 代码 | S_INFO_WINDCODE | VARCHAR2(40) | "), F.col("p_size").cast("string"), F.lit("% | 证券代码 |\n"),
        F.lit("| 2 | 交易 | 日期 | TRADE_DT | VARCHAR2 (8) |\n| 3 | x | 收盘 S_DQ_CLOSE NUMBER(20,4) | 元 |\n| 4 | 公告日期 ANN_DT DATE | 注 |\n| 5 | 说明 | 没有字段 |\n"),
    )
    files = d.table("part").select(F.concat(F.lit("dict/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))
    got = md.parse_dictionary(files, {"promo.s_dq_close": "cny"})
    return got.select("path", "table", "field", "name", "data_type", "fill_rate", "description", "unit", "asset_type", "frequency", "market", "observation_date_field", "announcement_date_field", "security_code_field")


# ---- search --------------------------------------------------------------------------


@query("t1_tokens", f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORDS}') AS w FROM documents)
  SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS words_md5, list_max(w) AS last_word FROM t""", dates="")
def _(d):
    from panelweave.functions.text import tokens

    t = d.table("documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"), F.md5(F.array_join("w", " ").cast("binary")).alias("words_md5"), F.array_max("w").alias("last_word"))


@query("t1_segment", """WITH RECURSIVE nm AS (SELECT p_partkey, replace(p_name, ' ', '') AS whole, p_name FROM part),
  w AS (SELECT word, count(*) AS n FROM (SELECT whole AS word FROM nm UNION ALL SELECT unnest(string_split(p_name, ' ')) FROM nm) GROUP BY 1),
  tot AS (SELECT ln(sum(n)) AS t FROM w), d AS (SELECT map(list(word), list(CAST(round((ln(n) - t) * 1000000) AS BIGINT))) AS m, max(CAST(round(-t * 1000000) AS BIGINT)) AS u, max(length(word)) AS longest FROM w, tot),
  x AS (SELECT DISTINCT whole || lower(p_type) || reverse(whole) AS s, length(whole || lower(p_type) || reverse(whole)) AS n FROM part JOIN nm USING (p_partkey)),
  r AS (SELECT s, n, n AS i, CAST([0] AS BIGINT[]) AS best, CAST([] AS BIGINT[]) AS step FROM x
    UNION ALL SELECT s, n, i - 1, list_prepend(b[1], best), list_prepend(b[2], step) FROM (SELECT r.*, list_max(list_filter(list_transform(range(1, least(longest, n - i + 1) + 1),
      lambda k: [coalesce(m[substr(s, i, k)], CASE WHEN k = 1 THEN u END) + best[k], k]), lambda c: c[1] IS NOT NULL)) AS b FROM r, d WHERE i > 0)),
  p AS (SELECT s, n, best[1] AS weight, step, 1 AS pos, CAST('' AS VARCHAR) AS words, 0 AS n_words FROM r WHERE i = 0
    UNION ALL SELECT s, n, weight, step, CAST(pos + step[pos] AS INTEGER), words || '|' || substr(s, pos, step[pos]), n_words + 1 FROM p WHERE pos <= n)
  SELECT p_partkey, n_words, substr(words, 2) AS words FROM part JOIN nm USING (p_partkey) JOIN p ON s = whole || lower(p_type) || reverse(whole) AND pos = n + 1""", dates="")
def _(d):
    """Names, types and reversed names run together, cut by the names and the words they consist of."""
    from panelweave.operators.segment import segment, word_list

    part = d.table("part").withColumn("_whole", F.replace("p_name", F.lit(" "), F.lit("")))
    joined = part.select("p_partkey", F.concat("_whole", F.lower("p_type"), F.reverse("_whole")).alias("text"))
    names = part.select(F.explode(F.array("p_name", "_whole")).alias("name"))
    got = segment(joined, word_list(names, letters="a-z"), "p_partkey", letters="a-z")
    return got.select("p_partkey", F.size("tokens").alias("n_words"), F.array_join("tokens", "|").alias("words"))


BM25 = f"""WITH dt AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORDS}') AS w FROM documents), dl AS (SELECT doc_id, len(w) AS dl FROM dt),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM dt) GROUP BY 1, 2),
  n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, n), fl AS (SELECT 0.25 * avg(idf) AS f FROM raw),
  idf AS (SELECT term, CASE WHEN idf < 0 THEN f ELSE idf END AS idf FROM raw, fl),
  qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM benchmark) GROUP BY 1, 2),
  sc AS (SELECT query_id, tf.doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = tf.doc_id, n GROUP BY 1, 2)"""


@query("t2_bm25_topk", f"{BM25} SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 5", nums="score", dates="")
def _(d):
    q = d.table("benchmark").select(F.col("item_id").alias("query_id"), "text")
    return se.bm25_topk(d.table("documents").select("doc_id", "text"), q, 5)


MARKET = "CASE WHEN p_type = 'SMALL' THEN NULL WHEN p_type = 'LARGE' THEN 'hk' ELSE 'cn_a' END"


@query("t3_market_rank", f"""SELECT p_size AS query_id, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY CASE WHEN {MARKET} IS NULL OR {MARKET} = 'cn_a' THEN 0 ELSE 1 END, p_retailprice DESC, p_partkey) AS position FROM part""", dates="")
def _(d):
    c = d.table("part").select(F.col("p_size").alias("query_id"), "p_partkey", F.expr(MARKET).alias("market"), F.col("p_retailprice").alias("score"))
    return se.ranked_by_market(c, tie=["p_partkey"]).select("query_id", "p_partkey", "position")


ASSET = "CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'stock' WHEN p_type = 'PROMO' THEN 'index' END"
FREQ = "CASE WHEN p_size < 20 THEN 'daily' WHEN p_size < 35 THEN 'quarterly' END"


@query("t4_constraint", f"SELECT p_partkey FROM part WHERE ({ASSET} IS NULL OR {ASSET} = 'stock') AND ({FREQ} IS NULL OR {FREQ} = 'daily')", dates="")
def _(d):
    c = d.table("part").select("p_partkey", F.expr(ASSET).alias("asset_type"), F.expr(FREQ).alias("frequency"))
    return se.null_safe_constraint(c, F.lit("stock"), F.lit("daily")).select("p_partkey")


REQUEST = """CASE p_brand WHEN 'Brand#1' THEN '收盘价' WHEN 'Brand#2' THEN '20日后复权收盘价动量' WHEN 'Brand#3' THEN '近期净利润增长' WHEN 'Brand#4' THEN 'adjclose of ' || p_name
  WHEN 'Brand#5' THEN 'return on equity' WHEN 'Brand#6' THEN '不复权收盘价' WHEN 'Brand#7' THEN 'forward adj close' WHEN 'Brand#8' THEN 'price volatility' WHEN 'Brand#9' THEN '资产收益率 and 产收益率'
  WHEN 'Brand#10' THEN '昨收与成交量' WHEN 'Brand#11' THEN '是否ST 状态' WHEN 'Brand#12' THEN '指数成分股列表' WHEN 'Brand#13' THEN '前复权开盘价' ELSE p_name END"""
MATCHED = "CASE p_brand WHEN 'Brand#1' THEN '收盘价' WHEN 'Brand#2' THEN '后复权收盘价' WHEN 'Brand#3' THEN '净利润' WHEN 'Brand#6' THEN '收盘价' WHEN 'Brand#10' THEN '成交量' WHEN 'Brand#11' THEN 'ST' WHEN 'Brand#12' THEN '指数成分股' WHEN 'Brand#13' THEN '前复权开盘价' END"
FIELD_OF = "CASE a WHEN '收盘价' THEN 's_dq_close' WHEN '后复权收盘价' THEN 's_dq_adjclose' WHEN '净利润' THEN 'net_profit' WHEN '成交量' THEN 's_dq_volume' WHEN 'ST' THEN 's_type_st' WHEN '指数成分股' THEN 's_con_indate' WHEN '前复权开盘价' THEN 's_dq_adjopen' END"
TABLE_OF = "CASE a WHEN '净利润' THEN 'asharecashflow' WHEN 'ST' THEN 'asharest' WHEN '指数成分股' THEN 'aindexmembers' ELSE 'ashareeodprices' END"


def requests(d):
    return d.table("part").select(F.col("p_partkey").alias("query_id"), F.expr(REQUEST).alias("text"), "p_brand", "p_name", "p_type", "p_size", "p_retailprice")


ALIASED = f"WITH m AS (SELECT p_partkey AS query_id, {MATCHED} AS a, p_brand FROM part), al AS (SELECT query_id, a AS alias, {TABLE_OF} AS \"table\", {FIELD_OF} AS field, CASE WHEN p_brand IN ('Brand#1', 'Brand#13') THEN 1.0 ELSE 0.9 END AS score FROM m WHERE a IS NOT NULL)"


@query("t5_alias_match", f"{ALIASED} SELECT query_id, alias, \"table\", field, score FROM al", nums="score", dates="")
def _(d):
    return se.alias_match(requests(d).select("query_id", "text"), aliases(d.spark))


def _lexical(d):
    """Two search rows per request: its own field twice over two tables, one of them an alias row too."""
    r = requests(d)
    one = r.select("query_id", F.lit("ashareeodprices").alias("table"), F.when(F.col("p_size") < 25, "s_dq_close").otherwise("s_dq_volume").alias("field"), F.col("p_retailprice").alias("score"))
    two = r.select("query_id", F.lower("p_type").alias("table"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("field"), (F.col("p_retailprice") / 2).alias("score"))
    return one.unionByName(two)


LEXICAL = """lx AS (SELECT p_partkey AS query_id, 'ashareeodprices' AS "table", CASE WHEN p_size < 25 THEN 's_dq_close' ELSE 's_dq_volume' END AS field, p_retailprice AS score FROM part
  UNION ALL SELECT p_partkey, lower(p_type), replace(p_name, ' ', '_'), p_retailprice / 2 FROM part)"""
MERGED = f"""{ALIASED}, {LEXICAL}, st AS (SELECT query_id, "table", field, 0 AS tier, score FROM al UNION ALL SELECT query_id, "table", field, 1, score FROM lx),
  bs AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY query_id, "table", field ORDER BY tier, score DESC) = 1),
  mg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, "table", field) AS position FROM bs)"""


def merged(d, limit):
    al = se.alias_match(requests(d).select("query_id", "text"), aliases(d.spark))
    return se.merge_tiers(al, _lexical(d), limit=limit)


@query("t6_merge_tiers", f"{MERGED} SELECT query_id, \"table\", field, tier, score, position FROM mg WHERE position <= 2", nums="score", dates="")
def _(d):
    return merged(d, 2)


FAMILY = "CASE p_brand WHEN 'Brand#1' THEN 'inferred' WHEN 'Brand#2' THEN 'backward' WHEN 'Brand#4' THEN 'backward' WHEN 'Brand#6' THEN 'none' WHEN 'Brand#7' THEN 'forward' WHEN 'Brand#8' THEN 'inferred' END"


@query("t7_price_rerank", f"""{MERGED}, fam AS (SELECT p_partkey AS query_id, {FAMILY} AS family FROM part),
  want(family, field, place) AS (VALUES ('none', 's_dq_close', 0), ('none', 's_dq_adjclose', 1), ('none', 's_dq_adjclose_backward', 2), ('forward', 's_dq_adjclose_backward', 0), ('forward', 's_dq_close', 1),
  ('backward', 's_dq_adjclose', 0), ('backward', 's_dq_close', 1), ('inferred', 's_dq_adjclose', 0), ('inferred', 's_dq_close', 1)),
  allr AS (SELECT query_id, "table", field, position FROM mg UNION ALL SELECT fam.query_id, 'ashareeodprices', want.field, NULL FROM fam JOIN want ON want.family = fam.family
    WHERE NOT EXISTS (SELECT 1 FROM mg WHERE mg.query_id = fam.query_id AND mg.field = want.field)),
  pl AS (SELECT allr.*, fam.family, want.place, CASE WHEN place = 0 THEN 0 WHEN place > 0 THEN 1 ELSE 2 END AS g FROM allr JOIN fam ON fam.query_id = allr.query_id LEFT JOIN want ON want.family = fam.family AND want.field = allr.field),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g, position NULLS LAST, place, "table", field) AS rank FROM pl)
  SELECT query_id, "table", field, rank, position IS NULL AS injected, CASE field WHEN 's_dq_close' THEN 'none' WHEN 's_dq_adjclose' THEN 'backward' WHEN 's_dq_adjopen' THEN 'backward' WHEN 's_dq_adjclose_backward' THEN 'forward' END AS price_adjustment,
  CASE WHEN family IS NULL THEN NULL WHEN field = 's_dq_close' AND family = 'inferred' THEN 'unadjusted close, not the adjusted close' WHEN field = 's_dq_close' THEN 'unadjusted'
  WHEN field = 's_dq_adjclose' AND family = 'inferred' THEN 'adjusted close recommended for return requests' END AS semantic_note FROM rk WHERE rank <= 3 OR g < 2""", dates="")
def _(d):
    return se.price_rerank(merged(d, 10), requests(d).select("query_id", "text"), aliases(d.spark), 3)


# ---- fields --------------------------------------------------------------------------

CAND = """c AS (SELECT p_partkey AS query_id, CASE WHEN p_type = 'SMALL' THEN 'orders' WHEN p_type = 'LARGE' THEN 'supplier' WHEN p_type = 'PROMO' THEN 'prices' ELSE 'nowhere' END AS "table",
  CASE WHEN p_type = 'PROMO' THEN CASE WHEN p_size < 25 THEN 'ann_dt' ELSE 'trade_dt' END WHEN p_size < 25 THEN 'o_totalprice' ELSE 's_acctbal' END AS field,
  CASE WHEN p_size > 10 THEN 'observation' END AS expected_role FROM part)"""


@query("t8_verify_schema", f"""WITH {CAND} SELECT query_id, "table", field, expected_role, CASE WHEN "table" = 'nowhere' THEN 'table_not_found' WHEN "table" = 'orders' AND field <> 'o_totalprice' OR "table" = 'supplier' AND field <> 's_acctbal' THEN 'column_not_found'
  WHEN field = 'ann_dt' AND expected_role IS NOT NULL THEN 'time_role_mismatch' ELSE 'ok' END AS status,
  CASE WHEN "table" = 'prices' THEN 'string' WHEN "table" = 'orders' AND field = 'o_totalprice' OR "table" = 'supplier' AND field = 's_acctbal' THEN 'double' END AS data_type FROM c""", dates="")
def _(d):
    tables = {"orders": d.table("orders"), "supplier": d.table("supplier"), "prices": d.table("orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("trade_dt"), F.lit("").alias("ann_dt"))}
    kind, size = F.col("p_type"), F.col("p_size")
    c = d.table("part").select(
        F.col("p_partkey").alias("query_id"), F.when(kind == "SMALL", "Orders ").when(kind == "LARGE", "supplier").when(kind == "PROMO", "PRICES").otherwise("nowhere").alias("table"),
        F.when(kind == "PROMO", F.when(size < 25, "ANN_DT").otherwise("trade_dt")).when(size < 25, "o_totalprice").otherwise("s_acctbal").alias("field"), F.when(size > 10, "observation").alias("expected_role"),
    )
    return fl.verify_schema(c, fl.columns_table(d.spark, tables))


@query("t9_profile_sample", """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS v FROM orders ORDER BY o_orderkey LIMIT 60)
  SELECT 'v' AS field, 'point_range' AS shape, count(*) AS row_count, count(v) / count(*) AS non_null_rate, CASE WHEN count(*) = 0 THEN 'no_data_in_sample' WHEN count(v) / count(*) < 0.5 THEN 'data_sparse' ELSE 'data_present' END AS status,
  array_to_string((list(v ORDER BY o_orderkey) FILTER (WHERE v IS NOT NULL))[1:5], '|') AS samples FROM s""", nums="non_null_rate", dates="")
def _(d):
    rows = d.table("orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("v"))
    return fl.profile_sample(rows, "v", "point_range", ["o_orderkey"]).withColumn("samples", F.array_join("samples", "|"))


@query("t10_fill_rate", """WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS o_totalprice FROM orders)
  SELECT 'o_orderkey' AS field, count(o_orderkey) AS filled, count(*) AS rows, count(o_orderkey) / count(*) AS fill_rate FROM o UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), count(*), count(o_orderstatus) / count(*) FROM o
  UNION ALL SELECT 'o_totalprice', count(o_totalprice), count(*), count(o_totalprice) / count(*) FROM o""", nums="fill_rate", dates="")
def _(d):
    o = d.table("orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("o_totalprice"))
    return fl.fill_rate(o)


@query("t11_discover_fields", f"""{MERGED}, rq AS (SELECT p_partkey AS query_id, CASE p_brand WHEN 'Brand#1' THEN 'PB' WHEN 'Brand#2' THEN 'FLOAT_MV' END AS k FROM part),
  st2 AS (SELECT query_id, 'ashareeodderivativeindicator' AS "table", 's_val_pb_new' AS field, 0 AS tier, 1.0 AS score FROM rq WHERE k = 'PB' UNION ALL SELECT query_id, "table", field, 1, score FROM lx)
  SELECT query_id, "table", field, tier, score, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, "table", field) AS position FROM st2""", nums="score", dates="")
def _(d):
    r = requests(d).select("query_id", F.when(F.col("p_brand") == "Brand#1", "pb").when(F.col("p_brand") == "Brand#2", "float_mv").alias("logical_name"))
    return fl.discover_fields(r, metrics(d.spark), _lexical(d))


@query("t12_match_intent", f"""WITH r AS (SELECT p_partkey AS query_id, p_brand AS b FROM part) SELECT query_id, CASE b WHEN 'Brand#1' THEN 'close' WHEN 'Brand#2' THEN 'close' WHEN 'Brand#6' THEN 'close' WHEN 'Brand#10' THEN 'volume' WHEN 'Brand#13' THEN 'open' END AS field,
  CASE b WHEN 'Brand#1' THEN 'none' WHEN 'Brand#2' THEN 'post' WHEN 'Brand#6' THEN 'none' WHEN 'Brand#10' THEN 'none' WHEN 'Brand#13' THEN 'pre' END AS adjust_type,
  CASE b WHEN 'Brand#11' THEN 'st_mask' WHEN 'Brand#12' THEN 'index_members' ELSE 'get_price' END AS tool FROM r WHERE b IN ('Brand#1', 'Brand#2', 'Brand#6', 'Brand#10', 'Brand#11', 'Brand#12', 'Brand#13')""", dates="")
def _(d):
    return fl.match_intent(requests(d).select("query_id", "text")).select("query_id", "field", "adjust_type", "tool")


IDEA = """CASE p_brand WHEN 'Brand#1' THEN '估值因子' WHEN 'Brand#2' THEN 'Value factor by PE_TTM' WHEN 'Brand#3' THEN '盈利质量与成长性' WHEN 'Brand#4' THEN '复合因子：估值 + 盈利质量'
  WHEN 'Brand#5' THEN 'Profitability via ROE_TTM' WHEN 'Brand#6' THEN '营收增长' ELSE p_name END"""
DRAFT = "CASE p_type WHEN 'SMALL' THEN 'rank of growth factor' WHEN 'LARGE' THEN 'revenue_yoy growth factor' ELSE '' END"


@query("t13_blocking_questions", """SELECT p_partkey, concat_ws(',', CASE WHEN p_brand = 'Brand#3' THEN 'profitability_definition' END, CASE WHEN p_brand = 'Brand#1' THEN 'valuation_definition' END,
  CASE WHEN p_brand IN ('Brand#3', 'Brand#6') OR p_type = 'SMALL' THEN 'growth_definition' END, CASE WHEN p_size < 10 THEN 'direction' END) AS blocking, CASE WHEN p_size > 40 THEN 'rebalance_frequency' ELSE '' END AS optional FROM part""", dates="")
def _(d):
    ideas = d.table("part").select("p_partkey", F.expr(IDEA).alias("idea"), F.expr(DRAFT).alias("draft"), F.when(F.col("p_size") >= 10, "higher_is_better").alias("direction"), F.when(F.col("p_size") <= 40, "monthly").alias("rebalance"))
    q = fl.blocking_questions(ideas)
    return q.select("p_partkey", F.array_join("blocking", ",").alias("blocking"), F.array_join("optional", ",").alias("optional"))
