"""Document evidence and outbound scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.operators import documents as dc
from panelweave.operators import outbound as ob
from panelweave.plans.registry import query

# Terms in the corpus' own languages beside the fixed ones, which its invented words never use.
SIGNALS = {**dc.SIGNALS, "ention": 3.0, "tional": 2.5, "ndly": 2.0, "ère": 1.5, "ción": 2.0, "lich": 1.5, "mente": 1.0, "hous": 0.5}
LINES_PER_PAGE = 5


def blocks(d):
    """Lines of a document are blocks, five to a page."""
    lines = d.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.select("doc_id", (F.floor(F.col("i") / LINES_PER_PAGE) + 1).cast("int").alias("page"), (F.col("i") % LINES_PER_PAGE).alias("block"), "i", "text")


BLOCKS = f"""ls AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
  bl AS (SELECT doc_id, i // {LINES_PER_PAGE} + 1 AS page, i % {LINES_PER_PAGE} AS block, i, text FROM ls)"""
SCORE = " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN {w} ELSE 0 END" for t, w in SIGNALS.items())
EXCERPTS = f"""{BLOCKS}, sc AS (SELECT *, {SCORE} AS score, 'p' || page || 'b' || block AS evidence_id FROM bl),
  ex AS (SELECT doc_id, page, evidence_id, score, substr(text, 1, 600) AS excerpt, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page, evidence_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 8)"""


def excerpts(d):
    return dc.score_blocks(blocks(d), SIGNALS)


@query("d1_score_blocks", f"WITH {EXCERPTS} SELECT doc_id, page, evidence_id, score, excerpt, rank FROM ex", nums="score", dates="")
def _(d):
    return excerpts(d)


def placed(d):
    """Blocks with a place on the page: four column starts, a fixed page size."""
    return blocks(d).withColumns({"x0": (F.col("i") % 4) * 150.0, "width": F.lit(600.0), "height": F.lit(800.0)})


PLACED = f"""{BLOCKS}, nt AS (SELECT doc_id, page, (i % 4) * 150.0 AS x0, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM bl),
  ps AS (SELECT doc_id, page, count(*) AS blocks, sum(length(t)) + count(*) - 1 AS chars, count(CASE WHEN x0 < 300 THEN 1 END) AS l, count(CASE WHEN x0 >= 300 THEN 1 END) AS r FROM nt WHERE t <> '' GROUP BY 1, 2)"""


@query("d2_page_stats", f"WITH {PLACED} SELECT doc_id, page, blocks, CAST(chars AS BIGINT) AS chars, chars / 480.0 AS text_density, l >= 3 AND r >= 3 AS multi_column FROM ps", nums="text_density", dates="")
def _(d):
    return dc.page_stats(placed(d))


@query("d3_multi_column", """SELECT conv_id AS doc_id, 1 AS page, count(CASE WHEN role <> 'assistant' THEN 1 END) >= 3 AND count(CASE WHEN role = 'assistant' THEN 1 END) >= 3 AS multi_column
  FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' GROUP BY 1""", dates="")
def _(d):
    """Turns as blocks: the two speakers are the two columns."""
    x0 = F.when(F.col("role") == "assistant", 400.0).otherwise(50.0)
    t = d.table("conversations").select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), "text", x0.alias("x0"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    return dc.multi_column(t)


@query("d4_scanned_pages", f"""WITH {PLACED}, s AS (SELECT doc_id, page, chars / 48000.0 AS dens, blocks >= 5 AS img FROM ps)
  SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS rank, row_number() OVER (PARTITION BY doc_id ORDER BY page) <= 50 AS within_limit FROM s WHERE dens < 0.02 OR (dens < 0.1 AND img)""", dates="")
def _(d):
    pages = dc.page_stats(placed(d)).select("doc_id", "page", (F.col("chars") / 48000.0).alias("text_density"), (F.col("blocks") >= 5).alias("has_image"))
    return dc.scanned_pages(pages).select("doc_id", "page", "rank", "within_limit")


@query("d5_merge_lines", """WITH l AS (SELECT conv_id AS doc_id, 1 + turn // 4 AS page, turn AS line, text, (length(text) % 100) / 100.0 AS confidence, (length(text) % 7) * 10.0 AS x, (length(text) % 5) * 0.5 AS y FROM conversations)
  SELECT doc_id, page, count(*) AS lines, avg(confidence) AS mean_confidence, count(CASE WHEN confidence < 0.6 THEN 1 END) AS uncertain_lines,
  string_agg(CASE WHEN text <> '' THEN text END, chr(10) ORDER BY round_even(y, 0), x, line) AS text FROM l GROUP BY 1, 2""", nums="mean_confidence", dates="")
def _(d):
    n = F.length("text")
    lines = d.table("conversations").select(
        F.col("conv_id").alias("doc_id"), (F.floor(F.col("turn") / 4) + 1).alias("page"), F.col("turn").alias("line"), "text",
        ((n % 100) / 100).alias("confidence"), ((n % 7) * 10.0).alias("x"), ((n % 5) * 0.5).alias("y"),
    )
    return dc.merge_lines(lines)


@query("d6_check_documents", """WITH f AS (SELECT 'doc/' || doc_id AS path, CASE WHEN source = 'src3' THEN 0 WHEN source = 'src4' THEN 60000000 ELSE octet_length(encode(text)) END AS length, lang, 1 + n_chars // 20 AS pages FROM documents)
  SELECT path, CAST(length AS BIGINT) AS length, CASE WHEN length = 0 THEN 'empty' WHEN length > 52428800 THEN 'too_large' WHEN lang <> 'en' THEN 'not_a_pdf' WHEN pages > 200 THEN 'too_many_pages' ELSE 'ok' END AS status FROM f""", dates="")
def _(d):
    """Documents in the shape of a binaryFile source; English ones carry the PDF signature."""
    doc = d.table("documents")
    size = F.when(F.col("source") == "src3", 0).when(F.col("source") == "src4", 60_000_000).otherwise(F.octet_length("text")).cast("long")
    files = doc.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), size.alias("length"),
        F.encode(F.concat(F.when(F.col("lang") == "en", dc.PDF_MAGIC).otherwise(""), F.col("text")), "utf-8").alias("content"),
    )
    pages = doc.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), (F.floor(F.col("n_chars") / 20) + 1).alias("page_count"))
    return dc.check_documents(files, pages)


def drafts(d):
    """A draft per document that cites three ids, one of which may not exist."""
    doc = d.table("documents").join(d.table("labels"), "doc_id", "left")
    third = F.when(F.col("lang") == "de", "p9999b9").otherwise("p1b2")
    return doc.select(
        "doc_id", F.array(F.lit("p1b0"), F.lit("p1b1"), third).alias("cited"), F.when(F.col("quality") == 1, 0.9).otherwise(0.5).alias("confidence"),
        F.when(F.col("source") == "src1", 0).otherwise(2).alias("n_variables"), (F.col("source") != "src2").alias("has_formula"),
        F.when(F.col("source") != "src5", "higher_is_better").alias("direction"), F.when(F.col("source") == "src6", 1).otherwise(0).alias("formula_errors"), (F.col("source") == "src7").alias("from_ocr"),
    )


CITED = f"""{EXCERPTS}, ct AS (SELECT doc_id, unnest(['p1b0', 'p1b1', CASE WHEN lang = 'de' THEN 'p9999b9' ELSE 'p1b2' END]) AS evidence_id FROM documents),
  mt AS (SELECT ct.doc_id, ct.evidence_id, ex.page FROM ct LEFT JOIN ex ON ex.doc_id = ct.doc_id AND ex.evidence_id = ct.evidence_id)"""


@query("d7_audit_citations", f"""WITH {CITED} SELECT doc_id, coalesce(string_agg(CASE WHEN page IS NULL THEN evidence_id END, ',' ORDER BY evidence_id), '') AS invented,
  coalesce(string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)), '') AS cited_pages FROM mt GROUP BY 1""", dates="")
def _(d):
    a = dc.audit_citations(drafts(d), excerpts(d))
    return a.select("doc_id", F.array_join("invented", ",").alias("invented"), F.array_join(F.transform("cited_pages", lambda p: p.cast("string")), ",").alias("cited_pages"))


@query("d8_route_extraction", f"""WITH {EXCERPTS}, {PLACED.split('bl AS', 1)[1].split('),', 1)[1].strip()}, has AS (SELECT doc_id, min(CASE WHEN rank = 1 THEN page END) AS best, count(*) AS n,
    count(CASE WHEN evidence_id IN ('p1b0', 'p1b1') THEN 1 END) AS c2, count(CASE WHEN evidence_id = 'p1b2' THEN 1 END) AS c3 FROM ex GROUP BY 1),
  j AS (SELECT d.doc_id, lang, source, quality, has.n, c2, c3, p1.l >= 3 AND p1.r >= 3 AS bad1, pb.l >= 3 AND pb.r >= 3 AS badb FROM documents d LEFT JOIN labels lb ON lb.doc_id = d.doc_id LEFT JOIN has ON has.doc_id = d.doc_id
    LEFT JOIN ps p1 ON p1.doc_id = d.doc_id AND p1.page = 1 LEFT JOIN ps pb ON pb.doc_id = d.doc_id AND pb.page = has.best)
  SELECT doc_id, CASE WHEN n IS NULL THEN 'no_evidence' WHEN c2 < 2 OR lang = 'de' OR c3 = 0 THEN 'invented_citation' WHEN bad1 THEN 'unreliable_layout' WHEN quality IS NULL OR quality <> 1 THEN 'low_confidence'
  WHEN source IN ('src1', 'src2', 'src5') THEN 'missing_parts' WHEN source = 'src6' THEN 'invalid_formula' WHEN source = 'src7' THEN 'ocr_source' ELSE 'accepted' END AS route FROM j""", dates="")
def _(d):
    pages = dc.page_stats(placed(d)).select("doc_id", "page", F.col("multi_column").alias("unreliable"))
    return dc.route_extraction(drafts(d), excerpts(d), pages)


# ---- outbound scans ------------------------------------------------------------------

# Text written from each event; every kind of event breaks another rule.
LEAKY = """CASE event_type WHEN 'view' THEN 'see page ' || event_id WHEN 'click' THEN 'key sk-' || md5(CAST(event_id AS VARCHAR)) || ' sent'
  WHEN 'purchase' THEN 'row "s_dq_close": ' || CAST(user_id AS VARCHAR) WHEN 'error' THEN 'failed at mysql+pymysql://db/' || event_id ELSE 'note' || chr(10) || 'import os' || event_id END"""


def leaky(d):
    text = LEAKY.replace("chr(10)", "'\\n'").replace("VARCHAR", "STRING")
    return d.table("events").select("event_id", "user_id", "event_type", "value", F.expr(text).alias("text"))


@query("d9_scan_text", """SELECT event_id, CASE event_type WHEN 'click' THEN 'secret' WHEN 'purchase' THEN 'raw_data' WHEN 'error' THEN 'connection_string' WHEN 'signup' THEN 'internal_code' END AS category FROM events""", dates="")
def _(d):
    return ob.scan_text(leaky(d), "text").select("event_id", "category")


SQL_TEXT = """CASE WHEN regexp_matches(text, '\\bsk-[A-Za-z0-9_-]{20,}|\\bgh[pousr]_[A-Za-z0-9]{30,}|\\bAKIA[0-9A-Z]{16}\\b|-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'secret'
  WHEN regexp_matches(text, '(?i)\\b(mysql|postgresql|oracle|mssql|sqlite)(\\+\\w+)?://|\\b(jdbc|dsn)\\s*[:=]|\\bhost\\s*=\\s*\\S+\\s*;\\s*(user|uid)\\s*=') THEN 'connection_string'
  WHEN regexp_matches(text, '(?i)["'']?\\b((s|f|b|w)_[a-z0-9_]+|trade_dt)\\b["'']?\\s*[:,=]\\s*["'']?-?\\d') THEN 'raw_data'
  WHEN regexp_matches(text, '(?m)^\\s*(import\\s+\\w|from\\s+\\w+\\s+import\\s|def\\s+\\w+\\s*\\()') THEN 'internal_code' END"""


@query("d9_scan_documents", f"SELECT 'documents' AS kind, coalesce({SQL_TEXT}, 'clean') AS category, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'pages', coalesce({SQL_TEXT.replace('(text,', '(html,')}, 'clean'), count(*) FROM pages GROUP BY 2 UNION ALL SELECT 'conversations', coalesce({SQL_TEXT}, 'clean'), count(*) FROM conversations GROUP BY 2", dates="")
def _(d):
    out = None
    for kind, key, col in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")):
        one = ob.scan_text(d.table(kind).select(key, F.col(col).alias("text")), "text", key)
        one = one.groupBy(F.lit(kind).alias("kind"), F.coalesce("category", F.lit("clean")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


ROWS21 = ",".join(['{"k":"v"}'] * 21)
JSON = f"""CASE event_type
  WHEN 'view' THEN '{{"messages":[{{"role":"me","content":"page ' || event_id || '"}}],"meta":{{"zone":1,"user":"u' || user_id || '"}}}}'
  WHEN 'click' THEN '{{"payload":{{"rows":[{{"s_dq_name":"x","note":"fine"}},{{"s_dq_close":12.5,"k":"v"}}]}},"secret":"later"}}'
  WHEN 'purchase' THEN '{{"zeta":"key sk-' || md5(CAST(event_id AS VARCHAR)) || '","password":"x"}}'
  WHEN 'error' THEN '{{"a":{{"b":{{"c":["ok","trade_dt = 5"]}}}},"n":' || event_id || '}}'
  ELSE CASE WHEN value < 5 THEN '[{ROWS21}]' WHEN value < 10 THEN '{{"x":{{"values":[1,2]}},"report_text":"t"}}' WHEN value < 20 THEN '{{"b":{{"values":3,"excerpt":"t"}}}}' WHEN value < 30 THEN '{{"ann_note":"n","when":"20240101"}}' ELSE '{{"fine":["t",{{"q":null}}]}}' END END"""


NESTED = f"""CASE WHEN event_id % 5 = 0 THEN repeat('{{"deep":[', CAST(1 + event_id % 15 AS INT)) || CASE event_id % 3 WHEN 0 THEN '{{"note":"fine"}}' WHEN 1 THEN '{{"note":"key sk-' || md5(CAST(event_id AS VARCHAR)) || '"}}' ELSE '{{"x":{{"ok":1,"access_token":null}}}}' END || repeat(']}}', CAST(1 + event_id % 15 AS INT)) ELSE {JSON} END"""


@query("d10_scan_json", f"""WITH d AS (SELECT event_id, CAST({NESTED} AS JSON) AS doc FROM events),
  n AS (SELECT event_id, t.id, t.parent, t.key, t.type, t.fullkey, CASE WHEN t.type = 'VARCHAR' THEN t.atom ->> '$' END AS text FROM d, json_tree(d.doc) t),
  c AS (SELECT event_id, parent, count(*) AS k, bool_and(type = 'OBJECT') AS objects, bool_or(regexp_matches(key, '{ob.FIELD_KEY}')) AS fields,
    bool_or(type NOT IN ('OBJECT', 'ARRAY', 'VARCHAR', 'NULL') OR (type = 'VARCHAR' AND regexp_matches(text, '{ob.DATE_VALUE}'))) AS observed FROM n WHERE parent IS NOT NULL GROUP BY 1, 2),
  h AS (SELECT n.event_id, n.id, 1 AS phase, fullkey, CASE WHEN type = 'OBJECT' AND fields AND observed THEN 'raw_data' WHEN type = 'ARRAY' AND k > {ob.MAX_ROWS} AND objects THEN 'full_result_data' WHEN type = 'VARCHAR' THEN {SQL_TEXT} END AS category
      FROM n LEFT JOIN c ON c.event_id = n.event_id AND c.parent = n.id
    UNION ALL SELECT n.event_id, n.id, 0, n.fullkey, CASE WHEN regexp_matches(n.key, '{ob.SECRET_KEY}') THEN 'secret' WHEN regexp_matches(n.key, '{ob.CODE_KEY}') THEN 'internal_code'
      WHEN regexp_matches(n.key, '{ob.RESULT_KEY}') AND n.type IN ('OBJECT', 'ARRAY', 'VARCHAR') THEN 'full_result_data' WHEN regexp_matches(n.key, '{ob.BODY_KEY}|{ob.EXCERPT_KEY}') THEN 'full_report_body' END FROM n JOIN n p ON p.event_id = n.event_id AND p.id = n.parent AND p.type = 'OBJECT'),
  f AS (SELECT event_id, arg_min(category, (id, phase)) AS category, arg_min(fullkey, (id, phase)) AS place FROM h WHERE category IS NOT NULL GROUP BY 1)
  SELECT d.event_id, category, CASE place WHEN '$' THEN '<root>' ELSE regexp_replace(replace(place, '$.', ''), '^\\$?\\[(\\d+)\\]|\\[(\\d+)\\]', '.\\1\\2', 'g') END AS location FROM d LEFT JOIN f ON f.event_id = d.event_id""", dates="")
def _(d):
    """Documents of 1 to 33 levels; the SQL walks them as a table of nodes."""
    docs = d.table("events").select("event_id", F.expr(NESTED.replace("VARCHAR", "STRING")).alias("doc"))
    return ob.scan_json(docs, "event_id", "doc")


@query("d11_audit_rows", f"""WITH t AS (SELECT event_id, event_type, {LEAKY} AS text FROM events)
  SELECT event_id, event_type <> 'view' AS blocked, CASE event_type WHEN 'click' THEN 'secret' WHEN 'purchase' THEN 'raw_data' WHEN 'error' THEN 'connection_string' WHEN 'signup' THEN 'internal_code' END AS category, length(text) AS text_length FROM t""", dates="")
def _(d):
    return ob.audit_rows(ob.scan_text(leaky(d), "text"), "event_id", "text")
