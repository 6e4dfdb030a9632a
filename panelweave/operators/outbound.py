"""Scan of outgoing text and JSON for data, credentials and source code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.operators.ordering import spread
from panelweave.session import land

# fixed values: patterns of the text rules
SECRET_TEXT = r"\bsk-[A-Za-z0-9_-]{20,}|\bgh[pousr]_[A-Za-z0-9]{30,}|\bAKIA[0-9A-Z]{16}\b|-----BEGIN [A-Z ]*PRIVATE KEY-----"
CONNECTION_TEXT = (
    r"(?i)\b(?:mysql|postgresql|oracle|mssql|sqlite)(?:\+\w+)?://|\b(?:jdbc|dsn)\s*[:=]|\bhost\s*=\s*\S+\s*;\s*(?:user|uid)\s*="
)
ROW_TEXT = r"""(?i)["']?\b((?:s|f|b|w)_[a-z0-9_]+|trade_dt)\b["']?\s*[:,=]\s*["']?-?\d"""
CODE_TEXT = r"(?m)^\s*(?:import\s+\w|from\s+\w+\s+import\s|def\s+\w+\s*\()"
# fixed values: patterns of the key rules
FIELD_KEY = r"(?i)^(s_|f_|b_|w_|ann_|trade_dt$|report_period$|opdate$|object_id$)"
SECRET_KEY = r"(?i)password|passwd|secret|api[_-]?key|access[_-]?token|credential|private[_-]?key|_pwd$|^pwd$|^token$|_user$|^user$|^uid$|^dsn$"
CODE_KEY = r"generated_code|factor_py|source_code|^script$|^source$"
RESULT_KEY = r"factor_values|result_rows|execution_result|^values$"
BODY_KEY = r"report_text|report_body|pdf_text|full_text|raw_text"
EXCERPT_KEY = r"report_excerpt|excerpt"
DATE_VALUE = r"^\d{8}$|^\d{4}-\d{2}-\d{2}$"
# Where a text in JSON may look like a bare value, or be written by numbers of letters; and bare values but objects, lists and null.
UNCLEAR = r'"(?:[-\[{0-9\\]|true"|false")|\\u'
BARE_VALUE = r"^(?:[-0-9]|(?:true|false)\z)"
MAX_ROWS = 20
MAX_EXCERPT_CHARS = 2000


def text_rule(text: Column) -> Column:
    """First text rule that matches; NULL if the text may leave."""
    return (
        F.when(text.rlike(SECRET_TEXT), "secret").when(text.rlike(CONNECTION_TEXT), "connection_string")
        .when(text.rlike(ROW_TEXT), "raw_data").when(text.rlike(CODE_TEXT), "internal_code")
    )


def scan_text(df: DataFrame, col: str, key: str | None = None) -> DataFrame:
    """Adds ``category`` of the first rule hit; the whole text is matched in one pass.

    ``key`` names a column to spread the rows by where the input has few splits.
    """
    rows = spread(df, key) if key else df
    return rows.withColumn("category", text_rule(F.col(col)))


def scan_json(df: DataFrame, key: str, col: str, allow_excerpt: bool = False, max_excerpt: int = MAX_EXCERPT_CHARS, levels: int = 3) -> DataFrame:
    """First violation of each JSON document in depth-first order, with its dotted location, however deep it is.

    The nodes still to be opened are an array in the document's own row, so nothing is exploded, joined or
    shuffled. ``levels`` levels are opened at a time; then documents without open nodes are done, and only
    the others go on. A node that comes after a document's first hit so far is not opened. Ordered maps keep the key
    order of the text. Text that is not valid JSON goes through the text rules and is ``unreadable`` at
    least. NULL passes.
    """
    raw = F.col(col)
    broken = raw.isNotNull() & F.try_parse_json(raw).isNull()
    root = F.struct(F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("path"), raw.alias("raw"), _kind_of(raw).alias("kind"))
    unread = F.when(broken, _hit(F.array().cast("array<int>"), 0, F.coalesce(text_rule(raw), F.lit("unreadable")), F.array().cast("array<string>")))
    level = F.filter(F.array(root), lambda _: raw.isNotNull() & ~broken)
    step = spread(df.select(key, col), key).select(key, unread.alias("_best"), level.alias("_level"))
    opened = F.transform("_level", _opened)
    hits = F.array_min(F.concat(
        F.transform(F.filter("_open", lambda n: n["hit"].isNotNull()), lambda n: _hit(n["at"], 1, n["hit"], n["path"])),
        _key_hits("_open", allow_excerpt, max_excerpt),
    ))
    below = F.flatten(F.transform(
        F.filter("_open", lambda n: n["hit"].isNull()),
        lambda n: F.transform(n["children"], lambda c, k: F.struct(
            F.array_append(n["at"], k).alias("at"), F.array_append(n["path"], c["name"]).alias("path"), c["raw"].alias("raw"), c["kind"].alias("kind"))),
    ))
    # What can still come before the best hit, and has something to look at.
    wanted = F.filter("_below", lambda n: n["kind"].isin("object", "list", "text") & (F.col("_best").isNull() | (n["at"] <= F.col("_best.at"))))
    done = None
    while True:
        for _ in range(levels):
            step = step.withColumn("_open", opened).select(key, F.least("_best", hits).alias("_best"), below.alias("_below")).select(key, "_best", wanted.alias("_level"))
        step = land(step, "json")
        ended = step.filter(F.size("_level") == 0).select(key, F.col("_best.category").alias("category"), F.col("_best.location").alias("location"))
        done = ended if done is None else done.unionByName(ended)
        step = step.filter(F.size("_level") > 0)
        if step.isEmpty():
            return done
        levels = min(2 * levels, 8)  # what is left is deep


def _kind_of(raw: Column) -> Column:
    first = F.substring(F.ltrim(raw), 1, 1)
    return F.when(first == "{", "object").when(first == "[", "list").otherwise("text")


def _hit(at: Column, phase: int, category: Column, path: Column) -> Column:
    """A hit; the fields before ``category`` are its place in depth-first order."""
    location = F.when(F.size(path) == 0, "<root>").otherwise(F.array_join(path, "."))
    return F.struct(at.alias("at"), F.lit(phase).alias("phase"), category.alias("category"), location.alias("location"))


def _key_hits(opened: str, allow_excerpt: bool, max_excerpt: int) -> Column:
    """Hits by key name among the children of the objects of a level; places are made of hits only."""
    objects = F.filter(opened, lambda n: n["hit"].isNull() & (n["kind"] == "object"))
    rule = lambda c: _key_rule(c["name"], c["kind"], c["raw"], allow_excerpt, max_excerpt)
    found = lambda n: F.filter(F.transform(n["children"], lambda c, k: F.struct(k.alias("k"), c["name"].alias("name"), rule(c).alias("rule"))), lambda h: h["rule"].isNotNull())
    return F.flatten(F.transform(objects, lambda n: F.transform(found(n), lambda h: _hit(F.array_append(n["at"], h["k"]), 0, h["rule"], F.array_append(n["path"], h["name"])))))


def _opened(node: Column) -> Column:
    """A node with its children ``(name, raw, kind)`` in text order and its own hit."""
    raw, kind = node["raw"], node["kind"]
    entry = lambda name, text, kind: F.struct(name.alias("name"), text.alias("raw"), kind.alias("kind"))
    texts, list_texts = F.from_json(raw, "map<string,string>"), F.from_json(raw, "array<string>")
    members = F.transform(F.map_entries(texts), lambda e: entry(e["key"], e["value"], _plain_kind(e["value"])))
    items = F.transform(list_texts, lambda t, k: entry(k.cast("string"), t, _plain_kind(t)))
    # A text that begins as other values do is told apart from them by its parsed value.
    exact_members = F.zip_with(F.map_entries(texts), F.map_values(F.from_json(raw, "map<string,variant>")), lambda e, v: entry(e["key"], e["value"], _variant_kind(v)))
    exact_items = F.transform(F.arrays_zip(list_texts.alias("t"), F.from_json(raw, "array<variant>").alias("v")), lambda z, k: entry(k.cast("string"), z["t"], _variant_kind(z["v"])))
    unclear = raw.rlike(UNCLEAR)
    members, items = F.when(unclear, exact_members).otherwise(members), F.when(unclear, exact_items).otherwise(items)
    none = F.array().cast("array<struct<name:string,raw:string,kind:string>>")
    children = F.coalesce(F.when(kind == "object", members).when(kind == "list", items), none)
    # The children are bound once and then looked at by the node's rule.
    bound = F.transform(F.array(children), lambda c: F.struct(
        node["at"].alias("at"), node["path"].alias("path"), raw.alias("raw"), kind.alias("kind"), c.alias("children"), _node_rule(kind, raw, c).alias("hit")))
    return F.element_at(bound, 1)


def _plain_kind(text: Column) -> Column:
    """Kind of a value by its text, where no text begins as another kind of value."""
    first = F.substring(text, 1, 1)
    return (
        F.when(text.isNull(), "null").when(first == "{", "object").when(first == "[", "list")
        .when(text.rlike(BARE_VALUE), "number").otherwise("text")
    )


def _variant_kind(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (t == "VOID"), "null").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "list")
        .when(t == "STRING", "text").otherwise("number")
    )


def _node_rule(kind: Column, raw: Column, children: Column) -> Column:
    """Rule of a node by itself: data row, too many rows, or its text."""
    field_like = F.exists(children, lambda c: c["name"].rlike(FIELD_KEY))
    observed = F.exists(children, lambda c: (c["kind"] == "number") | ((c["kind"] == "text") & c["raw"].rlike(DATE_VALUE)))
    many = (F.size(children) > MAX_ROWS) & F.forall(children, lambda c: c["kind"] == "object")
    return (
        F.when((kind == "object") & field_like & observed, "raw_data").when((kind == "list") & many, "full_result_data").when(kind == "text", text_rule(raw))
    )


def _key_rule(key: Column, kind: Column, raw: Column, allow_excerpt: bool, max_excerpt: int) -> Column:
    held = kind.isin("object", "list", "text")
    rule = (
        F.when(key.rlike(SECRET_KEY), "secret").when(key.rlike(CODE_KEY), "internal_code")
        .when(key.rlike(RESULT_KEY) & held, "full_result_data").when(key.rlike(BODY_KEY), "full_report_body")
    )
    too_long = (kind == "text") & (F.length(raw) > max_excerpt) if allow_excerpt else F.lit(True)
    return rule.when(key.rlike(EXCERPT_KEY) & too_long, "full_report_body")


def audit_rows(scanned: DataFrame, key: str, text_col: str) -> DataFrame:
    """What was sent and whether it was stopped; never the text itself. Any category stops it, ``unreadable`` too."""
    return scanned.select(key, F.col("category").isNotNull().alias("blocked"), "category", F.length(text_col).alias("text_length"))
