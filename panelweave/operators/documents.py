"""Evidence from documents: block scores, page facts, routing of drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from panelweave.functions.text import weighted_hits
from panelweave.operators.ordering import spread

# fixed values: terms that mark a block as defining a factor, and their weights
SIGNALS = {
    "因子": 3.0, "定义": 2.5, "构建": 2.0, "公式": 3.0, "排名": 1.5, "横截面": 2.0, "标准化": 1.5, "中性化": 2.0,
    "调仓": 2.0, "回测": 1.0, "样本": 1.0, "股票池": 2.0, "收益率": 1.5, "市值": 1.5, "换手": 1.5,
    "factor": 3.0, "define": 2.0, "formula": 3.0, "rank": 1.5, "cross-sectional": 2.0, "universe": 2.0,
    "rebalance": 2.0, "backtest": 1.0,
}
MAX_EXCERPTS = 8
MAX_EXCERPT_CHARS = 600
CONFIDENCE_THRESHOLD = 0.7
SCAN_DENSITY = 0.02
SPARSE_WITH_IMAGE = 0.10
MAX_OCR_PAGES = 50
MIN_LINE_CONFIDENCE = 0.60
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_PAGES = 200
PDF_MAGIC = "%PDF-"


def score_blocks(blocks: DataFrame, signals: dict[str, float] = SIGNALS, k: int = MAX_EXCERPTS) -> DataFrame:
    """The ``k`` best scoring blocks per document, as excerpts with an id to cite.

    ``blocks(doc_id, page, block, text)``. The whole text is scored and only the excerpt is cut.
    Scoring is one pass without a join, and the top-k is cut before the shuffle.
    """
    scored = spread(blocks, "doc_id", "page", "block").withColumn("score", weighted_hits(F.col("text"), signals)).filter("score > 0")
    eid = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("b"), F.col("block").cast("string"))
    cut = scored.select("doc_id", "page", eid.alias("evidence_id"), "score", F.substring("text", 1, MAX_EXCERPT_CHARS).alias("excerpt"))
    order = W.partitionBy("doc_id").orderBy(F.col("score").desc(), "page", "evidence_id")
    return cut.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def one_line(text: Column) -> Column:
    """Runs of whitespace become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_stats(blocks: DataFrame) -> DataFrame:
    """Per page: non-blank blocks, characters of the joined text, characters per 1000 units of area.

    ``blocks(doc_id, page, text, x0, width, height)``. The joined text has a break between blocks.
    """
    t = blocks.withColumn("_t", one_line(F.col("text"))).filter("_t <> ''")
    area = F.col("width") * F.col("height") / 1000
    left = F.count_if(F.col("x0") < F.col("width") / 2)
    right = F.count_if(F.col("x0") >= F.col("width") / 2)
    page = t.groupBy("doc_id", "page", "width", "height").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(F.length("_t")).alias("_chars"), left.alias("left_blocks"), right.alias("right_blocks")
    )
    chars = F.col("_chars") + F.col("blocks") - 1
    return page.select(
        "doc_id", "page", "blocks", chars.alias("chars"),
        (chars / F.when(area > 0, area).otherwise(1.0)).alias("text_density"),
        ((F.col("width") > 0) & (F.col("left_blocks") >= 3) & (F.col("right_blocks") >= 3)).alias("multi_column"),
    )


def multi_column(blocks: DataFrame) -> DataFrame:
    return page_stats(blocks).select("doc_id", "page", "multi_column")


def scanned_pages(pages: DataFrame, cap: int = MAX_OCR_PAGES) -> DataFrame:
    """Pages that carry no usable text layer, with their rank in the document.

    ``pages(doc_id, page, text_density, has_image)``. Only the first ``cap`` of a document are to be
    recognised; ``within_limit`` marks them, and no page is lost.
    """
    scan = (F.col("text_density") < SCAN_DENSITY) | ((F.col("text_density") < SPARSE_WITH_IMAGE) & F.col("has_image"))
    order = W.partitionBy("doc_id").orderBy("page")
    return pages.filter(scan).withColumn("rank", F.row_number().over(order)).withColumn("within_limit", F.col("rank") <= cap)


def merge_lines(lines: DataFrame) -> DataFrame:
    """Recognised lines of a page in reading order: by rounded top, then by left edge.

    ``lines(doc_id, page, line, text, confidence, x, y)``. The groups are pages, whose lines are
    few; the order is part of the sort key, so no window over a document is needed.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.rint("y").alias("y"), "x", "line", "text")))
    kept = F.filter(F.transform("_l", lambda s: s["text"]), lambda t: t.isNotNull() & (t != ""))
    page = lines.groupBy("doc_id", "page").agg(
        ordered.alias("_l"), F.count(F.lit(1)).alias("lines"), F.avg("confidence").alias("mean_confidence"),
        F.count_if(F.col("confidence") < MIN_LINE_CONFIDENCE).alias("uncertain_lines"),
    )
    return page.select("doc_id", "page", "lines", "mean_confidence", "uncertain_lines", F.array_join(kept, "\n").alias("text"))


def check_documents(files: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """First broken limit per file of a binaryFile source ``(path, length, content)``."""
    magic = F.substring("content", 1, len(PDF_MAGIC)).cast("binary") == F.lit(PDF_MAGIC).cast("binary")
    status = F.when(F.col("length") == 0, "empty").when(F.col("length") > MAX_FILE_BYTES, "too_large").when(~magic, "not_a_pdf")
    if page_counts is not None:
        files = files.join(page_counts, "path", "left")
        status = status.when(F.col("page_count") > MAX_PAGES, "too_many_pages")
    return files.select("path", "length", status.otherwise("ok").alias("status"))


def audit_citations(drafts: DataFrame, excerpts: DataFrame) -> DataFrame:
    """Per draft: cited ids that were never supplied, and the pages of those that were.

    ``drafts(doc_id, cited)`` with an array of ids; ``excerpts(doc_id, evidence_id, page)``.
    """
    cited = drafts.select("doc_id", F.explode(F.array_distinct("cited")).alias("evidence_id"))
    met = cited.join(excerpts.select("doc_id", "evidence_id", "page"), ["doc_id", "evidence_id"], "left")
    return met.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("page").isNull(), F.col("evidence_id")))).alias("invented"),
        F.array_sort(F.collect_set("page")).alias("cited_pages"),
    )


def route_extraction(drafts: DataFrame, excerpts: DataFrame, pages: DataFrame) -> DataFrame:
    """Why a draft needs a person, or that it was accepted; the first reason wins.

    ``drafts(doc_id, cited, confidence, n_variables, has_formula, direction, formula_errors, from_ocr)``,
    ``pages(doc_id, page, unreliable)``. Without a known citation the best excerpt's page counts.
    """
    audit = audit_citations(drafts, excerpts)
    best = excerpts.groupBy("doc_id").agg(F.min_by("page", "rank").alias("_best"), F.count(F.lit(1)).alias("_n"))
    base = drafts.join(audit, "doc_id", "left").join(best, "doc_id", "left")
    used = F.when(F.size(F.coalesce("cited_pages", F.array().cast("array<int>"))) > 0, F.col("cited_pages")).otherwise(F.array("_best"))
    bad = base.select("doc_id", F.explode(used).alias("page")).join(
        pages.filter("unreliable").select("doc_id", "page"), ["doc_id", "page"], "left_semi"
    ).select("doc_id").distinct().withColumn("_bad", F.lit(True))
    base = base.join(bad, "doc_id", "left")
    missing = (F.col("n_variables") == 0) | ~F.col("has_formula") | F.col("direction").isNull()
    reason = (
        F.when(F.col("_n").isNull(), "no_evidence")
        .when(F.size("invented") > 0, "invented_citation")
        .when(F.col("_bad"), "unreliable_layout")
        .when(F.col("confidence") < CONFIDENCE_THRESHOLD, "low_confidence")
        .when(missing, "missing_parts")
        .when(F.col("formula_errors") > 0, "invalid_formula")
        .when(F.col("from_ocr"), "ocr_source")
        .otherwise("accepted")
    )
    return base.select("doc_id", reason.alias("route"))
