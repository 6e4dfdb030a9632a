"""Catalog search: term ranking, aliases, merging of tiers, price semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from panelweave.functions.text import tokens
from panelweave.operators.ordering import numbered, spread
from panelweave.operators.ranking import K1, B, best_of_tasks
from panelweave.operators.segment import segment
from panelweave.session import land

EPSILON = 0.25
#: Letters by which queries meet aliases.
KEY = 3
#: Up to so many aliases go to every task; more are joined by shuffling both sides.
FEW_ALIASES = 50_000
PREFERRED_MARKET = "cn_a"


def _words_of(texts: DataFrame, key: str, words: DataFrame | None) -> DataFrame:
    if words is None:
        return texts.select(key, tokens(F.col("text")).alias("_w"))
    return segment(texts, words, key).withColumnRenamed("tokens", "_w")


def _weights(docs: DataFrame, queries: DataFrame, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame, float | None]:
    """Landed ``doc_id, _w, dl`` of the documents cut into words, ``query_id, term, w, df``, and the documents' mean length.

    The documents are cut once. A negative idf is raised to ``EPSILON`` times the mean idf of all words.
    """
    opened = _words_of(spread(docs.select("doc_id", "text"), "doc_id"), "doc_id", words).withColumn("dl", F.size("_w").cast("double"))
    opened = land(opened, "words")
    shape = opened.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
    n_docs = F.lit(shape["n"])
    # A document's own distinct terms are known within its row.
    df = opened.select(F.explode(F.array_distinct("_w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = land(df.withColumn("_idf", F.ln(n_docs - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)), "terms")
    floor = F.lit(raw.agg(F.avg("_idf") * EPSILON).first()[0])
    q_terms = land(_words_of(queries, "query_id", words).select("query_id", F.explode("_w").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")), "asked")
    idf = raw.join(q_terms.select("term").distinct(), "term", "left_semi").select("term", "df", F.when(F.col("_idf") < 0, floor).otherwise(F.col("_idf")).alias("idf"))
    return opened, q_terms.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "df"), shape["avgdl"]


def _hits(opened: DataFrame, weighted: DataFrame, avgdl: float | None) -> DataFrame:
    """``doc_id, term, sat`` of the documents' words that any query asks for."""
    met = opened.select("doc_id", "dl", F.explode("_w").alias("term")).join(weighted.select("term").distinct(), "term", "left_semi")
    hits = met.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    sat = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    return hits.select("doc_id", "term", sat.alias("sat"))


def _postings(docs: DataFrame, queries: DataFrame, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``doc_id, term, sat`` of the documents' words that any query asks for, and ``query_id, term, w, df``."""
    opened, weighted, avgdl = _weights(docs, queries, words)
    return _hits(opened, weighted, avgdl), weighted


def bm25_scores(docs: DataFrame, queries: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Okapi scores of every (query, document) pair that shares a term.

    ``docs(doc_id, text)``, ``queries(query_id, text)``. A document qualifies by sharing a term and not by the
    sign of its score. ``bm25_topk`` makes fewer pairs. With ``words(word, n)`` running text is cut by that dictionary
    (``segment``; ids are then unique), else into pairs of letters.
    """
    hits, weighted = _postings(docs, queries, words)
    return hits.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("sat")).alias("score"))


def essential_terms(hits: DataFrame, weighted: DataFrame, k: int) -> DataFrame:
    """``query_id, term``: the words by which a document can get among a query's best ``k``.

    No document gets more from a word than the word's weight times its greatest saturation. The query's rarest words,
    until enough documents have one, give k documents and so a score that the k-th best has at least. Words
    whose bounds together stay below that score cannot bring a document in alone.
    """
    reach = hits.groupBy("term").agg(F.max("sat").alias("most"), F.min("sat").alias("least"))
    bound = land(weighted.join(reach, "term").select("query_id", "term", "w", "df", F.greatest(F.lit(0.0), F.col("w") * F.col("most")).alias("up"), F.least(F.lit(0.0), F.col("w") * F.col("most")).alias("down")), "bounds")
    rare = W.partitionBy("query_id").orderBy("df", "term")  # a query's own words
    before = F.coalesce(F.sum("df").over(rare.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    seeds = bound.withColumn("_b", before).filter(F.col("_b") < 4 * k).select("query_id", "term", "w")
    part = hits.join(seeds, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("sat")).alias("score"))
    kth = part.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter(F.col("_r") <= k)
    kth = kth.groupBy("query_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("query_id", "score")
    # Words with a negative weight may still take from a seed's score.
    low = bound.groupBy("query_id").agg(F.sum("down").alias("down")).join(kth, "query_id").select("query_id", (F.col("score") + F.col("down") - 1e-6).alias("at_least"))
    weak = W.partitionBy("query_id").orderBy("up", F.desc("df"), "term").rowsBetween(W.unboundedPreceding, 0)
    ranked = bound.withColumn("_sum", F.sum("up").over(weak)).join(low, "query_id", "left")
    return ranked.filter(F.col("at_least").isNull() | (F.col("_sum") >= F.col("at_least"))).select("query_id", "term")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, words: DataFrame | None = None) -> DataFrame:
    """Best ``k`` documents per query, without a row for each pair.

    Tasks score their own documents against blocks of queries (``ranking``), and only each task's best ``k`` per query are shuffled.
    ``words`` is as in ``bm25_scores``. Rows of one ``doc_id`` are one document.
    """
    opened, weighted, avgdl = _weights(docs, queries, words)
    weighted = land(weighted, "weights")
    if opened.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        best = best_of_tasks(opened.select("doc_id", "_w"), weighted, k, avgdl)
    else:
        hits = land(_hits(opened, weighted, avgdl).groupBy("doc_id", "term").agg(F.sum("sat").alias("sat")), "postings")
        most = hits.agg(F.coalesce(F.max("sat"), F.lit(0.0))).first()[0]
        whole = hits.groupBy("doc_id").agg(F.collect_list(F.struct("term", "sat")).alias("_p")).select("doc_id", F.col("_p.term").alias("_w"), F.col("_p.sat").alias("_s"))
        best = best_of_tasks(whole, weighted, k, avgdl, most)
    order = W.partitionBy("query_id").orderBy(F.col("rounded").desc(), F.col("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rounded")


def market_rank(market: Column, preferred: str = PREFERRED_MARKET) -> Column:
    """0 for the preferred and for an unknown market, 1 for any other."""
    return F.when(market.isNull() | (market == preferred), 0).otherwise(1)


def ranked_by_market(scores: DataFrame, preferred: str = PREFERRED_MARKET, tie: list[str] = ()) -> DataFrame:
    """Candidates in market order first and score second, as a position per query."""
    order = [market_rank(F.col("market"), preferred), -F.col("score"), *[F.col(t) for t in tie]]
    return numbered(scores, order, ["query_id"], "position").drop("_n")


def null_safe_constraint(df: DataFrame, asset_type: Column | None, frequency: Column | None) -> DataFrame:
    """Keep rows that agree with the asked values or do not state their own."""
    for col, want in (("asset_type", asset_type), ("frequency", frequency)):
        if want is not None:
            df = df.filter(want.isNull() | F.col(col).isNull() | (F.col(col) == want))
    return df


def alias_match(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Best alias per query: the exact term (1.0), else the longest one it contains (0.9).

    Queries meet aliases by the letters an alias begins with: every place of a query offers its next ``KEY``
    letters (fewer for shorter aliases), and only aliases that begin so are looked at. The offered letters are many times
    the queries and are never broadcast: ``FEW_ALIASES`` at most are, and a longer list of aliases is joined by merging.
    """
    how = "broadcast" if aliases.limit(FEW_ALIASES + 1).count() <= FEW_ALIASES else "merge"
    known = aliases.filter("alias <> ''").select(F.substring("alias", 1, KEY).alias("_key"), "alias", "table", "field", F.col("asset_type").alias("_asset"), F.col("frequency").alias("_freq"))
    q = spread(queries, "query_id").withColumn("_q", F.trim("text"))
    places = F.sequence(F.lit(1), F.length("_q"))
    next_ = lambda k: F.transform(places, lambda i: F.substring(F.col("_q"), i, F.lit(k)))
    offered = F.array_distinct(F.flatten(F.array(*[next_(k) for k in range(1, KEY + 1)])))
    own = [c for c in ("asset_type", "frequency") if c in queries.columns]
    met = q.filter(F.length("_q") > 0).select("query_id", "_q", *own, F.explode(offered).alias("_key")).join(known.hint(how), "_key").filter(F.contains("_q", "alias"))
    for col, other in (("asset_type", "_asset"), ("frequency", "_freq")):
        if col in own:
            met = met.filter(F.col(col).isNull() | F.col(other).isNull() | (F.col(col) == F.col(other)))
    rank = F.struct((F.col("alias") == F.col("_q")).cast("int").alias("exact"), F.length("alias").alias("len"), "alias", "table", "field")
    return met.groupBy("query_id", "_q", *own).agg(F.max(rank).alias("_b")).select(
        "query_id", "_b.alias", "_b.table", "_b.field", F.when(F.col("_b.exact") == 1, 1.0).otherwise(0.9).alias("score")
    )


def merge_tiers(*tiers: DataFrame, limit: int) -> DataFrame:
    """Tiers in order of trust, one row per (query, table, field), the first tier wins.

    Each tier has (query_id, table, field, score).
    """
    stacked = None
    for i, t in enumerate(tiers):
        one = t.select("query_id", "table", "field", "score", F.lit(i).alias("tier"))
        stacked = one if stacked is None else stacked.unionByName(one)
    best = stacked.groupBy("query_id", "table", "field").agg(
        F.min_by(F.struct("tier", "score"), F.struct("tier", (-F.col("score")).alias("_s"))).alias("_b")
    ).select("query_id", "table", "field", "_b.tier", "_b.score")
    order = W.partitionBy("query_id").orderBy("tier", F.col("score").desc(), "table", "field")
    return best.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


# ---- price semantics -------------------------------------------------------------------

# fixed values: source column -> adjustment it carries
ADJUSTMENT = {
    "s_dq_close": "none", "s_dq_open": "none", "s_dq_high": "none", "s_dq_low": "none",
    "s_dq_adjclose": "backward", "s_dq_adjopen": "backward", "s_dq_adjhigh": "backward", "s_dq_adjlow": "backward",
    "s_dq_adjclose_backward": "forward",
}
# fixed values: wording of close-price requests and of explicit adjustments
CLOSE_WORDS = ["收盘价", "动量", "波动", "(?<!产)收益率"]
CLOSE_ENGLISH = ["close", "momentum", "volatility", "adjclose", "adj_close"]
CLOSE_ANYWHERE = ["adj close"]
RETURN_ENGLISH = ["return"]
RETURN_ON = ["return on equity", "return on assets"]
NONE_WORDS = ["不复权", "未复权", "原始收盘价"]
NONE_ENGLISH = ["unadjusted", "raw close"]
FORWARD_WORDS = ["前复权"]
FORWARD_ENGLISH = ["forward adj", "fwd adj", "pre-?adjust"]
BACKWARD_WORDS = ["后复权"]
BACKWARD_ENGLISH = ["adj close", "adjclose", "adj_close", "backward adj"]
BACKWARD_ANYWHERE = ["adj close"]
# fixed values: family -> preferred column and the others to list
FAMILIES = {
    "explicit_none": ("s_dq_close", ["s_dq_adjclose", "s_dq_adjclose_backward"]),
    "explicit_forward": ("s_dq_adjclose_backward", ["s_dq_close"]),
    "explicit_backward": ("s_dq_adjclose", ["s_dq_close"]),
    "inferred_adjusted": ("s_dq_adjclose", ["s_dq_close"]),
    "inferred_plain": ("s_dq_close", ["s_dq_adjclose", "s_dq_adjclose_backward"]),
}


def _says(text: Column, anywhere: list[str], whole: list[str] = ()) -> Column:
    """Whether the text has one of the wordings, in any case: ``anywhere``, or as ``whole`` words."""
    said = text.rlike("(?i)" + "|".join(anywhere)) if anywhere else F.lit(False)
    return said | text.rlike(rf"(?i)\b({'|'.join(whole)})\b") if whole else said


def price_family(text: Column, use_adjusted: bool = True) -> Column:
    """Which close price a request means; NULL for requests about something else."""
    close = _says(text, CLOSE_WORDS + CLOSE_ANYWHERE, CLOSE_ENGLISH) | (_says(text, [], RETURN_ENGLISH) & ~_says(text, RETURN_ON))
    return (
        F.when(~close, F.lit(None))
        .when(_says(text, NONE_WORDS, NONE_ENGLISH), "explicit_none")
        .when(_says(text, FORWARD_WORDS, FORWARD_ENGLISH), "explicit_forward")
        .when(_says(text, BACKWARD_WORDS + BACKWARD_ANYWHERE, BACKWARD_ENGLISH), "explicit_backward")
        .otherwise("inferred_adjusted" if use_adjusted else "inferred_plain")
    )


def price_rerank(candidates: DataFrame, requests: DataFrame, aliases: DataFrame, limit: int, use_adjusted: bool = True) -> DataFrame:
    """Put the meant close price first, add it if no tier found it, and label adjustments.

    ``candidates(query_id, table, field, position)``, ``requests(query_id, text)``. The preferred
    and listed columns keep their places inside ``limit``; the rest fills what is left.
    """
    family = requests.select("query_id", price_family(F.col("text"), use_adjusted).alias("family"))
    wanted_rows = [(f, col, i) for f, (first, others) in FAMILIES.items() for i, col in enumerate([first, *others])]
    spark = candidates.sparkSession
    wanted = F.broadcast(spark.createDataFrame(wanted_rows, "family string, field string, place int"))
    home = aliases.filter(F.col("field").isin(sorted({col for _, col, _ in wanted_rows}))).groupBy("field").agg(F.min("table").alias("table"))
    reserved = family.join(wanted, "family").join(F.broadcast(home), "field")
    found = candidates.select("query_id", "table", "field", "position", F.lit(None).cast("int").alias("place"))
    extra = reserved.select("query_id", "table", "field", F.lit(None).cast("int").alias("position"), "place")
    # Found rows and wanted columns meet by (query, field); a wanted column nobody found is added.
    by_field = W.partitionBy("query_id", "field")
    met = found.unionByName(extra).withColumn("_place", F.max("place").over(by_field)).withColumn("_found", F.max("position").over(by_field))
    rows = met.filter(F.col("position").isNotNull() | F.col("_found").isNull()).join(family.hint("merge"), "query_id", "left")  # a row per request, however short
    adjustment = F.create_map(*[F.lit(x) for kv in ADJUSTMENT.items() for x in kv])
    note = (
        F.when(F.col("family").isNull(), F.lit(None))
        .when(F.col("field") == "s_dq_close", F.when(F.col("family").startswith("inferred"), "unadjusted close, not the adjusted close").otherwise("unadjusted"))
        .when((F.col("field") == "s_dq_adjclose") & F.col("family").startswith("inferred"), "adjusted close recommended for return requests")
    )
    group = F.when(F.col("_place") == 0, 0).when(F.col("_place") > 0, 1).otherwise(2)
    order = W.partitionBy("query_id").orderBy(group, F.col("position").asc_nulls_last(), F.col("_place"), "table", "field")
    out = rows.withColumn("_group", group).withColumn("rank", F.row_number().over(order))
    return out.filter((F.col("rank") <= limit) | (F.col("_group") < 2)).select(
        "query_id", "table", "field", "rank", F.col("position").isNull().alias("injected"),
        F.try_element_at(adjustment, F.lower("field")).alias("price_adjustment"), note.alias("semantic_note"),
    )
