"""Quality rules by document and by host, in DataFrame functions only.

Each document is measured against rules; the failures are counted by host; the rate of each host is
pulled towards the corpus by a beta prior that is fitted to the hosts' own rates; the host's verdict
is joined back to its documents.

Defined cases: a null or empty text has no words and fails (too few words). A null host is a host of
its own. Repeated rows count and come back once each. An empty table gives an empty result. Columns
of the input stay and win over nothing: a measure whose name is taken replaces that column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import WORD, let
from panelweave.session import freeze

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# Failures that count against a host beside the base rules.
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINE_SHARE = 0.3
# A host is turned down when its shrunk rate of failing documents is above this.
MAX_HOST_RATE = 0.5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column, window: int) -> Column:
    """Words inside windows of ``window`` words that the text holds twice or more.

    Windows are compared by a 64-bit hash of their words. Only texts where two hashes agree go on
    to find which: the hashes are sorted with their places, places with an equal neighbour are
    put in order again, and each adds the words up to the next one.
    """
    zero = F.lit(0).cast("long")

    def hashes(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ws) - window), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(window)]))

    def covered(places: Column) -> Column:
        ahead = lambda i: F.get(places, i + 1) - F.get(places, i)
        spans = F.transform(places, lambda _, i: F.least(F.coalesce(ahead(i), F.lit(window)), F.lit(window)))
        return F.aggregate(spans, zero, lambda s, x: s + x)

    def repeated(hs: Column) -> Column:
        ranked = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda r: F.filter(r, lambda x, k: x["h"].eqNullSafe(F.get(r, k - 1)["h"]) | x["h"].eqNullSafe(F.get(r, k + 1)["h"]))
        places = let(ranked, lambda r: F.array_sort(F.transform(twice(r), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), zero).otherwise(let(places, covered))

    return F.when(F.size(words) >= window, let(hashes(words), repeated)).otherwise(zero)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the five measures of MEASURES and ``base_failed``."""
    body = F.coalesce(F.col(text), F.lit(""))

    def all_of(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _repeat_words(words, WINDOW).cast("long").alias("n_repeat_words"))

    def dup_lines(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
        return let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long")

    found = let(F.regexp_extract_all(body, F.lit(WORD), 0), all_of)
    made = F.struct(
        found.alias("found"),
        F.char_length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        dup_lines(body).alias("n_dup_lines"),
        F.size(F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))).cast("long").alias("n_lines"),
    )
    m = "__rules"
    out = docs.withColumn(m, made).withColumns({
        "n_words": F.col(f"{m}.found.n_words"), "n_repeat_words": F.col(f"{m}.found.n_repeat_words"),
        "word_chars": F.col(f"{m}.word_chars"), "n_symbols": F.col(f"{m}.n_symbols"), "n_dup_lines": F.col(f"{m}.n_dup_lines"), "n_lines": F.col(f"{m}.n_lines"),
    }).drop(m)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """One row per host: documents, failing ones, and the rate shrunk by a beta prior.

    The prior is the beta distribution with the mean and variance of the hosts' rates (method of
    moments, hosts weighted by documents). Hosts that agree wholly, or one host alone, give no
    variance beyond chance; then the prior weighs as much as an average host.
    """
    failing = (
        F.col("base_failed")
        | (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"))
        | (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines"))
    )
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(failing.cast("long")).alias("bad"))
    rate = F.col("bad") / F.col("n")
    total = hosts.agg(F.sum("n").alias("sum_n"), F.sum("bad").alias("sum_bad"), F.sum(F.col("n") * rate * rate).alias("sum_sq"), F.count(F.lit(1)).alias("hosts"))
    mean = F.col("sum_bad") / F.col("sum_n")
    spread = F.col("sum_sq") / F.col("sum_n") - mean * mean
    # Variance of binomial noise around equal rates, on average over documents.
    noise = mean * (1 - mean) * F.col("hosts") / F.col("sum_n")
    weight = F.when(spread > noise, mean * (1 - mean) / (spread - noise) - 1).otherwise(F.col("sum_n") / F.col("hosts"))
    prior = total.select(mean.alias("mean"), F.greatest(weight, F.lit(1.0)).alias("weight")).first()  # one row
    mu, w = (prior["mean"] or 0.0, prior["weight"] or 1.0)
    return hosts.select("host", "n", "bad", ((F.col("bad") + mu * w) / (F.col("n") + w)).alias("host_rate"))


def apply_rules(docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with the measures, ``base_failed``, ``host_rate`` and ``kept``.

    ``kept`` asks for a document that passes the base rules on a host that is not turned down.
    The measures are written once, without the text; counting by host and joining back read them.
    """
    cols = [*dict.fromkeys((*keep, host))]
    measured = freeze(measure(docs.select(*dict.fromkeys((*cols, text))), text).select(*cols, *MEASURES, "n_lines", "base_failed"))
    rates = host_rates(measured, host).select(F.col("host").alias("__host"), "host_rate")
    joined = measured.join(rates, F.col(host).eqNullSafe(F.col("__host")), "left").drop("__host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= MAX_HOST_RATE))


def op2(docs: DataFrame) -> DataFrame:
    return apply_rules(docs).select("doc_id", *MEASURES, "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


SQL = r"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
  g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
  r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY 1),
  m AS (SELECT w.doc_id, source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id),
  b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
  h AS (SELECT source AS host, count(*) AS n, sum(CASE WHEN base_failed OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.3 * n_lines THEN 1 ELSE 0 END) AS bad FROM b GROUP BY 1),
  s AS (SELECT sum(bad) * 1.0 / sum(n) AS mu, sum(n) AS n, count(*) AS hosts, sum(n * (bad * 1.0 / n) * (bad * 1.0 / n)) / sum(n) AS sq FROM h),
  v AS (SELECT mu, n, hosts, sq - mu * mu AS spread, mu * (1 - mu) * hosts / n AS noise FROM s),
  p AS (SELECT mu, greatest(CASE WHEN spread > noise THEN mu * (1 - mu) / (spread - noise) - 1 ELSE n * 1.0 / hosts END, 1.0) AS weight FROM v),
  k AS (SELECT host, (bad + mu * weight) / (n + weight) AS rate FROM h, p)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept, round(rate, 6) AS host_rate
  FROM b JOIN k ON k.host IS NOT DISTINCT FROM b.source"""
