"""Document quality by co-training a text view and a page-metadata view.

Two classifiers see different things: one what the text looks like, the other where it came from
(source, language, length, and the page's address). From a few labels each learns, labels the
unlabelled documents that it is surest of, and hands those to the other; after some rounds each view
is calibrated on labels that it did not learn from, and both together score every document.

Measures are DataFrame expressions over all rows. The driver gets a labelled and an unlabelled
sample of bounded size, as numbers only; the models are small arrays.

Defined cases: a null text is an empty one; null metadata are values of their own; a null length
counts as 0. Labels with a null id or value are not read; several labels of one document are
averaged and rounded up. With labels of one kind only, every score is their mean. Several pages of a
document count by the least address. Rows keep their number; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.quality_rules import measure
from panelweave.llm.toxicity import fold
from panelweave.session import freeze

#: Bounds of the samples that the driver learns from, in documents.
MAX_LABELLED = 20_000
MAX_UNLABELLED = 20_000
ROUNDS = 4
#: Of the unlabelled sample, the share that each view hands over in a round.
SHARE = 0.05
#: A pseudo-label needs at least this probability.
SURE = 0.9
BINS = 12

TEXT_VIEW = ("size", "word_length", "symbols", "dup_lines", "repeats", "line_length", "capitals", "digits", "stops", "variety")
META_VIEW = ("source", "lang", "length", "host", "query", "secure")
HASHED = {"source": 64, "lang": 16, "host": 64}


def features(docs: DataFrame, pages: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """``key`` and a double for each feature of both views; hashed ones hold their slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(key).alias("key"), text.alias("text"), *[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")], (F.col("n_chars") if "n_chars" in docs.columns else F.char_length(text)).cast("double").alias("n_chars"))
    m = measure(base)
    words, lines, chars = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1)), F.greatest("word_chars", F.lit(1))
    left = lambda drop: F.char_length(F.regexp_replace("text", f"[^{drop}]+", ""))
    slot = lambda c, n: F.pmod(F.xxhash64(F.coalesce(F.col(c), F.lit(""))), F.lit(n)).cast("double")
    m = m.select(
        "key", F.log1p("n_words").alias("size"), (F.col("word_chars") / words).alias("word_length"), (F.col("n_symbols") / words).alias("symbols"),
        (F.col("n_dup_lines") / lines).alias("dup_lines"), (F.col("n_repeat_words") / words).alias("repeats"), (F.col("n_words") / lines).alias("line_length"),
        (left("A-Z") / chars).alias("capitals"), (left("0-9") / chars).alias("digits"), (left(".!?") / words).alias("stops"),
        (F.size(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))) / words).alias("variety"),
        slot("source", HASHED["source"]).alias("source"), slot("lang", HASHED["lang"]).alias("lang"), F.log1p(F.greatest(F.coalesce("n_chars", F.lit(0.0)), F.lit(0.0))).alias("length"),
    )
    if pages is None:
        return m.withColumns({"host": F.lit(0.0), "query": F.lit(0.0), "secure": F.lit(0.0)})
    # A page's address ends in the number of the document that it holds.
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:\.html)?/?(?:[?#].*)?$", 1)
    of = pages.select(F.when(number != "", number.cast("long")).alias("page_of"), "url").filter("page_of is not null").groupBy("page_of").agg(F.min("url").alias("url"))
    host = F.regexp_extract("url", r"^[a-z]+://(?:www\.|m\.|blog\.)?([^/:?#]+)", 1)
    of = of.select("page_of", (1 + F.pmod(F.xxhash64(host), F.lit(HASHED["host"] - 1))).cast("double").alias("host"), F.contains("url", F.lit("?")).cast("double").alias("query"), F.startswith("url", F.lit("https")).cast("double").alias("secure"))
    joined = m.join(of, m["key"] == of["page_of"], "left").drop("page_of")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("host", "query", "secure")})


class View:
    """A logistic model over one-hot cells: quantile bins of numbers, slots of hashed values."""

    def __init__(self, names: tuple[str, ...], sample: np.ndarray):
        self.names = names
        self.edges = [np.arange(1, HASHED[n]) - 0.5 if n in HASHED else np.unique(np.quantile(sample[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i, n in enumerate(names)]
        sizes = [len(e) + 1 for e in self.edges]
        self.base = np.cumsum([0, *sizes[:-1]])
        self.weight = np.zeros(sum(sizes))
        self.bias, self.scale, self.shift = 0.0, 1.0, 0.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([b + np.searchsorted(e, x[:, i], "left") for i, (e, b) in enumerate(zip(self.edges, self.base, strict=True))], 1)

    def raw(self, cells: np.ndarray) -> np.ndarray:
        return self.weight[cells].sum(1) + self.bias

    def fit(self, cells: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.1, l2: float = 1e-3) -> None:
        m = np.zeros(len(self.weight) + 1)
        v = np.zeros_like(m)
        self.weight = np.zeros(len(self.weight))
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        for t in range(1, steps + 1):
            d = (1 / (1 + np.exp(-self.raw(cells))) - y) / len(y)
            g = np.append(np.bincount(cells.ravel(), np.repeat(d, cells.shape[1]), len(self.weight)) + l2 * self.weight, d.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.weight -= step[:-1]
            self.bias -= step[-1]

    def calibrate(self, cells: np.ndarray, y: np.ndarray) -> None:
        """Slope and shift of the raw margin by Newton steps on held-back labels."""
        z = self.raw(cells)
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = np.maximum(p * (1 - p), 1e-9)
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(h, np.array([((p - y) * z).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b]))
            a, b = a - step[0], b - step[1]
        self.scale, self.shift = float(a), float(b)

    def margin(self, cells: np.ndarray) -> np.ndarray:
        return self.scale * self.raw(cells) + self.shift


@dataclass
class Pair:
    text: View
    meta: View
    weights: tuple[float, float, float]

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(TEXT_VIEW)
        a, b = self.text.margin(self.text.cells(x[:, :k])), self.meta.margin(self.meta.cells(x[:, k:]))
        u, v, w = self.weights
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (u * a + v * b + w, a, b))


def co_train(x: np.ndarray, y: np.ndarray, pool: np.ndarray, rounds: int = ROUNDS, seed: int = 0) -> Pair:
    """Both views from labelled rows ``x, y`` and unlabelled rows ``pool``. A fifth of the labels is held back to calibrate."""
    k = len(TEXT_VIEW)
    every = np.concatenate((x, pool))
    views = (View(TEXT_VIEW, every[:, :k]), View(META_VIEW, every[:, k:]))
    back = np.random.default_rng(seed).random(len(x)) < 0.2
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back[:] = False
    cells = [v.cells(part) for v, part in zip(views, (x[:, :k], x[:, k:]), strict=True)]
    free = [v.cells(part) for v, part in zip(views, (pool[:, :k], pool[:, k:]), strict=True)]
    given = [dict(), dict()]  # pool row -> pseudo-label, per view
    for _ in range(rounds):
        for i, v in enumerate(views):
            rows = np.fromiter(given[i], np.int64, len(given[i]))
            v.fit(np.concatenate((cells[i][~back], free[i][rows])), np.concatenate((y[~back], np.fromiter(given[i].values(), np.float64, len(rows)))))
        for i, v in enumerate(views):
            # The surest rows of each kind, in the labels' proportion, go to the other view.
            p = 1 / (1 + np.exp(-v.raw(free[i])))
            other = given[1 - i]
            for label, share in ((1.0, y.mean()), (0.0, 1 - y.mean())):
                sure = p if label else 1 - p
                order = np.argsort(-sure, kind="stable")
                picked = [r for r in order[: int(len(pool) * SHARE * 2)] if sure[r] >= SURE and r not in other][: max(1, int(len(pool) * SHARE * share))]
                other.update(dict.fromkeys(picked, label))
    for i, v in enumerate(views):
        rows = np.fromiter(given[i], np.int64, len(given[i]))
        v.fit(np.concatenate((cells[i][~back], free[i][rows])), np.concatenate((y[~back], np.fromiter(given[i].values(), np.float64, len(rows)))))
        at = back if back.any() else ~back
        v.calibrate(cells[i][at], y[at])
    # How much each calibrated view counts, from the same held-back labels.
    at = back if back.any() else ~back
    z = np.stack([v.margin(c[at]) for v, c in zip(views, cells, strict=True)] + [np.ones(at.sum())], 1)
    w = np.array([0.5, 0.5, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + 1e-2 * np.eye(3)
        w = w - np.linalg.solve(h, z.T @ (p - y[at]) + 1e-2 * (w - np.array([0.5, 0.5, 0.0])))
    return Pair(*views, tuple(map(float, w)))


def _part(df: DataFrame, most: int, n: int, salt: int) -> DataFrame:
    share = min(1.0, most / max(n, 1))
    return df if share == 1.0 else df.filter(F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(1_000_000)) < int(share * 1_000_000))


def train(measured: DataFrame, labels: DataFrame) -> Pair | float:
    """The pair from ``labels`` (key, label 0 or 1, distinct keys) and measured rows that are not held out."""
    names = [*TEXT_VIEW, *META_VIEW]
    n = labels.count()
    picked = freeze(_part(labels, MAX_LABELLED, n, 5))  # bounded by MAX_LABELLED
    known = measured.join(F.broadcast(picked), "key").select("label", *names).toPandas()
    if known["label"].nunique() < 2:
        return float(known["label"].mean()) if len(known) else 0.5
    rest = measured.filter(~fold("key"))
    pool = _part(rest, MAX_UNLABELLED, rest.count(), 7).select(*names).toPandas()
    return co_train(known[names].to_numpy(np.float64), known["label"].to_numpy(np.float64), pool.to_numpy(np.float64))


def score(measured: DataFrame, model: Pair | float) -> DataFrame:
    """``measured`` keys with ``score`` and the calibrated score of each view."""
    names = [*TEXT_VIEW, *META_VIEW]
    if not isinstance(model, Pair):
        return measured.select("key", *[F.lit(model).alias(c) for c in ("score", "text_score", "meta_score")])
    shared = measured.sparkSession.sparkContext.broadcast(model)  # some hundreds of numbers

    @F.pandas_udf("score double, text_score double, meta_score double")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in parts:
            yield pd.DataFrame(dict(zip(("score", "text_score", "meta_score"), shared.value.scores(np.stack([c.to_numpy(np.float64) for c in cols], 1)), strict=True)))

    return measured.select("key", run(*names).alias("s")).select("key", "s.*")


def op10(docs: DataFrame, labels: DataFrame, pages: DataFrame) -> DataFrame:
    """Every document's quality; labels of held-out ids are not learnt from."""
    measured = freeze(features(docs, pages))
    good: Column = F.ceil(F.avg("quality")).cast("int")
    seen = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~fold()).groupBy(F.col("doc_id").alias("key")).agg(good.alias("label"))
    out = score(measured, train(measured, seen))
    return out.select(F.col("key").alias("doc_id"), fold("key").alias("held_out"), "score", "text_score", "meta_score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
