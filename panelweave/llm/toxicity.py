"""Toxicity by non-negative positive-unlabelled learning.

Known toxic documents are the positives; any documents, with no label read, are the unlabelled
ones. A linear model over words, word beginnings and letter runs minimises the risk that the class
prior corrects: the positives' loss as positive, plus the unlabelled loss as negative less the share
that positives among them cause. Where a batch drives that difference below zero, the step goes
the other way, so the model cannot make it negative by fitting the sample.

A score of one half lies where known toxic and known clean documents part with least error (the sign of
the margin if no clean ones are known), so how many documents are flagged follows from what they hold
and not from the labels' toxic share.

Features are chosen first, by how far their mean among positives stands from the unlabelled mean in
standard errors. Counting them and scoring run on all executors; the driver gets the chosen
features (at most ``features``) and the sample's values of them, both of bounded size.

Defined cases: null and empty texts have no features and get the score of the bias. Without any
positive (or any unlabelled) document nothing can be learned; every score is then the prior. Null
ids count as training rows. Labels with a null id or null label are not read; a document with
several labels is toxic if any says so. Repeated rows are scored each for itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.links import small_batches
from panelweave.session import freeze

#: Bounds of the training sample and of the known clean documents that place the cut, in documents, and of the features chosen from it.
MAX_POSITIVES = 4_000
MAX_UNLABELLED = 8_000
MAX_CLEAN = 8_000
MAX_FEATURES = 300
MIN_Z = 3.5
MAX_VALUE = 6.0
_STRIP = ".,;:!?|#$%&*()[]<>\"'"
_KEPT_WORDS = 300_000
#: Sums of features that a task holds before Spark adds them up.
SUMS_HELD = 100_000


def word_features(word: str) -> list[str]:
    """The word, its beginnings of 3 to 8 letters, and its runs of 4 and 5 letters with the ends marked."""
    ends = f"^{word}$"
    return [f"={word}", *[ends[: k + 1] for k in range(3, 9) if len(word) >= k], *[ends[i : i + k] for k in (4, 5) for i in range(1, len(ends) - k + 1)]]


def words_of(text: str | None) -> Counter:
    out = Counter()
    for w, n in Counter((text or "").lower().split()).items():
        w = w.strip(_STRIP)
        if w:
            out[w] += n
    return out


def text_values(text: str | None, known: dict[str, list] | None = None, of: dict[str, int] | None = None) -> dict:
    """``log1p`` of each feature's count in the text; with ``of``, only of those, by number.

    ``known`` remembers the features of words met before.
    """
    counts: dict = {}
    for w, n in words_of(text).items():
        if known is None:
            fs = word_features(w)
        else:
            fs = known.get(w)
            if fs is None:
                if len(known) > _KEPT_WORDS:
                    known.clear()
                fs = known[w] = [of[f] for f in word_features(w) if f in of]
        for f in fs:
            counts[f] = counts.get(f, 0) + n
    return {f: log1p(n) for f, n in counts.items()}


@dataclass
class Model:
    number: dict[str, int]
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def margins(self, texts: list[str | None], known: dict) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, t in enumerate(texts):
            v = text_values(t, known, self.number)
            if v:
                at = np.fromiter(v, np.int64, len(v))
                x = np.fromiter(v.values(), np.float64, len(v)) / self.scale[at]
                out[i] += np.minimum(x, MAX_VALUE) @ self.weight[at]
        return out


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, epochs: int = 30, rate: float = 0.005, l2: float = 0.1, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative risk, by Adam over batches of unlabelled rows with some positives each."""
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    rng, t = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(unl)
        for k in range(0, len(order), 512):
            u, p = order[k : k + 512], rng.choice(pos, min(len(pos), 128), replace=False)
            rows = x[np.concatenate((p, u))]
            z = rows @ w[:-1] + w[-1]
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            as_negative = np.logaddexp(0, z)
            pull = np.empty(len(z))
            if as_negative[len(p) :].mean() >= prior * as_negative[: len(p)].mean():
                pull[: len(p)], pull[len(p) :] = -prior / len(p), s[len(p) :] / len(u)
            else:
                pull[: len(p)], pull[len(p) :] = prior * s[: len(p)] / len(p), -s[len(p) :] / len(u)
            g = np.append(rows.T @ pull + l2 * w[:-1], pull.sum())
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def cut_between(toxic: np.ndarray, clean: np.ndarray, prior: float) -> float:
    """The margin that parts known toxic from known clean documents with least error, whatever their number: the middle of the widest such gap.

    The error weighs both kinds by the prior. Without either kind, the sign decides.
    """
    margins = np.concatenate((toxic, clean))
    if not len(toxic) or not len(clean) or margins.max() - margins.min() <= 1e-6:
        return 0.0
    order = np.argsort(margins, kind="stable")
    cost = np.concatenate((np.full(len(toxic), prior / len(toxic)), np.full(len(clean), (prior - 1) / len(clean))))[order]
    margins = margins[order]
    gap = np.diff(margins)
    error = 1 - prior + np.cumsum(cost)[:-1]  # toxic ones at or below each place, and clean ones above it
    error[gap <= 1e-6] = np.inf
    at = np.flatnonzero(error <= error.min() + 1e-12)
    k = at[np.argmax(gap[at])]
    return float(margins[k] + margins[k + 1]) / 2


def _sampled(df: DataFrame, key: Column, most: int, n: int) -> DataFrame:
    """About ``most`` of the ``n`` rows, by a hash of their key."""
    share = min(1.0, most / max(n, 1))
    return df if share == 1.0 else df.filter(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature and side of (text, positive): sum and sum of squares of its values so far, given out whenever SUMS_HELD of them have come together."""

    def out(sums: dict) -> pa.RecordBatch:
        keys, values = [*sums], [*sums.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([v[0] for v in values], pa.float64()), pa.array([v[1] for v in values], pa.float64())],
            names=["feature", "positive", "s", "ss"],
        )

    sums: dict = {}
    for batch in batches:
        for text, side in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for f, x in text_values(text.as_py()).items():
                got = sums.setdefault((f, side), [0.0, 0.0])
                got[0] += x
                got[1] += x * x
            if len(sums) >= SUMS_HELD:
                yield out(sums)
                sums = {}
    if sums:
        yield out(sums)


def _moments(sample: DataFrame) -> DataFrame:
    """Per feature and side: sum and sum of squares of its values; tasks add up before anything moves."""
    made = sample.select("text", "positive").mapInArrow(_sums, "feature string, positive boolean, s double, ss double")
    side = lambda c, p: F.sum(F.when(F.col("positive") == F.lit(p), F.col(c)).otherwise(0.0))
    return made.groupBy("feature").agg(side("s", True).alias("sp"), side("s", False).alias("su"), side("ss", False).alias("ssu"), side("ss", True).alias("ssp"))


def train(docs: DataFrame, toxic: DataFrame, learn: Column, prior: float, key: str = "doc_id", text: str = "text", features: int = MAX_FEATURES, clean: DataFrame | None = None) -> Model | float:
    """A model from ``toxic`` ids and the documents for which ``learn`` holds; the prior if there is nothing to learn from.

    ``toxic`` has the one column ``key``, distinct; ``clean`` likewise, of documents known not to be toxic,
    which only place the cut. Without it the cut is the sign of the margin.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(learn, F.lit(True)).alias("learn")).filter("learn").drop("learn")
    toxic = toxic.select(F.col(key).alias("key"))
    picked = freeze(_sampled(toxic, F.col("key"), MAX_POSITIVES, toxic.count()))  # bounded by MAX_POSITIVES
    positives = docs.join(F.broadcast(picked), "key").select("text", F.lit(True).alias("positive"))
    unlabelled = _sampled(docs, F.col("key"), MAX_UNLABELLED, docs.select("key").count()).select("text", F.lit(False).alias("positive"))
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    sample = freeze(positives.unionByName(unlabelled).repartition(max(tasks, 8), F.xxhash64("text")))
    n = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    if not n.get(True) or not n.get(False) or not 0 < prior < 1:
        return prior
    n_p, n_u = n[True], n[False]
    mean_u, mean_p, mean = F.col("su") / n_u, F.col("sp") / n_p, (F.col("su") + F.col("sp")) / (n_u + n_p)
    spread = (F.col("ssu") + F.col("ssp")) / (n_u + n_p) - mean * mean
    z = F.abs(mean_p - mean_u) / F.sqrt(F.greatest(spread, F.lit(1e-12)) * (1 / n_p + 1 / n_u))
    size = F.sqrt((F.col("ssu") + F.col("ssp")) / (n_u + n_p))
    chosen = _moments(sample).select("feature", z.alias("z"), size.alias("size")).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(features).collect()
    number = {r["feature"]: i for i, r in enumerate(chosen)}
    scale = np.array([r["size"] for r in chosen])
    if not number:
        return prior
    shared = number

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for frame in batches:
            vs = [text_values(t, known, shared) for t in frame["text"]]
            yield pd.DataFrame({"positive": frame["positive"], "at": [[*v] for v in vs], "x": [[*v.values()] for v in vs]})

    def table(rows: list) -> np.ndarray:
        x = np.zeros((len(rows), len(number)), np.float32)
        for i, r in enumerate(rows):
            x[i, r["at"]] = np.minimum(np.array(r["x"]) / scale[r["at"]], MAX_VALUE)
        return x

    kind = "positive boolean, at array<int>, x array<double>"
    rows = sample.mapInPandas(values, kind).collect()  # bounded by the sample
    x, positive = table(rows), np.array([r["positive"] for r in rows])
    weight, bias = fit_nnpu(x, positive, prior)
    if clean is None:
        return Model(number, scale, weight, bias)
    clean = clean.select(F.col(key).alias("key"))
    others = freeze(_sampled(clean, F.col("key"), MAX_CLEAN, clean.count()))  # bounded by MAX_CLEAN
    known = docs.join(F.broadcast(others), "key").select("text", F.lit(False).alias("positive"))
    apart = table(known.mapInPandas(values, kind).collect())
    return Model(number, scale, weight, bias - cut_between(x[positive] @ weight + bias, apart @ weight + bias, prior))


def score(docs: DataFrame, model: Model | float, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with ``name``: how likely the text is toxic, 0 to 1."""
    if not isinstance(model, Model):
        return docs.withColumn(name, F.lit(float(model)))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES strings and numbers

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}
        for texts in batches:
            yield pd.Series(1 / (1 + np.exp(-np.clip(shared.value.margins(texts.tolist(), known), -30, 30))))

    return docs.withColumn(name, run(F.col(text)))


def fold(key: str = "doc_id") -> Column:
    """Whether a row is held out: its id's checksum leaves 0 by five."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def train_on_labels(docs: DataFrame, labels: DataFrame) -> Model | float:
    """A model from the labels and documents that are not held out; the prior is the labels' own toxic share."""
    seen = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~fold()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = seen.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first()["p"]
    return train(docs, seen.filter("toxic = 1").select("doc_id"), ~fold(), float(share or 0.0), clean=seen.filter("toxic <> 1").select("doc_id"))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train_on_labels(docs, labels))
    return scored.select("doc_id", fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
