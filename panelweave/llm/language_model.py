"""Log-probabilities of texts under a log-bilinear neural language model.

A word's vector is predicted as the sum of the vectors of the two tokens before it, each scaled by its
place; the score of a token is that sum times the token's own vector plus its bias. The model is trained in numpy
by noise-contrastive estimation: tell each token from ones drawn from the unigram distribution. Every
training text is read once: in each of ROUNDS rounds, every trainer goes over its part of a share
of the texts, and the trainers' parameters are averaged. Scoring is normalised: products of batches of
contexts with all token vectors give the normaliser of every context.

The model's tokens are the MODEL_WORDS most frequent words, the end of a text, and CLASSES classes of all
other words by their ending. Inside its class a word has the share (c + 1) / (sum of c + 1 over the class, and 1
for words never seen), so probabilities add up to 1.

Counts are of all words of all training texts. The most frequent ones, at most HEAD, go to every task; words beyond
them are joined with the table of counts, where none of them is a hot key. Normalisers of all contexts of two tokens
are worked out once, in parallel, since their number depends on the model alone.

Defined cases: a null text is an empty one; each text ends with one end token, so none is without tokens. Null
ids are not held out. Repeated rows and ids are scored each for itself. Without any training text
there are no counts and every score is 0. An empty table gives an empty result. Ties in the
order of words go by the word. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.links import landed
from panelweave.llm.wordtable import chunks, kinds, split_words

MODEL_WORDS, CLASSES, WIDTH = 1_500, 256, 24
#: At most so many words' counts are held by every task.
HEAD = 200_000
ROUNDS = 4
NOISE, BATCH, RATE = 64, 4096, 0.05
#: So many trainers' parameters are averaged at a time, BLOCK numbers by BLOCK.
FAN, BLOCK = 64, 8192
HELD = 300_000
END = 0  #: token of the end; classes follow, then words
_KIND = kinds(b"\x20\x09\x0a\x0b\x0c\x0d")


def classes_of(words: pa.Array) -> np.ndarray:
    """The class of each word (large binary): a hash of its last three bytes."""
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and off[-1] else np.zeros(1, np.uint8)
    ending = np.zeros(len(words), np.uint64)
    for k in range(3):
        at = off[1:] - 1 - k
        ending += np.where(at >= off[:-1], raw[np.maximum(at, 0)], 0).astype(np.uint64) << np.uint64(8 * k)
    return ((ending * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) * np.uint64(CLASSES) >> np.uint64(32)).astype(np.int64)


@dataclass
class Vocabulary:
    """Counts of the training tokens, as far as every task has them."""

    tokens: int  #: N
    distinct: int  #: V
    ends: int
    head: pa.Array  #: frequent words, the most frequent first
    count: np.ndarray  #: their counts
    modelled: int  #: so many of them are tokens of their own
    rest: np.ndarray  #: per class: sum of (count + 1) over its words, and 1
    noise: np.ndarray  #: probability of each token of the model by its count plus 1

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word: its token, its count (-1 if only the whole table knows), and log10 of its share in its token."""
        at = pc.fill_null(pc.index_in(words, value_set=self.head), -1).to_numpy().astype(np.int64)
        count = np.where(at >= 0, np.append(self.count, -1)[at], -1)
        own = (at >= 0) & (at < self.modelled)
        kind = classes_of(words)
        share = np.where(own, 0.0, np.log10(np.maximum(count, 0) + 1.0) - np.log10(self.rest[kind]))
        return np.where(own, 1 + CLASSES + at, 1 + kind), count, share


@dataclass
class Model:
    context: np.ndarray
    place: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(noise: np.ndarray, width: int = WIDTH, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda *n: (rng.standard_normal(n) * 0.1).astype(np.float32)
        return Model(draw(len(noise), width), np.ones((2, width), np.float32), draw(len(noise), width), np.log(noise).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.place, self.target, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def of_flat(self, flat: np.ndarray) -> Model:
        cut = np.cumsum([p.size for p in self.parts()])[:-1]
        return Model(*(x.reshape(p.shape).astype(np.float32) for x, p in zip(np.split(flat, cut), self.parts(), strict=True)))

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Vectors after tokens ``one`` (just before) and ``two`` (before that)."""
        return self.context[one] * self.place[0] + self.context[two] * self.place[1]


def summed_rows(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``at`` and the sums of their ``rows``."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], np.add.reduceat(rows[order], first, axis=0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def contrasts(model: Model, log_noise: np.ndarray, q: np.ndarray, token: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds that each real token, and each drawn one after each context, comes from the model and not from the noise."""
    ratio = log_noise + np.log(len(noise)).astype(log_noise.dtype)
    return (q * model.target[token]).sum(1) + (model.bias - ratio)[token], q @ model.target[noise].T + (model.bias - ratio)[noise]


def nce_loss(model: Model, log_noise: np.ndarray, one: np.ndarray, two: np.ndarray, token: np.ndarray, noise: np.ndarray) -> float:
    """The contrastive loss of a batch against ``noise`` tokens that all its contexts share."""
    real, drawn = contrasts(model, log_noise, model.predicted(one, two), token, noise)
    return float(np.logaddexp(0, -real).sum() + np.logaddexp(0, drawn).sum())


def nce_gradient(model: Model, log_noise: np.ndarray, one: np.ndarray, two: np.ndarray, token: np.ndarray, noise: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The gradient of ``nce_loss``: (rows, values) for each part of the model."""
    q = model.predicted(one, two)
    real, push = contrasts(model, log_noise, q, token, noise)
    pull, push = -sigmoid(-real), sigmoid(push)
    dq = pull[:, None] * model.target[token] + push @ model.target[noise]
    targets = summed_rows(np.concatenate((token, noise)), np.concatenate((np.column_stack((pull[:, None] * q, pull)), np.column_stack((push.T @ q, push.sum(0))))))
    contexts = summed_rows(np.concatenate((one, two)), np.concatenate((dq * model.place[0], dq * model.place[1])))
    places = np.stack(((dq * model.context[one]).sum(0), (dq * model.context[two]).sum(0)))
    return [contexts, (np.arange(2), places), (targets[0], targets[1][:, :-1]), (targets[0], targets[1][:, -1])]


class Trainer:
    """Steps of adaptive size from a model onwards."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.model = Model(*(p.copy() for p in model.parts()))
        self.log_noise = np.log(noise).astype(np.float32)
        self.up_to = np.cumsum(noise)
        self.squares = [np.full(p.shape, 1e-2, np.float32) for p in self.model.parts()]
        self.rng = np.random.default_rng(seed)
        self.tokens = 0

    def learn(self, one: np.ndarray, two: np.ndarray, token: np.ndarray) -> None:
        """All the given tokens with their contexts, once, in batches of mixed order."""
        order = self.rng.permutation(len(token))
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            noise = np.minimum(np.searchsorted(self.up_to, self.rng.random(NOISE), "right"), len(self.up_to) - 1)
            gradient = nce_gradient(self.model, self.log_noise, one[at], two[at], token[at], noise)
            for part, square, (rows, g) in zip(self.model.parts(), self.squares, gradient, strict=True):
                g = g / np.float32(len(at) ** 0.5)
                square[rows] += g * g
                part[rows] -= np.float32(RATE) * g / np.sqrt(square[rows])
        self.tokens += len(token)


def with_ends(token: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of ``rows`` texts, each closed by an end, with the two before each one (an end before the first) and their rows."""
    size = np.bincount(row, minlength=rows)
    stop = np.cumsum(size + 1) - 1
    whole = np.full(len(token) + rows, END, np.int64)
    whole[np.arange(len(token)) + row] = token
    one = np.concatenate(([END], whole[:-1])) if len(whole) else whole
    two = np.concatenate(([END], one[:-1])) if len(whole) else whole
    two[stop - size] = END
    return whole, one, two, np.repeat(np.arange(rows), size + 1)


def fold(key: str) -> Column:
    """Whether a row is held out: its id's checksum leaves 2 by seven."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of a task with their counts and classes; a null word counts texts."""
    held: list[pa.Table] = []
    rows = texts = 0

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.group_by("word").aggregate([("n", "sum")])
        for part in table.to_batches(max_chunksize=50_000):
            words = part.column("word")
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary()).cast(pa.string()), pa.array(classes_of(words), pa.int32()), part.column("n_sum")], names=["word", "kind", "n"])

    for batch in batches:
        texts += batch.num_rows
        for part in chunks(batch):
            at, words, _, _ = split_words(part.column("text"), _KIND)
            held.append(pa.table([words, pa.array(np.bincount(at, minlength=len(words)), pa.int64())], names=["word", "n"]))
            rows += len(words)
            if rows > 2 * HELD:
                yield from out(pa.concat_tables(held))
                held, rows = [], 0
    if held:
        yield from out(pa.concat_tables(held))
    if texts:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([-1], pa.int32()), pa.array([texts], pa.int64())], names=["word", "kind", "n"])


def _least_count(table: DataFrame) -> int:
    """The least count such that at most HEAD words have it or a greater one, in steps of a sixteenth of a doubling beyond 1024."""
    n = F.col("n")
    step = F.when(n < 1024, n).otherwise(1024 + F.floor(16 * F.log2(n / 1024)).cast("long"))
    rows = table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()  # 2,000 at most
    total, least = 0, 2**62
    for r in rows:
        total += r["k"]
        if total > HEAD:
            break
        least = r["least"]
    return least


def count(texts: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """``word, n`` of all words of the training texts, and what tasks hold of it."""
    words = landed(texts.select("text").mapInArrow(_counted, "word string, kind int, n long").groupBy("word", "kind").agg(F.sum("n").alias("n")), "words")
    ends = words.filter("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    table = words.filter("word is not null")
    head = sorted(((r["word"].encode(), r["kind"], r["n"]) for r in table.filter(F.col("n") >= _least_count(table)).collect()), key=lambda r: (-r[2], r[0]))
    own = head[:MODEL_WORDS]
    total, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    rest, mass = np.ones(CLASSES), np.zeros(CLASSES)
    for r in table.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():  # a row a class
        rest[r["kind"]] += r["n"] + r["k"]
        mass[r["kind"]] += r["n"]
    for _, kind, n in own:
        rest[kind] -= n + 1
        mass[kind] -= n
    noise = np.concatenate(([ends], mass, [n for _, _, n in own])) + 1.0
    known, counts = pa.array([w for w, _, _ in head], pa.large_binary()), np.array([n for _, _, n in head], np.int64)
    return table.select("word", "n"), Vocabulary(int(total + ends), int(distinct + (ends > 0)), int(ends), known, counts, len(own), rest, noise / noise.sum())


def _averaged(blocks: pd.DataFrame) -> pd.DataFrame:
    """The sum of a block's numbers over trainers, and of their tokens."""
    r = blocks.iloc[0]
    return pd.DataFrame([{"block": r["block"], "trainer": r["trainer"] // FAN, "tokens": blocks["tokens"].sum(), "x": np.sum(np.stack(blocks["x"].tolist()), 0)}])


def train(texts: DataFrame, vocabulary: Vocabulary, width: int = WIDTH, rounds: int = ROUNDS) -> Model:
    """A model from column ``text`` of all of ``texts``."""
    spark = texts.sparkSession
    model = Model.start(vocabulary.noise, width)
    trainers = max(spark.sparkContext.defaultParallelism, 1)
    shared_words = spark.sparkContext.broadcast(vocabulary)  # HEAD words, and the model's tokens
    kind = "block int, trainer int, tokens long, x array<double>"
    share = F.pmod(F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit(11)), F.lit(rounds))
    for round_ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, round_=round_) -> Iterator[pa.RecordBatch]:
            number, words = TaskContext.get().partitionId(), shared_words.value
            trainer = Trainer(shared.value, words.noise, 1000 * round_ + number)
            for batch in batches:
                for part in chunks(batch):
                    at, known, _, row = split_words(part.column("text"), _KIND)
                    token, one, two, _ = with_ends(words.look_up(known)[0][at], row, part.num_rows)
                    trainer.learn(one, two, token)
            if trainer.tokens:
                flat = trainer.model.flat().astype(np.float64) * trainer.tokens
                for b, a in enumerate(range(0, len(flat), BLOCK)):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([number], pa.int32()), pa.array([trainer.tokens], pa.int64()), pa.array([flat[a : a + BLOCK]])], names=["block", "trainer", "tokens", "x"])

        sums = landed(texts.filter(share == round_).select("text").coalesce(trainers).mapInArrow(run, kind), "trained")
        left = trainers
        while left > FAN:
            sums = sums.groupBy("block", F.expr(f"trainer div {FAN}").alias("fan")).applyInPandas(_averaged, kind)
            left = -(-left // FAN)
        got = sums.groupBy("block").applyInPandas(_averaged, kind).orderBy("block").collect()  # the size of the model
        if got:
            model = model.of_flat(np.concatenate([np.array(r["x"]) / r["tokens"] for r in got]))
        shared.unpersist()
    shared_words.unpersist()
    return model


def normalisers(spark: SparkSession, model: Model) -> np.ndarray:
    """For every two tokens before, ``[one, two]``, the log of the sum of all tokens' exponentiated scores."""
    shared = spark.sparkContext.broadcast(model)
    size = len(model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for one in batch.column(0).to_pylist():
                s = m.predicted(np.full(size, one), np.arange(size)) @ m.target.T + m.bias
                top = s.max()
                s -= top
                yield pa.RecordBatch.from_arrays([pa.array([one], pa.int64()), pa.array([top + np.log(np.exp(s, out=s).sum(1))])], names=["one", "x"])

    tasks = min(size, 4 * max(spark.sparkContext.defaultParallelism, 1))
    rows = spark.range(0, size, 1, tasks).mapInArrow(run, "one long, x array<float>").collect()  # the square of the model's tokens
    out = np.empty((size, size), np.float32)
    for r in rows:
        out[r["one"]] = r["x"]
    shared.unpersist()
    return out


def log10_probabilities(m: Model, log_sum: np.ndarray, one: np.ndarray, two: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Normalised log10 probabilities of tokens after two others."""
    out = np.empty(len(token), np.float64)
    for a in range(0, len(token), 65_536):
        b = slice(a, a + 65_536)
        out[b] = (m.predicted(one[b], two[b]) * m.target[token[b]]).sum(1) + m.bias[token[b]] - log_sum[one[b], two[b]]
    return out / np.log(10)


SCORED = "id {}, held_out boolean, n_tokens long, n_known long, base double, score double, words array<string>, times array<int>"


def score(docs: DataFrame, table: DataFrame, vocabulary: Vocabulary, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key, held_out, n_tokens, n_known, base_score, score``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, model, normalisers(spark, model)))  # HEAD words, and what the model holds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m, log_sum = shared.value
        whole = log10(v.tokens + v.distinct + 1)
        for batch in batches:
            for part in chunks(batch):
                at, known, _, row = split_words(part.column("text"), _KIND)
                of_token, of_count, of_share = v.look_up(known)
                rows = part.num_rows
                token, one, two, owner = with_ends(of_token[at], row, rows)
                n = np.bincount(row, minlength=rows)
                add = lambda x: np.bincount(row, x, rows)  # noqa: B023, E731
                logs = np.log10(np.maximum(of_count, 0) + 1.0)[at]
                base = add(logs) + log10(v.ends + 1) - (n + 1) * whole
                score = np.bincount(owner, log10_probabilities(m, log_sum, one, two, token), rows) + add(of_share[at])
                sure = add((of_count[at] > 0).astype(np.float64)).astype(np.int64) + (v.ends > 0)
                # Words that only the table knows: counted per text.
                far = of_count[at] < 0
                pair, times = np.unique(row[far].astype(np.int64) * max(len(known), 1) + at[far], return_counts=True)
                of, which = np.divmod(pair, max(len(known), 1))
                offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=rows)))), pa.int32())
                names = known.take(pa.array(which)).cast(pa.binary()).cast(pa.string())
                columns = [part.column("id"), part.column("held_out"), pa.array(n + 1, pa.int64()), pa.array(sure, pa.int64()), pa.array(base), pa.array(score)]
                columns += [pa.ListArray.from_arrays(offsets, names), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"])

    kind = SCORED.format(docs.schema[key].dataType.simpleString())
    made = docs.select(F.col(key).alias("id"), fold(key).alias("held_out"), F.col(text).alias("text")).mapInArrow(run, kind)
    rows = landed(made.withColumn("row", F.monotonically_increasing_id()), "scored")
    far = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    more = far.join(table, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 1)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"))
    out = rows.drop("words", "times").join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(F.col("id").alias(key), "held_out", "n_tokens", plus("n_known", "known").alias("n_known"), plus("base", "more").alias("base_score"), plus("score", "more").alias("score"))


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` scored by a model of those that are not held out; adds ``train_tokens``."""
    learn = docs.filter(~fold(key)).select(F.col(text).alias("text"))
    table, vocabulary = count(learn)
    found = score(docs, table, vocabulary, train(learn, vocabulary), key, text)
    if not vocabulary.tokens:
        found = found.withColumn("score", F.lit(0.0))
    return found.withColumn("train_tokens", F.lit(vocabulary.tokens).cast("long"))


def op11(docs: DataFrame) -> DataFrame:
    return score_texts(docs.select("doc_id", "text")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
