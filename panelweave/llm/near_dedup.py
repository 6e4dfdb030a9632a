"""Near-duplicate documents by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its five-word shingles. Each shingle runs Poisson processes over the
interval of its weights; a signature keeps, for each of M labels, the earliest point at a height
within the document's weight. Two signatures agree at a label with a probability of the weighted
Jaccard similarity. Heights are cut at 1, 2, 4, 8, …; inside such a part the process splits in
halves down to single weights, and a part whose first point lies after all points kept so far is
left alone, so a large weight costs little more than a small one.

Exact copies become one node first. Nodes whose signatures collide in a band are candidates, and their
texts are compared exactly.

Defined cases: a null or empty text, or one of white space only, is in a class of its own. A text of
fewer than five words is one shingle. Rows of one text are in one class whatever their ids; the class
is named after the least id in it, where null ids count as greater than any. Extra columns are ignored
by ``classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import WORD, fresh
from panelweave.llm.links import TEXTS, groups, held, landed, maybe_in
from panelweave.llm.shingles import WordHash, counted, mixed, shingles, words_of
from panelweave.session import freeze

BANDS, ROWS = 12, 3
M = BANDS * ROWS
SIMILAR = 0.8
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _exp(h: np.ndarray) -> np.ndarray:
    return -np.log1p(-((h >> np.uint64(11)).astype(np.float64) * 2.0**-53))


class _Signing:
    """Signatures of several bags at once; ``value[d, i]`` is the earliest point of label ``i``."""

    def __init__(self, bags: int, m: int):
        self.m = m
        self.value = np.full(bags * m, np.inf)
        self.bags = bags
        self.last = np.full(bags, np.inf)

    def offer(self, bag: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        np.minimum.at(self.value, bag * self.m + label, x)

    def settle(self) -> None:
        self.last = self.value.reshape(self.bags, self.m).max(1)


def _label(h: np.ndarray, m: int) -> np.ndarray:
    return (mixed(h ^ _GOLD) % np.uint64(m)).astype(np.int64)


def _halves(s: _Signing, bag, seed, low, high, weight, x, label) -> list[tuple]:
    """Processes over (low, high] with their next points, split down to single weights.

    A point above ``weight`` counts for nothing. Returns the single-weight processes reached, with
    the point each has had: (bag, seed, x).
    """
    reached = []
    while len(bag):
        inside = high <= weight
        s.offer(bag[inside], label[inside], x[inside])
        s.settle()
        single = high - low == 1
        near = x <= s.last[bag]
        leaf = single & near & inside
        if leaf.any():
            reached.append((bag[leaf], seed[leaf], x[leaf]))
        go = near & ~single
        bag, seed, low, high, weight, x, label = (v[go] for v in (bag, seed, low, high, weight, x, label))
        mid = (low + high) // 2
        side = mixed(seed + np.uint64(1))
        to_upper = (side >> np.uint64(63)) == 1
        other = mixed(seed + np.uint64(2))
        later = x + _exp(other) / (mid - low)
        other_label = _label(other, s.m)
        parts = []
        for upper in (False, True):
            own = to_upper == upper
            parts.append((bag, mixed(seed + np.uint64(4 if upper else 3)), mid if upper else low, high if upper else mid, weight, np.where(own, x, later), np.where(own, label, other_label)))
        bag, seed, low, high, weight, x, label = (np.concatenate(v) for v in zip(*parts, strict=True))
        live = low < weight
        bag, seed, low, high, weight, x, label = (v[live] for v in (bag, seed, low, high, weight, x, label))
    return reached


def _singles(s: _Signing, bag, seed, x, step: int) -> None:
    """Single-weight processes from their point ``x`` on, ``step`` points at a time."""
    k = np.uint64(1)
    while len(bag):
        h = mixed(seed[:, None] + _GOLD * (k + np.arange(step, dtype=np.uint64))[None, :])
        # One after the other from ``x`` on, so that rounding does not depend on ``step``.
        xs = np.cumsum(np.concatenate((x[:, None], _exp(h)), 1), 1)[:, 1:]
        use = xs <= s.last[bag][:, None]
        s.offer(np.repeat(bag, use.sum(1)), _label(h[use], s.m), xs[use])
        s.settle()
        x = xs[:, -1]
        go = x <= s.last[bag]
        bag, seed, x = bag[go], seed[go], x[go]
        k += np.uint64(step)


def bagminhash(bags: list[tuple[np.ndarray, np.ndarray]], m: int = M) -> np.ndarray:
    """A signature per bag (distinct hashes, counts), as a matrix of 64-bit values; empty bags have all ones."""
    s = _Signing(len(bags), m)
    bag = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    seed = np.concatenate([h for h, _ in bags]) if bags else np.zeros(0, np.uint64)
    weight = np.concatenate([c for _, c in bags]) if bags else np.zeros(0, np.int64)
    leaves = []
    top = int(weight.max()) if len(weight) else 0
    low = 1
    tall = []
    while low < top:  # parts (1, 2], (2, 4], (4, 8], …
        tall.append(low)
        low *= 2
    for low in reversed(tall):
        on = weight > low
        part = mixed(seed[on] ^ np.uint64(low * 0x9E3779B97F4A7C15 % 2**64))
        first = mixed(part)
        leaves += _halves(s, bag[on], part, np.full(on.sum(), low), np.full(on.sum(), 2 * low), weight[on], _exp(first) / low, _label(first, m))
    step = max(1, 4 * m // max(1, len(seed) // max(1, len(bags))) // 8)
    _singles(s, bag, mixed(seed), np.zeros(len(seed)), step)
    for b, e, x in leaves:
        _singles(s, b, mixed(e + np.uint64(5)), x, step)
    out = mixed(s.value.view(np.uint64)).reshape(len(bags), m)
    out[[i for i, (h, _) in enumerate(bags) if not len(h)]] = np.uint64(2**64 - 1)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band."""
    part = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), part.shape[:2]).copy()
    for r in range(rows):
        key = mixed(key * np.uint64(31) + part[:, :, r])
    return key.view(np.int64)


def _text_key():
    """Two longs of a text's digest: what tells texts apart."""
    d = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    half = lambda a: F.conv(F.substring(d, a, 16), 16, -10).cast("long")
    return F.struct(half(1).alias("h1"), half(17).alias("h2"))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, seen = WordHash(), set()
    for batch in batches:
        h1, h2, texts = (batch.column(i) for i in range(3))
        bags = []
        for i, k in enumerate(zip(h1.to_pylist(), h2.to_pylist(), strict=True)):
            # A text that the task has signed already needs no second signature.
            bags.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)) if k in seen else counted(shingles(hashes.of(words_of(texts[i].as_py())))))
            if len(seen) < 100_000:
                seen.add(k)
        order = sorted((i for i in range(len(bags)) if len(bags[i][0])), key=lambda i: len(bags[i][0]))
        a = 0
        while a < len(order):  # bags of like sizes together, about 100,000 shingles at a time
            b, total = a, 0
            while b < len(order) and b - a < 256 and (total < 100_000 or b == a):
                total += len(bags[order[b]][0])
                b += 1
            at = order[a:b]
            a = b
            signature = bagminhash([bags[i] for i in at])
            keys = band_keys(signature)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [h1.take(take), h2.take(take), pa.array(list(keys), pa.list_(pa.int64()))],
                names=["h1", "h2", "bands"],
            )


def _occurrences():
    """The n-th occurrence of a shingle is a feature of its own: sets of those overlap as the bags do."""
    hashes = WordHash()

    def of(text: str) -> np.ndarray:
        h, n = counted(shingles(hashes.of(words_of(text))))
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return mixed(np.repeat(h, n) + _GOLD * nth.astype(np.uint64))

    return of


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, ``h1, h2`` (its text's digest), ``class_id`` and ``copies``, the rows in its class."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = freeze(docs.select("key", _text_key().alias("k"), (~F.coalesce(F.col("text"), F.lit("")).rlike(WORD)).alias("blank")).select("key", "k.*", "blank"))
    # Copies weigh once from here on: one row per text.
    texts = freeze(rows.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    signed = landed(docs.select(_text_key().alias("k"), "text").select("k.*", "text").mapInArrow(_sign, "h1 long, h2 long, bands array<long>"), "signed", TEXTS)
    one = signed.groupBy("h1", "h2").agg(F.first("bands").alias("bands"))
    nodes = landed(one.join(texts.select("h1", "h2", "node"), ["h1", "h2"]).select("node", "h1", "h2", "bands"), "nodes")
    placed = nodes.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = held(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("bucket"))
    members = held(placed.filter(maybe_in(shared, "bucket")("bucket")).join(shared, "bucket").select("bucket", "node"))
    near = held(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "h1", "h2"))
    some = docs.select(_text_key().alias("k"), "text").select("k.*", "text").filter(maybe_in(near, "h1")("h1"))
    bodies = landed(near.join(some, ["h1", "h2"]).groupBy("node").agg(F.first("text").alias("body")), "bodies", TEXTS)

    comps = groups(members, bodies, _occurrences, SIMILAR)
    named = texts.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("first").alias("class_id"), F.sum("copies").alias("copies"))
    of_text = named.join(names.withColumnRenamed("copies", "total"), "comp").select("h1", "h2", F.col("class_id"), F.col("total").alias("copies"))
    own = F.col("blank") | F.col("class_id").isNull()
    return rows.join(of_text, ["h1", "h2"], "left").select(
        F.col("key").alias(key), "h1", "h2", F.when(own, F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, F.lit(1).cast("long")).otherwise(F.col("copies")).alias("copies"), "blank"
    )


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each class, the first by its number in the input.

    Only rows that may have to go move again.
    """
    name = fresh(docs)
    row, hit = name("__row"), name("__hit")
    rows = landed(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # a later plan of ``docs`` may split files otherwise
    found = classes(rows.select(row, F.col(text).alias("text")), row)
    gone = held(found.filter(F.col(row) != F.col("class_id")).select(row))
    rows = rows.withColumn(hit, maybe_in(gone, row)(row))
    return rows.filter(~F.col(hit)).unionByName(rows.filter(hit).join(gone, row, "left_anti")).select(*docs.columns)


def op9(docs: DataFrame) -> DataFrame:
    """Each document with the class of its near copies, the rows in it, and whether it is the one that stays."""
    found = classes(docs)
    return found.select("doc_id", "class_id", "copies", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
