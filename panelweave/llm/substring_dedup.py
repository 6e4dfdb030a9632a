"""Repeated passages inside documents: paragraphs by MinHash banding, and runs of words anywhere.

A paragraph (a line of at least MIN_WORDS words) is a set of five-word shingles with MinHash bands
tuned for recall: BANDS bands of ROWS rows bring a pair alike by 0.8 together with a probability of
0.9997. Colliding paragraphs are compared exactly (Jaccard 0.8 or more); connected components are the
groups, and of each group the first paragraph (by document id, then place) stays.

A passage may also stand anywhere else: in the middle of different paragraphs, or over several short
lines. So every run of MIN_RUN words of the whole text, line ends being white space, is looked at, and
goes if it occurred before. Anchors find such runs: of every MIN_RUN - WORDS + 1 neighbouring five-word
shingles the least is one, so equal runs have equal anchors. Runs whose anchors stand elsewhere too
are compared as wholes, by 96 bits over their shingles' hashes; as every run that occurred before goes,
longer passages go from their first word to their last. A run that overlaps its own first place stays.

Places are ordered by document id, row and word, for paragraphs and runs alike, and a word goes only for
a word at an earlier place that does not go as part of a paragraph that is merely similar to another. So of
whatever goes word by word, one place stays. A text that has all words of an earlier one goes whole.

Defined cases: a null text is an empty one and stays null; shorter paragraphs and runs stay. Rows are
told apart by their number in the input; so repeated or null ids do no harm, and the first of equal rows
(null ids before all) keeps its text. A paragraph or run repeated within one document counts as repeated.
Extra columns pass through. What is removed is the paragraph's or run's words and the blanks between them;
line ends and white space around it stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import fresh
from panelweave.llm.links import TEXTS, bit_table, groups, held, in_bits, landed, maybe_in, small_batches, spent
from panelweave.llm.shingles import WORDS, mixed, shingles
from panelweave.llm.wordtable import SAME, chunks, kinds, span_hashes, split_words, word_spans

MIN_WORDS = 25
MIN_RUN = 16
BANDS, ROWS = 8, 2
SIMILAR = 0.8
#: A segment ends after a word whose hash with its neighbour's is 0 by this, or after MAX_SEGMENT words.
CUT_EVERY = 8
MAX_SEGMENT = 48
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_KIND = kinds(b"\x20\x09\x0b\x0c\x0d", b"\n")
_SALT = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def segment_starts(words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Starts of the segments of paragraphs that begin at ``start`` in ``words``, chosen by the words before and after."""
    pair = words.copy()
    pair[1:] += mixed(words[:-1])
    pair[start] = words[start]
    first = np.zeros(len(words) + 1, bool)
    first[1:] = mixed(pair) % np.uint64(CUT_EVERY) == 0
    first = first[:-1]
    first[start] = True
    at = np.flatnonzero(first)
    size = np.diff(at, append=len(words))
    parts = -(-size // MAX_SEGMENT)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(at, parts) + step * MAX_SEGMENT


def flat_shingles(words: np.ndarray, start: np.ndarray, size: np.ndarray | None = None, found: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of paragraphs of at least five words each, and where each paragraph's begin.

    Paragraphs fill ``words`` unless their ``size`` is given; ``found`` are all shingles of ``words`` where they are known.
    """
    found = shingles(words) if found is None else found
    n = (np.diff(start, append=len(words)) if size is None else size) - WORDS + 1
    begin = np.cumsum(n) - n
    return found[np.repeat(start - begin, n) + np.arange(n.sum())], begin


def band_keys(flat: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A key per set and band from the least hashes under BANDS * ROWS functions."""
    least = np.stack([np.minimum.reduceat(mixed(flat ^ salt), start) for salt in _SALT], 1).reshape(len(start), BANDS, ROWS)
    key = np.broadcast_to(_SALT[:BANDS], least.shape[:2]).copy()
    for r in range(ROWS):
        key = mixed(key * np.uint64(31) + least[:, :, r])
    return key.view(np.int64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of some texts: hash, line (numbers grow over the texts) and row."""
    raw, _, start, end, line, row = word_spans(texts, _KIND)
    return span_hashes(raw, start, end), line, row


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """As ``word_hashes``, and each word's number among the distinct ones, and those."""
    at, distinct, _, _ = split_words(texts, _KIND, SAME)
    return *word_hashes(texts), at, distinct.to_pylist()


def _heads(numbers: np.ndarray) -> np.ndarray:
    """Where each of the numbers, which do not descend, stands first."""
    return np.flatnonzero(np.diff(numbers, prepend=-1))


def _long_lines(words: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paragraphs: their words without all others, where they begin among these and among ``words``, and their sizes."""
    head = _heads(line)
    n = np.diff(head, append=len(words))
    own = words[np.repeat(n >= MIN_WORDS, n)]
    head, n = head[n >= MIN_WORDS], n[n >= MIN_WORDS]
    return own, np.cumsum(n) - n, head, n


def digests(words: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each sequence of words; sequences begin at ``start`` and fill ``words``."""
    place = (np.arange(1, len(words) + 1) - np.repeat(start, np.diff(start, append=len(words)))).astype(np.uint64)
    return tuple(mixed(np.add.reduceat(mixed((words ^ (salt << np.uint64(1))) + place * (salt | np.uint64(1))), start)).view(np.int64) for salt in _SALT[:2])


def anchors(words: np.ndarray, start: np.ndarray, found: np.ndarray) -> np.ndarray:
    """For every run of MIN_RUN words of the texts that begin at ``start`` in ``words``, the place of its anchor: its least shingle (of all, ``found``), the last of equal ones."""
    size = np.diff(start, append=len(words))
    runs = np.maximum(size - MIN_RUN + 1, 0)
    if not runs.sum():
        return np.zeros(0, np.int64)
    least = found
    at = np.arange(len(least))
    wide, most = 1, MIN_RUN - WORDS + 1
    while wide < most:
        step = min(wide, most - wide)
        later = least[step:] <= least[:-step]
        at, least = np.where(later, at[step:], at[:-step]), np.where(later, least[step:], least[:-step])
        wide += step
    return at[np.repeat(start, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)]


PARTS = "row long, n int, d1 long, d2 long, paragraphs array<struct<at:int,h1:long,h2:long,n:int,bands:array<long>>>, seeds array<long>, places array<int>"
_NAMES = ["row", "n", "d1", "d2", "paragraphs", "seeds", "places"]


def _listed(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text with words: its digest, its paragraphs' digests and bands, and its anchors."""
    for batch in batches:
        for part in chunks(batch):
            w, line, row = word_hashes(part.column("text"))
            if not len(w):
                continue
            start, sh = _heads(row), shingles(w)
            text_of = lambda word: np.searchsorted(start, word, "right") - 1  # noqa: B023, E731
            own, begin, head, n = _long_lines(w, line)
            bands, h1, h2 = pa.array([], pa.list_(pa.int64())), [], []
            if len(n):
                h1, h2 = digests(own, begin)
                bands = _listed(pa.array(band_keys(*flat_shingles(w, head, n, sh)).ravel(), pa.int64()), np.full(len(n), BANDS))
            inside = text_of(head)
            paragraphs = pa.StructArray.from_arrays([pa.array(head - start[inside], pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int32()), bands], names=["at", "h1", "h2", "n", "bands"])
            place = anchors(w, start, sh)
            place = place[np.flatnonzero(np.diff(place, prepend=-1))]
            of = text_of(place)
            per = np.bincount(of, minlength=len(start))
            seeds = sh[place].view(np.int64)
            d1, d2 = digests(w, start)
            columns = [part.column("row").take(pa.array(row[start])), pa.array(np.diff(start, append=len(w)), pa.int32()), pa.array(d1), pa.array(d2)]
            columns += [_listed(paragraphs, np.bincount(inside, minlength=len(start))), _listed(pa.array(seeds, pa.int64()), per), _listed(pa.array(place - start[of], pa.int32()), per)]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)


RUNS = "h1 long, h2 int, row long, at int, near int"
#: Shingles at these words of a run cover it.
_COVER = (*range(0, MIN_RUN - WORDS, WORDS), MIN_RUN - WORDS)


def _runs(often):
    """Of (row, text, gone, near): each run of MIN_RUN words whose anchor may be among ``often``, with its place in its text.

    Texts that are ``gone`` have none. Bit k of ``near``: the run's k-th word lies in one of the paragraphs ``near``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(often.value, np.uint8)
        for batch in batches:
            for part in chunks(batch.filter(pc.invert(batch.column("gone")))):
                w, _, row = word_hashes(part.column("text"))
                if not len(w):
                    continue
                start, sh = _heads(row), shingles(w)
                place = anchors(w, start, sh)
                hit = np.flatnonzero(in_bits(table, sh.view(np.int64)[place]))
                if not len(hit):
                    continue
                runs = np.maximum(np.diff(start, append=len(w)) - MIN_RUN + 1, 0)
                text = np.repeat(np.arange(len(start)), runs)[hit]
                at = hit - (np.cumsum(runs) - runs)[text] + start[text]
                h1, h2 = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
                for k, step in enumerate(_COVER):
                    piece = sh[at + step]
                    h1 += mixed(piece + _SALT[2 * k])
                    h2 += mixed(piece ^ _SALT[2 * k + 1])
                flag = np.zeros(len(w), np.int32)
                for a, spans in zip(start, part.column("near").take(pa.array(row[start])).to_pylist(), strict=True):
                    for x in spans or ():
                        flag[a + x["start"] : a + x["end"]] = 1
                near = np.zeros(len(at), np.int32)
                if flag.any():
                    for k in range(MIN_RUN):
                        near |= flag[at + k] << k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mixed(h1).view(np.int64)), pa.array((mixed(h2) >> np.uint64(32)).astype(np.uint32).view(np.int32)), part.column("row").take(pa.array(row[at])), pa.array(at - start[text], pa.int32()), pa.array(near)],
                    names=["h1", "h2", "row", "at", "near"],
                )

    return run


def _bodies(wanted: dict):
    """The distinct shingles, in order, of the paragraphs whose digest may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.frombuffer(wanted["bits"].value, np.uint8), set()
        for batch in batches:
            for part in chunks(batch):
                w, line, _ = word_hashes(part.column("text"))
                own, begin, head, n = _long_lines(w, line)
                if not len(n):
                    continue
                h1, h2 = digests(own, begin)
                hit = np.flatnonzero(in_bits(table, h1))
                if not len(hit):
                    continue
                flat, at = flat_shingles(w, head[hit], n[hit])
                got = []
                for key, sh in zip(zip(h1[hit].tolist(), h2[hit].tolist(), strict=True), np.split(flat, at[1:]), strict=True):
                    if key not in seen:
                        if len(seen) < 100_000:
                            seen.add(key)
                        got.append((*key, np.unique(sh).tobytes()))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], names=["h1", "h2", "body"])

    return run


def _sets():
    return lambda body: np.frombuffer(body, np.uint64)


def repeated(docs: DataFrame) -> DataFrame:
    """``row, start, end``: words [start, end) of the text that occurred before; they may overlap.

    ``docs`` has row and text, and the same rows at every read; rows come in the order of their numbers. A
    place is one number, so that the first of equal things is found by hashing, without a sort.
    """
    spark = docs.sparkSession
    texts = landed(docs.select("row", "text").mapInArrow(_parts, PARTS), "parts", TEXTS)
    span = texts.agg(F.max("row"), F.max("n")).first()
    shift = max(int(span[1] or 0).bit_length(), 1)
    # Where a number of 64 bits is too small for row and word, a decimal takes its place.
    kind = "long" if int(span[0] or 0).bit_length() + shift < 63 else "decimal(38, 0)"
    place = F.col("row").cast(kind) * F.lit(2**shift).cast(kind) + F.col("at").cast(kind)
    row_of = lambda p: F.floor(F.col(p) / 2**shift) if kind != "long" else F.shiftright(p, shift)
    parts = texts.select("row", F.explode("paragraphs").alias("p")).select("row", "p.*")
    # Equal paragraphs have equal bands: one of them stands for all.
    of_text = parts.select("h1", "h2", "n", place.alias("place")).groupBy("h1", "h2").agg(F.min("place").alias("first"), F.min("n").alias("n"), F.count(F.lit(1)).alias("k"))
    found = landed(of_text.withColumn("node", F.monotonically_increasing_id()), "found")
    # Buckets: of the paragraph at the first place only.
    first = parts.select("h1", "h2", "bands", place.alias("first")).join(found.select("h1", "h2", "first", "node"), ["h1", "h2", "first"]).select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    placed = landed(first, "buckets")
    shared = held(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("bucket"))
    members = held(placed.filter(maybe_in(shared, "bucket")("bucket")).join(shared, "bucket").select("bucket", "node"))
    near = held(found.select("node", "h1", "h2").join(members.select("node").distinct(), "node", "left_semi"))
    bits = spark.sparkContext.broadcast(bit_table(near, "h1"))
    some = docs.select("text").mapInArrow(_bodies({"bits": bits}), "h1 long, h2 long, body binary")
    bodies = landed(near.join(some, ["h1", "h2"]).groupBy("node").agg(F.first("body").alias("body")), "bodies", TEXTS)
    spent(placed, shared, near)
    comps = groups(members, bodies, _sets, SIMILAR)
    named = landed(found.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "named")
    spent(members, bodies, found, comps)
    several = named.groupBy("comp").agg(F.min("first").alias("stays"), F.sum("k").alias("total")).filter("total > 1")
    lead = named.select(F.col("first").alias("stays"), F.col("h1").alias("l1"), F.col("h2").alias("l2"))  # a place is of one paragraph
    alike = (F.col("h1") != F.col("l1")) | (F.col("h2") != F.col("l2"))
    again = held(named.join(several, "comp").join(lead, "stays").select("h1", "h2", "stays", alike.alias("alike")))
    whole = parts.select("row", "at", "h1", "h2", "n").filter(maybe_in(again, "h1")("h1")).join(again, ["h1", "h2"]).filter(place != F.col("stays"))
    gone = held(whole.select("row", F.col("at").alias("start"), (F.col("at") + F.col("n")).alias("end"), "alike"))
    spent(named, again)
    # Texts of the same words go whole but for the first, and take no part from here on.
    same = held(texts.filter(F.col("n") >= MIN_RUN).groupBy("d1", "d2").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k"))
    copies = held(texts.select("row", "n", "d1", "d2").filter(maybe_in(same, "d1")("d1")).join(same, ["d1", "d2"]).filter(F.col("row") != F.col("first")).select("row", "n"))
    # Runs anywhere in the others: those whose anchors stand elsewhere, too.
    there = texts.select("row", "seeds").withColumn("hit", maybe_in(copies, "row")("row"))
    rest = there.filter("not hit").unionByName(there.filter("hit").join(copies.select("row"), "row", "left_anti"))
    often = held(rest.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("seed"))
    table = spark.sparkContext.broadcast(bit_table(often, "seed"))
    spent(texts, same, often)
    flags = copies.select("row", F.lit(True).alias("gone"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("near"))
    flags = flags.unionByName(gone.filter("alike").groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("near")).select("row", F.lit(False).alias("gone"), "near"))  # bounded by a text's lines
    flags = held(flags.groupBy("row").agg(F.max("gone").alias("gone"), F.first("near", True).alias("near")))
    # Only texts that may have a flag move to meet it.
    flagged = docs.select("row", "text").withColumn("hit", maybe_in(flags, "row")("row"))
    plain = flagged.filter("not hit").select("row", "text", F.lit(False).alias("gone"), F.lit(None).cast(flags.schema["near"].dataType).alias("near"))
    touched = flagged.filter("hit").join(flags, "row", "left").select("row", "text", F.coalesce("gone", F.lit(False)).alias("gone"), "near")
    runs = plain.unionByName(touched).mapInArrow(_runs(table), RUNS)
    runs = landed(runs.select("h1", "h2", place.alias("place"), "near"), "runs", TEXTS)
    spent(flags)
    # The first place of all, the first that stays whole, and the words that go at the first of all where it doesn't.
    word = F.col("near").cast("long").bitwiseAND(F.lit(2**MIN_RUN - 1))
    wide = "long" if int(span[0] or 0).bit_length() + shift + MIN_RUN < 63 else "decimal(38, 0)"
    marked = F.when(word != 0, F.col("place").cast(wide) * F.lit(2**MIN_RUN).cast(wide) + word.cast(wide))
    firsts = runs.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.min(F.when(word == 0, F.col("place"))).alias("plain"), F.min(marked).alias("marked"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    lost = F.when(F.col("plain") == F.col("first"), F.lit(0).cast("long")).otherwise((F.col("marked") % F.lit(2**MIN_RUN)).cast("long"))
    firsts = held(firsts.select("h1", "h2", "first", "plain", lost.alias("lost")))
    # What stands at the first place of all goes but for words that do not stay there; what stands at an earlier place that stays goes.
    apart = lambda c: (F.col("place") != F.col(c)) & ((row_of("place") != row_of(c)) | (F.col("place") - F.col(c) >= MIN_RUN))
    kept = F.when(F.col("plain").isNotNull() & (F.col("plain") < F.col("place")) & apart("plain"), F.lit(0).cast("long")).when(apart("first"), F.col("lost"))
    cut = runs.filter(maybe_in(firsts, "h1")("h1")).join(firsts, ["h1", "h2"]).select(row_of("place").cast("long").alias("row"), (F.col("place") - row_of("place") * F.lit(2**shift).cast(kind)).cast("int").alias("at"), kept.alias("kept"))
    cut = landed(joined_runs(cut.filter("kept is not null")), "cut")
    spent(runs, firsts)
    whole_copies = copies.select("row", F.lit(0).alias("start"), F.col("n").alias("end"))
    return gone.drop("alike").unionByName(whole_copies).unionByName(cut)


def joined_runs(cut: DataFrame) -> DataFrame:
    """``row, start, end`` of the words of runs at ``row, at``, but for the words marked in ``kept``; runs that overlap become one.

    Per block of 64 words, a bit each for those that go (``low``), and for those that its runs have in the next block (``high``).
    """
    goes = cut.select("row", F.shiftright("at", 6).alias("block"), F.expr("at & 63").alias("at"), (F.lit(2**MIN_RUN - 1).cast("long") - F.col("kept")).alias("goes"))
    bits = goes.groupBy("row", "block").agg(F.expr("bit_or(shiftleft(goes, at))").alias("low"), F.expr("bit_or(shiftrightunsigned(shiftrightunsigned(goes, 1), 63 - at))").alias("high"))
    heads, tails = ("low & ~shiftleft(low, 1)", "high & ~(shiftleft(high, 1) | shiftrightunsigned(low, 63))"), ("low & ~(shiftrightunsigned(low, 1) | shiftleft(high, 63))", "high & ~shiftrightunsigned(high, 1)")
    edges = bits.select("row", "block", *[F.expr(x).alias(name) for name, x in zip(("h0", "h1", "t0", "t1"), heads + tails, strict=True)])
    at = lambda c: f"filter(sequence(0, {62 + MIN_RUN}), i -> if(i < 64, shiftright({c}0, i), shiftright({c}1, i - 64)) & 1 = 1)"
    spans = edges.select("row", "block", F.explode(F.arrays_zip(F.expr(at("h")).alias("head"), F.expr(at("t")).alias("tail"))).alias("s"))
    return spans.select("row", *[F.expr(f"cast(64 * block + s.{x} as int)").alias(name) for x, name in (("head", "start"), ("tail + 1", "end"))])


def without(text: str, removed: list[tuple[int, int]]) -> tuple[str, int]:
    """``text`` without words [start, end), which may overlap; and how many words went."""
    spans = [m.span() for m in _WORD.finditer(text)]  # words as they were counted: by ASCII white space
    out, pos, gone = [], 0, 0
    joined: list[list[int]] = []
    for start, end in sorted(removed):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    for start, end in joined:
        a, b = spans[start][0], spans[end - 1][1]
        out += [text[pos:a], "\n" * text.count("\n", a, b)]
        pos = b
        gone += end - start
    return "".join(out) + text[pos:], gone


def in_order(docs: DataFrame, key: str, row: str) -> DataFrame:
    """``docs`` written once with ``row``, numbers that ascend by key (nulls first), then by place in the input.

    A later plan of ``docs`` may split files otherwise, so the numbers are read back from here. Numbers of a
    partition follow each other, and those of the next one come after as small a gap as fits.
    """
    name = fresh(docs)
    first, at = name("__first"), name("__at")
    order = [F.col(key).cast("long").asc_nulls_first(), F.col(first).asc()]
    rows = docs.withColumn(first, F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop(first)
    rows = landed(rows.withColumn(at, F.monotonically_increasing_id()), "numbered")
    inside = F.col(at).bitwiseAND(F.lit(2**33 - 1))
    bits = int(rows.agg(F.max(inside)).first()[0] or 0).bit_length()
    return rows.withColumn(row, F.shiftleft(F.shiftright(at, 33), bits) + inside).drop(at)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", count: str = "words_removed") -> DataFrame:
    """``docs`` without repeated passages, and with ``count``, the words that went.

    Only rows that may have lost something move again; the others pass by.
    """
    fields = [c for c in docs.columns if c != count]
    name = fresh(docs)
    row, hit, done = (name(c) for c in ("__row", "__hit", "__cut"))
    rows = in_order(docs, key, row)
    gone = repeated(rows.select(F.col(row).alias("row"), F.col(text).alias("text")))
    by_row = held(gone.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("removed")))
    spent(gone)
    small_batches(docs.sparkSession)
    rows = rows.withColumn(hit, maybe_in(by_row, "row")(row))
    touched = rows.filter(F.col(hit)).join(by_row.withColumnRenamed("row", row).withColumnRenamed("removed", done), row, "left")

    @F.pandas_udf("text string, gone long")
    def cut(texts: pd.Series, removed: pd.Series) -> pd.DataFrame:
        done = [(t, 0) if r is None or t is None else without(t, [(x["start"], x["end"]) for x in r]) for t, r in zip(texts, removed, strict=True)]
        return pd.DataFrame(done, columns=["text", "gone"])

    made = touched.withColumn(done, cut(F.col(text), F.col(done)))
    changed = made.select(*[F.col(f"{done}.text").alias(c) if c == text else F.col(c) for c in fields], F.col(f"{done}.gone").alias(count))
    same = rows.filter(~F.col(hit)).select(*fields, F.lit(0).cast("long").alias(count))
    return changed.unionByName(same)


def op5(docs: DataFrame) -> DataFrame:
    """Each document's remaining text and the words that went."""
    return dedup(docs.select("doc_id", "text"))
