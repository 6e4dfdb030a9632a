"""Phrases whose words stand together more often than their parts would by chance.

Every task counts the word runs of its shard, sorts them and builds weighted acyclic automata from them
(``transducers``), one for each language and prefix range. A range's automata are united and their
weights summed; runs below the least count go. Longer runs are counted only where the runs inside
them were frequent, which loses nothing since a run is no more frequent than its parts. Most pairs of frequent words
are rare: they are first counted by 32 bits of their hash, a few bytes each, and only pairs whose hash occurs often
enough go into automata, by their symbols; hashes shared by several pairs can only let more in. Counts of the
parts of a candidate come from composing the parts asked for with the automata of their ranges.

A word's symbol is a 64-bit hash. That no two words of a language share one is checked over all
words of the corpus; if any do, another seed is taken. Automata hold whole sequences of
symbols, so counts are exact. A prefix range is a range of hashes of the first two words: an equal
prefix is in one range, and the number of ranges grows with the corpus. What tasks get beforehand is a
table of bits that tells which shorter runs are surely not frequent: sized by their number up to
``MAX_BITS``, beyond which it holds back less and costs a larger shuffle, never a phrase.

Defined cases: null and empty texts have no words; a null language is ``und``, together with
documents of that language. Repeated rows count each. An empty table gives an empty result. Ties
are ordered by phrase, and equal scores of cuts by the shorter first part. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.links import landed
from panelweave.llm.shingles import mixed
from panelweave.llm.transducers import COLUMNS, Transducer, build, of_sorted, tally, union
from panelweave.llm.wordtable import CHUNK, chunks, kinds, split_words

LEAST = 100
MAX_WORDS = 5
TOP = 2000
#: A range of prefixes holds about as many words of the corpus.
RANGE_WORDS = 2_000_000
#: Bits of the largest table of frequent runs that is sent to tasks (128 MB).
MAX_BITS = 1 << 30
#: So many shards' automata are united at a time.
FAN = 64
#: Rows of a task's tables that are held before they are summed up, and then sent on.
HELD = 600_000
_KIND = kinds(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")


def _langs(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    coded = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def _symbol(word: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(word, seed) - 2**63


def _words():
    """Distinct (lang, word) of a task with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("n", "sum")]).rename_columns(["lang", "word", "n"])

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            word = table["word"].cast(pa.binary()).cast(pa.string())
            made = pa.table([table["lang"].cast(pa.string()), word, table["n"]], names=["lang", "word", "n"])
            yield from made.to_batches(max_chunksize=50_000)

        for batch in batches:
            for part in chunks(batch, CHUNK):
                at, words, _, row = split_words(part.column("text"), _KIND)
                code, langs = _langs(part)
                key, n = np.unique(code[row].astype(np.int64) * max(len(words), 1) + at, return_counts=True)
                of, at = np.divmod(key, max(len(words), 1))
                held.append(pa.table([pa.array(langs, pa.string()).take(pa.array(of)), words.take(pa.array(at)), pa.array(n, pa.int64())], names=["lang", "word", "n"]))
                rows += len(n)
                if rows > HELD:
                    held[:] = [summed()]
                    rows = len(held[0])
                    if rows > HELD // 2:
                        yield from out(held.pop())
                        rows = 0
        if rows:
            yield from out(summed())

    return run


def _with_symbols(seed: int):
    """(lang, word, n) with the symbol of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = pa.array([_symbol(w, seed) for w in batch.column(1).cast(pa.binary()).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), h, batch.column(2)], names=["lang", "word", "h", "n"])

    return run


def run_hash(lang: np.ndarray, symbols: Sequence[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each run: of its language's hash and its symbols in order."""
    h = mixed(lang + np.uint64(len(symbols)))
    for s in symbols:
        h = mixed(h * np.uint64(31) + s.view(np.uint64))
    return h


def _lang_hash(langs: Sequence[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)


def prefix_range(lang: np.ndarray, symbols: Sequence[np.ndarray], parts: int) -> np.ndarray:
    """The number of the range that the first two words belong to."""
    return ((run_hash(lang, symbols[:2]) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _symbols(batches: Iterator[pa.RecordBatch], table: np.ndarray, inner: int, seed: int, names: dict[str, int]) -> Iterator[tuple[np.ndarray, ...]]:
    """For the words of some texts at a time: language's number in ``names`` and hash, symbol and piece; and which runs of ``inner`` words may be frequent."""
    full = np.uint64(len(table) * 8)
    for batch in batches:
        for part in chunks(batch, CHUNK):
            at, words, piece, row = split_words(part.column("text"), _KIND)
            m = len(at)
            if m < inner:
                continue
            code, langs = _langs(part)
            number = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
            hashed = _lang_hash(langs)[code][row]
            symbol = np.fromiter((_symbol(w, seed) for w in words.to_pylist()), np.int64, len(words))[at]
            h = run_hash(hashed[: m - inner + 1], [symbol[j : m - inner + 1 + j] for j in range(inner)]) % full
            yield number[code][row], hashed, symbol, piece, _among(table, h)


def _among(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (table[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1


TALLIES = "part long, rows int, steps binary, counts binary"


def _short(lang: np.ndarray, symbols: Sequence[np.ndarray]) -> np.ndarray:
    """32 bits of each run's hash."""
    return run_hash(lang, symbols) >> np.uint64(32)


def _tallies(bits, seed: int, parts: int, least: int):
    """Counts of pairs of words that may both be frequent, by 32 bits of the pair's hash: ascending, as steps, in ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            (h,), n = tally([np.concatenate([x for x, _ in held])], np.concatenate([n for _, n in held]))
            return h, n

        def out(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            part = h * np.uint64(parts) >> np.uint64(32)
            start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            packed = lambda x: pa.compress(x.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)
            cut = [slice(a, b) for a, b in zip(start, [*start[1:], len(h)], strict=True)]
            columns = [pa.array(part[start].astype(np.int64)), pa.array([c.stop - c.start for c in cut], pa.int32())]
            columns += [pa.array([packed(np.diff(h[c], prepend=np.uint64(0))) for c in cut], pa.binary()), pa.array([packed(np.minimum(n[c], least)) for c in cut], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "rows", "steps", "counts"])

        for _, hashed, symbol, piece, ok in _symbols(batches, np.frombuffer(bits.value, np.uint8), 1, seed, {}):
            where = np.flatnonzero((piece[:-1] == piece[1:]) & ok[:-1] & ok[1:])
            if len(where):
                held.append(np.unique(_short(hashed[where], [symbol[where], symbol[where + 1]]), return_counts=True))
                rows += len(held[-1][0])
            if rows > HELD:
                held[:] = [folded()]
                rows = len(held[0][0])
                if rows > HELD // 2:
                    yield out(*held.pop())
                    rows = 0
        if held:
            yield out(*folded())

    return run


def _enough(least: int):
    """The hashes of a range that are counted often enough over all shards."""

    def run(shards: pd.DataFrame) -> pd.DataFrame:
        read = lambda c: [np.frombuffer(pa.decompress(x, 4 * n, codec="zstd", asbytes=True), np.uint32) for x, n in zip(shards[c], shards["rows"].tolist(), strict=True)]
        (h,), n = tally([np.concatenate([np.cumsum(x, dtype=np.int64) for x in read("steps")])], np.concatenate(read("counts")).astype(np.int64))
        return pd.DataFrame({"h": h[n >= least]})

    return run


SHARDS = f"size int, lang string, part long, task int, {COLUMNS}"


def _shards(sizes: Sequence[int], inner: int, bits, seed: int, parts: int, pairs=None):
    """Automata of the runs of ``sizes`` words whose runs of ``inner`` words may all be frequent, by language and range.

    With ``pairs``, a table of ``_short`` hashes, only of those that begin with one of these pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        names: dict[str, int] = {}
        held: dict[int, list] = {k: [] for k in sizes}
        rows = dict.fromkeys(sizes, 0)
        task = TaskContext.get().partitionId()

        def fold(k: int) -> None:
            columns = [np.concatenate(c) for c in zip(*(x[0] for x in held[k]), strict=True)]
            held[k] = [tally(columns, np.concatenate([x[1] for x in held[k]]))]
            rows[k] = len(held[k][0][1])

        def out(k: int) -> pa.RecordBatch:
            (lang, *symbols), n = held[k].pop()
            rows[k] = 0
            langs = [*names]
            part = prefix_range(_lang_hash(langs)[lang], symbols, parts)
            order = np.lexsort([*symbols[::-1], part, lang])
            lang, part, n, symbols = lang[order], part[order], n[order], [s[order] for s in symbols]
            start = np.flatnonzero(np.concatenate(([True], (lang[1:] != lang[:-1]) | (part[1:] != part[:-1]))))
            made = [of_sorted([s[a:b] for s in symbols], n[a:b]) for a, b in zip(start, [*start[1:], len(n)], strict=True)]
            same = lambda x, t: pa.array(np.full(len(start), x), t)
            columns = [same(k, pa.int32()), pa.array(langs, pa.string()).take(pa.array(lang[start])), pa.array(part[start]), same(task, pa.int32())]
            for field, t in (("first", pa.int32()), ("label", pa.int64()), ("target", pa.int32()), ("weight", pa.int32()), ("final", pa.bool_()), ("counts", pa.int64())):
                values = [getattr(m, field) for m in made]
                offsets = np.concatenate(([0], np.cumsum([len(v) for v in values])))
                columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values)).cast(t)))
            return pa.RecordBatch.from_arrays(columns, names=["size", "lang", "part", "task", "first", "label", "target", "weight", "final", "counts"])

        for lang, hashed, symbol, piece, ok in _symbols(batches, table, inner, seed, names):
            m = len(symbol)
            for k in sizes:
                if m < k:
                    continue
                good = piece[: m - k + 1] == piece[k - 1 :]
                for j in range(k - inner + 1):
                    good = good & ok[j : m - k + 1 + j]
                where = np.flatnonzero(good)
                if pairs and len(where):
                    two = np.frombuffer(pairs.value, np.uint8)
                    where = where[_among(two, _short(hashed[where], [symbol[where], symbol[where + 1]]) % np.uint64(len(two) * 8))]
                if len(where):
                    held[k].append(tally([lang[where], *(symbol[where + j] for j in range(k))], np.ones(len(where), np.int64)))
                    rows[k] += len(held[k][-1][1])
                    if rows[k] > HELD:
                        fold(k)
                        if rows[k] > HELD // 2:
                            yield out(k)
        for k in sizes:
            if held[k]:
                fold(k)
                yield out(k)

    return run


FREQUENT = f"size int, lang string, part long, {COLUMNS}, hashes array<long>"


def _hashes(lang: str, keys: list[tuple[int, ...]]) -> list[int]:
    symbols = [np.array(c, np.int64) for c in zip(*keys, strict=True)]
    return run_hash(np.repeat(_lang_hash([lang]), len(keys)), symbols).view(np.int64).tolist()


def _united(least: int, last: bool):
    def run(shards: pd.DataFrame) -> pd.DataFrame:
        r = shards.iloc[0]
        whole = union([Transducer(*x) for x in zip(*(shards[c] for c in ("first", "label", "target", "weight", "final", "counts")), strict=True)], int(r["size"]), least)
        if not whole.counts:
            return pd.DataFrame()
        more = {"hashes": _hashes(r["lang"], [k for k, _ in whole.items()])} if last else {"task": r["task"] // FAN}
        return pd.DataFrame([{"size": r["size"], "lang": r["lang"], "part": r["part"], **whole.row(), **more}])

    return run


def _frequent(shards: DataFrame, tasks: int, least: int) -> DataFrame:
    """The frequent runs of every language and range: the shards of so many tasks are united FAN at a time, then all of a range."""
    while tasks > FAN:
        shards = shards.groupBy("size", "lang", "part", F.expr(f"task div {FAN}").alias("fan")).applyInPandas(_united(1, False), SHARDS)
        tasks = -(-tasks // FAN)
    return landed(shards.groupBy("size", "lang", "part").applyInPandas(_united(least, True), FREQUENT), "frequent")


def _bits(spark, hashes: DataFrame):
    """A broadcast bit for each of the hashes in column ``h``: 16 bits a key, up to MAX_BITS."""
    n = hashes.count()
    size = 1 << 16
    while size < min(16 * n, MAX_BITS):
        size *= 2
    at = F.expr(f"h & {size - 1}L") + 1
    rows = hashes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toLocalIterator()
    out = bytearray(size // 8)
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = r["bits"]
    return spark.sparkContext.broadcast(bytes(out))


CUTS = "lang string, gram array<long>, a long, k int, side string, part_gram array<long>, size int, part long"


def _cuts(parts: int):
    """For each frequent run of two words or more and each cut, its first part and the rest, with their ranges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, r in batch.iterrows():
                items = [*Transducer.of_row(r).items()]
                grams, a, size = [list(k) for k, _ in items], [n for _, n in items], r["size"]
                columns = [np.array(c, np.int64) for c in zip(*grams, strict=True)]
                lang = np.repeat(_lang_hash([r["lang"]]), len(grams))
                for k in range(1, size):
                    for side, lo, hi in (("first", 0, k), ("rest", k, size)):
                        yield pd.DataFrame({"lang": r["lang"], "gram": grams, "a": a, "k": k, "side": side, "part_gram": [g[lo:hi] for g in grams], "size": hi - lo, "part": prefix_range(lang, columns[lo:hi], parts)})

    return run


def _composed(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Counts of the parts asked for, from the range's automaton."""
    if not len(asked) or not len(held):
        return pd.DataFrame()
    whole = Transducer.of_row(held.iloc[0])
    found = [whole.find(g.tolist()) for g in asked["part_gram"]]
    return pd.DataFrame({"lang": asked["lang"], "part_gram": asked["part_gram"], "f": found})


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most_words: int = MAX_WORDS, top: int | None = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of every language (all with ``top`` None)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    seed = 0
    while True:
        counted = docs.mapInArrow(_words(), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        words = landed(counted.mapInArrow(_with_symbols(seed), "lang string, word string, h long, n long"), "words")
        if words.groupBy("lang", "h").count().filter("count > 1").isEmpty():
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("n").cast("long").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    parts = max(16, int(total) // RANGE_WORDS)
    often = words.filter(F.col("n") >= least)

    def singles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = pd.DataFrame({"size": 1, "lang": b["lang"], "h": b["h"], "n": b["n"], "part": 0, "hash": 0})
            for x, at in b.groupby("lang").indices.items():
                of, symbols = np.repeat(_lang_hash([x]), len(at)), [b["h"].to_numpy()[at]]
                made.iloc[at, 4], made.iloc[at, 5] = prefix_range(of, symbols, parts), run_hash(of, symbols).view(np.int64)
            yield made

    def of_words(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")
        made = build(((h,), n) for h, n in zip(rows["h"].tolist(), rows["n"].tolist(), strict=True))
        r = rows.iloc[0]
        return pd.DataFrame([{"size": 1, "lang": r["lang"], "part": r["part"], **made.row(), "hashes": rows["hash"].tolist()}])

    one = often.select("lang", "h", "n").mapInPandas(singles, "size int, lang string, h long, n long, part long, hash long")
    tasks = (docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    levels = [landed(one.groupBy("lang", "part").applyInPandas(of_words, FREQUENT), "frequent")]
    plan = [[k] for k in range(2, min(most_words, 3) + 1)] + ([[*range(4, most_words + 1)]] if most_words > 3 else [])
    for sizes in plan:
        known = levels[-1]
        bits = _bits(spark, known.select(F.explode("hashes").alias("h")))
        pairs = None
        if sizes == [2]:
            tallies = docs.mapInArrow(_tallies(bits, seed, parts, least), TALLIES)
            pairs = _bits(spark, landed(tallies.groupBy("part").applyInPandas(_enough(least), "h long"), "pairs"))
        levels.append(_frequent(docs.mapInArrow(_shards(sizes, sizes[0] - 1, bits, seed, parts, pairs), SHARDS), tasks, least))
        bits.unpersist()
        if pairs:
            pairs.unpersist()
    everything = levels[0]
    for more in levels[1:]:
        everything = everything.unionByName(more)
    everything = everything.drop("hashes")
    cuts = landed(everything.filter("size > 1").mapInPandas(_cuts(parts), CUTS), "cuts")
    asked = cuts.select("size", "lang", "part", "part_gram").distinct()
    keys = ["size", "lang", "part"]
    answers = landed(asked.groupBy(*keys).cogroup(everything.groupBy(*keys)).applyInPandas(_composed, "lang string, part_gram array<long>, f long"), "answers")
    known = cuts.join(answers, ["lang", "part_gram"])
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    known = landed(known.groupBy("lang", "gram", "k").agg(F.first("a").alias("a"), side("first").alias("l"), side("rest").alias("r")), "parts")
    d = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(cast(1000 as decimal(4, 0)) * {d('a')} * {d('n')}) div ({d('l')} * {d('r')})")
    scored = known.join(totals, "lang").withColumn("cut", F.struct(score.alias("score"), "k", "l", "r")).groupBy("lang", "gram", "a", "n").agg(F.min("cut").alias("cut"))
    # A longer run as frequent as one inside it: then one that is longer by a word is, too.
    size = F.size("gram")
    longer = known.filter(size > 2)
    inside = longer.filter("k = 1 and r = a").select("lang", F.slice("gram", 2, size - 1).alias("gram")).unionByName(longer.filter((F.col("k") == size - 1) & (F.col("l") == F.col("a"))).select("lang", F.slice("gram", F.lit(1), size - 1).alias("gram")))
    kept = scored.join(inside.distinct(), ["lang", "gram"], "left_anti")
    spelled = kept.select("lang", "gram", F.posexplode("gram").alias("at", "h")).join(often.select("lang", "h", "word"), ["lang", "h"]).groupBy("lang", "gram").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = kept.join(spelled, ["lang", "gram"]).select("lang", F.array_join(F.col("words.word"), " ").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(w).cast("long"))
    return (ranked if top is None else ranked.filter(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(docs: DataFrame) -> DataFrame:
    return mine(docs)


SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
  t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
  g AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k))),
  f AS (SELECT lang, phrase, k, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 100),
  c AS (SELECT f.lang, f.phrase, f.k AS words, f.n AS a, unnest(range(1, f.k)) AS cut, string_split(f.phrase, ' ') AS ws FROM f WHERE f.k > 1),
  s AS (SELECT c.lang, c.phrase, c.words, c.a, c.cut, l.n AS l, r.n AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.n::HUGEINT * r.n))::BIGINT AS score FROM c JOIN t ON t.lang = c.lang
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.cut + 1:], ' ')),
  b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  o AS (SELECT DISTINCT x.lang, x.phrase FROM b x JOIN b y ON y.lang = x.lang AND y.words > x.words AND 100 * y.a >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
  k AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN o ON o.lang = b.lang AND o.phrase = b.phrase)
  SELECT lang, rank, phrase, a, l, r, n, score FROM k WHERE rank <= 2000"""
