"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of ``K`` code points is hashed; of each window of ``W`` hashes the least is kept, the
rightmost one on ties, with its position. Two texts that share ``K + W - 1`` code points in a row
therefore share a kept hash.

A kept hash is one long: the hash's upper 32 bits, then ``2**31 - 1 - position``. The least long of
a window is thus the least hash at its rightmost place, and a part moved by ``d`` code points
keeps its hashes as ``value - d``.

Defined cases: a null text is an empty one and has no fingerprint; a text shorter than ``K`` is
hashed as a whole; fewer than ``W`` hashes make one window. Two empty fingerprints are alike (1.0),
an empty and another one are not (0.0). Rows without an id stand before all others; rows of one id
are ordered by text. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import let

K = 16
W = 16  # a power of four: window minima are found by fours
REACH = K + W - 1
LAST = 2**31 - 1


def kept_hashes(text: Column) -> Column:
    """The kept hashes of ``text`` in order of position, as an array of longs."""
    mask = F.lit(-(1 << 32)).cast("long")

    def grams(raw: Column, n: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(n - K, F.lit(0)) * 4 + 1, F.lit(4))
        return F.transform(at, lambda byte, i: F.xxhash64(F.substring(raw, byte, F.lit(4 * K))).bitwiseAND(mask) + (LAST - i))

    def least(values: Column, width: int) -> Column:
        if width == W:
            m = F.greatest(F.size(values) - (W - 1), F.lit(1))
            return let(F.slice(values, F.lit(1), m), lambda v: F.filter(v, lambda x, i: ~x.eqNullSafe(F.get(v, i - 1))))
        return let(F.transform(values, lambda x, i: F.least(x, *(F.get(values, i + k * width) for k in (1, 2, 3)))), lambda v: least(v, 4 * width))

    found = let(F.encode(text, "UTF-32"), lambda raw: grams(raw, F.char_length(text)))
    return F.when(F.char_length(text) > 0, let(found, lambda v: least(v, 1))).otherwise(F.array().cast("array<long>"))


def _of_prefix(kept: Column, length: Column) -> Column:
    """Those kept by a window that lies in the text's first ``length`` code points.

    A hash is first kept when it comes into the window, if no smaller one is there, or else when
    the one kept before it leaves.
    """
    place = lambda v: LAST - v.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))

    def first(v: Column, i: Column) -> Column:
        before = F.get(kept, i - 1)
        enters = (i == 0) | (F.shiftright(v, 32) <= F.shiftright(before, 32))
        return F.when(enters, F.greatest(place(v) - (W - 1), F.lit(0))).otherwise(place(before) + 1)

    return F.filter(kept, lambda v, i: first(v, i) <= length - REACH)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the kept hashes, positions aside."""
    hashes = lambda x: F.array_distinct(F.transform(x, lambda v: F.shiftright(v, 32)))
    both = F.struct(hashes(a).alias("a"), hashes(b).alias("b"))

    def share(s: Column) -> Column:
        common = F.size(F.array_intersect(s["a"], s["b"]))
        return let(common, lambda c: c / (F.size(s["a"]) + F.size(s["b"]) - c))

    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(both, share))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``text``, ``kept`` and the same of the next row by key, the first after the last.

    Keys are cut into as many ranges as there are shuffle partitions; each range is ordered by
    itself and gets the first row of the following range as a guest, so no task sees all rows
    and texts move once.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = docs.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(cuts))
    step = 64
    fine = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<long>")
    coarse = F.array(*map(F.lit, cuts[::step])) if cuts else F.array().cast("array<long>")
    reached = lambda among: F.size(F.filter(among, lambda c: c <= F.col("key")))
    block = reached(coarse)
    near = F.greatest(block - 1, F.lit(0)) * step
    docs = docs.withColumn("range", F.when(F.col("key").isNull(), -1).otherwise(near + reached(F.slice(fine, near + 1, F.lit(step)))))
    # One row per range: at most n + 1.
    starts = sorted(((r["range"], r["first"]) for r in docs.groupBy("range").agg(F.min("key").alias("first")).collect()), key=lambda r: r[0])
    before = [(first, starts[i - 1][0]) for i, (_, first) in enumerate(starts)]
    home = spark.createDataFrame(before, docs.select(F.col("key").alias("first"), F.lit(0).alias("to")).schema)
    guests = docs.join(F.broadcast(home), F.col("key").eqNullSafe(F.col("first"))).groupBy("to").agg(F.min("text").alias("text"))
    rows = docs.select("key", "text", "range", F.lit(0).alias("guest")).unionByName(guests.select(F.lit(None).cast(docs.schema["key"].dataType).alias("key"), "text", F.col("to").alias("range"), F.lit(1).alias("guest")))
    rows = rows.repartition(n, "range").withColumn("kept", kept_hashes(F.col("text")))
    order = Window.partitionBy("range").orderBy("guest", F.col("key").asc_nulls_first(), "text")
    ahead = {f"next_{c}": F.lead(c).over(order) for c in ("text", "kept")}
    return rows.withColumns(ahead).filter("guest = 0").drop("guest", "range")


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the fingerprint, that of the edited text, and how like they and the next row's are.

    The edited text keeps the first half of the text (the larger one) and goes on with as much of
    the next row's text. Its fingerprint is put together: what windows inside either part kept is
    known, so only the seam is hashed anew.
    """
    rows = with_next(docs, key, text)
    n = F.char_length("text")
    rows = rows.withColumns({"n_chars": n.cast("long"), "cut": (n - F.floor(n / 2)).cast("int"), "taken": F.least(F.floor(n / 2), F.char_length("next_text")).cast("int")})
    start = F.greatest(F.col("cut") - (REACH - 1), F.lit(0))
    seam = F.concat(F.substring("text", start + 1, F.col("cut") - start), F.substring("next_text", F.lit(1), F.least(F.col("taken"), F.lit(REACH - 1))))
    whole = F.col("cut") + F.col("taken") < REACH
    joins = F.when(whole | (F.char_length(seam) >= REACH), kept_hashes(seam)).otherwise(F.array().cast("array<long>"))
    moved = lambda part, by: F.transform(part, lambda v: v - by)
    edited = F.concat(_of_prefix(F.col("kept"), F.col("cut")), moved(joins, start), moved(_of_prefix(F.col("next_kept"), F.col("taken")), F.col("cut")))
    said = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    new_text = F.concat(F.substring("text", F.lit(1), F.col("cut")), F.substring("next_text", F.lit(1), F.col("taken")))
    near = F.struct(likeness(F.col("kept"), F.col("edited")).alias("near_edited"), likeness(F.col("kept"), F.col("next_kept")).alias("near_next"))
    return (
        rows.withColumn("edited", F.array_distinct(edited))
        .withColumn("near", near)
        .select(
            F.col("key").alias(key), "n_chars", F.sha2(new_text.cast("binary"), 256).alias("edited_sha256"),
            said(F.col("kept")).alias("fingerprint"), said(F.col("edited")).alias("edited_fingerprint"), "near.near_edited", "near.near_next",
        )
    )


def op7(docs: DataFrame) -> DataFrame:
    return fingerprint(docs)
