"""Words of running text without blanks: the best path through a lattice of dictionary words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from panelweave.functions.text import CJK

#: Weights are whole millionths of a natural logarithm, so sums and ties are exact.
UNIT = 1_000_000


def pieces_of(text: Column, letters: str = CJK) -> Column:
    """Lowercase pieces: runs of ``letters``, runs of other letters, and numbers with the other letters after them."""
    other = rf"[\p{{L}}&&[^{letters}]]"
    return F.regexp_extract_all(F.lower(text), F.lit(rf"\d+{other}*|{other}+|[{letters}]+"), F.lit(0))


def word_list(names: DataFrame, col: str = "name", letters: str = CJK) -> DataFrame:
    """``(word, n)``: the runs of ``letters`` in a catalog's names, counted."""
    runs = names.select(F.explode(pieces_of(F.col(col), letters)).alias("word")).filter(F.col("word").rlike(f"^[{letters}]+$"))
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_path(run: str, at: list[int], length: list[int], weight: list[int], unknown: int) -> list[str]:
    """Words of ``run`` along the path with the greatest sum of weights, from the words found at places from 1.

    A letter that is no word itself may stand alone with the ``unknown`` weight. Of equal paths the one with the
    longest first word is taken, and so on word by word.
    """
    ends: list[dict[int, int]] = [{} for _ in run]
    for a, n, w in zip(at, length, weight):
        ends[a - 1][n] = w
    best, step = [0] * (len(run) + 1), [1] * len(run)
    for i in range(len(run) - 1, -1, -1):
        found = ends[i] if 1 in ends[i] else {**ends[i], 1: unknown}
        best[i], step[i] = max((w + best[i + n], n) for n, w in found.items())
    out, i = [], 0
    while i < len(run):
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


@F.pandas_udf(ArrayType(StringType()))
def _best_paths(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for columns in parts:
        yield pd.Series([best_path(run, at, n, w, int(u)) for run, at, n, w, u in zip(*columns)])


def segment(texts: DataFrame, words: DataFrame, key: str = "doc_id", letters: str = CJK) -> DataFrame:
    """``(key, tokens)`` of ``texts(key, text)``: pieces in their order, runs of ``letters`` cut into words.

    ``words(word, n)`` may be of any size. A run is cut where the product of its words' shares of all ``n``
    is greatest; a letter that is no word counts as one seen once. ``best_path`` names the ties. Each distinct run is cut
    once. Its places offer substrings of the lengths that words have, and these meet the words in a join.
    ``key`` is unique; NULL and empty texts have no tokens; NULL, empty and repeated words are left out or summed.
    """
    known = words.filter("word <> '' and n > 0").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    shape = known.agg(F.coalesce(F.ln(F.sum("n")), F.lit(0.0)).alias("all"), F.array_sort(F.collect_set(F.length("word"))).alias("lengths"))
    share = lambda n: F.round((F.ln(n) - shape.select("all").scalar()) * UNIT).cast("long")
    known = known.select("word", share(F.col("n")).alias("_w"))

    pieces = texts.select(key, F.posexplode_outer(pieces_of(F.col("text"), letters)).alias("_at", "_piece"))
    runs = pieces.filter(F.col("_piece").rlike(f"^[{letters}]{{2,}}$")).select("_piece").distinct()
    places = runs.select("_piece", F.explode(F.sequence(F.lit(1), F.length("_piece"))).alias("_s")).withColumn("_all", shape.select("lengths").scalar())
    fit = F.filter("_all", lambda n: n <= F.length("_piece") - F.col("_s") + 1)
    offered = places.select("_piece", "_s", F.explode(fit).alias("_n")).withColumn("word", F.substring(F.col("_piece"), F.col("_s"), F.col("_n")))
    lattice = offered.join(known, "word").groupBy("_piece").agg(F.collect_list(F.struct("_s", "_n", "_w")).alias("_e"))
    # A run without any word is single letters.
    edges = [F.col("_e._s"), F.col("_e._n"), F.col("_e._w")]
    cut = lattice.select("_piece", _best_paths("_piece", *edges, share(F.lit(1))).alias("_words"))
    letters_of = F.filter(F.split("_piece", ""), lambda c: c != "")
    is_run = F.col("_piece").rlike(f"^[{letters}]+$")
    parts = F.coalesce("_words", F.when(is_run, letters_of).otherwise(F.array("_piece")))
    held = pieces.join(cut, "_piece", "left").select(key, F.when(F.col("_piece").isNotNull(), F.struct("_at", parts.alias("_t"))).alias("_p"))
    return held.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["_t"])).alias("tokens"))
