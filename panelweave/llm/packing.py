"""Best-fit packing of documents into sequences of several permitted lengths.

Lengths are packed in decreasing order, each into the open bin with the least room that takes it.
Where none does, a bin is opened, of the size that costs least for what it holds; at the end each
bin shrinks to the least costly permitted size that holds its contents. The permitted sizes are
weighed jointly: each shard is packed once per size that a bin may be opened with at first (a
longer piece opens the next size that holds it) and keeps the cheapest outcome.

Pieces are dealt to shards of about SHARD_PIECES pieces by their number, so shards are of one size
whatever the ids or sources look like, and no task sees more than a few shards. A shard's open bins
are all that sharding can waste: less than one bin per permitted size.

Defined cases: a document longer than the largest size is cut into pieces of that size and a rest,
in order; nothing is dropped. A document without words (null or empty) has one row with piece 0,
no words and null bin and capacity. Repeated rows and null ids are packed each for itself. Rows of
one length are taken by a hash of the id, then by number. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import WORD, numbered

SIZES = (512, 1024, 2048, 4096, 8192)
SHARD_PIECES = 2048


def default_cost(size: int) -> float:
    """Work of a sequence: a fixed part, a part by token, and attention by token pair."""
    return 256 + size + size * size / 16384


class _Bins:
    """Open bins by room left; the least sufficient room is found among the bits of one number."""

    def __init__(self):
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0

    def add(self, bin_: int, room: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(bin_)
            self.rooms |= 1 << room

    def take(self, need: int) -> tuple[int, int] | None:
        found = self.rooms >> need
        if not found:
            return None
        room = need + (found & -found).bit_length() - 1
        bins = self.by_room[room]
        out = bins.pop()
        if not bins:
            self.rooms ^= 1 << room
        return out, room


def pack_once(lengths: Sequence[int], sizes: Sequence[int], costs: Sequence[float], first: int) -> tuple[list[int], list[int], float]:
    """Bin of each length (given in decreasing order), size of each bin, and the cost of all.

    A bin is opened with size ``first``, or the least costly per token of those that hold the length.
    """
    rate = sorted(sizes, key=lambda s: (costs[sizes.index(s)] / s, -s))
    open_, used, where = _Bins(), [], []
    for n in lengths:
        got = open_.take(n)
        if got:
            b, room = got
        else:
            b, room = len(used), first if n <= first else next(s for s in rate if s >= n)
            used.append(0)
        used[b] += n
        where.append(b)
        open_.add(b, room - n)
    least = sorted(range(len(sizes)), key=lambda k: (costs[k], sizes[k]))
    final = [next(k for k in least if sizes[k] >= u) for u in used]
    return where, [sizes[k] for k in final], sum(costs[k] for k in final)


def pack_shard(lengths: Sequence[int], sizes: Sequence[int], costs: Sequence[float]) -> tuple[list[int], list[int]]:
    """The cheapest of the packings that open bins with each of the sizes; ties go to the smaller one."""
    best = min((pack_once(lengths, sizes, costs, s) for s in sizes), key=lambda p: p[2])
    return best[0], best[1]


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)).cast("long")


def pack(docs: DataFrame, length: Column, key: str = "doc_id", sizes: Sequence[int] = SIZES, costs: Sequence[float] | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: ``key``, piece, start and n_tokens in the document, bin, offset and capacity.

    Only keys and lengths move; they are written once, so that a lost task is done again alike.
    """
    sizes = sorted(set(sizes))
    costs = [float(c) for c in costs] if costs is not None else [default_cost(s) for s in sizes]
    top = sizes[-1]
    rows = numbered(docs.select(F.col(key).alias("key"), F.coalesce(length, F.lit(0)).cast("long").alias("total")), "row")
    last = F.greatest(F.ceil(F.col("total") / top) - 1, F.lit(0))
    pieces = rows.select("row", "key", "total", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    start = F.col("piece") * top
    pieces = pieces.select("row", "key", "piece", start.alias("start"), F.least(F.col("total") - start, F.lit(top)).alias("n_tokens"))
    # A count and a sum over the written rows: how many shards there are.
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("total") / top)).alias("full")).first()
    shards = max(1, -(-(n["n"] + int(n["full"] or 0)) // shard_pieces))
    todo = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    schema = "row long, piece long, bin string, offset long, capacity long"

    def shard(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "key", "row", "piece"], ascending=[False, True, True, True], kind="stable")
        lengths = frame["n_tokens"].to_numpy()
        where, size = (np.array(x, np.int64) for x in pack_shard(lengths.tolist(), sizes, costs))
        offset = pd.Series(lengths).groupby(where).cumsum().to_numpy() - lengths
        name = f"{frame['shard'].iloc[0]}-"
        return pd.DataFrame({"row": frame["row"].to_numpy(), "piece": frame["piece"].to_numpy(), "bin": [name + str(b) for b in where], "offset": offset, "capacity": size[where]})

    slim = todo.filter("n_tokens > 0").select("shard", "row", "piece", "n_tokens", F.xxhash64("key").alias("key"))
    placed = slim.groupBy("shard").applyInPandas(shard, schema)
    out = pieces.join(placed, ["row", "piece"], "left")
    return out.select(F.col("key").alias(key), "piece", "start", "n_tokens", "bin", "offset", "capacity")


def op1(docs: DataFrame) -> DataFrame:
    """Packs by words, the unit that needs no vocabulary; give ``pack`` token counts where there are some."""
    return pack(docs, word_count(F.col("text")))
