"""BPE encoding and decoding by batched numpy merge rounds.

The vocabulary file (of the tokenizers library's JSON kind, BPE with word ends) is a parameter. A
batch of texts is cut into words; words that the task has not met yet go through the merge rounds
together: their symbols lie in one flat array, each round looks all neighbouring pairs up by binary
search among the sorted pair keys, and merges each word's lowest-ranked pair wherever it stands.
Learned merges rank a pair after the pairs that made its parts, so that merging all places of one
pair at once gives what merging place by place gives; ``Tables`` refuses a file where this fails.

Defined cases: a null text is an empty one and has no tokens; rows are encoded each for itself,
other columns pass through, and a column of the result's name is replaced.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that a task keeps encoded; beyond it the memory starts anew.
KEPT_WORDS = 200_000
#: Code points that are cut into words at a time.
CHUNK_CHARS = 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from 256."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class Tables:
    """What encoding needs of a vocabulary file; a few MB, as large as the vocabulary."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        made = np.full(self.size, -1)
        made[into[::-1]] = np.arange(len(into))[::-1]
        if (np.maximum(made[left], made[right]) >= np.arange(len(into))).any():
            raise ValueError("a merge stands before one that makes its parts")
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], order, into[order]
        # Fixed pattern of the vocabulary file's word split.
        self.words = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]


def merged(words: list[str], t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and the number of each word's."""
    raw = [w.encode() for w in words]
    counts = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8)
    last = np.cumsum(counts) - 1
    syms = t.inner[flat]
    syms[last] = t.final[flat[last]]
    word = np.repeat(np.arange(len(raw)), counts)
    done_words, done_syms = [], []
    never = len(t.keys)
    while len(syms):
        key = syms[:-1] * t.size + syms[1:]
        at = np.minimum(np.searchsorted(t.keys, key), never - 1)
        rank = np.append(np.where((t.keys[at] == key) & (word[:-1] == word[1:]), t.ranks[at], never), never)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        size = np.diff(first, append=len(syms))
        best = np.repeat(np.minimum.reduceat(rank, first), size)
        over = best == never
        if over.any():  # words without a pair are finished
            done_words.append(word[over])
            done_syms.append(syms[over])
        place = np.flatnonzero((rank == best) & ~over)
        if len(place):
            # In a run of equal symbols every second pair is merged, from the left.
            start = np.flatnonzero(np.diff(place, prepend=-2) != 1)
            step = np.arange(len(place)) - np.repeat(start, np.diff(start, append=len(place)))
            place = place[step % 2 == 0]
            syms[place] = t.into[at[place]]
            stay = ~over
            stay[place + 1] = False
            syms, word = syms[stay], word[stay]
        else:
            break
    where = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
    ids = np.concatenate(done_syms) if done_syms else np.zeros(0, np.int64)
    return ids[np.argsort(where, kind="stable")], np.bincount(where, minlength=len(raw))


class Encoder:
    """Encodes texts; remembers the words that it has met, up to KEPT_WORDS."""

    def __init__(self, t: Tables):
        import regex

        self.t = t
        self.split = regex.compile(t.words).findall
        self.cut = regex.compile("|".join(sorted(map(regex.escape, t.special), key=len, reverse=True))).split if t.special else None
        self.marks = regex.compile("|".join(sorted(map(regex.escape, t.special), key=len, reverse=True))).findall if t.special else None
        self.forget()

    def forget(self) -> None:
        self.slots = {s: i for i, s in enumerate(self.t.special)}
        self.ids = np.array([*self.t.special.values()], np.int64)
        self.count = np.ones(len(self.slots), np.int64)
        self.start = np.arange(len(self.slots), dtype=np.int64)

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            # Letters are lowered one by one: a sigma at a word's end is no case of its own.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.split(text.lower())

    def words(self, text: str) -> list[str]:
        """The words of a text; strings of special tokens stand for themselves, before any other rule."""
        if not self.cut or "<|" not in text and not any(s in text for s in self.t.special):
            return self.plain(text)
        parts, marks = self.cut(text), self.marks(text)
        out = self.plain(parts[0])
        for mark, part in zip(marks, parts[1:], strict=True):
            out.append(mark)
            out += self.plain(part)
        return out

    def learn(self, new: list[str]) -> None:
        ids, count = merged(new, self.t)
        start = len(self.ids) + np.cumsum(count) - count
        self.slots.update(zip(new, range(len(self.slots), len(self.slots) + len(new)), strict=True))
        self.ids, self.count, self.start = (np.concatenate(x) for x in ((self.ids, ids), (self.count, count), (self.start, start)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of each text's."""
        cut = [self.words(x) if x else [] for x in texts]
        if len(self.slots) > KEPT_WORDS:
            self.forget()
        new = {w for ws in cut for w in ws if w not in self.slots}
        if new:
            self.learn(sorted(new))
        slot = np.fromiter((s for ws in cut for s in map(self.slots.__getitem__, ws)), np.int64, sum(map(len, cut)))
        count = self.count[slot]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.start[slot] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.concatenate(([0], ends))[np.cumsum([0, *map(len, cut)])]
        return ids, np.diff(upto)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = n = 0
    for i, x in enumerate(texts):
        n += len(x or "")
        if n >= CHUNK_CHARS:
            yield a, i + 1
            a, n = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array, names: list[str]) -> pa.RecordBatch:
    have = dict(zip(batch.schema.names, batch.columns, strict=True)) | {name: column}
    return pa.RecordBatch.from_arrays([have[n] for n in names], names=names)


def tables(path: str) -> Tables:
    with open(path, encoding="utf-8") as f:
        return Tables(json.load(f))


def encode(docs: DataFrame, path: str, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """``docs`` with the token ids of ``text`` as an array of ints."""
    shared = docs.sparkSession.sparkContext.broadcast(tables(path))  # as large as the vocabulary file
    schema = T.StructType([f for f in docs.schema.fields if f.name != tokens] + [T.StructField(tokens, T.ArrayType(T.IntegerType()))])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for a, b in _chunks(texts.to_pylist()):
                ids, count = enc.encode(texts.slice(a, b - a).to_pylist())
                offsets = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
                yield _with(batch.slice(a, b - a), tokens, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), names)

    return docs.mapInArrow(run, schema)


def joined(ids: pa.ListArray, strings: pa.Array) -> pa.Array:
    """For each list of numbers, their ``strings`` with a space between; empty for null."""
    count = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, strings.take(ids.flatten())), pa.scalar(" ", strings.type)).cast(pa.string())


def decode(docs: DataFrame, path: str, tokens: str = "tokens", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids in ``tokens``: the vocabulary's strings with a space between.

    The file names no decoder; word ends stay as they are written in it. Null ids give an empty text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tables(path).tokens)
    schema = T.StructType([f for f in docs.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.array(shared.value, pa.large_string())
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(tokens))
            for a in range(0, batch.num_rows, 256):
                yield _with(batch.slice(a, 256), text, joined(column.slice(a, 256), strings), names)

    return docs.mapInArrow(run, schema)


def op4(docs: DataFrame, path: str) -> DataFrame:
    """Counts and digests of both ways, over whole texts."""
    coded = encode(docs.select("doc_id", "text"), path).drop("text")
    said = F.array_join(F.transform("tokens", lambda x: x.cast("string")), " ")
    coded = coded.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(said.cast("binary"), 256).alias("ids_sha256"), "tokens")
    return decode(coded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
