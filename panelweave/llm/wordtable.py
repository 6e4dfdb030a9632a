"""Words of many texts at once, as numbers into a table of distinct ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from panelweave.llm.shingles import mixed

CHUNK = 1_500_000
SAME = np.arange(256, dtype=np.uint8)
_LOW = SAME.copy()
_LOW[0x41:0x5B] += 32
LONG_WORD = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: By a number of bytes: the mask of so many in eight.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def kinds(between_words: bytes, between_pieces: bytes = b"") -> np.ndarray:
    """A table of bytes: 0 in a word, 1 between words, 2 between pieces."""
    table = np.zeros(256, np.uint8)
    table[[*between_words]] = 1
    table[[*between_pieces]] = 2
    return table


def word_spans(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts and which of them are in words; each word's start and end there, its piece and its row."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    begin = off[:-1] - off[0]
    kind = table[raw]
    word = kind == 0
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = begin[(begin > 0) & (begin < len(raw))]
    first[edge] |= word[edge]
    last[edge - 1] |= word[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.repeat(np.arange(len(begin)), np.diff(np.searchsorted(start, begin), append=len(start)))
    piece = np.cumsum(kind == 2, dtype=np.int64)[start] + row  # grows with either
    return raw, word, start, end, piece, row


def split_words(texts: pa.Array, table: np.ndarray, letters: np.ndarray = _LOW) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of texts with A-Z lower-cased (or as ``letters`` turns each byte): each word's number among the distinct ones, those, its piece and its row."""
    raw, word, start, end, piece, row = word_spans(texts, table)
    offsets = np.concatenate(([0], np.cumsum(end - start, dtype=np.int64)))
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters[raw[word]])]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, piece, row


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: of their bytes, eight at a time, and their sizes. Words over LONG_WORD bytes are hashed one by one."""
    size = end - start
    eights = np.ndarray(len(raw) + 1, "<u8", np.concatenate((raw, np.zeros(8, np.uint8))), strides=(1,))
    out = mixed((eights[start] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD)
    done, more = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
    while len(more):
        part = eights[start[more] + done] & _MASKS[np.minimum(size[more] - done, 8)]
        out[more] = mixed(out[more] * _ODD + part)
        done += 8
        more = more[size[more] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes())
    return out


def chunks(batch: pa.RecordBatch, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text each (a longer text is one of its own)."""
    total = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + size, "right")))
        yield batch.slice(a, b - a)
        a = b
