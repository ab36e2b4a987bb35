"""Words of Arrow batches as arrays of hashes: no loop over rows or words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from quarrylight.functions.words import NOT_WORD

#: Bits of a Bloom filter: least and most (2 to 128 MB), and the pieces it is put together from.
LEAST_BITS, MOST_BITS, CHUNKS = 1 << 24, 1 << 30, 32

#: Odd multipliers of the rolling hashes (fixed values: golden-ratio fractions).
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def finish(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit sums (a bijection)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array, NULL as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and for each text where its words begin (one more at the end)."""
    body = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), NOT_WORD, " "), " ")
    lists = pc.split_pattern(body, " ")
    values, offsets = lists.values, lists.offsets.to_numpy()
    empty = pc.equal(values, "").to_numpy(zero_copy_only=False)
    if empty.any():  # a text without words gives one empty string
        offsets = offsets - np.r_[0, np.cumsum(empty)][offsets]
        values = values.filter(pa.array(~empty))
    return values, offsets.astype(np.int64)


def word_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hash of each word; each distinct word is hashed once."""
    if not len(values):
        return np.zeros(0, np.uint64)
    coded = values.dictionary_encode()
    codes = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()], np.uint64)
    return codes[coded.indices.to_numpy()]


def windows(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words within a text, and the offsets of the texts' runs."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    out = np.r_[0, np.cumsum(counts)]
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    start = np.repeat(offsets[:-1] - out[:-1], counts) + np.arange(out[-1])
    h = np.zeros(out[-1], np.uint64)
    for k in range(size):
        h = h * _MIX[0] + (words[start + k] ^ _MIX[k % 5])
        h ^= h >> np.uint64(29)
    return finish(h), out


def sized(n: int, least: int, most: int) -> int:
    """A power of two near ``n`` within bounds."""
    return max(least, min(most, 1 << max(n, 1).bit_length()))


def _places(keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for k in range(3):
        yield (finish(keys + np.uint64(k * 77 + 1)) % np.uint64(size)).astype(np.int64)


def bloom(keys: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of ``size`` bits of all longs in ``keys``, as bytes; pieces are put together by tasks, and its size is all the driver sees."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, some = np.zeros(size, bool), False
        for b in batches:
            for c in b.columns:
                for x in _places(c.to_numpy().view(np.uint64), size):
                    bits[x] = some = True
        if some:
            packed = np.packbits(bits, bitorder="little").reshape(CHUNKS, -1)
            for c in range(CHUNKS):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([packed[c].tobytes()], pa.binary())], names=["chunk", "n"])

    def join(table: pa.Table) -> pa.Table:
        out = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("n")])
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "n": pa.array([out.tobytes()], pa.binary())})

    got = {r.chunk: r.n for r in keys.mapInArrow(fill, "chunk int, n binary").groupBy("chunk").applyInArrow(join, "chunk int, n binary").collect()}
    return np.concatenate([np.frombuffer(got[c], np.uint8) if c in got else np.zeros(size // 8 // CHUNKS, np.uint8) for c in range(CHUNKS)])


def maybe_in(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each key may be in a filter; a key that is in it always may."""
    hit = np.ones(len(keys), bool)
    for x in _places(keys, len(bits) * 8):
        hit &= (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1
    return hit
