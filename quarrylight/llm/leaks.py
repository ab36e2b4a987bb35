"""Evaluation texts in the corpus: template windows, hash-joined, with a check of their slots.

A word is made canonical first: numbers, units and given names become typed placeholders. Windows
of ``RUN`` canonical words of the items (all words of a shorter item) are looked up in every
document; wherever a window meets, the words themselves are compared. Equal words are a leak; words
that differ in placeholders only are a *re-parameterised* item, if over all windows of a place where
the item stands each slot value of the item stands for one value of the document, and each value of
the document for one of the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import vectors
from quarrylight.storage import cut

RUN = 12
#: Items of up to this many words in all are sent to every task (16 bytes a word, 64 MB); of more, a filter of their windows is (128 MB at most), and what passes it is joined by a shuffle.
SENT_WORDS = 4_000_000
#: Given names a list may have.
MOST_NAMES = 200_000
#: Words that are units, and numbers written out (fixed values).
UNITS = ("second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
         "euro", "euros", "dollar", "dollars", "pound", "pounds", "cent", "cents", "percent", "px", "ms", "km", "cm", "mm", "kg", "mb", "gb")
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty",
           "forty", "fifty", "sixty", "hundred", "thousand", "million")
_SLOT = {kind: np.uint64(xxhash.xxh3_64_intdigest(f"<{kind}>")) for kind in ("number", "unit", "name")}


def _typed(word: str, names: frozenset[str]) -> np.uint64 | None:
    if word.isnumeric() or (word[0].isdigit() and word[-1].isdigit()):
        return _SLOT["number"]
    if word in NUMBERS:
        return _SLOT["number"]
    if word in UNITS:
        return _SLOT["unit"]
    return _SLOT["name"] if word in names else None


def _coded(texts: pa.Array, names: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, canonical word hashes, offsets."""
    values, offsets = vectors.split_words(texts)
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), offsets
    coded = values.dictionary_encode()
    known = coded.dictionary.to_pylist()
    exact = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in known], np.uint64)
    canonical = exact.copy()
    for i, w in enumerate(known):
        if (slot := _typed(w, names)) is not None:
            canonical[i] = slot
    at = coded.indices.to_numpy()
    return exact[at], canonical[at], offsets


class Items:
    """The items' words, and their windows sorted by hash, by window length."""

    def __init__(self, ids: list[int], texts: list[str], names: frozenset[str]):
        self.ids, self.names = np.array(ids, np.int64), names
        self.exact, canonical, self.offsets = _coded(vectors.plain(pa.array(texts, pa.string())), names)
        lengths = np.diff(self.offsets)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(RUN, n) for n in lengths.tolist() if n}):
            own = lengths >= RUN if size == RUN else lengths == size
            h, at = vectors.windows(canonical, self.offsets, size)
            item = np.repeat(np.arange(len(lengths)), np.diff(at))
            position = np.arange(len(h)) - at[item] + self.offsets[item] if len(h) else item
            keep = own[item] if len(h) else np.zeros(0, bool)
            order = np.argsort(h[keep], kind="stable")
            self.tables[size] = h[keep][order], item[keep][order], position[keep][order]


def _pairs(found: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into found, into sorted keys) of all equal pairs."""
    lo, hi = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
    hit = np.flatnonzero(hi > lo)
    counts = (hi - lo)[hit]
    left = np.repeat(hit, counts)
    right = np.repeat(lo[hit] - np.r_[0, np.cumsum(counts)][:-1], counts) + np.arange(counts.sum()) if len(hit) else hit
    return left, right


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("exact", pa.bool_()), ("windows", pa.int64()), ("changed", pa.int64())])


def _one_to_one(own: np.ndarray, theirs: np.ndarray) -> bool:
    """Whether each value of ``own`` stands for one of ``theirs``, and each of those for one of ``own``."""
    pairs = np.unique(np.stack([own, theirs], 1), axis=0)
    return len(pairs) == len(np.unique(pairs[:, 0])) == len(np.unique(pairs[:, 1]))


def _judged(doc: np.ndarray, item: np.ndarray, begin: np.ndarray, place: np.ndarray, own: np.ndarray, theirs: np.ndarray) -> pa.RecordBatch:
    """Verdicts on windows that meet: of document ``doc`` from ``begin`` on (words ``theirs``), of item ``item`` from ``place`` on (words ``own``).

    Windows of a document and item at one distance from each other are one place where the item
    stands. Where its slots are not one to one over all of them, only unchanged windows count.
    """
    changed = (own != theirs).sum(1)
    fine = changed == 0
    if not fine.all():
        order = np.lexsort((begin, begin - place, item, doc))
        d, i, g = doc[order], item[order], (begin - place)[order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (g[1:] != g[:-1])])
        last = np.r_[first[1:], len(order)]
        odd = np.add.reduceat(~fine[order], first) > 0
        for x, y in zip(first[odd].tolist(), last[odd].tolist()):
            rows = order[x:y]
            if _one_to_one(own[rows].ravel(), theirs[rows].ravel()):
                fine[rows] = True
    doc, item, changed = doc[fine], item[fine], changed[fine]
    order = np.lexsort((item, doc))
    doc, item, changed = doc[order], item[order], changed[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]) if len(doc) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(doc)])
    cols = [doc[first], item[first], np.minimum.reduceat(changed, first) == 0 if len(first) else np.zeros(0, bool), count, np.maximum.reduceat(changed, first) if len(first) else count]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)


def _match(ids: np.ndarray, texts: pa.Array, items: Items) -> Iterator[pa.RecordBatch]:
    exact, canonical, offsets = _coded(texts, items.names)
    for size, (keys, item, position) in items.tables.items():
        h, at = vectors.windows(canonical, offsets, size)
        if not len(h) or not len(keys):
            continue
        left, right = _pairs(h, keys)
        if len(left):
            doc = np.searchsorted(at, left, "right") - 1
            begin, place = left - at[doc] + offsets[doc], position[right]
            span = np.arange(size)
            yield _judged(ids[doc], items.ids[item[right]], begin, place - items.offsets[item[right]], items.exact[place[:, None] + span], exact[begin[:, None] + span])


def _names(names: DataFrame | None) -> frozenset[str]:
    """Given names, lower case; at most MOST_NAMES are taken to the tasks (more is an error)."""
    if names is None:
        return frozenset()
    rows = names.limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"a list of given names has at most {MOST_NAMES:,} entries")
    return frozenset(r[0].strip().lower() for r in rows if r[0] and r[0].strip())


def leaked(documents: DataFrame, items: DataFrame, names: DataFrame | None = None, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, exact, windows, changed): which items stand in which documents.

    ``exact``: a run of RUN words of the item (all of a shorter item) stands in the document word for word;
    ``windows``: matching windows; ``changed``: most words that differ in one window (0: none).
    Each document is read once, whole, and moved nowhere. NULL or empty texts and items match
    nothing; rows repeated under one id give one row; other columns are not read.

    The items travel to the tasks while they have at most SENT_WORDS words in all, which is
    counted first. Of a larger set the tasks get a filter of its windows, and the few windows of
    documents that pass it are joined with the items' by a shuffle; the verdict is the same code.
    """
    spark = documents.sparkSession
    kept = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).distinct()
    size = kept.agg(F.sum(F.length("t"))).first()[0] or 0  # a word has a character and a separator at least
    known = _names(names)
    docs = documents.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("t"))
    if size > 2 * SENT_WORDS:
        return _by_shuffle(docs, kept, known, size // 2)
    rows = kept.orderBy("i").collect()
    sent = spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows], known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _match(b.column(0).to_numpy(), vectors.plain(b.column(1)), sent.value)

    out = docs.mapInArrow(run, "doc_id long, item_id long, exact boolean, windows long, changed long")
    return out.groupBy("doc_id", "item_id").agg(F.bool_or("exact").alias("exact"), F.max("windows").alias("windows"), F.max("changed").alias("changed"))


_WINDOW = "id long, size int, key long, begin int, words array<long>"


def _windows_of(df: DataFrame, names: frozenset[str], sizes: list[int], bits: np.ndarray | None = None) -> DataFrame:
    """(id, size, key, begin, words): the windows an item is found by; with a filter, those windows of documents whose key may be in it."""
    sent = df.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            exact, canonical, offsets = _coded(vectors.plain(b.column(1)), names)
            lengths = np.diff(offsets)
            for size in sizes:
                h, at = vectors.windows(canonical, offsets, size)
                if sent is None:
                    own = np.repeat(np.arange(len(ids)), np.diff(at))
                    keep = np.flatnonzero(lengths[own] >= RUN if size == RUN else lengths[own] == size)
                else:
                    keep = np.flatnonzero(vectors.maybe_in(h ^ np.uint64(size), sent.value))
                doc = np.searchsorted(at, keep, "right") - 1
                begin = keep - at[doc]
                for s in range(0, len(keep), 50_000):
                    k, d, g = keep[s:s + 50_000], doc[s:s + 50_000], begin[s:s + 50_000]
                    values = exact[(g + offsets[d])[:, None] + np.arange(size)].view(np.int64).ravel()
                    words = pa.ListArray.from_arrays(pa.array(np.arange(0, len(k) * size + 1, size), pa.int32()), pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(np.full(len(k), size, np.int32)), pa.array((h[k] ^ np.uint64(size)).view(np.int64)), pa.array(g.astype(np.int32)), words],
                                                     names=["id", "size", "key", "begin", "words"])

    return df.toDF("id", "t").mapInArrow(run, _WINDOW)


def _by_shuffle(docs: DataFrame, items: DataFrame, names: frozenset[str], words: int) -> DataFrame:
    """The same for items of any number. Only windows that pass the filter leave the tasks; a window many items share, or many documents have, is split by AQE like any skewed key."""
    of_items = cut(_windows_of(items, names, list(range(1, RUN + 1))), "leak-items")
    sizes = sorted(r[0] for r in of_items.select("size").distinct().collect())  # RUN at most
    bits = vectors.bloom(of_items.select("key"), vectors.sized(words * 8, vectors.LEAST_BITS, vectors.MOST_BITS))
    found = _windows_of(docs.toDF("id", "t"), names, sizes, bits).withColumnsRenamed({"id": "doc", "begin": "at"})
    met = found.join(of_items.select("size", "key", F.col("id").alias("item"), F.col("begin").alias("place"), F.col("words").alias("own")), ["size", "key"])

    def judge(t: pa.Table) -> pa.Table:
        out = []
        for size in sizes:
            part = t.filter(pc.equal(t.column("size"), size))
            if part.num_rows:
                doc, item, at, place = (part.column(c).to_numpy().astype(np.int64) for c in ("doc", "item", "at", "place"))
                own, theirs = (part.column(c).combine_chunks().flatten().to_numpy().reshape(-1, size) for c in ("own", "words"))
                out.append(_judged(doc, item, at, place, own, theirs))
        return pa.Table.from_batches(out, schema=_OUT)

    # documents by part, each whole in one; a part is about as large as the windows of SENT_WORDS / RUN words
    parts = met.sparkSession.sparkContext.defaultParallelism * 16
    got = met.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(parts))).groupBy("part").applyInArrow(judge, "doc_id long, item_id long, exact boolean, windows long, changed long")
    return got.groupBy("doc_id", "item_id").agg(F.bool_or("exact").alias("exact"), F.max("windows").alias("windows"), F.max("changed").alias("changed"))
