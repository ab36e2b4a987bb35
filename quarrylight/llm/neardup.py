"""Near-duplicate texts: an exact set-similarity join that skips by relations between sets.

A text is the set of its distinct word runs (*tokens*); texts are compared within a kind only. Two
sets of Jaccard similarity t or more share a token among their first ``n - ceil(t n) + 1`` tokens in
any common order; the order here is rarest first, by a count sketch of fixed size over all texts.

* Index lists hold a set's size and the token's position in it. They are sorted by both and cut in
  blocks; a pair of blocks whose sizes or positions rule out the overlap needed is skipped whole.
* Pairs met are held against 256 marks of each set, parities of its tokens, before any token moves:
  two sets differ in at least as many tokens as marks, and that bounds their overlap.
* Answers are derived, not computed again, for sets related to one whose answers are known. Equal
  sets have one entry, one verification and one set of answers. Candidate pairs of related sets
  are verified together; the first set of such a group, the leader, is compared with each other
  one, and what is known of x and the leader and of y and the leader bounds the overlap of x and y:
  most pairs are settled by that alone, and the others by correcting the leader's overlap with y
  by the tokens in which x differs from the leader, which are worked out once for all y.

Texts are tokenised once; what follows reads their token sets from shared storage. Nothing is
dropped: a token's list that is too long for a task is cut in parts, and every pair of parts is one
list; a leader with too many pairs has several groups. No list, link, class or fingerprint reaches
the driver; a sketch of counts and a filter of names do, and both have a greatest size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm import vectors
from quarrylight.storage import cut

#: Counters of the sketch: least and most (8 to 128 MB), sized to the input in between, and the pieces it is summed in.
SLOTS, MOST_SLOTS, CHUNKS = 1 << 21, 1 << 25, 32
#: Candidate pairs verified in one step, and pairs a leader may have before it gets several groups.
GROUP = 60_000
#: Entries of a block, entries a list may hold before it is cut in parts, entries planned for a bucket.
BLOCK, LONG_LIST, BUCKET = 64, 1 << 15, 400_000
#: Pairs looked at in one step.
STEP = 2_000_000
#: Greatest count a counter holds.
MOST = (1 << 32) - 1

_POSTING = np.dtype([("token", "<u4"), ("set", "<u8"), ("size", "<u4"), ("at", "<u4")])
#: Columns of a set's marks, 64 in each.
_MARKS = ("marks_0", "marks_1", "marks_2", "marks_3")


#: Bits of a token: 48 of its hash. Two different tokens of a pair of sets of n tokens each are taken for one with a chance of n^2 / 2^48.
_KEPT = np.uint64(0xFFFFFFFFFFFF0000)


def _packed(tokens: np.ndarray) -> bytes:
    """Six bytes a token."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpacked(raw) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _by_field(rows: np.ndarray) -> bytes:
    """Entries field after field: sizes and positions, mostly small, then compress."""
    return b"".join(rows[f].tobytes() for f in _POSTING.names)


def _entries(raw) -> np.ndarray:
    n, at = len(raw) // _POSTING.itemsize, 0
    out = np.empty(n, _POSTING)
    for f in _POSTING.names:
        out[f] = np.frombuffer(raw, _POSTING[f], n, at)
        at += n * _POSTING[f].itemsize
    return out


class Sets:
    """Token sets of a batch: texts with at least ``least`` words and a kind."""

    def __init__(self, ids, kinds, texts, run: int, least: int):
        words, offsets = vectors.split_words(vectors.plain(texts))
        h, at = vectors.windows(vectors.word_hashes(words), offsets, run)
        kinds = kinds.to_pylist()
        salt = {k: xxhash.xxh3_64_intdigest("\0" if k is None else k) for k in set(kinds)}
        salts = np.array([salt[k] for k in kinds], np.uint64)
        fine = (np.diff(offsets) >= max(least, run)) & np.array([k is not None for k in kinds], bool)
        owner = np.repeat(np.arange(len(kinds)), np.diff(at))
        h = vectors.finish(h ^ salts[owner]) & _KEPT
        keep = fine[owner]
        h, owner = h[keep], owner[keep]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
        self.tokens, owner = h[new], owner[new]
        self.rows = np.flatnonzero(fine)
        self.begin = np.searchsorted(owner, self.rows)
        self.size = np.searchsorted(owner, self.rows, "right") - self.begin
        self.owner = np.repeat(np.arange(len(self.rows)), self.size)
        self.ids = ids.to_numpy()[self.rows]
        with np.errstate(over="ignore"):
            total = np.add.reduceat(vectors.finish(self.tokens + np.uint64(1)), self.begin) if len(self.rows) else np.zeros(0, np.uint64)
        #: identity of the set, kind included: equal sets have equal names
        self.name = vectors.finish(total ^ self.size.astype(np.uint64))

    @classmethod
    def stored(cls, names: pa.Array, tokens: pa.Array) -> Sets:
        """From rows of the table of sets."""
        s = cls.__new__(cls)
        s.name = names.to_numpy().view(np.uint64)
        parts = [_unpacked(t.as_buffer()) for t in tokens]
        s.size = np.array([len(x) for x in parts], np.int64)
        s.tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        s.rows = np.arange(len(parts))
        s.begin = np.cumsum(s.size) - s.size
        s.owner = np.repeat(s.rows, s.size)
        return s

    def marks(self) -> np.ndarray:
        """A row of longs for each set: the parity of its tokens by eight bits of their hash. Two sets differ in as many tokens as marks, or more."""
        out = np.zeros((len(self.rows), len(_MARKS)), np.uint64)
        if len(self.rows):
            at = self.tokens >> np.uint64(16)  # the bits below are not kept
            bit, column = np.uint64(1) << (at & np.uint64(63)), (at >> np.uint64(6)) % np.uint64(len(_MARKS))
            for k in range(len(_MARKS)):
                out[:, k] = np.bitwise_xor.reduceat(np.where(column == k, bit, np.uint64(0)), self.begin)
        return out

    def without_copies(self) -> np.ndarray:
        """Index of one of each equal sets."""
        return np.unique(self.name, return_index=True)[1]


def _slot(tokens: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    return (tokens >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of sizes a and b with similarity of ``percent`` % (in integers)."""
    return -(-(percent * (a.astype(np.int64) + b)) // (100 + percent))


class Join:
    """Parameters of a self-join on texts."""

    def __init__(self, run: int = 5, percent: int = 80, least: int = 0, number: str = "find_id", kind: str | None = "kind", text: str = "text"):
        self.run, self.percent, self.least = run, percent, max(least, run)
        self.number, self.kind, self.text = number, kind, text

    def source(self, df: DataFrame) -> DataFrame:
        kind = F.col(self.kind).cast("string") if self.kind else F.lit("")
        return (df.where(F.col(self.number).isNotNull() & F.col(self.text).isNotNull())
                .select(F.col(self.number).cast("long").alias("id"), kind.alias("kind"), F.col(self.text).alias("text")))

    def sets(self, b: pa.RecordBatch) -> Sets:
        return Sets(b.column(0), b.column(1), b.column(2), self.run, self.least)

    def table(self, source: DataFrame) -> DataFrame:
        """(id, name, tokens, size, marks) of every text that takes part, in shared storage; of the equal sets of a batch one has its tokens, size and marks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = self.sets(b)
                once = np.zeros(len(s.rows), bool)
                once[s.without_copies()] = True
                tokens = [_packed(s.tokens[i:i + n]) if o else None for i, n, o in zip(s.begin.tolist(), s.size.tolist(), once.tolist())]
                numbers = [pa.array(np.ascontiguousarray(x), pa.int64(), mask=~once) for x in (s.size, *s.marks().view(np.int64).T)]
                yield pa.RecordBatch.from_arrays([pa.array(s.ids), pa.array(s.name.view(np.int64)), pa.array(tokens, pa.binary()), *numbers], names=["id", "name", "tokens", "size", *_MARKS])

        return cut(source.mapInArrow(run, f"id long, name long, tokens binary, size long, {', '.join(f'{m} long' for m in _MARKS)}"), "neardup-sets")

    # --- the order of tokens: a count sketch ----------------------------------------------------
    def sketch(self, sets: DataFrame, rows: int) -> np.ndarray:
        own = sets.where("tokens IS NOT NULL").select("name", "tokens")
        parts = own.rdd.getNumPartitions()
        fan = max(1, parts // 256)
        size = vectors.sized(rows * 4, SLOTS, MOST_SLOTS)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = np.zeros(size, np.int64)
            for b in batches:
                s = Sets.stored(b.column(0), b.column(1))
                slots += np.bincount(_slot(s.tokens, size), minlength=size)
            small = np.minimum(slots, MOST).astype(np.uint32).reshape(CHUNKS, -1)
            group = (TaskContext.get().partitionId() % fan) * CHUNKS
            for c in range(CHUNKS):
                yield pa.RecordBatch.from_arrays([pa.array([group + c], pa.int32()), pa.array([small[c].tobytes()], pa.binary())], names=["chunk", "n"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in table.column("n"))
            return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "n": pa.array([np.minimum(total, MOST).astype(np.uint32).tobytes()], pa.binary())})

        rows = own.mapInArrow(count, "chunk int, n binary").groupBy("chunk").applyInArrow(add, "chunk int, n binary")
        if fan > 1:
            rows = rows.withColumn("chunk", F.col("chunk") % CHUNKS).groupBy("chunk").applyInArrow(add, "chunk int, n binary")
        got = {r.chunk: r.n for r in rows.collect()}  # CHUNKS rows, MOST_SLOTS counters in all at most
        return np.concatenate([np.frombuffer(got[c], np.uint32) if c in got else np.zeros(size // CHUNKS, np.uint32) for c in range(CHUNKS)])

    # --- index ----------------------------------------------------------------------------------
    def postings(self, s: Sets, counts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and entry of each prefix token of each distinct set."""
        mask = np.zeros(len(s.rows), bool)
        mask[s.without_copies()] = True
        keep = mask[s.owner]
        tokens, owner = s.tokens[keep], s.owner[keep]
        if not len(tokens):
            return np.zeros(0, np.int64), np.zeros(0, _POSTING)
        df = counts[_slot(tokens, len(counts))]
        order = np.lexsort((tokens, df, owner))
        tokens, owner, df = tokens[order], owner[order], df[order]
        begin = np.searchsorted(owner, owner)
        at, size = np.arange(len(owner)) - begin, s.size[owner]
        prefix = at <= size - -(-self.percent * size // 100)
        prefix &= df > 1  # a token that is in one set only (the sketch never counts too few)
        tokens, owner, df, at, size = tokens[prefix], owner[prefix], df[prefix], at[prefix], size[prefix]
        # what a counter holds beyond the average is the token's own: chance neighbours never cut a list
        parts = np.maximum(1, -(-(df.astype(np.int64) - int(counts.mean(dtype=np.float64))) // LONG_LIST))
        if len(parts) and parts.max() > 1:  # a long list: one entry for each pair of parts
            copies = np.arange(parts.sum()) - np.repeat(np.r_[0, np.cumsum(parts)][:-1], parts)
            tokens, owner, at, size, parts = (np.repeat(x, parts) for x in (tokens, owner, at, size, parts))
            mine = (s.name[owner] % parts.astype(np.uint64)).astype(np.int64)
            pair = np.minimum(mine, copies) * 65536 + np.maximum(mine, copies)
            tokens = np.where(parts > 1, vectors.finish(tokens + pair.astype(np.uint64)), tokens)
        out = np.empty(len(tokens), _POSTING)
        out["token"], out["set"], out["size"], out["at"] = tokens >> np.uint64(32), s.name[owner], size, at
        return ((tokens >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64), out

    def candidates(self, sets: DataFrame, counts: np.ndarray, rows: int) -> DataFrame:
        """Distinct pairs (a, b) of set names, a < b, that no filter rules out."""
        buckets = max(16, rows * 20 // BUCKET)
        sent = sets.sparkSession.sparkContext.broadcast(counts)

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, rows = self.postings(Sets.stored(b.column(0), b.column(1)), sent.value, buckets)
                order = np.argsort(at, kind="stable")
                at, rows = at[order], rows[order]
                own, begin = np.unique(at, return_index=True)
                ends = np.r_[begin[1:], len(at)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([_by_field(rows[i:j]) for i, j in zip(begin, ends)], pa.binary())], names=["bucket", "entries"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = np.concatenate([_entries(x.as_buffer()) for b in batches for x in b.column(b.schema.names.index("entries"))])
            for a, b in self.pairs(rows):  # step by step: a bucket's pairs are never held together
                a, b = a.view(np.int64), b.view(np.int64)
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                for k in range(0, len(both), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(both[k:k + (1 << 16), 0]), pa.array(both[k:k + (1 << 16), 1])], names=["a", "b"])

        met = sets.where("tokens IS NOT NULL").select("name", "tokens").mapInArrow(index, "bucket long, entries binary").groupBy("bucket").applyInArrow(meet, "a long, b long")
        return self.likely(met.distinct(), sets)

    def likely(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of ``pairs`` whose sizes and marks allow the overlap needed."""
        own = sets.where("size IS NOT NULL").groupBy("name").agg(*(F.min(c).alias(c) for c in ("size", *_MARKS)))
        for side in ("a", "b"):
            pairs = pairs.join(own.select(F.col("name").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("size", *_MARKS))), side)
        total = F.col("a_size") + F.col("b_size")
        differ = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in _MARKS), F.lit(0))
        return pairs.where(F.shiftright(total - differ, 1) * (100 + self.percent) >= total * self.percent).select("a", "b")

    def pairs(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Set names of the pairs in each list that pass the size and position bounds."""
        rows = rows[np.lexsort((rows["set"], rows["at"], rows["size"], rows["token"]))]
        if len(rows):  # equal sets come from several partitions: one entry
            same = (rows["token"][1:] == rows["token"][:-1]) & (rows["set"][1:] == rows["set"][:-1])
            rows = rows[np.r_[True, ~same]]
        if not len(rows):
            return
        token, size, at = rows["token"], rows["size"].astype(np.int64), rows["at"].astype(np.int64)
        # blocks never span two lists; each has its least and greatest size and its least position
        start = np.r_[True, token[1:] != token[:-1]]
        place = np.arange(len(rows)) - np.maximum.accumulate(np.where(start, np.arange(len(rows)), 0))
        first = np.flatnonzero(start | (place % BLOCK == 0))
        last = np.r_[first[1:], len(rows)]
        low, high, near = size[first], size[last - 1], np.minimum.reduceat(at, first)
        listed = token[first]
        end = np.searchsorted(listed, listed, "right")
        # partners of a block: itself and later ones of its list while sizes allow (sizes ascend)
        todo = end - np.arange(len(first))
        for s in _steps(todo, STEP // BLOCK):
            p = np.repeat(np.arange(*s), todo[s[0]:s[1]])
            q = p + np.arange(len(p)) - np.repeat(np.r_[0, np.cumsum(todo[s[0]:s[1]])][:-1], todo[s[0]:s[1]])
            bound = np.minimum(high[p] - near[p], high[q] - near[q])
            fine = (low[q] * self.percent <= 100 * high[p]) & (bound >= _needed(low[p], low[q], self.percent)) & ((p != q) | (last[p] - first[p] > 1))
            yield from self._inside(rows, size, at, first, last, p[fine], q[fine])

    def _inside(self, rows, size, at, first, last, p, q):
        count = (last[p] - first[p]) * (last[q] - first[q])
        for s in _steps(count, STEP):
            n = count[s[0]:s[1]]
            k = np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n)
            pp, qq = np.repeat(p[s[0]:s[1]], n), np.repeat(q[s[0]:s[1]], n)
            width = last[qq] - first[qq]
            i, j = first[pp] + k // width, first[qq] + k % width
            go = i < j
            i, j = i[go], j[go]
            need = _needed(size[i], size[j], self.percent)
            fine = (size[j] * self.percent <= 100 * size[i]) & (np.minimum(size[i] - at[i], size[j] - at[j]) >= need)
            i, j = i[fine], j[fine]
            if len(i):
                yield rows["set"][i], rows["set"][j]

    # --- verification ---------------------------------------------------------------------------
    def name_filter(self, pairs: DataFrame, rows: int) -> np.ndarray:
        """A Bloom filter of the names in ``pairs``: it decides which sets are moved, never which pairs are linked."""
        return vectors.bloom(pairs.select("a", "b"), vectors.sized(rows * 8, vectors.LEAST_BITS, vectors.MOST_BITS))

    def involved(self, sets: DataFrame, wanted: np.ndarray) -> DataFrame:
        """(name, tokens), once each, of the sets whose name may be in the filter."""
        sent = sets.sparkSession.sparkContext.broadcast(wanted)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(vectors.maybe_in(b.column(0).to_numpy().view(np.uint64), sent.value)))

        own = sets.where("tokens IS NOT NULL").select("name", "tokens").mapInArrow(run, "name long, tokens binary")
        return own.groupBy("name").agg(F.min("tokens").alias("tokens"))

    def grouped(self, pairs: DataFrame) -> DataFrame:
        """(a, b, group): pairs of related sets in one group, about GROUP of them; a leader with more has several."""
        least = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("leader"))
        led = pairs.join(least, "a", "left").withColumn("leader", F.coalesce("leader", "a"))
        many = led.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
        parts = F.coalesce(F.ceil(F.col("n") / GROUP), F.lit(1)).cast("int")
        groups = max(8, pairs.count() // GROUP)
        return led.join(many, "leader", "left").select("a", "b", F.pmod(F.xxhash64("leader", F.pmod(F.xxhash64("b"), parts)), F.lit(groups)).cast("int").alias("group"))

    def links(self, sets: DataFrame, rows: int) -> DataFrame:
        """(a, b): pairs of set names, a < b, at or above the threshold."""
        pairs = cut(self.candidates(sets, self.sketch(sets, rows), rows), "neardup-candidates")
        grouped = cut(self.grouped(pairs), "neardup-groups")
        needed = grouped.select(F.col("group").alias("at"), F.explode(F.array("a", "b")).alias("name")).distinct()  # a set goes once to a group, not once a pair
        tokens = needed.join(self.involved(sets, self.name_filter(pairs, rows)), "name")

        def verify(pairs: pa.Table, tokens: pa.Table) -> pa.Table:
            a, b = (pairs.column(c).to_numpy() for c in ("a", "b"))
            own = {n: _unpacked(t.as_buffer()) for n, t in zip(tokens.column("name").to_pylist(), tokens.column("tokens").combine_chunks())}
            keep = self.verified(a, b, own)
            return pa.table({"a": a[keep], "b": b[keep]})

        return grouped.groupBy("group").cogroup(tokens.groupBy("at")).applyInArrow(verify, "a long, b long")

    def verified(self, a: np.ndarray, b: np.ndarray, tokens: dict[int, np.ndarray], counts: dict | None = None) -> np.ndarray:
        """Which pairs are at or above the threshold. ``counts`` gets how many were settled by bounds, by differences and by themselves."""
        size = {n: len(t) for n, t in tokens.items()}
        of: dict[int, frozenset[int]] = {}
        changes: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        told: dict[tuple[int, int], int] = {}  # overlap of a leader with a set
        leader: dict[int, int] = {}
        tally = [0, 0, 0]

        def members(n: int) -> frozenset[int]:
            if n not in of:
                of[n] = frozenset(tokens[n].tolist())
            return of[n]

        keep = np.zeros(len(a), bool)
        for k in np.lexsort((b, a)).tolist():
            x, y = int(a[k]), int(b[k])
            need = -(-(self.percent * (size[x] + size[y])) // (100 + self.percent))
            root = leader.get(x)
            if root is not None and (root, y) in told:  # x and y were both compared with the leader
                with_x, with_y = told[root, x], told[root, y]
                if min(with_y + size[x] - with_x, with_x + size[y] - with_y) < need:
                    tally[0] += 1
                    continue
                if with_x + with_y - size[root] >= need:
                    tally[0] += 1
                    keep[k] = True
                    continue
                if 2 * (size[x] + size[root] - 2 * with_x) < min(size[x], size[y]):
                    if (root, x) not in changes:
                        changes[root, x] = list(members(x) - members(root)), list(members(root) - members(x))
                    gained, lost = changes[root, x]
                    other = members(y)
                    tally[1] += 1
                    keep[k] = with_y + sum(t in other for t in gained) - sum(t in other for t in lost) >= need
                    continue
            overlap = len(members(x) & members(y))
            tally[2] += 1
            if root is None:  # x is the first of its kind here: its overlaps are kept for the sets related to it
                told[x, y] = overlap
                leader.setdefault(y, x)
            keep[k] = overlap >= need
        if counts is not None:
            counts |= dict(zip(("bounds", "differences", "compared"), tally))
        return keep


def _steps(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``counts`` whose sums stay near ``most``."""
    total = np.cumsum(counts)
    at = 0
    while at < len(counts):
        base = total[at - 1] if at else 0
        nxt = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield at, nxt
        at = nxt


def _copies(members: DataFrame) -> DataFrame:
    """(a, b): all pairs of texts with equal sets. A large class is cut in parts; every pair of parts is its own join key."""
    sizes = members.groupBy("name").count().where("count > 1")
    rows = members.join(sizes, "name").withColumn("parts", F.ceil(F.col("count") / 1024).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    left = rows.select("name", F.col("id").alias("x"), F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"))
    right = rows.select("name", F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.col("part"))).alias("i"), F.col("part").alias("j"))
    both = left.join(right, ["name", "i", "j"]).where((F.col("i") != F.col("j")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def similar_pairs(df: DataFrame, join: Join) -> DataFrame:
    """(a, b), a < b: all pairs of texts of one kind at or above the threshold, copies written out.

    Texts that are NULL, empty or shorter than ``join.least`` words, and rows without number or
    kind, take part in no pair. The number must be unique. Other columns are not read.
    """
    sets = join.table(join.source(df))
    links = join.links(sets, sets.count())
    members = sets.select("id", "name")
    across = (links.select("a", "b").join(members.select(F.col("name").alias("a"), F.col("id").alias("x")), "a")
              .join(members.select(F.col("name").alias("b"), F.col("id").alias("y")), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return across.unionByName(_copies(members))


def groups(df: DataFrame, join: Join) -> DataFrame:
    """(id, class_id, links): one row for each text that has a near-duplicate.

    ``class_id`` is the smallest number among the texts connected by links; ``links`` the number
    of texts at or above the threshold with this one, copies included but never written out.
    """
    sets = join.table(join.source(df))
    links = cut(join.links(sets, sets.count()), "neardup-links")
    members = sets.select("id", "name")
    classes = members.groupBy("name").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(classes.select(F.col("name").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "name")
    root = components(links)
    nodes = (classes.join(degree, "name", "left").join(root, "name", "left")
             .select("name", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("root", "name").alias("root")).where("links > 0"))
    nodes = nodes.join(nodes.groupBy("root").agg(F.min("least").alias("class_id")), "root")
    return members.join(nodes.select("name", "class_id", "links"), "name").select("id", "class_id", "links")


def components(links: DataFrame) -> DataFrame:
    """(name, root) of every name in ``links``, by alternating large-star and small-star steps.

    Each step only moves edges to smaller names and ends in shared storage; the number of steps
    grows with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = cut(small, "components")
        changed = after.exceptAll(edges).unionByName(edges.exceptAll(after)).limit(1).count()
        edges = after
        if not changed:
            return edges.select(F.col("a").alias("name"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("name"), F.col("b").alias("root"))).groupBy("name").agg(F.min("root").alias("root"))
