"""Has this key been seen before? Quotient filters, cut by quotient, merged as sorted runs.

A key's fingerprint of ``bits`` bits is split in three: the leading bits name the *bucket*, a part
of the filter that one task handles; the next ones are the *quotient*, which names a run; the rest
is the *remainder*, all that is stored of the key. A bucket is kept as

* ``occupied``: a bitmap over the quotients that have a run,
* ``continues``: a bit for each remainder, set where it belongs to the run before it,
* ``remainders``: the remainders in order, in 8, 16, 32 or 64 bits,

so that a key costs its remainder and about three bits. Buckets are sorted; two of them merge by
one pass, and a quotient bit is taken from the remainder when the merged bucket has outgrown its
runs. Offers are taken in the order of their number, in blocks; each block's filter is stored, asked
of the filters of the blocks before it and then merged with them, filters of like size at a time (a
cascade), so that each key is moved a logarithmic number of times.

Wrong answers are of one kind: a new key reported as seen because it shares another key's
fingerprint. ``error_report`` derives their rate from the fill and measures it against whole keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.storage import cut

#: Fingerprint width of the queries, rows a bucket is planned for, offers in a block: least (a 1024th of the input beyond that) and most.
BITS, BUCKET_ROWS, BLOCK_ROWS, MOST_BLOCK_ROWS = 56, 1 << 20, 1 << 15, 1 << 21


class Run:
    """One bucket's quotient filter over ``width``-bit fingerprints, immutable."""

    def __init__(self, width: int, quotient_bits: int, occupied: np.ndarray, continues: np.ndarray, remainders: np.ndarray):
        self.width, self.quotient_bits = width, quotient_bits
        self.occupied, self.continues, self.remainders = occupied, continues, remainders

    @classmethod
    def of(cls, fingerprints: np.ndarray, width: int) -> Run:
        """From sorted distinct fingerprints."""
        n = len(fingerprints)
        q = min(width, max(3, math.ceil(math.log2(n + 1))))
        r = width - q
        quotients = (fingerprints >> np.uint64(r)) if r < 64 else np.zeros(n, np.uint64)
        bitmap = np.zeros(1 << q, np.uint8)
        bitmap[quotients.astype(np.int64)] = 1
        same = np.zeros(n, np.uint8)
        same[1:] = quotients[1:] == quotients[:-1]
        rest = fingerprints & np.uint64((1 << r) - 1)
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if r <= np.dtype(k).itemsize * 8)
        return cls(width, q, np.packbits(bitmap), np.packbits(same), rest.astype(kind))

    def __len__(self) -> int:
        return len(self.remainders)

    @property
    def nbytes(self) -> int:
        return self.occupied.nbytes + self.continues.nbytes + self.remainders.nbytes

    def fingerprints(self) -> np.ndarray:
        """Sorted: the n-th run belongs to the n-th occupied quotient."""
        n, r = len(self), self.width - self.quotient_bits
        if not n:
            return np.zeros(0, np.uint64)
        starts = np.unpackbits(self.continues)[:n] == 0
        runs = np.flatnonzero(np.unpackbits(self.occupied)).astype(np.uint64)
        return (runs[np.cumsum(starts) - 1] << np.uint64(r)) | self.remainders.astype(np.uint64)

    def has(self, asked: np.ndarray) -> np.ndarray:
        """Whether each fingerprint is in: by its quotient's run, then by remainder within it."""
        if not len(self):
            return np.zeros(len(asked), bool)
        own = self.fingerprints()
        r = np.uint64(self.width - self.quotient_bits)
        found = np.unpackbits(self.occupied)[(asked >> r).astype(np.int64)] == 1
        at = np.searchsorted(own, asked[found])
        found[found] = own[np.minimum(at, len(own) - 1)] == asked[found]
        return found

    def merge(self, other: Run) -> Run:
        """Both runs' keys; the quotient grows as the number of keys does."""
        both = np.concatenate([self.fingerprints(), other.fingerprints()])
        both.sort(kind="stable")  # two sorted runs: a single merge
        return Run.of(both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both, self.width)

    def columns(self) -> dict:
        return {"width": self.width, "quotient_bits": self.quotient_bits, "keys": len(self),
                "remainder_bytes": self.remainders.dtype.itemsize, "occupied": self.occupied.tobytes(),
                "continues": self.continues.tobytes(), "remainders": self.remainders.tobytes()}

    @classmethod
    def read(cls, row: dict) -> Run:
        kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[row["remainder_bytes"]]
        return cls(row["width"], row["quotient_bits"], np.frombuffer(row["occupied"], np.uint8),
                   np.frombuffer(row["continues"], np.uint8), np.frombuffer(row["remainders"], kind))


class Cascade:
    """Filters of doubling size; like sizes are merged."""

    def __init__(self, width: int):
        self.width, self.runs = width, []

    def has(self, asked: np.ndarray) -> np.ndarray:
        found = np.zeros(len(asked), bool)
        for run in self.runs:
            found |= run.has(asked)
        return found

    def add(self, fingerprints: np.ndarray) -> None:
        self.runs.append(Run.of(fingerprints, self.width))
        while len(self.runs) > 1 and len(self.runs[-2]) < 2 * len(self.runs[-1]):
            last = self.runs.pop()
            self.runs.append(self.runs.pop().merge(last))

    def whole(self) -> Run:
        out = Run.of(np.zeros(0, np.uint64), self.width)
        for run in self.runs:
            out = out.merge(run)
        return out


def bucket_bits(rows: int) -> int:
    """Leading bits that name the bucket: as many as keep a bucket near ``BUCKET_ROWS`` rows."""
    return max(2, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS))) if rows > BUCKET_ROWS else 2


def _keyed(df: DataFrame, number: str, key: Column) -> DataFrame:
    """number, fp (64 hash bits, cut to the width wanted later) and check (64 further bits)."""
    return (df.select(F.col(number).cast("long").alias("number"), key.alias("_key"))
            .where(F.col("_key").isNotNull() & F.col("number").isNotNull())
            .select("number", F.xxhash64("_key").alias("fp"), F.xxhash64(F.lit("check"), "_key").alias("check")))


_ROWS = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("fp", pa.int64()), ("check", pa.int64()), ("known", pa.bool_())])


def _first_of_partition(bits: int):
    """Per input partition: each key's first offer goes on, the later ones are known to be repeats.

    This is the combine before the shuffle: a key that holds a third of all rows sends one row
    from each partition to its bucket. Repeats go on under parts drawn from their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches]
        if not got:
            return
        number, fp, check = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((number, check, fp))
        number, fp, check = number[order], fp[order], check[order]
        start = np.r_[True, (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])] if len(fp) else np.zeros(0, bool)
        first = number[np.maximum.accumulate(np.where(start, np.arange(len(fp)), 0))] if len(fp) else number
        known = number > first
        keep = known | start
        number, fp, check, known = number[keep], fp[keep], check[keep], known[keep]
        bucket = (fp.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        part = np.where(known, number % (1 << bits), bucket)
        for at in range(0, len(number), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (part, number, fp, check, known)], schema=_ROWS)

    return run


def _blocks(table: pa.Table, width: int, lead: int, block: int):
    """Undecided rows of a bucket in the order of their numbers, with what the filter said."""
    t = table.filter(pc.invert(table.column("known")))
    number, fp, check = (t.column(c).to_numpy() for c in ("number", "fp", "check"))
    order = np.lexsort((check, fp, number))
    number, fp, check = number[order], fp[order], check[order]
    keep = np.r_[True, (number[1:] != number[:-1]) | (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])] if len(fp) else np.zeros(0, bool)
    number, fp, check = number[keep], fp[keep], check[keep]
    short = (fp.view(np.uint64) << np.uint64(lead)) >> np.uint64(64 - (width - lead))
    cascade, said = Cascade(width - lead), np.zeros(len(fp), bool)
    for at in range(0, len(fp), block):
        cut = slice(at, at + block)
        distinct, first = np.unique(short[cut], return_index=True)
        new = np.zeros(len(short[cut]), bool)
        new[first] = True
        said[cut] = ~new
        old = cascade.has(distinct)
        said[at + first[old]] = True
        cascade.add(distinct[~old])
    return number, fp, check, said, cascade


def _repeated(fp: np.ndarray, check: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Exact: whether the whole 128-bit key stands at a smaller number."""
    if not len(fp):
        return np.zeros(0, bool)
    order = np.lexsort((number, check, fp))
    start = np.r_[True, (np.diff(fp[order]) != 0) | (np.diff(check[order]) != 0)]
    first = number[order][np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]
    out = np.zeros(len(fp), bool)
    out[order] = number[order] > first
    return out


def _prepared(df: DataFrame, number: str, key: Column, lead: int | None) -> tuple[DataFrame, int]:
    bits = bucket_bits(df.count()) if lead is None else lead
    return _keyed(df, number, key).mapInArrow(_first_of_partition(bits), "part long, number long, fp long, check long, known boolean"), bits


# --- the operator: blocks of offers, stored filters, an exact check of what they say ------------
_CELL = "kind int, block int, bucket int, width int, quotient_bits int, keys long, remainder_bytes int, occupied binary, continues binary, remainders binary"
_CELL_SCHEMA = pa.schema([("kind", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("width", pa.int32()), ("quotient_bits", pa.int32()), ("keys", pa.int64()),
                          ("remainder_bytes", pa.int32()), ("occupied", pa.binary()), ("continues", pa.binary()), ("remainders", pa.binary())])
_MARKS = "block int, bucket int, seen binary, elsewhere binary"


def _sorted_block(number: np.ndarray, fp: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by fingerprint, key and number, and whether each is the first of its key."""
    order = np.lexsort((number, check, fp.view(np.uint64)))
    number, fp, check = number[order], fp[order], check[order]
    start = np.r_[True, (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])] if len(fp) else np.zeros(0, bool)
    return number, fp, check, start


def _bounds(df: DataFrame, number: str, blocks: int, rows: int) -> np.ndarray:
    """Numbers at which blocks begin, from a draw of about twenty a block, as a range exchange draws its bounds: sizes vary a little, no result does."""
    drawn = df.select(F.col(number).cast("long").alias("n")).where("n IS NOT NULL").sample(min(1.0, 20.0 * blocks / rows), seed=7)
    drawn = np.sort(np.array([r.n for r in drawn.toLocalIterator()], np.int64))  # twenty longs a block
    return np.unique(drawn[(np.arange(1, blocks) * len(drawn)) // blocks]) if len(drawn) else drawn


def _stored(df: DataFrame, number: str, key: Column, width: int, lead: int | None, block: int | None) -> tuple[DataFrame, int]:
    """Cells in shared storage: for each block of offers its rows (kind 1), sorted by key, and its filter, a bucket a cell (kind 0)."""
    rows = df.count()
    size = block or min(max(rows // 1024, BLOCK_ROWS), MOST_BLOCK_ROWS)
    bits = bucket_bits(rows) if lead is None else lead
    bounds = _bounds(df, number, -(-rows // size), rows) if rows > size else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(bounds, b.column(0).to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), *b.columns], names=["block", "number", "fp", "check"])

    def build(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        number, fp, check, _ = _sorted_block(*(table.column(c).to_numpy() for c in ("number", "fp", "check")))
        whole = np.unique(fp.view(np.uint64) >> np.uint64(64 - width))
        bucket = (whole >> np.uint64(width - bits)).astype(np.int64)
        rows = [{"kind": 1, "block": block, "bucket": None, "width": width, "quotient_bits": None, "keys": len(number), "remainder_bytes": None,
                 "occupied": number.tobytes(), "continues": fp.tobytes(), "remainders": check.tobytes()}]
        for k, own in zip(*_runs(bucket)):
            rows.append({"kind": 0, "block": block, "bucket": int(k)} | Run.of(whole[own] & np.uint64((1 << (width - bits)) - 1), width - bits).columns())
        return pa.Table.from_pylist(rows, schema=_CELL_SCHEMA)

    placed = _keyed(df, number, key).mapInArrow(place, "block int, number long, fp long, check long")
    return cut(placed.groupBy("block").applyInArrow(build, _CELL), "seen-cells"), bits


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """Distinct values of a sorted array and where each stands."""
    values, begin = np.unique(sorted_values, return_index=True)
    return values, [slice(i, j) for i, j in zip(begin, np.r_[begin[1:], len(sorted_values)])]


def _ask(table: pa.Table) -> pa.Table:
    """A bucket's filters in the order of their blocks: each is asked of the merged filter of those before, then joins it.

    Nothing but filters is held. For each block: which of its fingerprints stand in earlier
    blocks, and which in any other block (where the exact check may find the first offer).
    """
    runs = sorted(((r["block"], Run.read(r)) for r in table.to_pylist()), key=lambda x: x[0])
    before, said, several = Cascade(runs[0][1].width), [], []
    for _, run in runs:
        own = run.fingerprints()
        seen = before.has(own)
        said.append(seen)
        several.append(own[seen])
        before.add(own[~seen])
    several = np.unique(np.concatenate(several))
    out = []
    for (block, run), seen in zip(runs, said):
        out.append({"block": block, "bucket": table.column("bucket")[0].as_py(), "seen": np.packbits(seen).tobytes(), "elsewhere": np.packbits(np.isin(run.fingerprints(), several)).tobytes()})
    return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("seen", pa.binary()), ("elsewhere", pa.binary())]))


def seen_before(df: DataFrame, number: str, key: Column, width: int = BITS, lead: int | None = None, block: int | None = None) -> DataFrame:
    """Numbers of the rows whose key stands at a smaller number too, each number once.

    Offers are cut in blocks by number; each block's keys become a quotient filter, stored in
    shared storage, a cell a bucket. A bucket's filters are asked and merged in the order of the
    blocks, so a task holds filters, never the keys before. What a filter calls new is new. What
    it calls seen, in its block or in an earlier one, is held against 128 hash bits of the key,
    within the block where the first offer is there, else against the stored first offers of the
    blocks that have the fingerprint: no wrong answer of the filter remains.

    A key with a third of all rows is one entry of each block's filter and one row of each block
    in the exact check. Rows without key or number are never seen; an empty table gives no rows;
    a row delivered twice under its number is one row. Other columns of ``df``, whatever their
    names, are not looked at.
    """
    cells, bits = _stored(df, number, key, width, lead, block)
    marks = cells.where("kind = 0").groupBy("bucket").applyInArrow(_ask, _MARKS)

    def judge(rows: pa.Table, marks: pa.Table) -> pa.Table:
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        if rows.num_rows:
            number, fp, check = (np.frombuffer(rows.column(c)[0].as_buffer(), np.int64) for c in ("occupied", "continues", "remainders"))
            short = fp.view(np.uint64) >> np.uint64(64 - width)
            values, at, times = np.unique(short, return_inverse=True, return_counts=True)
            seen, elsewhere = np.zeros(len(values), bool), np.zeros(len(values), bool)
            bucket, places = _runs((values >> np.uint64(width - bits)).astype(np.int64))
            where = dict(zip(bucket.tolist(), places))
            for m in marks.to_pylist():
                own = where[m["bucket"]]
                n = own.stop - own.start
                seen[own] = np.unpackbits(np.frombuffer(m["seen"], np.uint8))[:n]
                elsewhere[own] = np.unpackbits(np.frombuffer(m["elsewhere"], np.uint8))[:n]
            # the block's own filter calls every fingerprint but the first seen; only those are looked at
            asked = (times > 1)[at]
            _, _, _, start = _sorted_block(number, fp, check)  # the rows are sorted already
            first = number[np.maximum.accumulate(np.where(start, np.arange(len(fp)), 0))] if len(fp) else number
            here = asked & (number > first)
            left = start & (seen | elsewhere)[at]
            found = [np.r_[np.unique(number[here]), number[left]], np.r_[np.zeros(len(np.unique(number[here])), np.int64), fp[left]],
                     np.r_[np.zeros(len(np.unique(number[here])), np.int64), check[left]], np.r_[np.full(len(np.unique(number[here])), 2), seen[at][left].astype(np.int64)]]
        return pa.table({"number": found[0], "fp": found[1], "check": found[2], "asked": found[3].astype(np.int32)}, schema=pa.schema([("number", pa.int64()), ("fp", pa.int64()), ("check", pa.int64()), ("asked", pa.int32())]))

    stored = cells.where("kind = 1").select("block", "occupied", "continues", "remainders")
    told = stored.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(judge, "number long, fp long, check long, asked int")
    told = cut(told, "seen-told")  # 2: seen within its block; 1: a filter of earlier blocks says so; 0: a first offer it may have meant
    least = F.min("number").over(Window.partitionBy("fp", "check"))
    across = told.where("asked < 2").withColumn("first", least).where("asked = 1 AND number > first").select("number")
    return told.where("asked = 2").select("number").unionByName(across).dropDuplicates(["number"]).select(F.col("number").alias(number))


def error_report(df: DataFrame, number: str, key: Column, widths: tuple[int, ...] = (20, 24, 28, 32, 40, 56), lead: int | None = None) -> DataFrame:
    """For each fingerprint width: keys, new keys wrongly called seen, measured and derived rate.

    Derived: the k-th new key meets k-1 fingerprints among 2^width, so of n keys about
    ``1 - (1 - e^-x) / x`` with ``x = n / 2^width`` are called seen wrongly. The measure counts them against 128 hash bits.
    """
    rows, bits = _prepared(df, number, key, lead)

    def run(table: pa.Table) -> pa.Table:
        out = []
        for w in widths:
            if w <= bits:
                continue
            numbers, fp, check, said, cascade = _blocks(table, w, bits, BLOCK_ROWS)
            new = ~_repeated(fp, check, numbers)
            out.append((w, int(new.sum()), int((said & new).sum()), cascade.whole().nbytes))
        return pa.table(dict(zip(("bits", "keys", "wrong", "bytes"), map(list, zip(*out)))) if out else {"bits": [], "keys": [], "wrong": [], "bytes": []},
                        schema=pa.schema([("bits", pa.int32()), ("keys", pa.int64()), ("wrong", pa.int64()), ("bytes", pa.int64())]))

    x = F.col("keys") / F.pow(F.lit(2.0), F.col("bits").cast("double"))
    derived = F.when(x > 1e-4, 1 - (1 - F.exp(-x)) / x).otherwise(x / 2)
    return (rows.groupBy("part").applyInArrow(run, "bits int, keys long, wrong long, bytes long")
            .groupBy("bits").agg(F.sum("keys").alias("keys"), F.sum("wrong").alias("wrong"), F.sum("bytes").alias("filter_bytes"))
            .select("bits", "keys", "wrong", "filter_bytes", (F.col("wrong") / F.col("keys")).alias("measured_rate"), derived.alias("derived_rate")))


_FILTER = "part long, width int, quotient_bits int, keys long, remainder_bytes int, occupied binary, continues binary, remainders binary"


def build_filter(df: DataFrame, key: Column, lead: int, width: int = BITS) -> DataFrame:
    """The keys of ``df`` as a table of filter buckets, to be stored and merged later."""

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        short = np.unique((fp << np.uint64(lead)) >> np.uint64(64 - (width - lead)))
        row = {"part": table.column("part")[0].as_py()} | Run.of(short, width - lead).columns()
        return pa.Table.from_pylist([row], schema=_filter_schema())

    hashed = df.select(key.alias("_key")).where("_key IS NOT NULL").select(F.xxhash64("_key").alias("fp")).distinct()
    return hashed.withColumn("part", F.shiftrightunsigned("fp", 64 - lead)).groupBy("part").applyInArrow(run, _FILTER)


def _filter_schema() -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("width", pa.int32()), ("quotient_bits", pa.int32()), ("keys", pa.int64()),
                      ("remainder_bytes", pa.int32()), ("occupied", pa.binary()), ("continues", pa.binary()), ("remainders", pa.binary())])


def merge_filters(filters: DataFrame) -> DataFrame:
    """Several stored filters (a union of their buckets) as one: sorted runs merged bucket by bucket."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["keys"])
        out = Run.read(rows[0])
        for row in rows[1:]:
            out = out.merge(Run.read(row))
        return pa.Table.from_pylist([{"part": rows[0]["part"]} | out.columns()], schema=_filter_schema())

    return filters.groupBy("part").applyInArrow(run, _FILTER)


def probe_filter(df: DataFrame, number: str, key: Column, filters: DataFrame, lead: int) -> DataFrame:
    """(number, maybe_seen) of every row of ``df`` with a key, asked of a stored filter."""
    asked = df.select(F.col(number).cast("long").alias("number"), key.alias("_key")).where("_key IS NOT NULL AND number IS NOT NULL")
    asked = asked.select("number", F.xxhash64("_key").alias("fp")).withColumn("part", F.shiftrightunsigned("fp", 64 - lead))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        fp = left.column("fp").to_numpy().view(np.uint64)
        hit = np.zeros(len(fp), bool)
        for row in right.to_pylist():
            own = Run.read(row)
            hit |= own.has((fp << np.uint64(lead)) >> np.uint64(64 - own.width))
        return pa.table({"number": left.column("number"), "maybe_seen": hit})

    return (asked.groupBy("part").cogroup(filters.groupBy("part")).applyInArrow(run, "number long, maybe_seen boolean")
            .select(F.col("number").alias(number), "maybe_seen"))
