"""Mixing sources to target weights: a min-cost flow over membership patterns.

A text may stand in several sources, so its tokens can serve any of them, but not more often in
all than the strictest of its sources allows. Texts are aggregated by their *membership pattern*
(the set of their sources); patterns supply tokens in layers, the n-th use of a text at cost n-1;
sources demand their share of the total. The flow on that graph, whose size depends on the number
of sources alone, says how many tokens of each pattern, in each layer, go to each source; seeded
documents are then cut from each pattern at exactly those running totals.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight.storage import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Sources a mixture may have: the driver holds their patterns, 4,095 at most, and segments.
MOST_SOURCES = 12
#: Texts a running total is taken over within one task.
TEXTS_A_CELL = 4096


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, path: str = TOKENIZER) -> DataFrame:
    """``df`` (columns other than ``text``) with ``tokens`` of each text; NULL and empty texts have 0."""
    keep = [c for c in df.columns if c != text]
    schema = df.select(*keep).withColumn("tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "tokens"])

    return df.select(*keep, text).mapInArrow(run, schema)


class Flow:
    """Minimum-cost flow by shortest augmenting paths on a small graph."""

    def __init__(self):
        self.edges: list[list] = []  # to, capacity left, cost
        self.at: dict = defaultdict(list)

    def add(self, a, b, capacity: int, cost: int) -> int:
        self.at[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.at[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, source, sink) -> int:
        total = 0
        while True:
            cost, came, queue = {source: 0}, {}, [source]
            while queue:
                a = queue.pop(0)
                for e in self.at[a]:
                    b, left, c = self.edges[e]
                    if left > 0 and cost[a] + c < cost.get(b, 1 << 60):
                        cost[b], came[b] = cost[a] + c, e
                        queue.append(b)
            if sink not in came:
                return total
            path, node = [], sink
            while node != source:
                path.append(came[node])
                node = self.edges[came[node] ^ 1][0]
            push = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= push
                self.edges[e ^ 1][1] += push
            total += push


def _graph(capacity: dict[tuple, int], targets: dict[str, tuple[float, int]], total: int):
    flow, uses = Flow(), {}
    want = {s: int(share * total) for s, (share, _) in targets.items()}
    for pattern, tokens in sorted(capacity.items()):
        for layer in range(min(targets[s][1] for s in pattern)):
            flow.add("in", (pattern, layer), tokens, layer)
            for s in pattern:
                uses[pattern, layer, s] = flow.add((pattern, layer), s, tokens, 0)
    for s, n in want.items():
        flow.add(s, "out", n, 0)
    return flow, uses, sum(want.values())


def plan(capacity: dict[tuple, int], targets: dict[str, tuple[float, int]], wanted: int | None = None) -> tuple[int, dict[tuple, list]]:
    """(total, segments): the largest total (or ``wanted``, if less) all shares can be met with, and
    for each pattern its segments (layer, from, to, source) on the running total of its tokens.
    """
    low, high = 0, int(sum(n * min(targets[s][1] for s in p) for p, n in capacity.items()))
    high = min(high, wanted) if wanted is not None else high
    while low < high:  # feasibility of a total is monotone
        mid = (low + high + 1) // 2
        flow, _, need = _graph(capacity, targets, mid)
        low, high = (mid, high) if flow.run("in", "out") == need else (low, mid - 1)
    flow, uses, _ = _graph(capacity, targets, low)
    flow.run("in", "out")
    begin: dict[tuple, int] = defaultdict(int)
    segments: dict[tuple, list] = defaultdict(list)
    for (pattern, layer, s), e in sorted(uses.items()):
        if n := flow.edges[e ^ 1][1]:
            segments[pattern].append((layer, begin[pattern, layer], begin[pattern, layer] + n, s))
            begin[pattern, layer] += n
    return low, dict(segments)


def clean_source(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"a mixture has at most {MOST_SOURCES} sources")
    whole = sum(r["target_share"] for r in rows) or 1.0
    return {r["source"].strip().lower(): (r["target_share"] / whole, r["max_repeats"]) for r in rows}


def _texts(documents: DataFrame, targets: dict, path: str, seed: int) -> DataFrame:
    """One row for each distinct text: seeded order, tokens, pattern and a document of each source."""
    rows = (documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
            .select("doc_id", clean_source(F.col("source")).alias("source"), F.xxhash64(F.lit(seed), "text").alias("h"), F.xxhash64(F.lit(seed + 1), "text").alias("g"), "text")
            .where(F.col("source").isin(*targets)))
    by_source = with_tokens(rows, "text", path).groupBy("h", "g", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    texts = by_source.groupBy("h", "g").agg(F.max("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("docs"))
    return texts.where("tokens > 0").withColumn("pattern", F.array_join(F.transform("docs", lambda d: d["source"]), "|"))


def _running(texts: DataFrame, count: int) -> DataFrame:
    """``texts`` with ``at``: tokens of its pattern before it in the seeded order.

    Totals of cells come first, then cells of coarse ranges, then texts within a cell: no window
    holds more than about TEXTS_A_CELL rows, however large a pattern is.
    """
    bits = max(1, (max(1, count) // TEXTS_A_CELL).bit_length())
    half = bits // 2
    cell = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)
    texts = texts.withColumn("cell", cell)
    cells = texts.groupBy("pattern", "cell").agg(F.sum("tokens").alias("n")).withColumn("range", F.shiftright("cell", half).cast("long"))
    ranges = cells.groupBy("pattern", "range").agg(F.sum("n").alias("n"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("pattern", "range", F.coalesce(F.sum("n").over(before("pattern", "range")), F.lit(0)).alias("r"))
    cells = (cells.withColumn("c", F.coalesce(F.sum("n").over(before("pattern", "range", "cell")), F.lit(0)))
             .join(ranges, ["pattern", "range"]).select("pattern", "cell", (F.col("r") + F.col("c")).alias("begin")))
    w = Window.partitionBy("pattern", "cell").orderBy("h", "g").rowsBetween(Window.unboundedPreceding, -1)
    return texts.join(cells, ["pattern", "cell"]).withColumn("at", F.col("begin") + F.coalesce(F.sum("tokens").over(w), F.lit(0)))


def mix(documents: DataFrame, targets: DataFrame, wanted: int | None = None, path: str = TOKENIZER, seed: int = 17) -> DataFrame:
    """(doc_id, source, repeats, tokens): the mixture, one row for each document and source it serves.

    Total and shares follow from ``plan``; a text's last token may run over a segment's end, so a
    source misses its target by less than a text for each segment. Texts that are equal count
    once, under the smallest doc_id of each source. Documents without text, id or a source of the
    targets take no part; no targets or no documents give no rows; the order of the input plays no part.
    """
    spark = documents.sparkSession
    goals = _targets(targets)
    schema = "doc_id long, source string, repeats int, tokens long"
    if not goals:
        return spark.createDataFrame([], schema)
    texts = cut(_texts(documents, goals, path, seed), "mix-texts")
    # one row a pattern: at most as many as there are sets of sources in the data
    supply = texts.groupBy("pattern").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    _, segments = plan({tuple(r["pattern"].split("|")): r["n"] for r in supply}, goals, wanted)
    table = [("|".join(p), [{"layer": a, "lo": b, "hi": c, "source": s} for a, b, c, s in own]) for p, own in segments.items()]
    cuts = spark.createDataFrame(table, "pattern string, cuts array<struct<layer:int,lo:long,hi:long,source:string>>")
    placed = (_running(texts, sum(r["k"] for r in supply)).join(F.broadcast(cuts), "pattern")
              .select("docs", "tokens", F.explode(F.filter("cuts", lambda c: (c["lo"] <= F.col("at")) & (F.col("at") < c["hi"]))).alias("c")))
    doc = F.get(F.filter("docs", lambda d: d["source"] == F.col("c.source")), F.lit(0))["doc_id"]
    return (placed.select(doc.alias("doc_id"), F.col("c.source").alias("source"), "tokens")
            .groupBy("doc_id", "source").agg(F.count(F.lit(1)).cast("int").alias("repeats"), F.max("tokens").alias("tokens")))


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, tokens, share, most_repeats): what ``mix`` reached; a source without documents has 0."""
    got = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    all_of_it = Window.partitionBy()  # one row a source
    return (targets.where("source IS NOT NULL").select(clean_source(F.col("source")).alias("source"), "target_share", "max_repeats").join(got, "source", "left")
            .select("source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
                    (F.coalesce("tokens", F.lit(0)) / F.greatest(F.sum("tokens").over(all_of_it), F.lit(1))).alias("share"),
                    F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats"))
