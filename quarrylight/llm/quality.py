"""Text statistics that tell prose from lists, tables, code and rubbish.

Per text: counts and ratios of words, symbols, punctuation and common words, and three measures of
layout: how far delimiters stand in line with each other vertically, how regularly lines begin
alike, by mark or indentation, and the autocorrelation of line lengths. Words are measured too: a
word is *loose* if no function word stands close to it, or its line is a table row, list item
(marked, or one of several short lines indented alike) or label-value line.

The judgement is a linear one over all of them, fitted on a bounded sample of labelled texts
(``fitted``): half of the sample is fitted on, the other half tells the error. Without labels of
both kinds a text is not prose if most of its words are loose.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.words import NOT_WORD
from quarrylight.llm.vectors import plain

#: Function words of English, German, French and Spanish (fixed values).
FUNCTION_WORDS = frozenset("""
the a an and or but nor of to in into on onto at by for with from as than that this these those it its is are was were be been being am has have had having do does did not never
i you he she we they us them my your his her our their who whom whose which what whoever how why when where while because so if though although until unless since before after during
without within against between among through under over above below beneath behind beside besides near beyond inside outside around along across despite toward towards about
every each some any another other both either neither all one two more most such same can could may might must shall should will would let there here then just too also only even
somebody someone nobody everybody everyone anybody everything nothing something please thanks whenever wherever whether instead
der die das den dem des ein eine einen einem einer eines und oder aber denn sondern ist sind war waren wird werden hat haben nicht kein keine mit von zu zum zur bei beim nach aus auf für über unter
hinter neben vor zwischen durch gegen ohne um an am im ins seit bis weil dass daß ob obwohl während wenn als wie bevor nachdem sobald damit er sie es wir ihr ich du man sich mein dein sein unser
le la les l un une des du de d et ou mais donc car ni que qui quoi dont où est sont était été a ont avait pas ne n plus sans avec dans en sur sous entre vers chez par pour contre depuis pendant derrière devant
parce puisque lorsque quand tandis alors afin ce cet cette ces son sa ses mon ma mes leur leurs notre nos votre vos il elle ils elles nous vous je tu on se s au aux
el los las lo al del una unos unas y e o u pero sino porque pues aunque cuando mientras como para por sin con contra entre hacia hasta desde según sobre tras bajo ante es son era fue está están ha han no se su sus
mi tu nuestro nuestra este esta estos estas ese esa eso que quien cuyo donde yo él ella ellos nos
""".split()) - {"no", "near", "all", "one", "two", "new", "e", "o", "u", "d", "l", "n", "s"} | {"one", "all"}
#: How many tokens away a function word still makes a word part of a sentence.
REACH = 3

_LABEL = re.compile(r"\s*(?:[-*•+]\s*)?[^\W\d_][\w /-]{0,24}:\s+\S")
_BULLET = re.compile(r"\s*(?:[-*•+–·‣>]|\[[ xX]?\]|\(?\d{1,3}[.)]|[a-z]\))\s+\S")
_PATH = re.compile(r"\s*(?:/[\w.~-]+)+/?\s*$")
_DELIMITERS = ("|", "\t", ";", ",", "<td>", "||")
_WORD = re.compile(r"[^\W_]+")


#: Labelled texts a model is fitted and tested on, at most, and the least that are enough.
MOST_LABELS, LEAST_LABELS = 20_000, 20
#: What the judgement looks at: the share of loose words, whether they are the most, layout, ratios.
FEATURES = ("loose_share", "loose_most", "alignment", "periodicity", "autocorrelation", "symbol_ratio", "digit_ratio", "lines_ending_in_punctuation", "common_word_share", "mean_word_length")


def _autocorrelation(lengths: list[int]) -> float:
    """Of line lengths at lag 1; 1 for equal lines, 0 for fewer than three."""
    if len(lengths) < 3:
        return 0.0
    x = np.array(lengths, float)
    x -= x.mean()
    whole = float(x @ x)
    return 1.0 if whole == 0 else float(x[1:] @ x[:-1]) / whole


def _row_of(line: str) -> tuple[str, int] | None:
    """Delimiter and number of cells of a line that could be a table row."""
    for d in _DELIMITERS:
        if (n := line.count(d)) >= 2:
            return d, n
    n = len(re.findall(r"\S {2,}(?=\S)", line))
    return ("  ", n) if n >= 1 else None


def _columns(line: str, delimiter: str) -> list[int]:
    if delimiter == "  ":
        return [m.end() for m in re.finditer(r"\S {2,}(?=\S)", line)]
    return [m.start() for m in re.finditer(re.escape(delimiter), line)]


def _below(above: str, line: str, delimiter: str) -> bool:
    """Whether the delimiters of a line stand in the columns, one to the side at most, of those of the line above."""
    return all(abs(x - y) <= 1 for x, y in zip(_columns(above, delimiter), _columns(line, delimiter)))


def _item_of(line: str) -> bool:
    """Whether an indented line is short and ends in no sentence, as no line of a wrapped paragraph but its last is."""
    return len(line.split()) <= 6 and line.rstrip()[-1:] not in (".", "!", "?", ",", ";", "…")


def layout(text: str) -> tuple[float, float, float, list[bool]]:
    """(alignment, periodicity, autocorrelation, structural) of a text of several lines.

    alignment: share of lines whose delimiters stand below those of the line before, half for as
    many that don't; periodicity: share of lines that begin as a line shortly before does, by mark
    or indentation; structural: for each line, whether it is a table
    row, list item or label-value line among others of its kind.
    """
    lines = text.split("\n")
    full = [k for k, x in enumerate(lines) if x.strip()]
    structural = [False] * len(lines)
    if len(full) < 2:
        return 0.0, 0.0, 0.0, structural
    rows = {k: _row_of(lines[k]) for k in full}
    indents = {k: len(x) - len(x.lstrip()) if (x := lines[k].expandtabs(4))[:2] == "  " else 0 for k in full}
    kinds = Counter(r for r in rows.values() if r)
    marks: dict[int, str] = {}
    for k in full:
        x = lines[k]
        if _PATH.match(x):
            marks[k] = "path"
        elif _BULLET.match(x):
            marks[k] = "bullet"
        elif _LABEL.match(x) and len(x.split()) <= 8:
            marks[k] = "label"
    indented = {k: x for k, d in indents.items() if d and (x := _item_of(lines[k])) and k not in marks}
    if len(indented) >= 3 and len(indented) * 3 >= 2 * sum(d > 0 for d in indents.values()):  # else a wrapped paragraph
        marks |= dict.fromkeys(indented, "indent")
    aligned = sum(1.0 if _below(lines[a], lines[k], rows[k][0]) else 0.5 for a, k in zip(full, full[1:]) if rows[k] and rows[k] == rows[a])
    tabular = {k for k in full if rows[k] and kinds[rows[k]] >= 3 and (rows[k][0] != "," or _few_function_words(lines[k]))}
    counts = Counter(marks.values())
    period = sum(any(marks.get(k) and marks.get(k) == marks.get(j) for j in full[max(0, i - 2):i]) for i, k in enumerate(full)) / len(full)
    for k in full:
        kind = marks.get(k)
        if k in tabular:
            structural[k] = True
        elif kind == "indent":
            structural[k] = any(indents[j] == indents[k] and marks.get(j) == "indent" for j in full if 0 < abs(j - k) <= 3)
        elif kind == "label":
            structural[k] = counts["label"] >= 3 and counts["label"] * 3 >= 2 * (len(full) - 1)
        elif kind:
            structural[k] = counts[kind] >= 3 and _few_function_words(lines[k])
    return aligned / len(full), period, _autocorrelation([len(lines[k]) for k in full]), structural


def _few_function_words(line: str) -> bool:
    w = _WORD.findall(line.lower())
    return sum(x in FUNCTION_WORDS for x in w) * 4 <= len(w)


_FIELDS = [("n_words", pa.int64()), ("n_chars", pa.int64()), ("mean_word_length", pa.float64()), ("symbol_ratio", pa.float64()), ("digit_ratio", pa.float64()),
           ("lines_ending_in_punctuation", pa.float64()), ("common_word_share", pa.float64()), ("alignment", pa.float64()), ("periodicity", pa.float64()),
           ("autocorrelation", pa.float64()), ("loose_words", pa.int64())]
SCHEMA = ", ".join(f"{n} {'long' if t == pa.int64() else 'double'}" for n, t in _FIELDS)


def _nearest(flag: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Distance of each token to the nearest flagged token of its text."""
    n = len(flag)
    at, far = np.arange(n), 1 << 30
    back = np.maximum.accumulate(np.where(flag, at, -1))
    ahead = np.minimum.accumulate(np.where(flag, at, n)[::-1])[::-1]
    behind = np.where((back >= 0) & (owner[np.maximum(back, 0)] == owner), at - back, far)
    before = np.where((ahead < n) & (owner[np.minimum(ahead, n - 1)] == owner), ahead - at, far)
    return np.minimum(behind, before)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of a batch of texts."""
    n = len(texts)
    # tokens between blanks; line ends are tokens of their own, so that a token knows its line
    body = pc.utf8_trim(pc.replace_substring_regex(pc.replace_substring(texts, "\n", " \x01 "), r"[^\S\x01]+", " "), " ")
    lists = pc.split_pattern(body, " ")
    values, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    coded = values.dictionary_encode()
    known = coded.dictionary
    low = pc.utf8_lower(known)
    words = pc.count_substring_regex(low, r"[\p{L}\p{N}]+").to_numpy(zero_copy_only=False).astype(np.int64)
    letters = pc.utf8_length(pc.replace_substring_regex(low, NOT_WORD, "")).to_numpy(zero_copy_only=False).astype(np.int64)
    digits = pc.count_substring_regex(low, r"\p{N}").to_numpy(zero_copy_only=False).astype(np.int64)
    length = pc.utf8_length(known).to_numpy(zero_copy_only=False).astype(np.int64)
    bare = pc.utf8_trim(low, "()[]{}.,;:!?\"'“”„»«…-–—*_")
    common = pc.is_in(bare, value_set=pa.array(sorted(FUNCTION_WORDS), bare.type)).to_numpy(zero_copy_only=False)
    elided = pc.match_substring_regex(low, r"^[ldnsjcmt]['’]\p{L}|^\p{L}+['’](?:s|t|re|m|ll|ve|d)\b").to_numpy(zero_copy_only=False)
    newline = pc.equal(known, "\x01").to_numpy(zero_copy_only=False)
    at = coded.indices.to_numpy()
    stop, size = (common | elided)[at], words[at]
    loose = (_nearest(stop, owner) > REACH) if len(at) else np.zeros(0, bool)
    line = np.zeros(len(at), np.int64)
    if len(at):
        breaks = np.cumsum(newline[at])
        line = breaks - np.r_[0, breaks][np.repeat(offsets[:-1], np.diff(offsets))]
    add = lambda x: np.bincount(owner, weights=x, minlength=n)
    n_words = add(size).astype(np.int64)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {"alignment": np.zeros(n), "periodicity": np.zeros(n), "autocorrelation": np.zeros(n)}
    several = np.flatnonzero(add(newline[at]) >= 1)
    for k, t in zip(several.tolist(), pc.take(texts, pa.array(several)).to_pylist()):
        # lines are counted as the tokens were: from the first that is not blank
        a, p, c, structural = layout(t.strip(" \t\r\f\v"))
        out["alignment"][k], out["periodicity"][k], out["autocorrelation"][k] = a, p, c
        if any(structural):
            i, j = offsets[k], offsets[k + 1]
            loose[i:j] |= np.array(structural, bool)[np.minimum(line[i:j], len(structural) - 1)]
    ends = pc.count_substring_regex(texts, r"[.!?:;…][\"'”»)]*[ \t\r]*(?:\n|\z)").to_numpy(zero_copy_only=False)
    lines = pc.count_substring_regex(texts, r"[^\n]*\S[^\n]*").to_numpy(zero_copy_only=False)
    safe = np.maximum(n_words, 1)
    total = add(length[at] * ~newline[at])
    return out | {
        "n_words": n_words, "n_chars": chars, "mean_word_length": add(letters[at]) / safe, "symbol_ratio": (total - add(letters[at])) / np.maximum(total, 1),
        "digit_ratio": add(digits[at]) / np.maximum(total, 1), "lines_ending_in_punctuation": ends / np.maximum(lines, 1),
        "common_word_share": add(stop * 1.0) / safe, "loose_words": add(size * loose).astype(np.int64)}


class Model:
    """A linear judgement over FEATURES, standardised; positive is prose."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, held: int = 0, wrong: int = 0, wrong_by_loose: int = 0):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias
        self.held, self.wrong, self.wrong_by_loose = held, wrong, wrong_by_loose

    @classmethod
    def of(cls, x: np.ndarray, prose: np.ndarray, steps: int = 60, ridge: float = 0.3) -> Model:
        """Ridge logistic regression by Newton steps."""
        mean, scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - mean) / scale]
        w, penalty = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (p - prose) + penalty @ w)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        return cls(mean, scale, w[1:], float(w[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.bias + (x - self.mean) / self.scale @ self.weights

    def column(self) -> Column:
        """The score as an expression over the columns of ``statistics``."""
        score = F.lit(self.bias - float(self.mean / self.scale @ self.weights))
        for name, w in zip(FEATURES, self.weights / self.scale):
            score = score + feature(name) * F.lit(float(w))
        return score


def feature(name: str) -> Column:
    if name == "loose_share":
        return F.col("loose_words") / F.greatest(F.col("n_words"), F.lit(1))
    if name == "loose_most":
        return (F.col("loose_words") * 2 > F.col("n_words")).cast("double")
    return F.col(name)


def fitted(df: DataFrame, labels: DataFrame, number: str = "find_id", text: str = "text", form: str = "form", prose: str = "prose", least: int = 15) -> Model | None:
    """A model of the labelled texts of ``df`` with ``least`` words or more, or None where labels are too few or of one kind.

    At most MOST_LABELS labels are taken, those of the least hash of their number; of several
    labels of a number the least counts. Half of them, by another bit of the hash, are fitted on;
    the model keeps the errors it makes on the other half, and those of the share of loose words alone.
    """
    once = labels.where(F.col(number).isNotNull() & F.col(form).isNotNull()).groupBy(F.col(number).alias("_n")).agg((F.min(F.lower(F.trim(form))) == prose).alias("_prose"))
    drawn = once.orderBy(F.xxhash64("_n"), "_n").limit(MOST_LABELS)
    own = df.select(F.col(number).alias("_n"), F.col(text).cast("string").alias("_t")).join(F.broadcast(drawn), "_n")  # MOST_LABELS rows at most
    measured = statistics(own, "_n", "_t", keep=("_prose",)).where(F.col("n_words") >= least).dropDuplicates(["_n"])
    rows = measured.select("_prose", (F.xxhash64("_n", F.lit(1)).bitwiseAND(F.lit(1)) == 1).alias("held"), *(feature(f).alias(f) for f in FEATURES)).collect()
    x, y, held = np.array([r[2:] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r[0] for r in rows], bool), np.array([r[1] for r in rows], bool)
    if len(rows) < LEAST_LABELS or len(set(y[~held].tolist())) < 2:
        return None
    model = Model.of(x[~held], y[~held])
    model.held, model.wrong = int(held.sum()), int(((model.score(x) > 0) != y)[held].sum())
    model.wrong_by_loose = int(((x[:, FEATURES.index("loose_most")] == 0) != y)[held].sum())
    return model


def statistics(df: DataFrame, number: str = "find_id", text: str = "text", model: Model | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(number, statistics, prose): one row for each row of ``df``; a NULL or empty text has zeros and is no prose.

    Texts are measured whole, in the task that reads them; nothing is moved. Other columns, but
    those to ``keep``, are neither read nor kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(plain(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[c], t) for c, t in _FIELDS), *b.columns[2:]], names=[number, *(c for c, _ in _FIELDS), *keep])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (number, *keep)}
    out = df.select(number, F.col(text).cast("string"), *keep).mapInArrow(run, f"`{number}` {kinds[number]}, {SCHEMA}" + "".join(f", `{c}` {kinds[c]}" for c in keep))
    fine = F.col("loose_words") * 2 <= F.col("n_words") if model is None else model.column() > 0
    return out.withColumn("prose", (F.col("n_words") > 0) & fine)


def not_prose(df: DataFrame, number: str = "find_id", text: str = "text", least: int = 15, model: Model | None = None) -> DataFrame:
    """Numbers of the texts of ``least`` words or more that are no sentences by ``model``, or, without one, most of whose words are loose."""
    return statistics(df, number, text, model).where((F.col("n_words") >= least) & ~F.col("prose")).select(number)
