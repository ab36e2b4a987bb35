"""Repetition inside a document, measured and judged by one Spark projection.

``METRICS`` names the ratios a document has; a *threshold table* says which values are too much.
``compile_table`` turns the table into columns, so that the whole judgement is a projection over
the scan: no user function, no exchange, one pass over each text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.match import let
from quarrylight.functions.words import words

#: Words in a run, and bits of a position within a document in a packed run.
RUN, POSITION_BITS = 5, 20

#: Common words of English, German, French and Spanish (fixed values).
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "that", "it", "was", "for", "on", "as", "with", "be", "at", "by", "this", "a", "an", "or", "not",
              "der", "die", "das", "und", "ist", "den", "von", "zu", "mit", "dem", "nicht", "ein", "eine", "auf", "für",
              "le", "la", "les", "et", "des", "est", "une", "un", "dans", "que", "pour", "sur", "par",
              "el", "los", "las", "y", "es", "una", "con", "para", "por", "del")


def _covered(starts: Column) -> Column:
    """Number of words in runs that begin at ``starts`` (sorted, a variable): each start adds up to RUN words."""
    end = F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-RUN).cast("long").alias("last")),
                      lambda acc, x: F.struct((acc["n"] + F.least(x - acc["last"], F.lit(RUN).cast("long"))).alias("n"), x.alias("last")))
    return end["n"]


def repeated_words(w: Column) -> Column:
    """Number of words of the array ``w`` that lie in a run of RUN words that also occurs starting earlier.

    Runs are hashed; hash and position are packed in one long each, so that a sort of longs puts
    equal runs together in the order of their positions. 44 hash bits stay for a document of up to
    a million words; longer ones are sorted as (hash, position) pairs with all 64.
    """
    n = F.size(w)
    low = (1 << POSITION_BITS) - 1
    hashes = F.transform(F.sequence(F.lit(0), n - RUN), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(RUN))))

    def of(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
        repeats = lambda p: F.transform(
            F.filter(p, lambda x, i: (i > 0) & (x.bitwiseXOR(F.get(p, F.greatest(i - 1, F.lit(0)))) <= low) & (x.bitwiseXOR(F.get(p, F.greatest(i - 1, F.lit(0)))) >= 0)),
            lambda x: x.bitwiseAND(F.lit(low)))
        return let(packed, lambda p: let(F.sort_array(repeats(p)), _covered))

    def long_of(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        repeats = lambda p: F.transform(F.filter(p, lambda x, i: (i > 0) & (x["h"] == F.get(p, F.greatest(i - 1, F.lit(0)))["h"])), lambda x: x["i"])
        return let(pairs, lambda p: let(F.sort_array(repeats(p)), _covered))

    # most documents repeat nothing: a hash set of longs says so before any sort
    body = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
               .when(n > low, long_of(h)).otherwise(of(h)))
    return F.when(n <= RUN, F.lit(0).cast("long")).otherwise(body)


def _repeated_units(units: Column) -> Column:
    """Share of non-blank units that equal an earlier one."""
    kept = F.filter(F.transform(units, lambda u: F.lower(F.trim(u))), lambda u: u != "")
    return let(kept, lambda k: F.when(F.size(k) > 0, 1 - F.size(F.array_distinct(k)) / F.size(k)).otherwise(F.lit(0.0)))


def metrics(text: Column, wanted: set[str] | None = None) -> Column:
    """A struct of a document's metrics (all, or those ``wanted``); NULL text counts as empty.

    Text and words are bound once by ``let``: a predicate that the optimizer pushes down or an
    outer projection then can't make Spark split the text again for each use.
    """

    def over(t: Column, w: Column, lines: Column) -> dict[str, Column]:
        chars, n = F.greatest(F.length(t), F.lit(1)), F.size(w)
        return {
            "n_words": n.cast("long"),
            "n_chars": F.length(t).cast("long"),
            "repeated_words": repeated_words(w),
            "line_share": _repeated_units(lines),
            "paragraph_share": _repeated_units(F.split(t, r"\n[ \t]*\n")),
            "sentence_share": _repeated_units(F.split(t, r"[.!?]+\s+|\n")),
            "symbol_ratio": F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]+", "")) / chars,
            "stop_ratio": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))) / F.greatest(n, F.lit(1)),
            "mean_line_length": chars / F.greatest(F.size(F.filter(lines, lambda x: F.trim(x) != "")), F.lit(1)),
        }

    def struct(t: Column, w: Column, lines: Column) -> Column:
        return F.struct(*(c.alias(k) for k, c in over(t, w, lines).items() if not wanted or k in wanted))

    whole = F.coalesce(text, F.lit(""))
    if wanted and wanted <= {"n_words", "repeated_words"}:
        return let(words(whole), lambda w: struct(F.lit(""), w, F.array()))
    return let(whole, lambda t: let(words(t), lambda w: let(F.split(t, "\n"), lambda lines: struct(t, w, lines))))


@dataclass(frozen=True)
class Threshold:
    """``metric`` compared by ``op`` (``>=``, ``<=``, ``>``, ``<``) with ``bound``; ``flag`` names the verdict."""

    flag: str
    metric: str
    op: str
    bound: float


#: The production table: a document is repetitive if all rules of its flag hold.
REPEATED = (Threshold("repetitive", "n_words", ">=", 50), Threshold("repetitive", "repeated_share", ">=", 0.3))
QUALITY = (*REPEATED,
           Threshold("symbols", "symbol_ratio", ">", 0.25),
           Threshold("few_stop_words", "n_words", ">=", 50), Threshold("few_stop_words", "stop_ratio", "<", 0.05),
           Threshold("short_lines", "n_words", ">=", 50), Threshold("short_lines", "mean_line_length", "<", 12),
           Threshold("repeated_lines", "line_share", ">", 0.3), Threshold("repeated_paragraphs", "paragraph_share", ">", 0.3))


def compile_table(table: tuple[Threshold, ...], m: Column) -> dict[str, Column]:
    """A boolean column for each flag of ``table`` over the metrics struct ``m``: its rules' conjunction."""
    compare = {">=": Column.__ge__, "<=": Column.__le__, ">": Column.__gt__, "<": Column.__lt__}
    out: dict[str, Column] = {}
    for rule in table:
        if rule.metric == "repeated_share":  # by integers, so that a share of exactly the bound is one
            test = compare[rule.op](m["repeated_words"] * 1000, m["n_words"] * round(rule.bound * 1000))
        else:
            test = compare[rule.op](m[rule.metric], F.lit(rule.bound))
        out[rule.flag] = out[rule.flag] & test if rule.flag in out else test
    return out


def measure(df: DataFrame, number: str, text: str, table: tuple[Threshold, ...] = QUALITY) -> DataFrame:
    """(number, metrics, repeated_share, flags) of every document; other columns are not read.

    A NULL, empty or short text has no repeated words and a share of 0. Repeated rows give
    repeated results.
    """
    out = df.select(F.col(number), F.inline(F.array(metrics(F.col(text)))))
    row = F.struct(*(F.col(c) for c in out.columns if c != number))
    return out.select("*", (F.col("repeated_words") / F.greatest(F.col("n_words"), F.lit(1))).alias("repeated_share"),
                      *(c.alias(k) for k, c in compile_table(table, row).items()))


def repetitive(df: DataFrame, number: str, text: str, table: tuple[Threshold, ...] = REPEATED) -> DataFrame:
    """Numbers of the documents for which every flag of the table holds: one filter over the scan."""
    wanted = ({r.metric for r in table} | {"n_words"}) - {"repeated_share"} | {"repeated_words"}

    def verdict(m: Column) -> Column:
        flags = list(compile_table(table, m).values())
        return flags[0] if len(flags) == 1 else F.forall(F.array(*flags), lambda x: x)

    return df.where(let(metrics(F.col(text), wanted), verdict)).select(number)
