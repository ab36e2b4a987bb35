"""The queries of this package by name, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import urls
from quarrylight.llm import leaks, mixing, neardup, pii, quality, repetition, residue, seen
from quarrylight.storage import table

#: Near-duplicates as the found-query states them; the operator's defaults are five words and 80 %.
FINDS = neardup.Join(run=3, percent=60, least=20)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "finds"), FINDS).select(F.col("a").alias("find_a"), F.col("b").alias("find_b"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "finds"), neardup.Join()).withColumnRenamed("id", "find_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    frontier = table(spark, d, "frontier")
    return seen.seen_before(frontier, "offer_id", urls.offered_key(F.col("urlhash"), F.col("url")))


def p2_error_rate(spark: SparkSession, d: str) -> DataFrame:
    frontier = table(spark, d, "frontier")
    return seen.error_report(frontier, "offer_id", urls.offered_key(F.col("urlhash"), F.col("url")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    finds = table(spark, d, "finds").where("score IS NOT NULL AND kind IS DISTINCT FROM 'ascii_art'")
    return quality.not_prose(finds, model=_model(spark, d))


def _model(spark: SparkSession, d: str) -> quality.Model | None:
    return quality.fitted(table(spark, d, "finds"), table(spark, d, "find_labels"))


def p3_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the fitted judgement on the labels it was not fitted on, and of the share of loose words alone; weights by feature."""
    m = _model(spark, d)
    rows = [(f, round(float(w), 6), m.held, m.wrong, m.wrong_by_loose) for f, w in zip(quality.FEATURES, m.weights)] if m else []
    return spark.createDataFrame(rows, "feature string, weight double, held_out int, wrong int, wrong_by_loose_words int")


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = quality.statistics(table(spark, d, "finds").where("score IS NOT NULL"), model=_model(spark, d))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.details(table(spark, d, "finds"), table(spark, d, "given_names"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "finds"), table(spark, d, "given_names"))


def p4_surrogates(spark: SparkSession, d: str) -> DataFrame:
    # the key of a deployment comes from its secret store; this one makes the query repeatable
    return pii.surrogates(table(spark, d, "finds"), b"public example key", table(spark, d, "given_names"))


def p4_surrogate_texts(spark: SparkSession, d: str) -> DataFrame:
    return pii.replaced(table(spark, d, "finds"), b"public example key", table(spark, d, "given_names"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.judged(table(spark, d, "finds")).select("find_id")


def p6_clean_finds(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "finds")).select("find_id", "kind", "domain")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("exact").select("doc_id", "item_id")


def p7_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("changed > 0").select("doc_id", "item_id", "windows", "changed")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), table(spark, d, "given_names"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents"), "doc_id", "text")


def p9_repetition(spark: SparkSession, d: str) -> DataFrame:
    out = repetition.measure(table(spark, d, "documents"), "doc_id", "text")
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_error_rate, p3_found, p3_held_out, p3_statistics, p4_found, p4_redacted, p4_surrogates, p4_surrogate_texts,
                                       p6_found, p6_clean_finds, p7_found, p7_reparameterised, p8_mix, p8_shares, p9_found, p9_repetition)}
