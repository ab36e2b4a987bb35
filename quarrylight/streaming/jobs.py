"""Streaming forms: first-seen addresses, live line files, checkpointed reports, host cooldowns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrylight.functions import urls
from quarrylight.operators import relational as R
from quarrylight.sources import files
from quarrylight.sources.http import cooldown


def first_offers(offers: DataFrame) -> DataFrame:
    """Each address once, when it is first offered; state is kept by key, in the state store of the session."""
    key = urls.offered_key(F.col("urlhash"), F.col("url"))
    return offers.withColumn("key", key).where("key IS NOT NULL").dropDuplicates(["key"])


def offers_per_window(offers: DataFrame, time: str = "offered_at", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Offers a window of event time and kind; rows later than the watermark, or without time, are left out."""
    timed = offers.where(F.col(time).isNotNull()).withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("offers")).select(F.col("w.start").alias("window_start"), "kind", "offers")


def append_new(stream: DataFrame, column: str, path: str, checkpoint: str):
    """A query that appends new lines to files, each line once across runs."""

    def add(batch: DataFrame, _: int) -> None:
        files.append_new_lines(batch, column, path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def checkpointed_report(findings: DataFrame, render: Callable[[DataFrame, int], None], store: str, checkpoint: str, every: str = "120 seconds"):
    """A query that stores findings as they come and renders a partial report after each trigger."""

    def step(batch: DataFrame, n: int) -> None:
        at = f"{store}/batch={n}"
        batch.write.mode("overwrite").parquet(at)  # a repeated batch replaces itself
        render(batch.sparkSession.read.option("basePath", store).parquet(store), n)

    return findings.writeStream.foreachBatch(step).trigger(processingTime=every).option("checkpointLocation", checkpoint)


def throttle(responses: DataFrame) -> DataFrame:
    """(host, status, streak, wait) for each response (host, status, retry_after): the cooldown its host has earned.

    A rate limit lengthens the host's streak, any other answer ends it. Answers of a batch are
    taken in the order of the column ``at``, if there is one, ties by status; what arrives in a
    later batch counts as later.
    """
    timed = "at" in responses.columns

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        out = []
        if timed:  # numbers only: a host's answers of one batch
            frames = [pd.concat([f[["at", "status", "retry_after"]] for f in frames]).sort_values(["at", "status"], kind="stable")]
        for f in frames:
            for status, asked in zip(f["status"], f["retry_after"]):
                limited = status in (429, 503)
                streak = streak + 1 if limited else 0
                out.append((key[0], int(status), streak, cooldown(streak, None if pd.isna(asked) else str(asked)) if limited else 0.0))
        state.update((streak,))
        yield pd.DataFrame(out, columns=["host", "status", "streak", "wait"])

    return responses.groupBy("host").applyInPandasWithState(step, "host string, status int, streak int, wait double", "streak int", "append", GroupStateTimeout.NoTimeout)


def gallery_every(finds: DataFrame, write: Callable[[str], None], store: str, checkpoint: str):
    """A query that stores finds and rebuilds the gallery after each trigger."""
    from datetime import datetime

    from quarrylight.reports import gallery

    def render(whole: DataFrame, _: int) -> None:
        write(gallery(whole, datetime.now()))

    return checkpointed_report(finds, render, store, checkpoint)


def read_offers(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def fresh_only(batch: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The batch form of ``first_offers``, where state would grow without bound: an anti-join with a stored table."""
    return R.unseen(batch, seen, keys)
