"""Incremental forms of the batch steps. The batch steps are the contract; these feed them with what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import sinks


def first_seen(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first row of each key; state is dropped ``delay`` after the latest time seen."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Rows for each window and key; late rows count until ``delay`` after the window's end."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n")).select("window.start", "window.end", *keys, "n")


def fresh_systems(standards: DataFrame, today: str, days: int = 6) -> DataFrame:
    """Systems that were verified within ``days`` before ``today``, which need no new run."""
    last = standards.groupBy("system").agg(F.max(F.try_to_timestamp("last_verified_date", F.lit("yyyy-MM-dd")).cast("date")).alias("last"))
    return last.where(F.col("last") > F.date_sub(F.lit(today).cast("date"), days))


def embed_new(stream: DataFrame, done: Callable[[], DataFrame], embed: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Embeds rows of each micro-batch that ``done()`` does not have, and appends them; a repeated batch adds nothing twice
    since its ids are done by then."""

    def step(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["id"]).join(done().select("id"), "id", "left_anti")
        embed(new).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_new(stream: DataFrame, keys: list[str], at: str, root: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch merged into the current version of a table under ``root``: the latest row of each key wins.

    A version is named by its batch, so a batch that is repeated after a failure finds its version and changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"batch-{number}"
        rest = [c for c in batch.columns if c not in (*keys, at)]
        latest = lambda df: df.groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("m")).select(*keys, *(F.col(f"m.`{c}`").alias(c) for c in [at, *rest]))
        if sinks.has_version(spark, root, name):
            return
        old = sinks.read_current(spark, root) if sinks.has_version(spark, root) else batch.limit(0)
        sinks.write_version(latest(old.unionByName(batch)), root, name)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
