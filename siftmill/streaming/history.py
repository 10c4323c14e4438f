"""Recently opened projects per user: newest visit per project, five minutes long, twenty at most."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Workers get these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Age limit and list length.
TTL_SECONDS, MAX_ENTRIES = 300, 20


def recent_projects(visits: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS, limit: int = MAX_ENTRIES) -> DataFrame:
    """Visits (user_id, project, ts) to the list at time ``now``: (user_id, place, project, ts)."""
    fresh = visits.filter((F.col("ts") > now - F.make_dt_interval(secs=F.lit(ttl_seconds))) & (F.col("ts") <= now))
    newest = fresh.groupBy("user_id", "project").agg(F.max("ts").alias("ts"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "project"))
    return newest.withColumn("place", place).filter(F.col("place") <= limit)


def history_lists(visits: DataFrame, ttl_seconds: int = TTL_SECONDS, limit: int = MAX_ENTRIES) -> DataFrame:
    """The same list as of every user's own last visit."""
    last = visits.groupBy("user_id").agg(F.max("ts").alias("now"))
    joined = visits.join(last, "user_id")
    fresh = joined.filter(F.col("ts") > F.col("now") - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    newest = fresh.groupBy("user_id", "project").agg(F.max("ts").alias("ts"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "project"))
    return newest.withColumn("place", place).filter(F.col("place") <= limit)


def note_visits(known: dict[str, int], projects: list[str | None], times: list[int]) -> None:
    """Keep the newest time per project in ``known``; a dict, as one operation of pandas costs more than most users' visits."""
    for project, us in zip(projects, times, strict=True):
        if project is not None:
            known[project] = max(us, known.get(project, us))


def newest_first(known: dict[str, int], ttl: int, limit: int) -> tuple[list[str], list[int]]:
    """The projects seen less than ``ttl`` before the last one, newest first, then by name, and their times."""
    oldest = max(known.values()) - ttl
    kept = heapq.nsmallest(limit, ((-us, project) for project, us in known.items() if us > oldest))
    return [project for _, project in kept], [-us for us, _ in kept]


def stream_recent_projects(visits: DataFrame, ttl_seconds: int = TTL_SECONDS, limit: int = MAX_ENTRIES) -> DataFrame:
    """Running list per user over a stream of visits; state is at most ``limit`` pairs and expires by event time."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known: dict[str, int] = dict(zip(*state.get, strict=True)) if state.exists else {}
        for batch in batches:  # of Arrow, which may hold any number of visits
            note_visits(known, batch["project"].tolist(), batch["ts"].to_numpy("datetime64[us]").view("int64").tolist())
        if not known:
            return
        projects, times = newest_first(known, ttl_seconds * 1_000_000, limit)
        state.update((projects, times))
        state.setTimeoutTimestamp(max(times[0] // 1000, state.getCurrentWatermarkMs()) + ttl_seconds * 1000)
        yield pd.DataFrame({"user_id": key[0], "place": range(1, len(projects) + 1), "project": projects, "ts": np.array(times, "int64").view("datetime64[us]")})

    return (
        visits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{ttl_seconds} seconds").groupBy("user_id")
        .applyInPandasWithState(
            update, "user_id bigint, place int, project string, ts timestamp", "projects array<string>, times array<bigint>",
            "update", GroupStateTimeout.EventTimeTimeout,
        )
    )


def start_history(visits: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Keep every user's list as visits arrive: each micro-batch writes the lists that it changed, under its own number."""

    def write(lists: DataFrame, number: int) -> None:
        lists.write.mode("overwrite").parquet(f"{target}/batch={number}")

    lists = stream_recent_projects(visits)
    return lists.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_lists(spark: SparkSession, target: str) -> DataFrame:
    """The last list of every user: (user_id, place, project, ts)."""
    rows = spark.read.schema("user_id bigint, place int, project string, ts timestamp, batch bigint").parquet(target)
    return rows.join(rows.groupBy("user_id").agg(F.max("batch").alias("batch")), ["user_id", "batch"]).select("user_id", "place", "project", "ts")
