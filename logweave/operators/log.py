"""Queries over the log: reading, appending, scheduling, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


class ConcurrentAppendError(Exception):
    """(stream_id, seq) is taken."""


def read_stream(log: DataFrame, stream_id: str, after: int | None = None, upto: int | None = None) -> DataFrame:
    out = log.where(F.col("stream_id") == stream_id)
    out = out if after is None else out.where(F.col("seq") > after)
    out = out if upto is None else out.where(F.col("seq") <= upto)
    return out.orderBy("global_seq")


def history_for(log: DataFrame, of, after: int | None = None, upto: int | None = None) -> DataFrame:
    """The history of a stream, given by its id or by anything that has a ``stream_id`` or an ``id``."""
    stream_id = of if isinstance(of, str) else getattr(of, "stream_id", None) or getattr(of, "id", None)
    if not isinstance(stream_id, str):
        raise TypeError(f"{of!r} names no stream")
    return read_stream(log, stream_id, after, upto)


def correlation_batch(log: DataFrame, message_id: str) -> DataFrame:
    """All messages that share the correlation of one; none if it is unknown."""
    of = log.where(F.col("id") == message_id).select("correlation_id")
    return log.join(of, "correlation_id", "left_semi").orderBy("global_seq")


def recent_streams(log: DataFrame, limit: int = 10) -> DataFrame:
    """The streams with the latest messages; ties by stream id."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    by = log.groupBy("stream_id").agg(F.max("seq").alias("seq"), F.max("created_at").alias("updated_at"))
    return by.orderBy(F.desc("updated_at"), "stream_id").limit(limit)


def log_stats(log: DataFrame) -> DataFrame:
    """Streams, and the log's last number: null for an empty log."""
    return log.agg(F.countDistinct("stream_id").alias("stream_count"), F.max("global_seq").alias("max_global_seq"))


def consumer_stats(groups: DataFrame, offsets: DataFrame) -> DataFrame:
    """Per group: oldest and newest offset over zero and the streams that have one; groups without any count 0."""
    used = offsets.where("global_seq > 0").groupBy("group_id").agg(F.min("global_seq").alias("lo"), F.max("global_seq").alias("hi"), F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    return groups.join(used, "group_id", "left").select("group_id", "status", "retry_at", F.coalesce("lo", zero).alias("oldest_processed"), F.coalesce("hi", zero).alias("newest_processed"), F.coalesce("n", zero).alias("stream_count"))


def heads(log: DataFrame) -> DataFrame:
    """The last number of each stream and when it got a message: what appending needs of a log."""
    return log.groupBy("stream_id").agg(F.max("seq").alias("seq"), F.max("created_at").alias("updated_at"))


def advanced(heads_: DataFrame, appended: DataFrame) -> DataFrame:
    """Heads after messages were appended, so that the log itself isn't read again."""
    return heads_.unionByName(heads(appended)).groupBy("stream_id").agg(F.max("seq").alias("seq"), F.max("updated_at").alias("updated_at"))


def append_next(log: DataFrame, messages: DataFrame, order: str = "arrival", heads_: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """Messages numbered on: seq after the stream's last, in order of arrival; global_seq after the log's last.

    Streams are numbered apart. The global number needs one order over all that is appended: arrival ranges are counted,
    then numbered within, so no task sees all rows. With ``heads_`` and ``top`` (as ``sources.store`` keeps them) the log isn't read.
    """
    last = (heads(log) if heads_ is None else heads_).select("stream_id", F.col("seq").alias("last"))
    w = Window.partitionBy("stream_id").orderBy(order)
    rows = messages.withColumn("_n", F.row_number().over(w).cast("long")).join(last, "stream_id", "left")
    rows = rows.withColumn("seq", F.coalesce("last", F.lit(0)) + F.col("_n")).drop("last", "_n")
    if top is None:
        top = log.agg(F.coalesce(F.max("global_seq"), F.lit(0)).alias("top")).first()["top"]
    return with_global_seq(rows, order, top)


def with_global_seq(rows: DataFrame, order: str, start: int) -> DataFrame:
    """global_seq from start + 1 in the order of a column of unique values, by counts of ranges and numbers within them."""
    ranged = written(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    base, total = {}, start
    for p in sorted(sizes):
        base[p], total = total, total + sizes[p]
    if not base:
        return ranged.withColumn("global_seq", F.lit(0).cast("long")).drop("_p")
    lookup = F.create_map(*[x for p, n in base.items() for x in (F.lit(p), F.lit(n))])
    w = Window.partitionBy("_p").orderBy(order)
    return ranged.withColumn("global_seq", (lookup[F.col("_p")] + F.row_number().over(w)).cast("long")).drop("_p")


def append_conflicts(log: DataFrame, messages: DataFrame) -> DataFrame:
    """(stream_id, seq) of messages that the log has already, or that come twice."""
    taken = messages.join(log.select("stream_id", "seq"), ["stream_id", "seq"], "left_semi").select("stream_id", "seq")
    twice = messages.groupBy("stream_id", "seq").count().where("count > 1").select("stream_id", "seq")
    return taken.unionByName(twice).distinct()


def append_after(log: DataFrame, messages: DataFrame) -> DataFrame:
    """The log with messages of one stream whose callers chose seq: all, or none and ConcurrentAppendError."""
    if len(messages.select("stream_id").distinct().limit(2).collect()) > 1:
        raise ValueError("messages of one stream at a time")
    if not append_conflicts(log, messages).isEmpty():
        raise ConcurrentAppendError("stream_id, seq")
    return log.unionByName(messages, allowMissingColumns=True)


def schedule(messages: DataFrame, at, now, start: int = 0, order: str = "id") -> DataFrame:
    """Messages as rows of the schedule: schedule_id from start + 1 in order, available ``at`` (a time or a column), and
    metadata (a map) with ``scheduled_at``."""
    when = F.col(at) if isinstance(at, str) else F.lit(at)
    old = F.col("metadata") if "metadata" in messages.columns else F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: k != "scheduled_at")
    metadata = F.map_concat(kept, F.create_map(F.lit("scheduled_at"), F.lit(now).cast("string")))
    rows = messages.withColumns({"available_at": when, "metadata": metadata})
    return with_global_seq(rows, order, start).withColumnRenamed("global_seq", "schedule_id")


def due(scheduled: DataFrame, now, limit: int | None = 100) -> DataFrame:
    """Scheduled messages to promote: available by ``now``, the first by id. The limit is the feature: one round's share."""
    rows = scheduled.where(F.col("available_at") <= F.lit(now)).orderBy("schedule_id")
    return rows if limit is None else rows.limit(limit)


def promote(log: DataFrame, scheduled: DataFrame, now, limit: int | None = 100) -> tuple[DataFrame, DataFrame]:
    """(messages appended, what stays scheduled): due messages get created_at = now and the next numbers of their streams."""
    taken = due(scheduled, now, limit)
    rest = scheduled.join(taken.select("schedule_id"), "schedule_id", "left_anti")
    return append_next(log, taken.withColumn("created_at", F.lit(now)), "schedule_id"), rest
