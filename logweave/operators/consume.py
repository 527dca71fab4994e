"""Consumer groups: offsets, batches, replay, retries, claims."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bootstrap(log: DataFrame, groups: DataFrame, offsets: DataFrame) -> DataFrame:
    """Offsets of zero for streams that an active group has none for."""
    active = [r["group_id"] for r in groups.where("status = 'active'").select("group_id").collect()]  # a row for each reactor class
    ids = F.array(*[F.lit(g) for g in active]) if active else F.array().cast("array<string>")
    pairs = log.select("stream_id").distinct().select(F.explode(ids).alias("group_id"), "stream_id")
    return pairs.join(offsets, ["group_id", "stream_id"], "left_anti").select("group_id", "stream_id", F.lit(0).cast("long").alias("global_seq"))


def since(start_from, now: datetime) -> datetime | None:
    """The time that a group's start option stands for: ``beginning``, no bound; ``now``, five seconds ago, so that nothing is missed;
    a function, what it gives; else a time itself."""
    if start_from == "beginning":
        return None
    if start_from == "now":
        return now - timedelta(seconds=5)
    return start_from() if callable(start_from) else start_from


def gate(groups: DataFrame, now) -> DataFrame:
    """Groups that may work: active, and not waiting for a later retry."""
    return groups.where((F.col("status") == "active") & (F.col("retry_at").isNull() | (F.col("retry_at") <= F.lit(now))))


def pending(log: DataFrame, groups: DataFrame, offsets: DataFrame, now, types: list[str] | None = None, start_from=None) -> DataFrame:
    """Messages past their group's offset in unclaimed streams. types: those the reactor handles, of which an empty list has none;
    start_from: only messages created later."""
    rows = log if types is None else log.where(F.col("type").isin(types) if types else F.lit(False))
    rows = rows if start_from is None else rows.where(F.col("created_at") > F.lit(start_from))
    at = offsets.where("not claimed").join(gate(groups, now).select("group_id"), "group_id")
    at = at.select("group_id", "stream_id", F.col("global_seq").alias("offset"), "high_water")
    return rows.join(at, "stream_id").where(F.col("global_seq") > F.col("offset"))


def replaying() -> Column:
    """Whether a message was handled before: at or below the high-water mark of its stream."""
    return F.col("global_seq") <= F.col("high_water")


def replaying_in_group(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """``rows`` with ``replaying`` judged by the high-water mark of the whole group: marks are aggregated, a row for each group."""
    marks = offsets.groupBy("group_id").agg(F.max("high_water").alias("_mark"))
    rows = rows.join(F.broadcast(marks), "group_id", "left")  # a row for each reactor class
    return rows.withColumn("replaying", F.coalesce(F.col("global_seq") <= F.col("_mark"), F.lit(False))).drop("_mark")


def claim(offsets: DataFrame, batch: DataFrame, worker: str | Column, now) -> DataFrame:
    """Offsets with the streams of a batch claimed, by one worker or a column of the batch; claims that stand are not taken over."""
    by = F.lit(worker) if isinstance(worker, str) else worker
    mine = batch.groupBy("group_id", "stream_id").agg(F.min(by).alias("_by"))
    rows = offsets.join(mine, ["group_id", "stream_id"], "left")
    new = F.col("_by").isNotNull() & ~F.col("claimed")
    return rows.select(
        "group_id",
        "stream_id",
        "global_seq",
        "high_water",
        (F.col("claimed") | new).alias("claimed"),
        F.when(new, F.lit(now)).otherwise(F.col("claimed_at")).alias("claimed_at"),
        F.when(new, F.col("_by")).otherwise(F.col("claimed_by")).alias("claimed_by"),
    )


def claim_batch(pending_rows: DataFrame, size: int = 50) -> DataFrame:
    """The first ``size`` pending messages of every stream of a group, with ``replaying``: all streams at once."""
    w = Window.partitionBy("group_id", "stream_id").orderBy("global_seq")
    return pending_rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n").withColumn("replaying", replaying())


def with_history(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The whole stream of each message in the batch, with ``in_batch``."""
    streams = batch.select("group_id", "stream_id").distinct()
    flags = batch.select("group_id", "global_seq", F.lit(True).alias("in_batch"))
    return log.join(streams, "stream_id").join(flags, ["group_id", "global_seq"], "left").withColumn("in_batch", F.coalesce("in_batch", F.lit(False)))


def ack(offsets: DataFrame, acked: DataFrame) -> DataFrame:
    """Offsets moved to what was handled last (group_id, stream_id, global_seq), never back, claims released; high water follows."""
    new = acked.groupBy("group_id", "stream_id").agg(F.max("global_seq").alias("acked"))
    rows = offsets.join(new, ["group_id", "stream_id"], "full_outer")
    done = F.col("acked").isNotNull()
    return rows.select(
        "group_id",
        "stream_id",
        F.coalesce("acked", "global_seq").alias("global_seq"),
        F.greatest(F.coalesce("high_water", F.lit(0).cast("long")), F.coalesce("acked", F.lit(0).cast("long"))).alias("high_water"),
        (F.coalesce("claimed", F.lit(False)) & ~done).alias("claimed"),
        *([F.when(~done, F.col("claimed_at")).alias("claimed_at")] if "claimed_at" in offsets.columns else []),
        F.when(~done, F.col("claimed_by")).alias("claimed_by"),
    )


class ConcurrentAckError(Exception):
    """The message to acknowledge isn't there, or a worker has claimed its stream."""


def ack_on(log: DataFrame, offsets: DataFrame, group_id: str, message_id: str) -> DataFrame:
    """Offsets with one message of a group acknowledged."""
    one = log.where(F.col("id") == message_id).select(F.lit(group_id).alias("group_id"), "stream_id", "global_seq")
    if one.isEmpty() or not offsets.where("claimed").join(one.drop("global_seq"), ["group_id", "stream_id"], "left_semi").isEmpty():
        raise ConcurrentAckError(message_id)
    return ack(offsets, one)


def reset(offsets: DataFrame, group_id: str) -> DataFrame:
    """The group reads all again: offsets zero, claims gone, high water kept, so that what it had handled counts as replayed."""
    mine = F.col("group_id") == group_id
    new = {"global_seq": F.when(mine, F.lit(0).cast("long")).otherwise(F.col("global_seq")), "claimed": ~mine & F.col("claimed")}
    new |= {c: F.when(~mine, F.col(c)) for c in ("claimed_at", "claimed_by") if c in offsets.columns}
    return offsets.withColumns(new)


def register(groups: DataFrame, ids: list[str], now) -> DataFrame:
    """Groups with those of ``ids`` that weren't there, active."""
    spark = groups.sparkSession
    new = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "group_id string").join(groups.select("group_id"), "group_id", "left_anti")
    return groups.unionByName(new.select("group_id", F.lit("active").alias("status"), F.lit(0).cast("long").alias("retries"), F.lit(now).alias("updated_at")), allowMissingColumns=True).select(groups.columns)


def _updated(groups: DataFrame, group_id: str, new: dict[str, Column]) -> DataFrame:
    mine = F.col("group_id") == group_id
    return groups.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in new.items() if c in groups.columns})


def stop(groups: DataFrame, group_id: str, reason: str, now) -> DataFrame:
    """The group stopped, with the reason."""
    return _updated(groups, group_id, {"status": F.lit("stopped"), "error_context": F.to_json(F.struct(F.lit(reason).alias("reason"))), "updated_at": F.lit(now)})


def start(groups: DataFrame, group_id: str, now) -> DataFrame:
    """The group active again: no retry waits, errors and their count forgotten."""
    return _updated(groups, group_id, {"status": F.lit("active"), "retry_at": F.lit(None), "retries": F.lit(0), "error_context": F.lit(None), "updated_at": F.lit(now)})


def heartbeat(workers: DataFrame, ids: list[str], now) -> DataFrame:
    """Workers (id, last_seen) with those of ``ids`` seen now; unknown ones are added."""
    alive = workers.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string").withColumn("_now", F.lit(now))
    rows = workers.join(alive, "id", "full_outer")
    return rows.select(*[F.coalesce("_now", "last_seen").alias(c) if c == "last_seen" else F.col(c) for c in workers.columns])


def partial_ack(handled: DataFrame) -> DataFrame:
    """Of handled messages (group_id, stream_id, global_seq, failed), those before their stream's first failure."""
    first = F.min(F.when(F.col("failed"), F.col("global_seq"))).over(Window.partitionBy("group_id", "stream_id"))
    return handled.withColumn("_f", first).where("_f is null or global_seq < _f").drop("_f")


def after_error(groups: DataFrame, now, max_retries: int = 0, seconds: int = 3) -> DataFrame:
    """Groups after an error: retried at now + seconds times the count while that is within max_retries, else stopped."""
    count = F.col("retries") + 1
    again = count <= max_retries
    at = F.to_timestamp_ntz(F.lit(now)) + F.make_dt_interval(secs=(count * seconds).cast("decimal(18,6)"))
    return groups.select("group_id", F.when(again, F.col("status")).otherwise("stopped").alias("status"), F.when(again, at).otherwise(F.col("retry_at")).alias("retry_at"), F.when(again, count).otherwise(F.col("retries")).alias("retries"))


def release_stale(offsets: DataFrame, workers: DataFrame, cutoff) -> DataFrame:
    """Claims made by ``cutoff`` by workers that were last seen by then are let go; those of workers never seen stay."""
    stale = workers.where(F.col("last_seen") <= F.lit(cutoff)).select(F.col("id").alias("claimed_by"), F.lit(True).alias("_stale")).distinct()
    free = F.col("_stale").isNotNull() & F.col("claimed") & (F.col("claimed_at") <= F.lit(cutoff))
    free = F.coalesce(free, F.lit(False))
    rows = offsets.join(stale, "claimed_by", "left")
    new = {"claimed": F.col("claimed") & ~free, "claimed_at": F.when(~free, F.col("claimed_at")), "claimed_by": F.when(~free, F.col("claimed_by"))}
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in offsets.columns])
