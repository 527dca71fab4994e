"""Messages that follow others, reactions, actions, decisions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


class InfiniteCascadeError(Exception):
    """A cascade made more messages than its limit."""


def follow(parents: DataFrame, type_: str | Column, ordinal: str | Column = "0", stream: Column | None = None, payload: Column | None = None, metadata: Column | None = None, at: Column | None = None) -> DataFrame:
    """A message for each parent: caused by it, of its correlation, in its stream and of its time unless others are given;
    ids derive from the parent's, so that doing it again makes the same messages.

    ``payload`` is JSON, ``{}`` if not given; ``metadata``, a map, is merged over the parent's. Both are columns of the
    result if given or if the parents have them.
    """
    kind = F.lit(type_) if isinstance(type_, str) else type_
    n = F.lit(ordinal) if isinstance(ordinal, str) else ordinal
    more = []
    if payload is not None or "payload" in parents.columns:
        more.append(F.coalesce(payload if payload is not None else F.lit(None), F.lit("{}")).alias("payload"))
    if metadata is not None or "metadata" in parents.columns:
        none = F.create_map().cast("map<string,string>")
        old = F.coalesce("metadata", none) if "metadata" in parents.columns else none
        more.append((with_metadata(old, F.coalesce(metadata, none)) if metadata is not None else old).alias("metadata"))
    return parents.select(
        F.md5(F.concat_ws(":", F.col("id"), kind, n)).alias("id"),
        (F.col("stream_id") if stream is None else F.coalesce(stream, "stream_id")).alias("stream_id"),
        kind.alias("type"),
        F.col("id").alias("causation_id"),
        F.col("correlation_id"),
        (F.col("created_at") if at is None else F.greatest("created_at", at)).alias("created_at"),
        *more,
    )


def causation_depth(log: DataFrame) -> DataFrame:
    """How many causes stand above each message, by its causation_id; 0 if it caused itself or its cause isn't in the log.

    Pointers double: each round a message learns of the ancestor twice as far, so rounds grow with the logarithm of the
    longest chain. Messages whose causes run in a circle have no depth and are left out.
    """
    ids = log.select("id", "global_seq", F.col("causation_id").alias("up"))
    known = ids.select(F.col("id").alias("_id"))
    p = ids.join(known, ids["up"] == known["_id"], "left")
    p = p.select("id", "global_seq", F.when(F.col("_id") != F.col("id"), F.col("_id")).alias("up"))
    p = written(p.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), "depth")
    left = p.where("up is not null").count()
    while left:
        above = p.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        p = written(p.join(above, p["up"] == above["_id"], "left").select("id", "global_seq", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")), "depth")
        now = p.where("up is not null").count()
        if now == left:  # circles
            break
        left = now
    return p.where("up is null").select("id", "global_seq", "depth")


def ancestors(log: DataFrame, message_id: str) -> DataFrame:
    """The chain of causes of one message, itself among them, however long; pointers double within its correlation."""
    from .log import correlation_batch

    jump = written(correlation_batch(log, message_id).where("causation_id <> id").select(F.col("id").alias("a"), F.col("causation_id").alias("b")), "jumps")
    found, size = log.where(F.col("id") == message_id).select("id").distinct(), 0
    while True:
        found = written(found.unionByName(found.join(jump, found["id"] == jump["a"]).select(F.col("b").alias("id"))).distinct(), "chain")
        now = found.count()
        if now == size:  # nothing was that far, or all that is further is known: chains have no gaps
            break
        size = now
        far = jump.select(F.col("a").alias("c"), F.col("b").alias("d"))
        jump = written(jump.join(far, jump["b"] == far["c"]).select("a", F.col("d").alias("b")), "jumps")
    return log.join(found, "id", "left_semi")


def cascade(first: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int = 100) -> DataFrame:
    """Messages and all that ``step`` makes of them, level by level until a level is empty, with ``level``.

    Messages of one cascade (correlation_id) beyond ``limit`` raise InfiniteCascadeError, and nothing is given: the limit
    counts messages, not levels.
    """
    out = at = written(first.withColumn("level", F.lit(0)), "cascade")
    level = 0
    while not at.isEmpty():
        if not out.groupBy("correlation_id").count().where(F.col("count") > limit).isEmpty():
            raise InfiniteCascadeError(f"over {limit} messages")
        level += 1
        at = written(step(at.drop("level")).withColumn("level", F.lit(level)), "cascade")
        out = out.unionByName(at)
    return out


@dataclass(frozen=True)
class Dispatch:
    """A command that a handler dispatches for an event: its type, when, and what it has other than the event."""

    type: str
    when: Column | None = None
    payload: Column | None = None
    to: Column | None = None
    at: Column | None = None
    metadata: Column | None = None


def reactions(log: DataFrame, handlers: list[tuple[list[str] | None, list]], producer: str | None = None) -> DataFrame:
    """Commands that handlers dispatch: (types, [Dispatch or (command type, condition)]). types None: a catch-all, for events no
    other handler names. ``producer``: the group's name, which goes into the commands' metadata."""
    named = sorted({t for types, _ in handlers if types for t in types})
    rich, commands = producer is not None, []
    for types, dispatched in handlers:
        mine = F.col("type").isin(types) if types else ~F.col("type").isin(named)
        for d in dispatched:
            d = d if isinstance(d, Dispatch) else Dispatch(*d)
            rich = rich or d.payload is not None or d.to is not None or d.at is not None or d.metadata is not None
            commands.append((mine if d.when is None else mine & d.when, d))
    none = lambda kind: F.lit(None).cast(kind)
    made = [
        F.when(
            when,
            F.struct(
                F.lit(n).alias("n"),
                F.lit(d.type).alias("type"),
                (none("string") if d.payload is None else d.payload).alias("payload"),
                (none("string") if d.to is None else d.to).alias("to"),
                (F.col("created_at") if d.at is None else d.at).alias("at"),
                (none("map<string,string>") if d.metadata is None else d.metadata).alias("metadata"),
            ),
        )
        for n, (when, d) in enumerate(commands)
    ]
    rows = log.withColumn("_c", F.explode(F.array_compact(F.array(*made))))
    if not rich:
        return follow(rows, F.col("_c.type"))
    metadata = F.col("_c.metadata")
    if producer is not None:
        made_by = F.create_map(F.lit("producer"), F.lit(producer))
        metadata = with_metadata(made_by, F.coalesce(metadata, F.create_map().cast("map<string,string>")))
    return follow(rows, F.col("_c.type"), "0", F.col("_c.to"), F.col("_c.payload"), metadata, F.col("_c.at"))


def actions(messages: DataFrame, now) -> DataFrame:
    """Where messages go: those created later than ``now`` are scheduled for then, the others appended next."""
    return messages.withColumn("action", F.when(F.col("created_at") > F.lit(now), "schedule").otherwise("append_next"))


def with_metadata(metadata: Column, more: Column) -> Column:
    """A map merged with another, whose values win."""
    return F.map_concat(F.map_filter(metadata, lambda k, v: ~F.array_contains(F.map_keys(more), k)), more)


def decide_running(commands: DataFrame, value: Column, limit: Column) -> DataFrame:
    """Decisions of one batch per stream with the state threaded through: each command is accepted while the running total
    stays within ``limit``, and the events it emits take the stream's next numbers."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    rows = commands.withColumn("total", F.sum(value).over(w))
    rows = rows.withColumn("accepted", F.col("total") <= limit)
    return rows.withColumn("event_seq", F.when(F.col("accepted"), F.count(F.when(F.col("accepted"), 1)).over(w)))
