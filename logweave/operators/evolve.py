"""State of streams: folds over their events, in order of seq.

Cheapest first: commutative and last-value folds are plain aggregates, combined before the shuffle; ordered ones that
columns can say run as ``aggregate`` over the sorted events in the JVM; others run as Python over each stream, read in
order and never gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals(log: DataFrame, handlers: dict[str, Column]) -> DataFrame:
    """Per stream: last seq, and the sum of each handled type's amount."""
    amount = F.lit(0).cast("long")
    for type_, value in handlers.items():
        amount = F.when(F.col("type") == type_, value).otherwise(amount)
    return log.groupBy("stream_id").agg(F.max("seq").alias("seq"), F.sum(amount).alias("total"), F.count("*").alias("n"))


def last_of(log: DataFrame, *columns: str) -> DataFrame:
    return log.groupBy("stream_id").agg(F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in columns])


def fold(log: DataFrame, zero: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column], columns: list[str], name: str = "state") -> DataFrame:
    """Ordered fold by an expression; a stream's events are one row meanwhile, so use ``fold_stream`` for streams beyond memory."""
    events = F.sort_array(F.collect_list(F.struct("seq", *columns)))
    return log.groupBy("stream_id").agg(events.alias("_e"), F.max("seq").alias("seq")).select("stream_id", "seq", F.aggregate("_e", zero, step, finish).alias(name))


def fold_handlers(log: DataFrame, zero: Column, handlers: dict[str, Callable], columns: list[str], before: Callable | None = None, name: str = "state") -> DataFrame:
    """Ordered fold by a handler for each type: f(state, event) -> state, both columns. ``before`` runs ahead of every handled
    event; events that no handler is for leave the state alone, and count for the stream's seq only."""

    def step(a: Column, e: Column) -> Column:
        out = a
        for type_, f in handlers.items():
            out = F.when(e["type"] == type_, f(before(a, e) if before else a, e)).otherwise(out)
        return out

    return fold(log, zero, step, lambda a: a, list(dict.fromkeys(["type", *columns])), name)


def fold_stream(log: DataFrame, zero: Callable, step: Callable, columns: list[str], schema: str) -> DataFrame:
    """Ordered fold in Python: step(state, row) -> state, a tuple of the schema's columns after stream_id and seq.

    Streams are read one after another from sorted partitions: memory holds one state, whatever a stream's length.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, seq, state = None, 0, None
        names = None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.stream_id != at:
                    if at is not None:
                        out.append((at, seq, *state))
                    at, state = row.stream_id, zero()
                state, seq = step(state, row), row.seq
            names = names or [x.split()[0] for x in f"stream_id string, seq long, {schema}".split(", ")]
            yield pd.DataFrame(out, columns=names)
        if at is not None:
            yield pd.DataFrame([(at, seq, *state)], columns=names)

    rows = log.select("stream_id", "seq", *columns).repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return rows.mapInPandas(run, f"stream_id string, seq long, {schema}")


def since_last(log: DataFrame, reset_type: str, value: Column) -> DataFrame:
    """Running state per event of a fold that a type resets: the sum since the last reset."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    rows = log.withColumn("_era", F.count(F.when(F.col("type") == reset_type, 1)).over(w))
    v = Window.partitionBy("stream_id", "_era").orderBy("seq")
    return rows.withColumn("state", F.sum(F.when(F.col("type") == reset_type, 0).otherwise(value)).over(v)).drop("_era")


def sequence_errors(messages: DataFrame) -> DataFrame:
    """Messages whose seq doesn't rise in their stream, in order of arrival."""
    before = F.max("seq").over(Window.partitionBy("stream_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    return messages.withColumn("_b", before).where("seq <= _b").drop("_b")


def incremental(snapshot: DataFrame, news: DataFrame) -> DataFrame:
    """totals() of a log from the snapshot of an earlier part and the totals of the rest."""
    return snapshot.unionByName(news).groupBy("stream_id").agg(F.max("seq").alias("seq"), F.sum("total").alias("total"), F.sum("n").alias("n"))
