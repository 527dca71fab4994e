"""Live projections by Structured Streaming."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

#: Folders that a read model's keys are dealt to; a batch rewrites those it touches.
PARTS = 32


def projection(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """Per-user totals of ``events``, kept as state by a stream that takes all there is and ends; equal to the batch fold.

    Its checkpoint and output are in ``out``, by default a folder of its own in spark.checkpoint.dir.
    """
    out = out or f"{shared_dir(spark)}/projection-{uuid.uuid4().hex}"
    folder, _, name = path.rpartition("/")
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder)
    state = events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))
    upsert(state, out, ["user_id"])
    return read_model(spark, out)


def live_fold(events: DataFrame, zero: Callable, step: Callable, columns: list[str], schema: str, order: str = "seq", key: str = "stream_id", idle: str | None = None) -> DataFrame:
    """An ordered fold as a stream: step(state, row) -> state, a tuple of the schema's columns, for each row of a key in order.

    Each batch gives the state of the keys it touched. ``idle``, such as ``1 hour``: state that nothing touched so long is dropped.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(k, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        now = tuple(state.get) if state.exists else zero()
        for row in rows.itertuples(index=False):
            now = step(now, row)
        state.update(now)
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame([(*k, *now)], columns=[key, *names])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    rows = events.select(key, *dict.fromkeys([order, *columns]))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {dict(rows.dtypes)[key]}, {schema}", schema, "update", timeout)


def upsert(stream: DataFrame, out: str, key: list[str], parts: int = PARTS) -> None:
    """Runs a stream that gives changed rows to the end of what there is, merging them by key into the read model in ``out``.

    Keys are dealt to folders by hash; a batch writes anew the folders it touches, under its number, from those of earlier
    batches. So a batch done again replaces what it wrote, and readers see whole folders.
    """

    def publish(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        new = df.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")).persist()
        touched = [r["_part"] for r in new.select("_part").distinct().collect()]  # at most ``parts``
        if not touched:
            new.unpersist()
            return
        batch = new
        old = read_model(spark, out, n, touched)
        if old is not None:
            keys = new.select(*[F.col(k).alias(f"_{k}") for k in key])
            same = F.lit(True)
            for k in key:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            new = new.unionByName(old.join(keys, same, "left_anti"))
        new.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{out}/model/batch={n:09d}")
        batch.unpersist()

    query = stream.writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def read_model(spark: SparkSession, out: str, before: int | None = None, parts: list[int] | None = None) -> DataFrame | None:
    """What ``upsert`` keeps, from each part's last batch; with ``before`` and ``parts`` as that batch found it, None if nothing."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    root = jvm.org.apache.hadoop.fs.Path(f"{out}/model")
    fs = root.getFileSystem(conf)
    last: dict[int, str] = {}
    for batch in sorted(s.getPath().toString() for s in (fs.listStatus(root) if fs.exists(root) else [])):
        n = int(re.search(r"batch=(\d+)$", batch)[1])
        path = jvm.org.apache.hadoop.fs.Path(batch)
        if (before is None or n < before) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{batch}/_SUCCESS")):
            for s in fs.listStatus(path):
                if m := re.search(r"_part=(\d+)$", s.getPath().toString()):
                    last[int(m[1])] = s.getPath().toString()
    paths = {p: f for p, f in last.items() if parts is None or p in parts}
    if not paths:
        return None
    if before is None:
        return spark.read.parquet(*paths.values())
    rows = [spark.read.parquet(f).withColumn("_part", F.lit(p)) for p, f in paths.items()]
    return reduce(DataFrame.unionByName, rows)


def sink(stream: DataFrame, step, out: str, checkpoint: str):
    """Runs a stream to the end of what there is, writing ``step(batch)`` of each micro-batch under its number: a batch done
    again after a failure replaces what it wrote. ``step`` is any DataFrame function, such as reactions or run_actor."""

    def publish(df: DataFrame, n: int) -> None:
        step(df).write.mode("overwrite").parquet(f"{out}/batch={n:09d}")

    query = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
