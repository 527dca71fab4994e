"""The message log as a DataFrame, over the test tables; ``store`` has logs of one's own.

A log has global_seq, id, stream_id, seq, type, created_at, causation_id, correlation_id and the payload's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def message_id(global_seq) -> F.Column:
    return F.md5(global_seq.cast("string"))


def events_log(spark: SparkSession, sf_dir: str, causality: bool = False) -> DataFrame:
    """``events``: a stream for each user. With causality: a signup (or a stream's first message) starts a chain, in which
    each message is caused by the one before."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    gs = F.col("event_id") + 1
    log = e.select(
        gs.alias("global_seq"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("stream_id"),
        F.row_number().over(w).cast("long").alias("seq"),
        F.col("event_type").alias("type"),
        F.col("ts").alias("created_at"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        *([F.coalesce(F.max(F.when(F.col("event_type") == "signup", gs)).over(w), F.min(gs).over(w)).alias("root"), F.lag(gs).over(w).alias("prev")] if causality else []),
    )
    if not causality:
        return log
    cause = F.when(F.col("global_seq") == F.col("root"), F.col("global_seq")).otherwise(F.col("prev"))
    return log.withColumns({"id": message_id(F.col("global_seq")), "causation_id": message_id(cause), "correlation_id": message_id(F.col("root"))}).drop("root", "prev")


#: The same for the oracle.
EVENTS_SQL = """select event_id + 1 as global_seq, concat('user-', user_id) as stream_id,
  row_number() over (partition by user_id order by event_id) as seq, event_type as type, ts as created_at, value,
  cast(json_extract_string(props, '$.k') as bigint) as k from events"""
CAUSAL_SQL = f"""select *, md5(cast(global_seq as varchar)) as id,
  md5(cast(case when global_seq = root then global_seq else prev end as varchar)) as causation_id, md5(cast(root as varchar)) as correlation_id
  from (select *, coalesce(max(case when type = 'signup' then global_seq end) over w, min(global_seq) over w) as root, lag(global_seq) over w as prev
        from ({EVENTS_SQL}) window w as (partition by stream_id order by seq rows unbounded preceding))"""


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` and ``orders``: a stream for each order, an item_added for each line, then order_placed unless the order is open."""
    lines = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    items = lines.select(F.col("l_orderkey").alias("order_key"), F.row_number().over(w).cast("long").alias("seq"), F.lit("item_added").alias("type"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    placed = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("order_key"))
    counts = lines.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.count("*").alias("n"))
    placed = placed.join(counts, "order_key", "left").select("order_key", (F.coalesce("n", F.lit(0)) + 1).alias("seq"), F.lit("order_placed").alias("type"), F.lit(0).cast("long").alias("cents"))
    return items.unionByName(placed).select(F.concat(F.lit("order-"), F.col("order_key").cast("string")).alias("stream_id"), "seq", "type", "cents")


ORDERS_SQL = """select concat('order-', order_key) as stream_id, seq, type, cents from (
  select l_orderkey as order_key, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as seq,
    'item_added' as type, cast(round(l_extendedprice * 100) as bigint) as cents from lineitem
  union all
  select o_orderkey, coalesce(n, 0) + 1, 'order_placed', 0 from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey
  where o_orderstatus <> 'O')"""


def offsets(log: DataFrame) -> DataFrame:
    """Consumer offsets made up from a log, for queries over the test tables: three groups, a fifth of the streams of each without one."""
    streams = log.groupBy("stream_id").agg(F.max("global_seq").alias("top"))
    n = F.substring_index("stream_id", "-", -1).cast("long")
    g = F.explode(F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)]))
    rows = streams.select("stream_id", "top", n.alias("n"), g.alias("g")).where("(n + g) % 5 <> 0")
    return rows.select(
        F.concat(F.lit("group"), F.col("g").cast("string")).alias("group_id"),
        "stream_id",
        F.floor(F.col("top") * F.col("g") / 4).cast("long").alias("global_seq"),
        F.floor(F.col("top") * 0.8).cast("long").alias("high_water"),
        ((F.col("n") + F.col("g")) % 7 == 0).alias("claimed"),
        F.when((F.col("n") + F.col("g")) % 7 == 0, F.to_timestamp_ntz(F.lit("2024-01-19 23:50:00")) + F.make_dt_interval(mins=(F.col("n") % 20).cast("int"))).alias("claimed_at"),
        F.when((F.col("n") + F.col("g")) % 7 == 0, F.concat(F.lit("worker"), (F.col("n") % 3).cast("string"))).alias("claimed_by"),
    )


OFFSETS_SQL = f"""select concat('group', g) as group_id, stream_id, cast(floor(top * g / 4.0) as bigint) as global_seq, cast(floor(top * 0.8::double) as bigint) as high_water,
  (n + g) % 7 = 0 as claimed, case when (n + g) % 7 = 0 then timestamp '2024-01-19 23:50:00' + to_minutes(cast(n % 20 as integer)) end as claimed_at, case when (n + g) % 7 = 0 then concat('worker', n % 3) end as claimed_by
  from (select stream_id, max(global_seq) as top, cast(split_part(stream_id, '-', 2) as bigint) as n from ({EVENTS_SQL}) group by stream_id)
  cross join (values (1), (2), (3)) as t(g) where (n + g) % 5 <> 0"""


def groups(spark: SparkSession) -> DataFrame:
    rows = [("group1", "active", None, 0), ("group2", "active", "2030-01-01 00:00:00", 2), ("group3", "stopped", None, 1), ("group4", "active", None, 0)]
    return spark.createDataFrame(rows, "group_id string, status string, retry_at string, retries long").withColumn("retry_at", F.to_timestamp_ntz("retry_at"))


GROUPS_SQL = """select * from (values ('group1', 'active', cast(null as timestamp), 0), ('group2', 'active', timestamp '2030-01-01', 2),
  ('group3', 'stopped', null, 1), ('group4', 'active', null, 0)) as t(group_id, status, retry_at, retries)"""
