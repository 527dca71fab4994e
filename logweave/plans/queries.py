"""Queries over the test tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as N
from .. import reactors as R
from ..operators import consume as C
from ..operators import evolve as E
from ..operators import log as L
from ..operators import messages as M
from ..sources import log as S
from ..sources.store import invalid
from ..storage import written
from ..streaming import projection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: The time that stands for now.
NOW = "2024-01-20 00:00:00"
EV, CA, OF, GR, OR = S.EVENTS_SQL, S.CAUSAL_SQL, S.OFFSETS_SQL, S.GROUPS_SQL, S.ORDERS_SQL


def now(text: str = NOW):
    return F.to_timestamp_ntz(F.lit(text))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


MSG = ["global_seq", "stream_id", "seq", "type", "created_at"]
CHAIN = ["id", "global_seq", "stream_id", "causation_id", "correlation_id"]


@query(f"select {', '.join(MSG)} from ({EV}) where stream_id = 'user-7'")
def read_stream(spark, d):
    return L.read_stream(S.events_log(spark, d), "user-7").select(MSG)


@query(f"select {', '.join(MSG)} from ({EV}) where stream_id = 'user-7' and seq > 3 and seq <= 12")
def read_stream_bounds(spark, d):
    return L.read_stream(S.events_log(spark, d), "user-7", 3, 12).select(MSG)


@query("select conv_id, turn + 1 as seq, role as type, length(coalesce(text, '')) as n_chars, lag(turn + 1) over (partition by conv_id order by turn) as after from conversations")
def conversation_history(spark, d):
    """All conversations as streams, each message with the number of the one before it."""
    c = S.table(spark, d, "conversations").withColumn("seq", F.col("turn") + 1)
    after = F.lag("seq").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "seq", F.col("role").alias("type"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), after.alias("after"))


@query(f"select stream_id, max(seq) as seq, max(created_at) as updated_at from ({EV}) group by 1 order by updated_at desc, stream_id limit 10")
def recent_streams(spark, d):
    return L.recent_streams(S.events_log(spark, d))


@query(f"with l as ({CA}) select {', '.join(CHAIN)} from l where correlation_id in (select correlation_id from l where id = md5('100'))")
def correlation_batch(spark, d):
    return L.correlation_batch(S.events_log(spark, d, True), "f899139df5e1059396431415e770c6dd").select(CHAIN)


@query(f"select count(distinct stream_id) as stream_count, max(global_seq) as max_global_seq from ({EV})")
def log_stats(spark, d):
    return L.log_stats(S.events_log(spark, d))


@query(f"""select g.group_id, status, retry_at, coalesce(min(global_seq), 0) as oldest_processed, coalesce(max(global_seq), 0) as newest_processed,
  count(global_seq) as stream_count from ({GR}) g left join ({OF}) o on o.group_id = g.group_id and o.global_seq > 0 group by all""")
def consumer_stats(spark, d):
    return L.consumer_stats(S.groups(spark), S.offsets(S.events_log(spark, d)))


_OLD, _NEW = "created_at <= timestamp '2024-01-20'", "created_at > timestamp '2024-01-20'"


def _parts(spark, d):
    log = S.events_log(spark, d)
    return log.where(F.col("created_at") <= now()), log.where(F.col("created_at") > now())


@query(f"select stream_id, seq, type, global_seq from ({EV}) where {_NEW}")
def append_next_seq(spark, d):
    """The later part appended to the earlier one gets back the numbers that it has in the whole log."""
    old, new = _parts(spark, d)
    return L.append_next(old, new.select("stream_id", "type", F.col("global_seq").alias("arrival"))).select("stream_id", "seq", "type", "global_seq")


@query(f"select stream_id, max(seq) as seq, max(created_at) as updated_at from ({EV}) group by 1")
def stream_heads(spark, d):
    """Kept heads, advanced by what is appended, are those of the whole log."""
    old, new = _parts(spark, d)
    return L.advanced(L.heads(old), new)


@query(f"select stream_id, seq, type, global_seq from ({EV}) where {_NEW}")
def append_next_by_heads(spark, d):
    """Appending by the streams' heads alone: the log isn't read."""
    old, new = _parts(spark, d)
    top = old.agg(F.max("global_seq")).first()[0]
    return L.append_next(old, new.select("stream_id", "type", F.col("global_seq").alias("arrival")), heads_=L.heads(old), top=top).select("stream_id", "seq", "type", "global_seq")


@query(f"""with l as ({EV}), m as (select stream_id, seq - 5 as seq from l where {_NEW})
select distinct stream_id, seq from m semi join (select stream_id, seq from l where {_OLD}) using (stream_id, seq)""")
def append_conflicts(spark, d):
    old, new = _parts(spark, d)
    return L.append_conflicts(old, new.select("stream_id", (F.col("seq") - 5).alias("seq")))


@query(f"""select 500 + row_number() over (order by id) as schedule_id, id, stream_id, type, created_at + interval 2 days as available_at, '{NOW}' as scheduled_at
  from ({CA}) where type = 'signup'""")
def schedule_messages(spark, d):
    """Messages put on the schedule, numbered on from 500, two days after their time."""
    rows = S.events_log(spark, d, True).where("type = 'signup'").withColumn("due", F.expr("created_at + interval 2 days"))
    return L.schedule(rows, "due", now(), 500).select("schedule_id", "id", "stream_id", "type", "available_at", F.col("metadata")["scheduled_at"].alias("scheduled_at"))


def _scheduled(spark, d):
    return S.events_log(spark, d).where("type = 'view'").select(F.col("global_seq").alias("schedule_id"), "stream_id", "type", F.expr("created_at + interval 3 days").alias("available_at"))


_SCH = f"select global_seq as schedule_id, stream_id, type, created_at + interval 3 days as available_at from ({EV}) where type = 'view'"


@query(f"select * from ({_SCH}) where available_at <= timestamp '{NOW}' order by schedule_id limit 100")
def schedule_due(spark, d):
    return L.due(_scheduled(spark, d), now())


@query(f"""with s as ({_SCH}), due as (select * from s where available_at <= timestamp '{NOW}' order by schedule_id limit 100),
o as (select * from ({EV}) where {_OLD}), last as (select stream_id, max(seq) as last from o group by 1)
select stream_id, schedule_id, coalesce(last, 0) + row_number() over (partition by stream_id order by schedule_id) as seq,
  (select max(global_seq) from o) + row_number() over (order by schedule_id) as global_seq from due left join last using (stream_id)""")
def schedule_promoted(spark, d):
    old, _ = _parts(spark, d)
    return L.promote(old, _scheduled(spark, d), now())[0].select("stream_id", "schedule_id", "seq", "global_seq")


@query(f"with s as ({_SCH}) select * from s where schedule_id not in (select schedule_id from s where available_at <= timestamp '{NOW}' order by schedule_id limit 100)")
def schedule_remaining(spark, d):
    old, _ = _parts(spark, d)
    return L.promote(old, _scheduled(spark, d), now())[1]


def _consumer(spark, d):
    log = S.events_log(spark, d)
    return log, S.groups(spark), S.offsets(log)


@query(f"""select group_id, stream_id, 0::bigint as global_seq from (select group_id from ({GR}) where status = 'active')
cross join (select distinct stream_id from ({EV})) anti join ({OF}) using (group_id, stream_id)""")
def bootstrap_offsets(spark, d):
    return C.bootstrap(*_consumer(spark, d))


_PEND = f"""select l.global_seq, l.stream_id, l.seq, l.type, o.group_id, o.high_water from ({EV}) l join ({OF}) o using (stream_id) join ({GR}) g using (group_id)
  where l.global_seq > o.global_seq and not claimed and status = 'active' and (retry_at is null or retry_at <= timestamp '{NOW}')"""
PCOL = ["global_seq", "stream_id", "seq", "type", "group_id"]


@query(f"select {', '.join(PCOL)} from ({_PEND}) where type in ('purchase', 'error')")
def pending_messages(spark, d):
    return C.pending(*_consumer(spark, d), now(), ["purchase", "error"]).select(PCOL)


@query(f"select {', '.join(PCOL)} from ({_PEND}) where global_seq in (select global_seq from ({EV}) where created_at > timestamp '2024-01-25')")
def pending_window(spark, d):
    return C.pending(*_consumer(spark, d), now(), start_from=now("2024-01-25 00:00:00")).select(PCOL)


_CLAIM = f"select {', '.join(PCOL)}, global_seq <= high_water as replaying from ({_PEND}) qualify row_number() over (partition by group_id, stream_id order by global_seq) <= 5"


@query(_CLAIM)
def claim_batch(spark, d):
    return C.claim_batch(C.pending(*_consumer(spark, d), now()), 5).select(*PCOL, "replaying")


@query(f"""select o.group_id, o.stream_id, o.global_seq, o.claimed or b.stream_id is not null as claimed,
  case when b.stream_id is not null and not o.claimed then timestamp '{NOW}' else o.claimed_at end as claimed_at,
  case when b.stream_id is not null and not o.claimed then 'worker9' else o.claimed_by end as claimed_by
  from ({OF}) o left join (select distinct group_id, stream_id from ({_CLAIM})) b using (group_id, stream_id)""")
def claim_streams(spark, d):
    """Offsets with the streams of a batch claimed."""
    log, groups, offsets = _consumer(spark, d)
    batch = C.claim_batch(C.pending(log, groups, offsets, now()), 5)
    return C.claim(offsets, batch, "worker9", now()).drop("high_water")


@query(f"""with mark as (select group_id, max(high_water) as mark from ({OF}) group by 1)
select global_seq, stream_id, group_id, global_seq <= mark as replaying from ({_PEND}) join mark using (group_id)""")
def replay_flags_of_group(spark, d):
    """The group-wide mark: what any of the group's streams had reached counts as replayed."""
    log, groups, offsets = _consumer(spark, d)
    return C.replaying_in_group(C.pending(log, groups, offsets, now()), offsets).select("global_seq", "stream_id", "group_id", "replaying")


@query(f"""with b as ({_CLAIM}) select l.global_seq, l.stream_id, s.group_id, b.global_seq is not null as in_batch from ({EV}) l
join (select distinct group_id, stream_id from b) s using (stream_id) left join b on b.group_id = s.group_id and b.global_seq = l.global_seq""")
def claim_batch_history(spark, d):
    log, groups, offsets = _consumer(spark, d)
    batch = C.claim_batch(C.pending(log, groups, offsets, now()), 5)
    return C.with_history(log, batch).select("global_seq", "stream_id", "group_id", "in_batch")


_ACKED = f"select group_id, stream_id, max(global_seq) as acked from ({_CLAIM}) group by all"
_ACK = f"""select group_id, stream_id, coalesce(acked, global_seq) as global_seq, greatest(coalesce(high_water, 0), coalesce(acked, 0)) as high_water,
  claimed and acked is null as claimed from ({OF}) left join ({_ACKED}) using (group_id, stream_id)"""


@query(_ACK)
def ack_offsets(spark, d):
    log, groups, offsets = _consumer(spark, d)
    batch = C.claim_batch(C.pending(log, groups, offsets, now()), 5)
    return C.ack(offsets, batch).drop("claimed_at", "claimed_by")


@query(f"""with m as (select 'group1' as group_id, stream_id, global_seq as acked from ({CA}) where id = md5('120'))
select o.group_id, o.stream_id, coalesce(acked, global_seq) as global_seq, greatest(high_water, coalesce(acked, 0)) as high_water from ({OF}) o left join m using (group_id, stream_id)
union all select group_id, stream_id, acked, acked from m where not exists (select 1 from ({OF}) o where o.group_id = m.group_id and o.stream_id = m.stream_id)""")
def ack_one(spark, d):
    """One message acknowledged by its id."""
    log = S.events_log(spark, d, True)
    return C.ack_on(log, S.offsets(S.events_log(spark, d)).withColumn("claimed", F.lit(False)), "group1", "da4fb5c6e93e74d3df8527599fa62642").select("group_id", "stream_id", "global_seq", "high_water")


@query(f"select group_id, stream_id, case when group_id = 'group1' then 0 else global_seq end as global_seq, high_water from ({OF})")
def reset_group(spark, d):
    return C.reset(_consumer(spark, d)[2], "group1").select("group_id", "stream_id", "global_seq", "high_water")


@query(f"""select l.global_seq, l.stream_id, l.global_seq <= o.high_water as replaying from ({EV}) l join ({OF}) o using (stream_id)
where o.group_id = 'group1' and not o.claimed""")
def replay_flags(spark, d):
    """After a reset all is read again; what the stream had handled is flagged, and nothing else."""
    log, groups, offsets = _consumer(spark, d)
    rows = C.pending(log, groups, C.reset(offsets, "group1").where("group_id = 'group1'"), now())
    claimed = offsets.where("group_id = 'group1' and claimed").select("stream_id")
    return rows.join(claimed, "stream_id", "left_anti").select("global_seq", "stream_id", C.replaying().alias("replaying"))


@query(f"select group_id from ({GR}) where status = 'active' and (retry_at is null or retry_at <= timestamp '{NOW}')")
def retry_gate(spark, d):
    return C.gate(S.groups(spark), now()).select("group_id")


@query(f"""select group_id, case when retries + 1 <= 2 then status else 'stopped' end as status,
case when retries + 1 <= 2 then timestamp '{NOW}' + to_seconds((retries + 1) * 3) else retry_at end as retry_at,
case when retries + 1 <= 2 then retries + 1 else retries end as retries from ({GR})""")
def error_backoff(spark, d):
    return C.after_error(S.groups(spark), now(), 2, 3)


_STALE = "claimed and coalesce(claimed_at <= timestamp '2024-01-19 23:58:00' and claimed_by in ('worker1'), false)"


@query(f"""select group_id, stream_id, global_seq, claimed and not ({_STALE}) as claimed, case when not ({_STALE}) then claimed_at end as claimed_at,
  case when not ({_STALE}) then claimed_by end as claimed_by from ({OF})""")
def release_stale_claims(spark, d):
    """worker1 was last seen long ago, worker2 just now, worker0 never: old claims of worker1 are let go."""
    return C.release_stale(_consumer(spark, d)[2], _workers(spark), now("2024-01-19 23:58:00")).drop("high_water")


def _workers(spark):
    seen = [("worker1", "2024-01-19 23:50:00"), ("worker2", "2024-01-19 23:59:59")]
    return spark.createDataFrame(seen, "id string, last_seen string").withColumn("last_seen", F.to_timestamp_ntz("last_seen"))


@query(f"select * from (values ('worker1', timestamp '2024-01-19 23:50:00'), ('worker2', timestamp '{NOW}'), ('worker3', timestamp '{NOW}')) as w(id, last_seen)")
def worker_heartbeats(spark, d):
    return C.heartbeat(_workers(spark), ["worker2", "worker3", "worker3"], now())


@query(f"select group_id, status, retry_at, retries from ({GR}) union all select 'group5', 'active', null, 0")
def register_groups(spark, d):
    return C.register(S.groups(spark), ["group4", "group5", "group5"], now())


@query(f"""select group_id, case group_id when 'group1' then 'stopped' when 'group3' then 'active' else status end as status,
  case when group_id <> 'group3' then retry_at end as retry_at, case when group_id = 'group3' then 0 else retries end as retries from ({GR})""")
def stop_and_start_groups(spark, d):
    return C.start(C.stop(S.groups(spark), "group1", "upkeep", now()), "group3", now())


@query(f"""select group_id, stream_id, global_seq from (select group_id, stream_id, global_seq, min(case when type = 'error' then global_seq end) over (partition by group_id, stream_id) as f
  from ({_CLAIM})) where f is null or global_seq < f""")
def partial_ack(spark, d):
    batch = C.claim_batch(C.pending(*_consumer(spark, d), now()), 5)
    return C.partial_ack(batch.withColumn("failed", F.col("type") == "error")).select("group_id", "stream_id", "global_seq")


_SUM = "sum(case type when 'purchase' then k when 'error' then -1 else 0 end)::bigint"


def _totals(log):
    return E.totals(log, {"purchase": F.col("k"), "error": F.lit(-1)})


@query(f"select stream_id, max(seq) as seq, {_SUM} as total, count(*) as n from ({EV}) group by 1")
def fold_sum(spark, d):
    return _totals(S.events_log(spark, d))


@query(f"select stream_id, max(seq) as seq, arg_max(type, seq) as type, arg_max(k, seq) as k from ({EV}) group by 1")
def fold_last(spark, d):
    return E.last_of(S.events_log(spark, d), "type", "k")


_RESET = f"""with l as ({EV}), e as (select *, coalesce(max(case when type = 'error' then seq end) over (partition by stream_id), 0) as r from l)
select stream_id, max(seq) as seq, coalesce(sum(case when seq > r then k end), 0)::bigint as state from e group by 1"""


@query(_RESET)
def fold_reset(spark, d):
    """An ordered fold: an error sets the sum back to zero."""
    step = lambda a, e: F.when(e["type"] == "error", F.lit(0).cast("long")).otherwise(a + e["k"])
    return E.fold(S.events_log(spark, d), F.lit(0).cast("long"), step, lambda a: a, ["type", "k"])


@query(_RESET)
def fold_reset_stream(spark, d):
    """The same in Python, for streams of any length."""
    step = lambda s, e: (0,) if e.type == "error" else (s[0] + e.k,)
    return E.fold_stream(S.events_log(spark, d), lambda: (0,), step, ["type", "k"], "state long")


@query(f"""with e as (select *, count(case when type = 'error' then 1 end) over (partition by stream_id order by seq) as era from ({EV}))
select global_seq, sum(case when type = 'error' then 0 else k end) over (partition by stream_id, era order by seq)::bigint as state from e""")
def state_per_event(spark, d):
    return E.since_last(S.events_log(spark, d), "error", F.col("k")).select("global_seq", "state")


@query(f"""with e as (select *, coalesce(max(case when type = 'error' then seq end) over (partition by stream_id), 0) as r from ({EV}))
select stream_id, max(seq) as seq, count(case when type in ('purchase', 'error') then 1 end) as handled, coalesce(max(case when type in ('purchase', 'error') then seq end), 0) as last,
  coalesce(sum(case when type = 'purchase' and seq > r then k end), 0)::bigint as total from e group by 1""")
def before_evolve_seq(spark, d):
    """What runs before each handled event counts them and notes their seq; then purchases add up, and an error sets the sum back."""
    zero = F.lit(0).cast("long")
    state = lambda handled, last, total: F.struct(handled.alias("handled"), last.alias("last"), total.alias("total"))
    before = lambda a, e: state(a["handled"] + 1, e["seq"], a["total"])
    handlers = {"purchase": lambda a, e: state(a["handled"], a["last"], a["total"] + e["k"]), "error": lambda a, e: state(a["handled"], a["last"], zero)}
    return E.fold_handlers(S.events_log(spark, d), state(zero, zero, zero), handlers, ["k"], before).select("stream_id", "seq", "state.*")


@query(f"select stream_id, max(seq) as seq, {_SUM} as total, count(*) as n from ({EV}) group by 1")
def projection_incremental(spark, d):
    old, new = _parts(spark, d)
    return E.incremental(_totals(old), _totals(new))


@query(f"select stream_id, max(seq) as seq, {_SUM} as total, count(*) as n from ({EV}) where seq <= 20 group by 1")
def state_upto(spark, d):
    return _totals(S.events_log(spark, d).where("seq <= 20"))


@query(f"""select stream_id, seq, arrival from (select *, max(seq) over (partition by stream_id order by arrival rows between unbounded preceding and 1 preceding) as b
from (select stream_id, global_seq as arrival, case when global_seq % 97 = 0 then seq - 2 else seq end as seq from ({EV}))) where seq <= b""")
def sequence_errors(spark, d):
    rows = S.events_log(spark, d).select("stream_id", F.col("global_seq").alias("arrival"), F.when(F.col("global_seq") % 97 == 0, F.col("seq") - 2).otherwise(F.col("seq")).alias("seq"))
    return E.sequence_errors(rows)


FCOL = ["id", "stream_id", "type", "causation_id", "correlation_id"]


@query(f"select md5(id || ':notify:0') as id, stream_id, 'notify' as type, id as causation_id, correlation_id from ({CA}) where type = 'signup'")
def follow_messages(spark, d):
    return M.follow(S.events_log(spark, d, True).where("type = 'signup'"), "notify").select(FCOL)


_TREE = f"""select id, global_seq, causation_id from ({CA})
  union all select md5(id || ':ship:0'), 10000000 + global_seq, id from ({CA}) where type = 'purchase'
  union all select md5(md5(id || ':ship:0') || ':' || t || ':0'), n * 10000000 + global_seq, md5(id || ':ship:0') from ({CA}), (values ('shipped', 2), ('thank', 3)) as v(t, n) where type = 'purchase'"""


@query(f"""with recursive l as materialized ({_TREE}), t as (select id, global_seq, 0::bigint as depth from l where causation_id = id or causation_id not in (select id from l)
  union all select l.id, l.global_seq, t.depth + 1 from l join t on l.causation_id = t.id and l.id <> t.id) select id, global_seq, depth from t""")
def causation_depth(spark, d):
    """Depth in the tree of causes: chains of events, from which commands and what follows them branch off."""
    log = S.events_log(spark, d, True)
    shift = lambda df, n: df.withColumn("global_seq", F.col("global_seq") + n * 10000000)
    bought = log.where("type = 'purchase'")
    gs = bought.select(F.col("id").alias("cause"), "global_seq")
    ship = M.follow(bought, "ship")
    ship = shift(ship.join(gs, ship["causation_id"] == gs["cause"]).drop("cause"), 1)
    both = [M.follow(ship, t).join(ship.select(F.col("id").alias("cause"), (F.col("global_seq") + n * 10000000).alias("global_seq")), F.col("causation_id") == F.col("cause")) for n, t in ((1, "shipped"), (2, "thank"))]
    cols = ["id", "global_seq", "causation_id"]
    return M.causation_depth(log.select(cols).unionByName(ship.select(cols)).unionByName(both[0].select(cols)).unionByName(both[1].select(cols)))


@query(f"""with recursive l as ({CA}), a as (select id, causation_id from l where id = md5('120') union
select l.id, l.causation_id from l join a on l.id = a.causation_id) select id, global_seq from l where id in (select id from a)""")
def causation_chain(spark, d):
    return M.ancestors(S.events_log(spark, d, True), "da4fb5c6e93e74d3df8527599fa62642").select("id", "global_seq")


@query(f"""select md5(id || ':ship:0') as id, 'stock-' || (k % 5) as stream_id, 'ship' as type, id as causation_id, '{{"k":' || k || '}}' as payload,
  greatest(created_at, created_at + interval 1 hour) as created_at, 'shop' as producer, type as via from ({CA}) where type = 'purchase' and k >= 10""")
def reaction_commands(spark, d):
    """Commands with a payload, a stream, a time and metadata of their own."""
    log = S.events_log(spark, d, True)
    ship = M.Dispatch("ship", F.col("k") >= 10, F.to_json(F.struct("k")), F.concat(F.lit("stock-"), (F.col("k") % 5).cast("string")), F.expr("created_at + interval 1 hour"), F.create_map(F.lit("via"), F.col("type")))
    rows = M.reactions(log, [(["purchase"], [ship])], "shop")
    return rows.select("id", "stream_id", "type", "causation_id", "payload", "created_at", F.col("metadata")["producer"].alias("producer"), F.col("metadata")["via"].alias("via"))


_REACT = f"""select md5(id || ':' || c || ':0') as id, stream_id, c as type, id as causation_id, correlation_id from ({CA}) join
  (values ('purchase', 'ship', 0), ('purchase', 'thank', 50), ('error', 'alert', -1)) as h(t, c, least) on type = t and k >= least"""


@query(_REACT)
def reactions(spark, d):
    k = F.col("k")
    return M.reactions(S.events_log(spark, d, True), [(["purchase"], [("ship", k >= 0), ("thank", k >= 50)]), (["error"], [("alert", k >= -1)])]).select(FCOL)


@query(f"select md5(id || ':log:0') as id, stream_id, 'log' as type, id as causation_id, correlation_id from ({CA}) where type not in ('purchase', 'error')")
def catch_all_reactions(spark, d):
    log = S.events_log(spark, d, True)
    return M.reactions(log, [(["purchase", "error"], [("ship", F.lit(True))]), (None, [("log", F.lit(True))])]).where("type = 'log'").select(FCOL)


@query(f"select global_seq, case when created_at > timestamp '{NOW}' then 'schedule' else 'append_next' end as action from ({EV})")
def actions_partition(spark, d):
    return M.actions(S.events_log(spark, d), now()).select("global_seq", "action")


_DEC = f"select stream_id, seq, sum(cents) over (partition by stream_id order by seq)::bigint as total from ({OR}) where type = 'item_added'"


@query(f"""with t as (select *, total <= 20000000 as accepted from ({_DEC})) select *, case when accepted then count(case when accepted then 1 end) over (partition by stream_id order by seq) end as event_seq from t""")
def decide_batch(spark, d):
    """A batch of commands of a stream: each sees what those before it did, and no two events get one number."""
    commands = S.orders_log(spark, d).where("type = 'item_added'")
    return M.decide_running(commands, F.col("cents"), F.lit(20000000)).select("stream_id", "seq", "total", "accepted", "event_seq")


@query(f"select stream_id, count(case when type = 'item_added' then 1 end) as items, sum(cents)::bigint as cents, bool_or(type = 'order_placed') as placed from ({OR}) group by 1")
def order_states(spark, d):
    log = S.orders_log(spark, d)
    return log.groupBy("stream_id").agg(F.count(F.when(F.col("type") == "item_added", 1)).alias("items"), F.sum("cents").alias("cents"), F.bool_or(F.col("type") == "order_placed").alias("placed"))


_SAYS = [("purchase", "ship"), ("ship", "shipped"), ("ship", "bill"), ("shipped", "thank")]


@query(f"""with recursive h(t, c) as (values {', '.join(map(str, _SAYS))}),
m as (select id, type, causation_id, correlation_id, 0 as level from ({CA}) where type = 'purchase'
  union all select md5(m.id || ':' || c || ':0'), c, m.id, correlation_id, level + 1 from m join h on m.type = h.t) select * from m""")
def unit_cascade(spark, d):
    """Purchases and all that handlers make of them, level by level until nobody says anything; the limit counts messages."""
    first = S.events_log(spark, d, True).where("type = 'purchase'").select("id", "stream_id", "type", "causation_id", "correlation_id", "created_at")
    handlers = [([t], [(c, F.lit(True))]) for t, c in _SAYS]
    return M.cascade(first, lambda df: M.reactions(df, handlers), 10000).select("id", "type", "causation_id", "correlation_id", "level")


class Desk(R.Actor):
    """Ships an order once, if it was placed."""


@Desk.event("item_added")
def _added(state, e):
    state["cents"] = state.get("cents", 0) + e.payload["cents"]


@Desk.event("order_placed", "shipped")
def _marked(state, e):
    state[e.type] = True


@Desk.command("ship")
def _ship(state, c, apply):
    if state.get("order_placed") and not state.get("shipped"):
        apply("shipped")
        apply("billed", {"cents": state.get("cents", 0)})
    else:
        apply("refused")


@query(f"""with o as (select stream_id, max(seq) as last, sum(cents)::bigint as cents, bool_or(type = 'order_placed') as placed from ({OR}) group by 1),
e(placed, n, type, command) as (values (true, 1, 'shipped', 1), (true, 2, 'billed', 1), (true, 3, 'refused', 2), (false, 1, 'refused', 1), (false, 2, 'refused', 2))
select stream_id, last + n as seq, type, case when type = 'billed' then '{{"cents": ' || cents || '}}' else '{{}}' end as payload, md5(stream_id || ':ship:' || command) as causation_id, 'append_after' as action
from o join e using (placed)""")
def run_actor(spark, d):
    """Two commands to every order: state and numbers go through both, and on from the stream's last."""
    log = S.orders_log(spark, d).withColumn("payload", F.to_json(F.struct("cents")))
    n = F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))
    asked = log.select("stream_id").distinct().select("stream_id", n.alias("seq"), F.lit("ship").alias("type"))
    asked = asked.withColumn("id", F.md5(F.concat_ws(":", "stream_id", "type", F.col("seq").cast("string"))))
    return R.run_reactor(log, asked, Desk, datetime(2024, 1, 20)).select("stream_id", "seq", "type", "payload", "causation_id", "action")


_STEP = f"""select stream_id, 'step-' || (k % 3) as key, seq, case type when 'view' then 'started' when 'error' then 'failed' when 'purchase' then 'complete' end as status
  from ({EV}) where type in ('view', 'error', 'purchase')"""


def _steps(spark, d):
    log = S.events_log(spark, d).where("type in ('view', 'error', 'purchase')")
    status = F.when(F.col("type") == "view", "started").when(F.col("type") == "error", "failed").otherwise("complete")
    return log.select("stream_id", F.concat(F.lit("step-"), (F.col("k") % 3).cast("string")).alias("key"), "seq", status.alias("status"))


@query(f"select stream_id, key, arg_max(status, seq) as status, count(case when status = 'started' then 1 end) as attempts from ({_STEP}) group by all")
def workflow_steps(spark, d):
    return _steps(spark, d).groupBy("stream_id", "key").agg(F.max_by("status", "seq").alias("status"), F.count(F.when(F.col("status") == "started", 1)).alias("attempts"))


@query(f"""select global_seq, sha256('{{"name":"' || type || '","args":[' || k || ',"' || stream_id || '"]}}') as key from ({EV})""")
def workflow_step_keys(spark, d):
    args = F.concat(F.lit("["), F.col("k").cast("string"), F.lit(',"'), F.col("stream_id"), F.lit('"]'))
    return S.events_log(spark, d).select("global_seq", N.step_key(F.col("type"), args).alias("key"))


@query(f"select stream_id, key, seq, count(case when status = 'started' then 1 end) over (partition by stream_id, key order by seq) as attempts from ({_STEP})")
def workflow_attempts(spark, d):
    w = Window.partitionBy("stream_id", "key").orderBy("seq")
    return _steps(spark, d).select("stream_id", "key", "seq", F.count(F.when(F.col("status") == "started", 1)).over(w).alias("attempts"))


class Shop(R.Actor):
    pass


@Shop.command("place")
def _place(state, c, apply):
    apply("placed")


@Shop.command("ship")
def _send(state, c, apply):
    apply(_SHIPPED)


_SHIPPED = "shipped"
Shop.event("placed", "shipped")()


@Shop.reaction("placed")
def _next(state, e, dispatch):
    dispatch("ship", {"order": e.stream_id})


class Orders(R.Projector):
    pass


Orders.event("placed", "shipped")()


@Orders.reaction("shipped")
def _tell(state, e, dispatch):
    dispatch("place")


#: What those handlers say, written out by hand for the oracle.
_EDGES = [("place", "placed"), ("ship", "shipped"), ("placed", "placed-Shop-aut"), ("placed-Shop-aut", "ship"), ("placed", "Orders-rm"), ("shipped", "Orders-rm"), ("Orders-rm", "shipped-Orders-aut"), ("shipped-Orders-aut", "place")]
_EV = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in _EDGES) + ") as e(source, target)"


@query(f"select * from {_EV}")
def topology_edges(spark, d):
    """The flow of messages between two reactors, read from the source of their handlers."""
    return R.topology_frames(spark, Shop, Orders)[1]


@query("""select * from (values ('place', 'command', 'Shop'), ('ship', 'command', 'Shop'), ('placed', 'event', 'Shop'), ('shipped', 'event', 'Shop'),
  ('placed-Shop-aut', 'automation', 'Shop'), ('Orders-rm', 'readmodel', 'Orders'), ('shipped-Orders-aut', 'automation', 'Orders')) as n(id, kind, group_id)""")
def topology_nodes(spark, d):
    """Events belong to the first reactor that has them."""
    return R.topology_frames(spark, Shop, Orders)[0]


@query(f"with recursive r as (select source as origin, target from {_EV} union select r.origin, e.target from r join {_EV} on e.source = r.target) select origin, target from r")
def topology_reachability(spark, d):
    edges = topology_edges(spark, d)
    step, found, size = edges.toDF("source", "next"), edges.toDF("origin", "target"), 0
    while (now_ := found.count()) > size:  # a node for each message type: small
        size = now_
        found = written(found.unionByName(found.join(step, F.col("target") == F.col("source")).select("origin", F.col("next").alias("target"))).distinct(), "reach")
    return found


@query("""select n_name, 'main_' || lower(replace(n_name, '_', '')) as from_camel, lower(n_name) as from_dashes, 'http_main_' || lower(replace(n_name, '_', '')) as from_capitals,
  'Main' || upper(n_name[1]) || lower(replace(n_name[2:], '_', '')) as class_name from nation""")
def name_cases(spark, d):
    """CamelCase, dashes and runs of capitals to underscores, and underscores to a class name."""
    n = F.lower("n_name")
    camel = N.class_name(F.concat(F.lit("main_"), n))
    return S.table(spark, d, "nation").select("n_name", N.underscored(camel).alias("from_camel"), N.underscored(F.replace(n, F.lit("_"), F.lit("-"))).alias("from_dashes"), N.underscored(F.concat(F.lit("HTTP"), camel)).alias("from_capitals"), camel.alias("class_name"))


@query(f"""select global_seq, type, case when type = 'error' then 'unknown type' else 'k is no tinyint' end as error
  from (select event_id + 1 as global_seq, event_type as type, json_extract_string(props, '$.k') as k from events) where type = 'error' or (type = 'purchase' and try_cast(k as tinyint) is null)""")
def invalid_messages(spark, d):
    """Messages that a registry wouldn't take: errors are unknown to it, purchases need a small number."""
    e = S.table(spark, d, "events")
    log = e.select((F.col("event_id") + 1).alias("global_seq"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("stream_id"), F.col("event_type").alias("type"), F.col("props").alias("payload"))
    types = {t: {} for t in ("view", "click", "signup")} | {"purchase": {"k": "tinyint"}}
    return invalid(log, types).select("global_seq", "type", "error")


@query(r"""select n_name, lower(replace(n_name, ' ', '_')) as snake, replace('Shop::' || n_name, '::', '.') as dotted, 'Shop::' || n_name as path,
  split_part('Shop::' || n_name, '::', 2) as last, lower('shop.' || n_name) as type from nation""")
def name_normalise(spark, d):
    n = F.col("n_name")
    path = F.concat(F.lit("Shop::"), n)
    return S.table(spark, d, "nation").select("n_name", N.underscored(F.replace(n, F.lit(" "), F.lit("_"))).alias("snake"), N.dotted(path).alias("dotted"), path.alias("path"), N.last_module(path).alias("last"), N.prefixed_type(F.lit("shop"), n).alias("type"))


@query("""select user_id, count(*) as n, max(event_id) as last_event, sum(cast(json_extract_string(props, '$.k') as bigint))::bigint as total from events group by 1""")
def stream_projection(spark, d):
    """Structured Streaming to the end of what there is, against the batch fold."""
    return projection(spark, f"{d}/events.parquet")
