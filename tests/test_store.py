from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from logweave import streaming
from logweave.operators import consume as C
from logweave.operators import evolve as E
from logweave.operators import log as L
from logweave.operators import messages as M
from logweave.sources import store as S
from logweave.workers import FolderChannel

NOW = datetime(2024, 1, 2)
NEW = "id string, stream_id string, type string, created_at timestamp_ntz, payload string, arrival long"


def new(spark, *spec):
    return spark.createDataFrame([(f"m{n}", s, t, datetime(2024, 1, 1), p, n) for n, s, t, p in spec], NEW)


def test_store(spark, tmp_path):
    store = S.open_log(f"file://{tmp_path}/log", spark)
    assert store.installed() and store.log().isEmpty() and store.table("heads").isEmpty()
    store.append_next(new(spark, (1, "a", "x", '{"n": 1}'), (2, "b", "x", None), (3, "a", "y", '{"n": 2}')))
    store.append_next(new(spark, (4, "a", "x", '{"n": 3}')))
    assert [(r["global_seq"], r["stream_id"], r["seq"]) for r in store.log().orderBy("global_seq").collect()] == [(1, "a", 1), (2, "b", 1), (3, "a", 2), (4, "a", 3)]
    assert sorted((r["stream_id"], r["seq"]) for r in store.table("heads").collect()) == [("a", 3), ("b", 1)]
    with pytest.raises(L.ConcurrentAppendError):
        store.append_after(new(spark, (5, "a", "x", None)).withColumn("seq", F.lit(3).cast("long")))
    store.append_after(new(spark, (5, "b", "x", None)).withColumn("seq", F.lit(7).cast("long")))
    assert store.log().count() == 5
    # of two that began from one version, the second publishes nothing
    base = store._versions()[-1]
    groups = C.register(store.table("groups"), ["g"], NOW)
    store.commit(groups=groups, base=base)
    with pytest.raises(L.ConcurrentAppendError):
        store.commit(new(spark, (6, "c", "x", None)).withColumns({"seq": F.lit(1).cast("long"), "global_seq": F.lit(9).cast("long")}), base, groups=groups.limit(0))
    assert store.log().count() == 5 and [r["status"] for r in store.table("groups").collect()] == ["active"]
    store.commit(scheduled=L.schedule(new(spark, (7, "a", "later", None), (8, "a", "much later", None)), F.when(F.col("type") == "later", F.lit(NOW)).otherwise(F.lit(NOW + timedelta(9))), NOW))
    assert store.promote(NOW) == 1 and store.promote(NOW) == 0
    last = store.log().orderBy(F.desc("global_seq")).first()
    assert (last["stream_id"], last["seq"], last["type"], last["created_at"], last["metadata"]["scheduled_at"]) == ("a", 4, "later", NOW, str(NOW))
    schema = StructType([StructField("n", LongType())])
    assert [r["n"] for r in S.decoded(store.log(), {"x": schema})["x"].orderBy("global_seq").collect()] == [1, None, 3, None]
    with pytest.raises(KeyError):
        S.fetch(schema, "other")
    assert store.clear().log().isEmpty()
    store.uninstall()
    assert not store.installed()
    with pytest.raises(TypeError):
        S.open_log(object())


def test_groups(spark):
    g = spark.createDataFrame([("g", "active", None, 1, None, None)], S.TABLES["groups"])
    stopped = C.stop(g, "g", "why", NOW).first()
    assert (stopped["status"], stopped["error_context"]) == ("stopped", '{"reason":"why"}')
    started = C.start(C.stop(g, "g", "why", NOW), "g", NOW).first()
    assert (started["status"], started["retries"], started["error_context"]) == ("active", 0, None)
    assert sorted(r["group_id"] for r in C.register(g, ["g", "h", "h"], NOW).collect()) == ["g", "h"]


def test_claims(spark):
    o = spark.createDataFrame([("g", "a", 0, 0, False, None, None), ("g", "b", 0, 0, True, NOW, "w1"), ("g", "c", 0, 0, True, NOW - timedelta(1), "w1"), ("g", "d", 0, 0, True, NOW - timedelta(1), "w2")], S.TABLES["offsets"])
    batch = spark.createDataFrame([("g", "a", 1), ("g", "b", 2)], "group_id string, stream_id string, global_seq long")
    claimed = {r["stream_id"]: (r["claimed"], r["claimed_by"]) for r in C.claim(o, batch, "w9", NOW).collect()}
    assert claimed == {"a": (True, "w9"), "b": (True, "w1"), "c": (True, "w1"), "d": (True, "w2")}
    workers = spark.createDataFrame([("w1", NOW - timedelta(1)), ("w2", NOW)], S.TABLES["workers"])
    freed = {r["stream_id"]: r["claimed"] for r in C.release_stale(o, workers, NOW - timedelta(hours=1)).collect()}
    assert freed == {"a": False, "b": True, "c": False, "d": True}  # b's claim is new, d's worker lives
    log = spark.createDataFrame([("m1", "a", 5), ("m2", "b", 6)], "id string, stream_id string, global_seq long")
    assert {r["stream_id"]: r["global_seq"] for r in C.ack_on(log, o, "g", "m1").collect()}["a"] == 5
    for unknown in ("m2", "m3"):  # claimed, not there
        with pytest.raises(C.ConcurrentAckError):
            C.ack_on(log, o, "g", unknown)


def test_causes(spark):
    rows = [("a", "a", 1), ("b", "a", 2), ("c", "a", 3), ("d", "b", 4), ("x", "gone", 5), ("p", "q", 6), ("q", "p", 7)]
    log = spark.createDataFrame([(i, c, n, "k") for i, c, n in rows], "id string, causation_id string, global_seq long, correlation_id string")
    assert {r["id"]: r["depth"] for r in M.causation_depth(log).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "x": 0}
    n = 1500
    chain = spark.range(n).selectExpr("cast(id as string) as id", "cast(greatest(id - 1, 0) as string) as causation_id", "id as global_seq", "'k' as correlation_id")
    assert M.ancestors(chain, str(n - 1)).count() == n and M.ancestors(chain, "9").count() == 10 and M.ancestors(chain, "none").isEmpty()
    assert sorted(r["id"] for r in M.ancestors(log, "d").collect()) == ["a", "b", "d"]


def test_cascades_end(spark):
    first = spark.createDataFrame([("m", "s", "go", "m", "m", datetime(2024, 1, 1))], "id string, stream_id string, type string, causation_id string, correlation_id string, created_at timestamp_ntz")
    with pytest.raises(M.InfiniteCascadeError):
        M.cascade(first, lambda df: M.reactions(df, [(["go"], [("go", F.lit(True))])]), 5)
    out = M.cascade(first, lambda df: M.reactions(df, [(["go"], [("a", F.lit(True)), ("b", F.lit(True))])]), 5)
    assert sorted((r["type"], r["level"]) for r in out.collect()) == [("a", 1), ("b", 1), ("go", 0)]


def test_live_folds(spark, tmp_path):
    """State and read model over several micro-batches are those of one batch fold."""
    rows = [(f"s{i % 3}", i, "reset" if i % 11 == 5 else "add") for i in range(60)]
    for k in range(0, 60, 20):
        spark.createDataFrame(rows[k : k + 20], "stream_id string, seq long, type string").coalesce(1).write.parquet(f"{tmp_path}/in/{k:02d}")
    read = spark.readStream.schema("stream_id string, seq long, type string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)
    step = lambda s, e: (0,) if e.type == "reset" else (s[0] + 1,)
    live = streaming.live_fold(read.parquet(f"{tmp_path}/in"), lambda: (0,), step, ["type"], "n long")
    streaming.upsert(live, f"file://{tmp_path}/out", ["stream_id"], 4)
    got = {r["stream_id"]: r["n"] for r in streaming.read_model(spark, f"file://{tmp_path}/out").collect()}
    log = spark.createDataFrame(rows, "stream_id string, seq long, type string")
    assert got == {r["stream_id"]: r["n"] for r in E.fold_stream(log, lambda: (0,), step, ["type"], "n long").collect()}
    assert streaming.read_model(spark, f"file://{tmp_path}/none") is None


def test_channels(spark, tmp_path):
    one, two = (FolderChannel(spark, f"file://{tmp_path}/channel") for _ in range(2))
    assert two.poll() == []
    one.publish("messages_appended", "a,b")
    one.publish("reactor_resumed", "g")
    assert two.poll() == [("messages_appended", "a,b"), ("reactor_resumed", "g")] and two.poll() == [] and one.poll() == []


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from logweave import storage

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        storage.shared_dir(Session())
