from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logweave.operators import consume as C
from logweave.operators import evolve as E
from logweave.operators import log as L
from logweave.operators import messages as M

LOG = "global_seq long, stream_id string, seq long, type string, created_at timestamp_ntz"


def rows(*spec):
    return [(i + 1, s, q, t, datetime(2024, 1, 1, 0, 0, i)) for i, (s, q, t) in enumerate(spec)]


@pytest.fixture
def log(spark):
    return spark.createDataFrame(rows(("s1", 1, "a"), ("s2", 1, "a"), ("s1", 2, "b"), ("s2", 2, "a"), ("s1", 3, "a")), LOG)


def test_bounds(log):
    assert [r["seq"] for r in L.read_stream(log, "s1", upto=2).collect()] == [1, 2]
    assert [r["seq"] for r in L.read_stream(log, "s1", after=1).collect()] == [2, 3]
    assert L.read_stream(log, "none").isEmpty()
    one = type("One", (), {"stream_id": "s1"})()
    assert [r["seq"] for r in L.history_for(log, one, after=2).collect()] == [3] and L.history_for(log, "s2").count() == 2
    with pytest.raises(TypeError):
        L.history_for(log, 5)


def test_recent(log):
    assert [r["stream_id"] for r in L.recent_streams(log).collect()] == ["s1", "s2"]
    assert L.recent_streams(log, 0).isEmpty()
    with pytest.raises(ValueError):
        L.recent_streams(log, -1)


def test_append(spark, log):
    new = spark.createDataFrame([("s1", "c", 10), ("s3", "c", 11), ("s1", "c", 12)], "stream_id string, type string, arrival long")
    out = sorted((r["global_seq"], r["stream_id"], r["seq"]) for r in L.append_next(log, new).collect())
    assert out == [(6, "s1", 4), (7, "s3", 1), (8, "s1", 5)]
    taken = spark.createDataFrame([("s1", 3)], "stream_id string, seq long")
    with pytest.raises(L.ConcurrentAppendError):
        L.append_after(log, taken)
    with pytest.raises(L.ConcurrentAppendError):
        L.append_after(log, spark.createDataFrame([("s9", 1), ("s9", 1)], "stream_id string, seq long"))
    assert L.append_after(log, spark.createDataFrame([("s1", 10)], "stream_id string, seq long")).count() == 6
    assert L.append_next(log, new.limit(0)).isEmpty()


def offsets(spark, *r):
    return spark.createDataFrame([(g, s, o, h, False, None) for g, s, o, h in r], "group_id string, stream_id string, global_seq long, high_water long, claimed boolean, claimed_by string")


def groups(spark, *r):
    return spark.createDataFrame([(g, s, None, 0) for g, s in r], "group_id string, status string, retry_at timestamp_ntz, retries long")


NOW = datetime(2024, 1, 2)


def test_batches_ack_and_replay(spark, log):
    g, o = groups(spark, ("g", "active")), offsets(spark, ("g", "s1", 0, 0), ("g", "s2", 0, 0))
    batch = C.claim_batch(C.pending(log, g, o, NOW), 2)
    assert sorted((r["stream_id"], r["seq"], r["replaying"]) for r in batch.collect()) == [("s1", 1, False), ("s1", 2, False), ("s2", 1, False), ("s2", 2, False)]
    o = C.ack(o, batch)
    assert sorted((r["stream_id"], r["seq"]) for r in C.claim_batch(C.pending(log, g, o, NOW), 2).collect()) == [("s1", 3)]
    again = C.claim_batch(C.pending(log, g, C.reset(o, "g"), NOW), 50)
    assert [r["replaying"] for r in again.where("stream_id = 's1'").orderBy("seq").collect()] == [True, True, False]


def test_a_stream_never_seen_is_not_replayed(spark):
    log = spark.createDataFrame(rows(("a", 1, "x"), ("b", 1, "x"), ("a", 2, "x")), LOG)
    g, o = groups(spark, ("g", "active")), offsets(spark, ("g", "a", 3, 3), ("g", "b", 0, 0))
    assert [r["replaying"] for r in C.claim_batch(C.pending(log, g, o, NOW), 9).collect()] == [False]


def test_types(spark, log):
    g, o = groups(spark, ("g", "active")), offsets(spark, ("g", "s1", 0, 0))
    assert sorted(r["seq"] for r in C.pending(log, g, o, NOW, ["a"]).collect()) == [1, 3]
    assert C.pending(log, g, o, NOW, []).isEmpty()
    assert C.pending(log, groups(spark, ("g", "stopped")), o, NOW).isEmpty()
    assert C.bootstrap(log, g, o).count() == 1


def test_folds_agree_and_batch_size_does_not_matter(spark):
    spec = [("s", i + 1, "reset" if i % 7 == 0 else "add") for i in range(50)]
    log = spark.createDataFrame(rows(*spec), LOG)
    step = lambda a, e: F.when(e["type"] == "reset", F.lit(0)).otherwise(a + 1)
    one = E.fold(log, F.lit(0), step, lambda a: a, ["type"]).first()["state"]
    two = E.fold_stream(log, lambda: (0,), lambda s, e: (0,) if e.type == "reset" else (s[0] + 1,), ["type"], "state long").first()["state"]
    assert one == two == 0
    t = lambda df: E.totals(df, {"add": F.lit(2)})
    assert E.incremental(t(log.where("seq <= 20")), t(log.where("seq > 20"))).collect() == t(log).collect()


def test_errors_and_partial(spark):
    g = groups(spark, ("g", "active"))
    once = C.after_error(g, NOW, 1, 3)
    assert once.first()["retry_at"] == datetime(2024, 1, 2, 0, 0, 3)
    assert C.after_error(once, NOW, 1, 3).first()["status"] == "stopped"
    handled = spark.createDataFrame([("g", "s", 1, False), ("g", "s", 2, True), ("g", "s", 3, False)], "group_id string, stream_id string, global_seq long, failed boolean")
    assert [r["global_seq"] for r in C.partial_ack(handled).collect()] == [1]


def test_metadata(spark):
    row = spark.range(1).select(M.with_metadata(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(1)), F.create_map(F.lit("b"), F.lit(2))).alias("m")).first()
    assert row["m"] == {"a": 1, "b": 2}
