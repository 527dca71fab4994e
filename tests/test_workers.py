from datetime import datetime, timedelta

import pytest

from logweave.reactors import Actor, Memory, Message, Projector, Unit, Workflow, reset_topology, run_reactor, said, topology
from logweave.operators.consume import since
from logweave.reactors import Registry
from logweave.runtime import Ack, Config, Group, Handler, Router, inject
from logweave.workers import HouseKeeper, Supervisor, WorkQueue

NOW = datetime(2024, 1, 1)


class Counter(Actor):
    @classmethod
    def identity_from(cls, m):
        return m.payload.get("of", m.stream_id)


@Counter.command("count")
def count(state, c, apply):
    apply("counted", {"n": state.get("n", 0) + 1})


@Counter.event("counted")
def counted(state, e):
    state["n"] = e.payload["n"]


@Counter.reaction("counted")
def tell(state, e, dispatch):
    if e.payload["n"] < 3:
        dispatch("count")
    dispatch("remind", {"n": state["n"]}, at=e.created_at + timedelta(1))


TYPES = {"told": "told.all"}


class Names:
    heard = "heard.one"


@Handler.on("nothing")
def nothing(m, history, replaying):
    return ()


def test_queue():
    q = WorkQueue(2)
    assert [q.push(Counter) for _ in range(3)] == [True, True, False]
    assert q.pop() is Counter and q.push(Counter) and q.pop(0) is Counter and q.pop(0) is Counter and q.pop(0) is None
    q.close()
    assert not q.push(Counter) and q.pop() is None


def test_supervisor():
    """Work is found by notice, commands chain, and nothing is left."""
    memory = Memory()
    router = Router(memory, Config(workers=3, promote_every=0.05, catch_up_every=0.05))
    router.register(Counter)
    memory.append_next([Message("count", "a", created_at=NOW), Message("count", "b", created_at=NOW)])
    boss = Supervisor(router, lambda: NOW).start()
    assert boss.settle()
    boss.stop()
    assert sorted(m.type for m in memory.log) == ["count"] * 6 + ["counted"] * 6 and len(memory.scheduled) == 6
    assert len({(m.stream_id, m.seq) for m in memory.log}) == 12


def test_house_keeper():
    router = Router(Memory(), Config(claim_ttl=60))
    claims = {("g", "a"): ("w", NOW), ("g", "b"): ("other", NOW), ("g", "c"): ("w", NOW + timedelta(minutes=5))}
    keeper = HouseKeeper(router, ["w"], {}, claims)
    keeper.heartbeat(NOW)
    assert keeper.reap(NOW + timedelta(seconds=30)) == 0 and keeper.reap(NOW + timedelta(minutes=2)) == 1 and set(claims) == {("g", "b"), ("g", "c")}
    router.memory.scheduled += [Message("x", "s", created_at=NOW + timedelta(n)) for n in (3, 1, 2)]
    assert keeper.promote(NOW + timedelta(2)) == 2 and [m.seq for m in router.memory.log] == [1, 2]


def test_promotion_by_time():
    memory = Memory()
    memory.scheduled += [Message(t, "s", created_at=NOW + timedelta(n)) for t, n in (("c", 3), ("a", 1), ("b", 1))]
    assert memory.promote(NOW + timedelta(9)) == 3 and [m.type for m in memory.log] == ["a", "b", "c"]
    assert memory.recent(1)[0][0] == "s" and memory.recent(0) == []


def test_inject():
    def f(m, history, replaying=False, **more):
        return m, history, replaying, more

    assert inject(f, {"history": [1], "now": 2}, "m") == ("m", [1], False, {"history": [1], "now": 2}) or inject(f, {"history": [1], "now": 2}, "m")[:3] == ("m", [1], False)
    assert inject(lambda m: m, {"history": 1}, 5) == 5
    with pytest.raises(TypeError):
        inject(lambda m, other: m, {}, 5)


def test_ack_of_another_message():
    class Skipper(Handler):
        pass

    memory = Memory()
    first, second = memory.append_next([Message("go", "s", created_at=NOW), Message("go", "s", {"n": 2}, created_at=NOW)])
    Skipper.reacts = {}
    seen = []

    @Skipper.on("go")
    def go(m, history, replaying):
        seen.append(m.id)
        return ()

    router = Router(memory)
    group = router.register(Skipper)
    import logweave.runtime as runtime

    real = runtime.work
    try:
        runtime.work = lambda *a: ((m, [Ack(second.id)]) for m, _ in real(*a))
        assert router.step(Skipper, NOW, 1)
    finally:
        runtime.work = real
    assert seen == [first.id] and group.offsets == {"s": 2} and not router.pending(Skipper)


def test_source_is_read():
    class Reader(Actor):
        pass

    local = "heard.two"

    @Reader.command("go")
    def go(state, c, apply):
        apply(TYPES["told"])
        if state:
            apply(Names.heard, {})
        apply(local)
        apply("a" "b")

    # apply("in a comment")
    assert said(go) == ["told.all", "heard.one", "heard.two", "ab"]
    reset_topology()
    nodes, edges = topology(Reader)
    assert ("go", "told.all") in edges and topology(Reader) is topology(Reader)


def test_workflow_context_and_failures():
    class Flow(Workflow):
        retries, prefix = 1, "flow"

        def execute(self):
            self.context.setdefault("list", []).append(len(self.steps))
            if "list" in self.context and len(self.context["list"]) > 1:
                return "done"
            self.step(fail)

    def fail():
        raise RuntimeError("no")

    log = [Message("flow.workflow.started", "w", {"args": []}, seq=1)]
    log += Flow.handle(log, NOW)
    assert [m.type for m in log[1:]] == ["flow.step.started", "flow.context.updated"]
    log += Flow.handle(log, NOW)  # the nested list grew: it's said before the end
    assert [m.type for m in log[3:]] == ["flow.context.updated", "flow.workflow.complete"] and log[3].payload["context"] == {"list": [0, 1]}
    assert Flow.handled() == {f"flow.{n}" for n in Workflow.SAYS} - {"flow.context.updated", "flow.workflow.failed"}

    class Bad(Workflow):
        retries = 1

        def execute(self):
            self.step(fail)

    log = [Message("workflow.started", "w", {"args": []}, seq=1)]
    for _ in range(2):
        log += Bad.handle(log, NOW)
    assert [m.type for m in log[1:]] == ["step.started", "step.failed", "workflow.failed"] and "RuntimeError" in "".join(log[2].payload["backtrace"])


def test_unit_by_instance():
    memory = Memory()
    unit = Unit(memory, Counter)
    unit.handle(Message("count", "a", created_at=NOW), NOW)
    assert unit[Counter, "a"].state == {"n": 3} and [e.payload["n"] for e in unit.events_for(Counter, "a") if e.type == "counted"] == [1, 2, 3]


def test_units_sync():
    class Model(Projector):
        pass

    Model.event("counted")(lambda state, e: {**state, "n": e.payload["n"]})
    seen = []
    Model.syncs = [lambda state, events, replaying: seen.append(state["n"])]
    Unit(Memory(), Counter, Model).handle(Message("count", "a", created_at=NOW), NOW)
    assert seen == [1, 2, 3]


def test_reactors_over_dataframes(spark):
    """Numbers go on from the stream's last, reactions are appended or scheduled, what is replayed is skipped."""
    log = spark.createDataFrame([("m1", "s", 1, "counted", '{"n": 1}'), ("m2", "s", 2, "other", None), ("m3", "s", 3, "counted", '{"n": 2}'), ("m4", "t", 1, "counted", '{"n": 7}')], "id string, stream_id string, seq long, type string, payload string")
    asked = spark.createDataFrame([("c1", "s", 4, "count", False), ("c2", "s", 5, "count", None), ("c3", "t", 9, "count", True), ("c4", "u", 1, "count", False), ("m4", "t", 1, "counted", False)], "id string, stream_id string, seq long, type string, replaying boolean").selectExpr("*", "case when type = 'counted' then '{\"n\": 7}' end as payload")
    out = sorted((r["action"], r["stream_id"], r["seq"], r["type"], r["payload"], r["causation_id"]) for r in run_reactor(log, asked, Counter, NOW).collect())
    assert out == [
        ("append_after", "s", 4, "counted", '{"n": 3}', "c1"),
        ("append_after", "s", 5, "counted", '{"n": 4}', "c2"),
        ("append_after", "u", 1, "counted", '{"n": 1}', "c4"),
        ("schedule", "t", None, "remind", '{"n": 7}', "m4"),
    ]


def test_step_keys_agree(spark):
    from pyspark.sql import functions as F

    from logweave.functions import step_key as column
    from logweave.reactors import step_key

    row = spark.createDataFrame([("f", '[1,"a"]')], "name string, args string").select(column(F.col("name"), F.col("args")).alias("k")).first()
    assert row["k"] == step_key("f", [1, "a"])


def test_group_maintenance():
    g = Group("g")
    g.stop("why")
    assert g.status == "stopped" and g.error["reason"] == "why"
    g.start()
    assert g.may_work(NOW)


def test_start_options_and_coercion():
    assert since("beginning", NOW) is None and since("now", NOW) == NOW - timedelta(seconds=5) and since(lambda: NOW, None) == since(NOW, None) == NOW
    r = Registry()
    r.define("add", n=int)
    assert r.build("add", "s", {"n": "5"}).payload == {"n": 5} and r.errors(r.build("add", "s", {"n": "x"})) and r.errors(r.build("add", "s"))


def test_handlers_ask_by_name_and_batches_have_sizes():
    class Asker(Handler):
        batch_size = 2

    seen = []
    Asker.on("go")(lambda m, replaying: seen.append((m.seq, replaying)))
    memory = Memory()
    memory.append_next(Message("go", "s", {"n": i}, created_at=NOW) for i in range(3))
    router = Router(memory)
    router.register(Asker)
    assert router.step(Asker, NOW) and seen == [(1, False), (2, False)]
    assert router.stats() == [("Asker", "active", None, 2, 2, 1)]
    router.register(Counter)
    assert router.stats()[1] == ("Counter", "active", None, 0, 0, 0)
