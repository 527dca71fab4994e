from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logweave import functions, runtime as R, streaming
from logweave.operators.log import ConcurrentAppendError
from logweave.reactors import Actor, Memory, Message, Projector, Registry, Workflow

NOW = datetime(2024, 1, 1)


def make():
    class Cart(Actor):
        pass

    @Cart.command("add")
    def add(state, c, apply):
        if c.payload.get("n", 1) < 0:
            raise ValueError("negative")
        if state.get("n", 0) < 3:
            apply("added", c.payload)

    @Cart.event("added")
    def added(state, e):
        state["n"] = state.get("n", 0) + 1

    @Cart.reaction("added")
    def remind(state, e, dispatch):
        if state["n"] == 3:  # the history holds what came later, too
            dispatch("mail", to="mails")
            dispatch("remind", at=e.created_at + timedelta(hours=1))

    class Total(Projector):
        pass

    @Total.event("added")
    def count(state, e):
        if e.payload.get("bad"):
            raise RuntimeError("bad")
        state["n"] = state.get("n", 0) + 1

    return Cart, Total


def test_router_drains():
    cart, total = make()
    mem, seen, told = Memory(), [], []
    R.synced(total)(lambda state, events, replaying: seen.append((dict(state), len(events), replaying)))
    router = R.Router(mem)
    router.notifier.on("messages_appended", told.append)
    router.register(cart), router.register(total)
    mem.append_next(Message("add", "a", {"i": i}, created_at=NOW) for i in range(4))
    router.drain(NOW)
    assert [m.type for m in mem.log] == ["add"] * 4 + ["added"] * 3 + ["mail"] * 3
    assert [m.type for m in mem.scheduled] == ["remind"] * 3
    assert seen[-1] == ({"n": 3}, 1, False) and "added" in told
    assert [m.seq for m in mem.stream("a")] == list(range(1, 8))
    router.groups["Total"].reset()
    router.drain(NOW)
    assert seen[-1] == ({"n": 3}, 1, True)
    n = len(mem.log)
    router.groups["Cart"].reset()
    router.drain(NOW)
    assert len(mem.log) == n  # an actor skips what is replayed
    assert router.tick(NOW + timedelta(hours=2)) == 0 and not mem.scheduled


def test_batch_of_commands_shares_state():
    cart, _ = make()
    mem = Memory()
    router = R.Router(mem)
    router.register(cart)
    mem.append_next(Message("add", "a", {"i": i}, created_at=NOW) for i in range(5))
    assert router.step(cart, NOW)
    assert [m.seq for m in mem.log if m.type == "added"] == [6, 7, 8]


def test_partial_batch_and_retries():
    cart, total = make()
    mem, seen, stopped = Memory(), [], []
    R.synced(total)(lambda state, events, replaying: seen.append((dict(state), len(events))))
    router = R.Router(mem, R.Config(error_strategy=R.ErrorStrategy(1, 3, on_stop=lambda *a: stopped.append(a))))
    g = router.register(total)
    mem.append_next(Message("added", "a", {"bad": i == 2}, created_at=NOW) for i in range(4))
    router.step(total, NOW)
    assert seen == [({"n": 2}, 2)] and g.offsets == {"a": 2}
    assert (g.retries, g.retry_at) == (1, NOW + timedelta(seconds=3)) and not router.step(total, NOW)
    router.step(total, NOW + timedelta(seconds=3))
    assert g.status == "stopped" and stopped and not router.step(total, NOW + timedelta(days=1))
    g.start()
    with pytest.raises(RuntimeError):
        router.drain(NOW)
    router.ack_on("Total", mem.log[2].id)
    assert [n for n, _ in router.pending(total)] == [4]
    with pytest.raises(R.ConcurrentAckError):
        router.ack_on("Total", "unknown")
    with pytest.raises(R.InvalidReactorError):
        router.register(object)


def test_start_and_config():
    cart, total = make()
    mem = Memory()
    router = R.Router(mem)
    router.register(total, now=NOW)
    mem.append_next([Message("added", "a", created_at=NOW - timedelta(seconds=6)), Message("added", "a", created_at=NOW)])
    assert [n for n, _ in router.pending(total)] == [2] and router.registered(total) and not router.registered(cart)
    for bad in ({"workers": 0}, {"error_strategy": 1}, {"pubsub": 1}):
        with pytest.raises((ValueError, TypeError)):
            R.Config(**bad)
    assert (R.Config().batch_size, R.Config().claim_ttl) == (50, 120)


def test_pubsub():
    p = R.PubSub()
    a, b = p.subscribe("x"), p.subscribe("x")
    assert p.publish("x", 1) == 2 and p.publish("y", 1) == 0
    a.popleft()
    p.unsubscribe("x", a)
    p.publish("x", 2)
    assert (list(a), list(b)) == ([], [1, 2])


def test_commands_and_loading():
    cart, _ = make()
    reg, mem = Registry(), Memory()
    reg.define("shop.add", n=int)
    ctx = R.CommandContext("s", {"user": 1}, reg, within="shop")
    m = ctx.build("shop.add", {"n": 1}, metadata={"ip": 2})
    assert (m.stream_id, m.metadata) == ("s", {"user": 1, "ip": 2}) and R.dispatch(mem, m, reg).seq == 1
    for bad, error in ((("shop.add", {"n": "x"}), R.InvalidMessageError), (("shop.other", {}), R.UnknownMessageError), (("add", {}), R.UnknownMessageError)):
        with pytest.raises(error):
            ctx.build(*bad)
    one, _ = R.load(mem, cart, "c")
    _, events = R.command(mem, one, "add", {"n": 1}, store=True)
    again, seen = R.load(mem, cart, "c")
    assert [e.id for e in seen] == [e.id for e in events] and R.load(mem, again)[1] == []
    stale, _ = R.load(mem, cart, "c", upto=0)
    with pytest.raises(ConcurrentAppendError):
        R.command(mem, stale, "add", store=True)


def test_handler_and_actions():
    class Mailer(R.Handler):
        pass

    @Mailer.on("added")
    def mail(m, history, replaying):
        return [m.follow("mail", {"n": len(history)}), m.follow("later").at(NOW + timedelta(1)), m.follow("later2").at(NOW + timedelta(1))]

    mem = Memory()
    router = R.Router(mem)
    router.register(Mailer)
    mem.append_next([Message("added", "a", created_at=NOW)])
    assert router.drain(NOW) == 1 and mem.log[1].payload == {"n": 1} and mem.log[1].causation_id == mem.log[0].id
    assert len(mem.scheduled) == 2 and len(R.actions_for(mem.scheduled, NOW)) == 1
    with pytest.raises(ZeroDivisionError), R.transaction(mem):
        mem.append_next([Message("x", "y")])
        1 / 0
    assert len(mem.log) == 2


def test_scenarios():
    cart, total = make()
    s = R.Scenario("c", cart)
    s.given("added").when("add", {"n": 1}).then(Message("added", "c", {"n": 1}))
    R.Scenario("c", cart).given("added").given("added").given("added").when("add").then()
    R.Scenario("c", cart).when("add", {"n": -1}).then(ValueError)
    R.Scenario("c", cart, total).when("add").then(lambda found: None if [m.type for m in found] == ["added"] else pytest.fail(str(found)))
    with pytest.raises(AssertionError):
        R.Scenario("c", cart).when("add").then(Message("other", "c"))


def test_workflow_waits():
    def double(x):
        return 2 * x

    class Flow(Workflow):
        retries = 2

        def execute(self, x):
            y = self.step(double, x)
            self.wait(60)
            return y + 1

    mem = Memory()
    assert R.start_workflow(mem, Flow, "workflow-1", 20, now=NOW) == "started"
    assert R.advance_workflow(mem, Flow, "workflow-1", NOW) == "started"
    later = NOW + timedelta(seconds=60)
    assert mem.promote(later) == 1 and R.advance_workflow(mem, Flow, "workflow-1", later) == "complete"
    assert mem.log[-1].payload["output"] == 41


def test_sink(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        streaming.sink(stream, lambda df: df.where("id % 2 = 0"), f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_class_name(spark):
    assert spark.range(1).select(functions.class_name(F.lit("item_was_added"))).first()[0] == "ItemWasAdded"


def test_equal_messages_stay_apart():
    mem = Memory()
    mem.append_next(Message("x", "a", {"i": 1}) for _ in range(3))
    assert len({m.id for m in mem.log}) == 3 and all(m.causation_id == m.correlation_id == m.id for m in mem.log)
    mem.scheduled = [Message("x", "b", created_at=NOW) for _ in range(3)]
    assert mem.promote(NOW, limit=2) == 2 and len(mem.scheduled) == 1
