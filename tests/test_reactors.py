from datetime import datetime, timedelta

import pytest

from logweave.reactors import Actor, InfiniteLoopError, Memory, Message, PastMessageDateError, Projector, Registry, SmallerSequenceError, Unit, Workflow, run_actor, topology

NOW = datetime(2024, 1, 1)


class Things(Actor):
    pass


@Things.command("create")
def create(state, c, apply):
    if not state.get("created"):
        apply("created", {"name": c.payload.get("name", "")})


@Things.event("created")
def created(state, e):
    state["created"] = True


@Things.reaction("created")
def welcome(state, e, dispatch):
    dispatch("notify", {"name": e.payload["name"]})
    dispatch("remind", at=e.created_at + timedelta(days=1))


@Things.command("notify")
def notify(state, c, apply):
    apply("notified")


class Totals(Projector):
    pass


@Totals.event("created")
def count(state, e):
    state["n"] = state.get("n", 0) + 1


def test_messages():
    r = Registry()
    r.define("add", value=int)
    m = Message("add", "s", {"value": "x"})
    assert r.errors(m) and not r.errors(Message("add", "s", {"value": 1})) and r.errors(Message("other", "s"))
    child = m.follow("added")
    assert (child.causation_id, child.correlation_id, m.causation_id) == (m.id, m.correlation_id, m.id)
    assert m.with_metadata(a=1).correlate(Message("x", "s", metadata={"b": 2})).metadata == {"a": 1, "b": 2}
    with pytest.raises(PastMessageDateError):
        Message("x", "s", created_at=NOW).at(NOW - timedelta(1))


def test_unit():
    mem = Memory()
    unit = Unit(mem, Things, Totals)
    done = unit.handle(Message("create", "t1", {"name": "a"}, created_at=NOW))
    assert [m.type for m in mem.log] == ["create", "created", "notify", "notified"]
    assert [m.seq for m in mem.log] == [1, 2, 3, 4]
    assert len({m.correlation_id for m in mem.log}) == 1 and [m.type for m in done] == ["create", "created", "notify"]
    assert [m.type for m in mem.scheduled] == ["remind"]
    assert mem.promote(NOW) == 0 and mem.promote(NOW + timedelta(days=2)) == 1
    assert len(mem.correlated(mem.log[0].id)) == 5


def test_loops_leave_nothing():
    class Loop(Actor):
        pass

    @Loop.command("go")
    def go(state, c, apply):
        apply("went")

    Loop.event("went")()

    @Loop.reaction("went")
    def again(state, e, dispatch):
        dispatch("go")

    mem = Memory()
    with pytest.raises(InfiniteLoopError):
        Unit(mem, Loop, max_iterations=10).handle(Message("go", "l"))
    assert mem.log == []


def test_guards():
    with pytest.raises(ValueError):
        Things.reaction("create")(lambda *a: None)
    with pytest.raises(SmallerSequenceError):
        Things("s").evolve([Message("created", "s", seq=1), Message("created", "s", seq=1)])


def test_workflow():
    tries = []

    def flaky(x):
        tries.append(x)
        if len(tries) < 2:
            raise RuntimeError("no")
        return x * 2

    class Flow(Workflow):
        retries = 2

        def execute(self, x):
            y = self.step(flaky, x)
            self.wait(5)
            return y + 1

    log = [Message("workflow.started", "w", {"args": [3]}, seq=1)]
    for _ in range(9):
        new = Flow.handle(log, NOW)
        log += new
        if new and new[-1].type == "wait.started":
            log.append(Message("wait.ended", "w", {"count": 1}, seq=log[-1].seq + 1))
        if not new:
            break
    assert [m.type for m in log] == ["workflow.started", "step.started", "step.failed", "step.started", "step.complete", "wait.started", "wait.ended", "workflow.complete"]
    assert log[-1].payload["output"] == 7 and tries == [3, 3]


def test_topology():
    nodes, edges = topology(Things, Totals)
    assert ("create", "created") in edges and ("created-Things-aut", "notify") in edges and ("created", "Totals-rm") in edges
    assert ("create", "command", "Things") in nodes


def test_two_commands_of_a_batch_get_their_own_numbers(spark):
    rows = [("s", 1, "create", "{}"), ("s", 2, "create", "{}"), ("t", 1, "create", '{"name": "x"}')]
    out = run_actor(spark.createDataFrame(rows, "stream_id string, seq long, type string, payload string"), Things).collect()
    assert sorted((r["stream_id"], r["seq"], r["type"]) for r in out) == [("s", 3, "created"), ("t", 2, "created")]  # 1 and 2 are the commands'
