"""Reactors in Python: messages, actors, projectors, handlers, synchronous units, durable workflows, topology.

For handlers that columns can't say. ``Memory`` is a log on the driver for tests and small cascades; ``run_actor`` runs an
actor over a log DataFrame, one stream after another in each task.
"""

from __future__ import annotations

import ast
import copy
import hashlib
import inspect
import json
import textwrap
import traceback
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta
from typing import Any

from .operators.log import ConcurrentAppendError


class InfiniteLoopError(Exception):
    pass


class PastMessageDateError(ValueError):
    pass


class SmallerSequenceError(ValueError):
    pass


class DifferentStreamError(ValueError):
    pass


@dataclass(frozen=True)
class Message:
    type: str
    stream_id: str
    payload: dict = field(default_factory=dict)
    id: str = ""
    seq: int = 1
    created_at: datetime = datetime(1970, 1, 1)
    causation_id: str = ""
    correlation_id: str = ""
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.stream_id or not self.type:
            raise ValueError("a message has a stream and a type")
        if not self.id:  # derived, so that the same work makes the same messages
            content = json.dumps([self.type, self.stream_id, self.payload, self.seq, self.causation_id], sort_keys=True, default=str)
            object.__setattr__(self, "id", hashlib.md5(content.encode()).hexdigest())
        for name in ("causation_id", "correlation_id"):
            if not getattr(self, name):
                object.__setattr__(self, name, self.id)

    def follow(self, type_: str, payload: dict | None = None, **other) -> Message:
        base = {"stream_id": self.stream_id, "created_at": self.created_at, "metadata": {**self.metadata, **other.pop("metadata", {})}}
        return Message(type_, payload=payload or {}, causation_id=self.id, correlation_id=self.correlation_id, **{**base, **other})

    def correlate(self, child: Message) -> Message:
        return replace(child, causation_id=self.id, correlation_id=self.correlation_id, metadata={**self.metadata, **child.metadata})

    def to(self, stream_id: str) -> Message:
        return replace(self, stream_id=stream_id)

    def at(self, time: datetime) -> Message:
        if time < self.created_at:
            raise PastMessageDateError(time)
        return replace(self, created_at=time)

    def with_metadata(self, **more) -> Message:
        return replace(self, metadata={**self.metadata, **more})


class Registry:
    """Message types and the payload fields that they require: {field: type}."""

    def __init__(self):
        self.types: dict[str, dict[str, type]] = {}

    def define(self, type_: str, **fields: type) -> str:
        self.types[type_] = fields
        return type_

    def build(self, type_: str, stream_id: str, payload: dict | None = None, **other) -> Message:
        """A message whose fields are read as their types where that can be done, such as ``"5"`` as a number; see ``errors``."""
        read = dict(payload or {})
        for name, t in self.types.get(type_, {}).items():
            try:
                read[name] = read[name] if isinstance(read[name], t) else t(read[name])
            except (KeyError, TypeError, ValueError):
                pass
        return Message(type_, stream_id, read, **other)

    def errors(self, m: Message) -> dict[str, str]:
        if m.type not in self.types:
            return {"type": "unknown"}
        return {k: f"is no {t.__name__}" for k, t in self.types[m.type].items() if not isinstance(m.payload.get(k), t)}


class Reactor:
    """Handlers by message type. A subclass starts with copies of its parent's; a type is a command or an event reacted to, not both."""

    @classmethod
    def identity_from(cls, m: Message) -> str:
        """The stream of the instance that handles a message."""
        return m.stream_id

    commands: dict[str, Callable] = {}
    events: dict[str, Callable | None] = {}
    reacts: dict[str | None, list[Callable]] = {}
    before: Callable | None = None
    group_id = ""
    batch_size: int | None = None  # messages that it's given at once; None: the router's

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        cls.commands, cls.events, cls.reacts = dict(cls.commands), dict(cls.events), {k: [*v] for k, v in cls.reacts.items()}
        cls.group_id = cls.__dict__.get("group_id") or cls.__name__

    @classmethod
    def command(cls, type_: str):
        def add(f):
            if type_ in cls.reacts:
                raise ValueError(f"{type_} is reacted to")
            cls.commands[type_] = f
            return f

        return add

    @classmethod
    def event(cls, *types: str):
        def add(f=None):
            cls.events.update(dict.fromkeys(types, f))
            return f

        return add

    @classmethod
    def reaction(cls, *types: str):
        """Of no types: of every event evolved that has no reaction of its own."""

        def add(f):
            for t in types or (None,):
                if t in cls.commands:
                    raise ValueError(f"{t} is a command")
                if issubclass(cls, Projector) and t is not None and t not in cls.events:
                    raise ValueError(f"{t} isn't evolved")
                cls.reacts.setdefault(t, []).append(f)
            return f

        return add

    @classmethod
    def handled(cls) -> set[str]:
        return set(cls.commands) | {t for t in cls.reacts if t} | (set(cls.events) if None in cls.reacts or issubclass(cls, Projector) else set())

    @staticmethod
    def initial(stream_id: str) -> Any:
        return {}

    def __init__(self, stream_id: str):
        self.stream_id, self.seq, self.state, self.new = stream_id, 0, self.initial(stream_id), []
        self.synced: list[Callable] = []

    strict = True

    def evolve(self, events: Iterable[Message]) -> Any:
        for e in events:
            if self.strict:
                if e.stream_id != self.stream_id:
                    raise DifferentStreamError(e.stream_id)
                if e.seq <= self.seq:
                    raise SmallerSequenceError(e.seq)
            self.seq = e.seq
            if e.type in self.events:
                if self.before:
                    type(self).before(self.state, e)
                if f := self.events[e.type]:
                    new = f(self.state, e)
                    self.state = self.state if new is None else new
        return self.state

    def react(self, e: Message) -> list[Message]:
        out: list[Message] = []

        def dispatch(type_: str, payload: dict | None = None, to: str | None = None, at: datetime | None = None, **metadata) -> None:
            m = e.follow(type_, payload, metadata={"producer": self.group_id, **metadata}, **({"stream_id": to} if to else {}))
            out.append(m.at(at) if at else m)

        for f in self.reacts.get(e.type) or (self.reacts.get(None, []) if e.type in self.events else []):
            f(self.state, e, dispatch)
        return out


class Actor(Reactor):
    """Decides commands: a handler (state, command, apply) applies events, which the state has taken in when apply returns."""

    def decide(self, c: Message) -> list[Message]:
        new: list[Message] = []

        def apply(type_: str, payload: dict | None = None) -> None:
            e = c.follow(type_, payload, seq=self.seq + 1)
            self.evolve([e])
            new.append(e)

        self.commands[c.type](self.state, c, apply)
        return new


class Projector(Reactor):
    """Folds events into a read model; reacts to live ones only."""

    strict = False


class Memory:
    """A log in memory with all-or-nothing appends."""

    def __init__(self):
        self.log: list[Message] = []
        self.scheduled: list[Message] = []

    def stream(self, stream_id: str, after: int = 0, upto: int | None = None) -> list[Message]:
        return [m for m in self.log if m.stream_id == stream_id and m.seq > after and (upto is None or m.seq <= upto)]

    def recent(self, limit: int = 10) -> list[tuple[str, int, datetime]]:
        """(stream, last seq, time) of the streams with the latest messages."""
        if limit < 0:
            raise ValueError("limit must not be negative")
        last: dict[str, tuple] = {}
        for m in self.log:
            seq, at = last.get(m.stream_id, (0, m.created_at))
            last[m.stream_id] = max(seq, m.seq), max(at, m.created_at)
        return sorted(((s, *x) for s, x in last.items()), key=lambda x: (-x[2].timestamp(), x[0]))[:limit]

    def correlated(self, message_id: str) -> list[Message]:
        of = {m.correlation_id for m in self.log if m.id == message_id}
        return [m for m in self.log if m.correlation_id in of]

    def append_next(self, messages: Iterable[Message]) -> list[Message]:
        out = []
        for m in messages:
            last = max((x.seq for x in self.log if x.stream_id == m.stream_id), default=0)
            if any(x.id == m.id for x in self.log):  # the same was said before: its number tells them apart
                own = {k: "" for k in ("causation_id", "correlation_id") if getattr(m, k) == m.id}
                m = replace(m, id="", seq=last + 1, **own)
            out.append(replace(m, seq=last + 1))
            self.log.append(out[-1])
        return out

    def append_after(self, messages: list[Message]) -> None:
        taken = {(m.stream_id, m.seq) for m in self.log}
        if len({m.stream_id for m in messages}) > 1:
            raise ValueError("messages of one stream at a time")
        keys = [(m.stream_id, m.seq) for m in messages]
        if taken & set(keys) or len(set(keys)) < len(keys):
            raise ConcurrentAppendError(keys)
        self.log += messages

    def promote(self, now: datetime, limit: int = 100) -> int:
        """Messages that are due go to the log, the earliest first, of one time in the order they came in; their number."""
        due = sorted((m for m in self.scheduled if m.created_at <= now), key=lambda m: m.created_at)[:limit]
        taken = {id(m) for m in due}
        self.scheduled = [m for m in self.scheduled if id(m) not in taken]
        self.append_next(replace(m, created_at=now) for m in due)
        return len(due)


class Unit:
    """A message and all that follows from it, first come first served, in one transaction: all is kept, or on an error nothing."""

    def __init__(self, memory: Memory, *reactors: type[Reactor], max_iterations: int = 100, persist_commands: bool = True):
        self.memory, self.reactors, self.max, self.persist = memory, reactors, max_iterations, persist_commands
        self.produced: dict[tuple[str, str], list[Message]] = {}
        self.instances: dict[tuple[str, str], Reactor] = {}

    def handle(self, message: Message, now: datetime | None = None) -> list[Message]:
        """Messages handled, in order. Those of a later time than ``now`` (the message's own, if not given) are scheduled."""
        before = [*self.memory.log], [*self.memory.scheduled]
        now = now or message.created_at
        try:
            first = self.memory.append_next([message])[0] if self.persist else message
            queue, done = deque([first]), []
            while queue:
                m = queue.popleft()
                done.append(m)
                if len(done) > self.max:
                    raise InfiniteLoopError(m.type)
                for r in self.reactors:
                    if m.type in r.handled():
                        queue += self._step(r, m, now)
            return done
        except Exception:
            self.memory.log, self.memory.scheduled = before
            raise

    def _step(self, r: type[Reactor], m: Message, now: datetime) -> list[Message]:
        instance = r.identity_from(m)
        actor = r(instance)
        history = self.memory.stream(instance)
        actor.evolve(history)
        if m.type in r.commands:
            actor.seq = max((x.seq for x in history), default=0)
            new = actor.decide(m)
            if new:
                self.memory.append_after(new)
            said = new, m
        else:
            out = actor.react(m)
            self.memory.scheduled += [x for x in out if x.created_at > now]
            live = [x for x in out if x.created_at <= now]
            new = self.memory.append_next(live) if self.persist else live
            said = [m] if m.type in r.events else [], None
        for f in getattr(r, "syncs", []):
            f(actor.state, *said)
        self.produced.setdefault((r.group_id, instance), []).extend(new)
        self.instances[r.group_id, instance] = actor
        return [x for x in new if any(x.type in q.handled() for q in self.reactors)]

    def __getitem__(self, key: tuple[type[Reactor], str]) -> Reactor | None:
        """The last instance of a reactor that handled a message of a stream."""
        return self.instances.get((key[0].group_id, key[1]))

    def events_for(self, reactor: type[Reactor], stream_id: str) -> list[Message]:
        """What a reactor's instances of a stream produced, in order."""
        return self.produced.get((reactor.group_id, stream_id), [])


class Halt(Exception):
    """A workflow's step has said something; it goes on when that is in the log."""


def step_key(name: str, args: list | tuple) -> str:
    """Key of a workflow step: the same in every process, and as ``functions.step_key`` has it."""
    return hashlib.sha256(json.dumps({"name": name, "args": list(args)}, separators=(",", ":"), default=str).encode()).hexdigest()


class Workflow:
    """A durable workflow: ``execute`` runs again after every event; steps that are complete give their stored output.

    ``retries`` is the number of attempts in all. Step keys are the same in every process. A subclass with a ``prefix`` of
    its own has its events under that name.
    """

    retries = 0
    prefix = ""
    #: Events of a workflow, and those it goes on after. Fixed values.
    SAYS = ("workflow.started", "context.updated", "workflow.complete", "workflow.failed", "step.started", "step.failed", "step.complete", "wait.started", "wait.ended")
    UNHANDLED = ("context.updated", "workflow.failed")

    @classmethod
    def typed(cls, name: str) -> str:
        return f"{cls.prefix}.{name}" if cls.prefix else name

    @classmethod
    def handled(cls) -> set[str]:
        return {cls.typed(n) for n in cls.SAYS if n not in cls.UNHANDLED}

    def execute(self, *args):
        raise NotImplementedError

    def __init__(self, stream_id: str, now: datetime):
        self.stream_id, self.now, self.context, self.waits = stream_id, now, {}, 0
        self.steps: dict[str, dict] = {}
        self.waiting: dict[int, bool] = {}
        self.status, self.out, self.seq, self.args, self.output = "new", [], 0, [], None

    def evolve(self, events: Iterable[Message]) -> None:
        skip = len(self.prefix) + 1 if self.prefix else 0
        for e in events:
            self.seq, p, kind = e.seq, e.payload, e.type[skip:]
            if self.prefix and not e.type.startswith(self.prefix + "."):
                continue
            if kind == "workflow.started":
                self.status, self.args = "started", p["args"]
            elif kind.startswith("step."):
                s = self.steps.setdefault(p["key"], {"attempts": 0})
                s["status"] = kind[5:]
                s["attempts"] += kind == "step.started"
                s["output"], s["backtrace"] = p.get("output"), p.get("backtrace")
            elif kind == "context.updated":
                self.context = copy.deepcopy(p["context"])
            elif kind in ("wait.started", "wait.ended"):
                self.waiting[p["count"]] = kind == "wait.ended"
            elif kind in ("workflow.complete", "workflow.failed"):
                self.status, self.output = kind[9:], p.get("output")

    def _say(self, name: str, **payload) -> None:
        self.seq += 1
        self.out.append(Message(self.typed(name), self.stream_id, payload, seq=self.seq, created_at=self.now))

    def step(self, f: Callable, *args):
        key = step_key(f.__name__, args)
        s = self.steps.get(key, {"status": None, "attempts": 0})
        if s["status"] == "complete":
            return s["output"]
        if s["status"] in (None, "failed"):
            self._say("step.started", key=key, step_name=f.__name__, args=list(args))
        else:
            try:
                self._say("step.complete", key=key, step_name=f.__name__, output=f(*args))
            except Exception as e:
                told = traceback.format_exception(e)
                self._say("step.failed", key=key, step_name=f.__name__, error_message=str(e), error_class=type(e).__name__, backtrace=told)
                if s["attempts"] >= self.retries:
                    self._say("workflow.failed")
        raise Halt

    def wait(self, seconds: float) -> None:
        self.waits += 1
        if self.waiting.get(self.waits):
            return
        if self.waits not in self.waiting:
            self._say("wait.started", count=self.waits, at=(self.now + timedelta(seconds=seconds)).isoformat())
        raise Halt

    @classmethod
    def handle(cls, history: list[Message], now: datetime) -> list[Message]:
        """What the workflow says next, given its stream so far; nothing once it has ended. A context that changed is said
        before the end."""
        flow = cls(history[0].stream_id, now)
        flow.evolve(history)
        if flow.status != "started":
            return []
        before, result, ended = copy.deepcopy(flow.context), None, False
        try:
            result, ended = flow.execute(*copy.deepcopy(flow.args)), True
        except Halt:
            pass
        if flow.context != before:
            flow._say("context.updated", context=copy.deepcopy(flow.context))
        if ended:
            flow._say("workflow.complete", output=result)
        return flow.out


def _value(node: ast.expr, names: dict) -> Any:
    """What an expression of constants, names, attributes and subscripts stands for where its function was defined."""
    if isinstance(node, ast.Constant):
        return node.value
    if isinstance(node, ast.Name):
        return names.get(node.id)
    if isinstance(node, ast.Attribute):
        return getattr(_value(node.value, names), node.attr, None)
    if isinstance(node, ast.Subscript):
        try:
            return _value(node.value, names)[_value(node.slice, names)]
        except (KeyError, IndexError, TypeError):
            return None
    if isinstance(node, ast.JoinedStr):
        parts = [_value(v.value if isinstance(v, ast.FormattedValue) else v, names) for v in node.values]
        return "".join(map(str, parts)) if None not in parts else None
    return None


def said(f: Callable) -> list[str]:
    """Message types that a handler applies or dispatches, read from its source: first arguments of calls of the functions it was
    given, resolved in its closure, its module and the builtins."""
    try:
        tree = ast.parse(textwrap.dedent(inspect.getsource(f)))
        scope = inspect.getclosurevars(f)
    except (OSError, TypeError, SyntaxError, ValueError):
        return []
    names = {**scope.builtins, **getattr(f, "__globals__", {}), **scope.globals, **scope.nonlocals}
    given = set(list(inspect.signature(f).parameters)[2:]) or {"apply", "dispatch"}
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in given and node.args:
            value = _value(node.args[0], names)
            value = value if isinstance(value, str) else getattr(value, "type", None)
            if isinstance(value, str):
                out.append((node.lineno, node.col_offset, value))
    return list(dict.fromkeys(v for _, _, v in sorted(out)))


_TOPOLOGIES: dict[tuple, tuple] = {}


def reset_topology() -> None:
    """Reactors changed: topologies are read anew."""
    _TOPOLOGIES.clear()


def topology(*reactors: type[Reactor]) -> tuple[list[tuple[str, str, str]], list[tuple[str, str]]]:
    """(nodes: id, kind, group; edges: from, to) of the flow of messages, read from the source of the handlers, once.

    An event belongs to the first reactor that has it. Automations consume events, those of projectors the read model.
    """
    if reactors in _TOPOLOGIES:
        return _TOPOLOGIES[reactors]
    nodes, edges = {}, []
    for r in reactors:
        for c, f in r.commands.items():
            nodes.setdefault(c, (c, "command", r.group_id))
            edges += [(c, e) for e in said(f)]
        for e in r.events:
            nodes.setdefault(e, (e, "event", r.group_id))
        model = f"{r.group_id}-rm"
        if issubclass(r, Projector):
            nodes[model] = (model, "readmodel", r.group_id)
            edges += [(e, model) for e in r.events]
        for t, fs in r.reacts.items():
            at = f"{t}-{r.group_id}-aut" if t else f"{r.group_id}-aut"
            nodes[at] = (at, "automation", r.group_id)
            sources = [model] if issubclass(r, Projector) else [t] if t else [e for e in r.events if e not in r.reacts]
            edges += [(x, at) for x in sources] + [(at, c) for f in fs for c in said(f)]
    _TOPOLOGIES[reactors] = list(nodes.values()), list(dict.fromkeys(edges))
    return _TOPOLOGIES[reactors]


def topology_frames(spark, *reactors: type[Reactor]):
    """The topology as DataFrames: nodes (id, kind, group_id) and edges (source, target)."""
    nodes, edges = topology(*reactors)
    return spark.createDataFrame(nodes, "id string, kind string, group_id string"), spark.createDataFrame(edges, "source string, target string")


#: What a reactor over DataFrames gives: messages and where they go.
SAID = "action string, id string, stream_id string, seq long, type string, payload string, metadata string, created_at timestamp_ntz, causation_id string, correlation_id string"


def run_reactor(log, pending, reactor: type[Reactor], now: datetime, identity=None):
    """What a reactor says to ``pending`` messages, given the log: rows of SAID, with ``action`` append_after, append_next or schedule.

    Both are DataFrames of id, stream_id, seq, type, payload (JSON) and, if they have them, created_at, causation_id,
    correlation_id, metadata (JSON) and replaying; pending rows may be in the log as well. Instances are told apart by
    ``identity``, a column, by default the stream. All of an instance's log is taken in first, then its pending messages
    come in order of seq: state and numbers are threaded through them, so no two events get one number, and those go on
    from the stream's last. Replayed messages are skipped. Streams are read from sorted partitions and never gathered.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    identity = F.col("stream_id") if identity is None else identity
    kinds = {"id": "string", "stream_id": "string", "seq": "long", "type": "string", "payload": "string", "metadata": "string", "created_at": "timestamp_ntz", "causation_id": "string", "correlation_id": "string", "replaying": "boolean"}

    def rows(df, late: bool):
        columns = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
        return df.select(identity.alias("instance"), F.lit(late).alias("late"), *columns)

    def message(row) -> Message:
        text = lambda v: v if isinstance(v, str) else ""
        at = now if pd.isna(row.created_at) else row.created_at.to_pydatetime()
        return Message(row.type, row.stream_id, json.loads(text(row.payload) or "{}"), text(row.id), int(row.seq), at, text(row.causation_id), text(row.correlation_id), json.loads(text(row.metadata) or "{}"))

    def run(frames):
        one, names = None, [f.split()[0] for f in SAID.split(", ")]
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if one is None or one.stream_id != row.instance:
                    one = reactor(row.instance)
                if not row.late:
                    if row.type in reactor.events and row.stream_id == one.stream_id:
                        one.evolve([message(row)])
                    elif row.stream_id == one.stream_id:
                        one.seq = max(one.seq, int(row.seq))
                    continue
                if row.replaying is True:
                    continue
                m = message(row)
                if m.type in reactor.commands:
                    said_ = [("append_after", e) for e in one.decide(m)]
                else:
                    said_ = [("schedule" if e.created_at > now else "append_next", e) for e in one.react(m)]
                for n, (action, e) in enumerate(said_):
                    id_ = hashlib.md5(f"{m.id}:{e.type}:{n}".encode()).hexdigest()
                    out.append((action, id_, e.stream_id, e.seq if action == "append_after" else None, e.type, json.dumps(e.payload, sort_keys=True), json.dumps(e.metadata, sort_keys=True), e.created_at, e.causation_id, e.correlation_id))
            yield pd.DataFrame(out, columns=names).astype({"seq": "Int64", "created_at": "datetime64[us]"})

    both = rows(log, False).unionByName(rows(pending, True))
    return both.repartition("instance").sortWithinPartitions("instance", "late", "seq", "id").mapInPandas(run, SAID)


def run_actor(log, actor: type[Actor]):
    """The events an actor decides for the commands in a log DataFrame (stream_id, seq, type, payload as JSON), numbered on from
    each stream's last."""
    from pyspark.sql import functions as F

    commands = log.where(F.col("type").isin(list(actor.commands)))
    return run_reactor(log, commands, actor, datetime(1970, 1, 1)).select("stream_id", "seq", "type", "payload", "causation_id")
