"""Authoring: immutable sources, flows, sinks and graphs. Composing runs nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame

from .functions import Expr, Fold, Py
from .operators.interpreter import ADMITTED
from .options import BufferOptions, CollectOptions, DistinctOptions, GroupByOptions, KeyOverflowPolicy, OverflowPolicy, ParallelismOptions, SupervisionForm, SupervisionOptions, ThrottleMode, ThrottleOptions, ValveMode, at_least, positive
from .plans import identity, vocabulary
from .plans.document import DURABLE_STATE, EPHEMERAL, NONDEPLOYABLE, Contract, GraphDocument, GraphEdge, Port, ResultSlot, StageNode, StageRef

#: Sources whose elements come from code or memory that a document cannot hold.
SOURCES_OF_CODE = ("single", "from-task", "failed", "unfold", "unfold-async", "from-async-enumerable", "from-factory", "from-async-factory", "cycle")


NO_FALLBACK = object()


@dataclass(frozen=True, eq=False)
class Node:
    kind: str
    params: dict = field(default_factory=dict)
    bind: dict = field(default_factory=dict)
    inputs: tuple[tuple[Node, str], ...] = ()
    name: str | None = None
    ref: StageRef | None = None
    slot: str | None = None

    @property
    def opaque(self) -> bool:
        """Whether a function that the document cannot hold is bound to it."""
        if self.ref is not None:
            return False
        found = [v for k, v in self.bind.items() if k in ("fn", "cost", "key", "combine")]
        for kind, b in self.bind.get("steps", []):
            found += [v for k, v in b.items() if k in ("fn", "fold")]
        if self.kind == "from-enumerable" and not self.params:
            return True
        f = self.bind.get("fold")
        if isinstance(f, Fold) and (f.kind == "python" or not isinstance(f.value, (str, type(None)))):
            return True
        return any(_opaque(v) for v in found) or self.kind in (*SOURCES_OF_CODE, "valve", "first-or-default", "last-or-default", "for-each", "for-each-async", "to-channel", "queue", "from-channel")


def _opaque(e: Any) -> bool:
    if isinstance(e, dict):
        return any(_opaque(v) for v in e.values())
    if isinstance(e, Fold):
        return e.kind == "python" or _opaque(e.value)
    return not (e is None or isinstance(e, str))


def _said(e: Any) -> dict:
    """What a document can say of a functional parameter: SQL text."""
    if isinstance(e, dict) and not _opaque(e):
        return {"columns": dict(e)}
    return {"expression": e} if isinstance(e, str) else {}


def _fold_params(f: Fold) -> dict:
    seed = {"seed": f.seed} if isinstance(f.seed, (int, str, type(None))) else {}
    return {"fold": f.kind, **seed, **_said(f.value)}


class Operators:
    """The stages that sources and flows share. Each method gives a new object; `_add` appends one stage."""

    def _add(self, kind: str, params: dict, bind: dict):
        raise NotImplementedError

    # stateless
    def select(self, fn: Expr | dict[str, Expr] | Py):
        return self._add("select", _said(fn), {"fn": fn})

    def where(self, fn: Expr | Py):
        return self._add("where", _said(fn), {"fn": fn})

    def choose(self, fn: Expr):
        """Map, and drop what maps to null: a select-many of no or one element."""
        from pyspark.sql import functions as F

        from .functions import column

        as_array = lambda: F.when(column(fn).isNull(), F.array()).otherwise(F.array(column(fn)))
        sql = f"CASE WHEN ({fn}) IS NULL THEN array() ELSE array({fn}) END" if isinstance(fn, str) else as_array
        return self._add("select-many", _said(sql), {"fn": sql, "check": False})

    def select_many(self, fn: Expr | Py):
        return self._add("select-many", _said(fn), {"fn": fn})

    def merge_map(self, options: ParallelismOptions, fn: Expr | Py):
        options.check()
        return self._add("merge-map", {"maxConcurrency": options.max_concurrency, **_said(fn)}, {"fn": fn, "options": options})

    def _async(self, kind: str, options: ParallelismOptions, fn: Expr | Py):
        options.check()
        return self._add(kind, {"maxConcurrency": options.max_concurrency, **_said(fn)}, {"fn": fn, "options": options})

    def select_async(self, options: ParallelismOptions, fn):
        return self._async("select-async", options, fn)

    def select_async_unordered(self, options: ParallelismOptions, fn):
        return self._async("select-async-unordered", options, fn)

    def select_value_task_async(self, options: ParallelismOptions, fn):
        return self._async("select-value-task-async", options, fn)

    def select_value_task_async_unordered(self, options: ParallelismOptions, fn):
        return self._async("select-value-task-async-unordered", options, fn)

    def via_registered(self, registry, stage: str, name: str, **params):
        entry = registry.flow(stage)
        return self._add("registered", params, {"flow": entry.fn, "params": params, "ref": entry.ref}).named(name)

    def fault_point(self, fn: Expr | Py):
        return self._add("fault-point", _said(fn), {"fn": fn})

    # positional
    def take(self, n: int):
        return self._add("take", {"count": at_least("n", n, 0)}, {"n": n})

    def skip(self, n: int):
        return self._add("skip", {"count": at_least("n", n, 0)}, {"n": n})

    def take_while(self, fn):
        return self._add("take-while", _said(fn), {"fn": fn})

    def take_through(self, fn):
        return self._add("take-through", _said(fn), {"fn": fn})

    def skip_while(self, fn):
        return self._add("skip-while", _said(fn), {"fn": fn})

    def distinct(self, options: DistinctOptions):
        options.check()
        return self._add("distinct", {"maxTrackedKeys": options.max_tracked_keys, "overflowPolicy": str(KeyOverflowPolicy(options.overflow_policy))}, {"options": options})

    def deduplicate_consecutive(self):
        return self._add("deduplicate-consecutive", {}, {})

    # folds
    def scan(self, fold: Fold):
        return self._add("scan", _fold_params(fold), {"fold": fold})

    def scan_durable(self, fold: Fold, export: Callable[[Any], Any], restore: Callable[[Any], Any]):
        return self._add("scan", _fold_params(fold), {"fold": fold, "export": export, "restore": restore})

    def scan_async(self, fold: Fold):
        return self._add("scan-async", _fold_params(fold), {"fold": fold})

    # batches
    def grouped(self, size: int):
        return self._add("grouped", {"size": at_least("size", size, 1)}, {"size": size})

    def sliding(self, size: int, step: int = 1):
        return self._add("sliding", {"size": at_least("size", size, 1), "step": at_least("step", step, 1)}, {"size": size, "step": step})

    def grouped_within(self, max_elements: int, window_micros: int):
        at_least("max_elements", max_elements, 1)
        return self._add("grouped-within", {"maxElements": max_elements, "windowTicks": 10 * positive("window_micros", window_micros)}, {"size": max_elements, "window": window_micros})

    def grouped_weighted_within(self, max_elements: int, max_weight: int, window_micros: int, cost: Callable[[dict], int]):
        at_least("max_elements", max_elements, 1)
        at_least("max_weight", max_weight, 1)
        params = {"maxElements": max_elements, "maxWeight": max_weight, "windowTicks": 10 * positive("window_micros", window_micros)}
        return self._add("grouped-weighted-within", params, {"size": max_elements, "window": window_micros, "max_weight": max_weight, "cost": cost})

    def group_by(self, options: GroupByOptions, key: Expr | Py, flow: Flow, *, key_name: str | None = None, schema: str | None = None):
        """A private instance of the flow for each key. key_name adds the key as a column; schema: what a flow of Python functions gives."""
        options.check()
        _admit("group_by", flow, ADMITTED)
        params = {"maxActiveKeys": options.max_active_keys, "overflowPolicy": str(options.overflow_policy), "flow": [{"stage": k, "parameters": p} for k, p, _ in flow.steps], **_said(key)}
        return self._add("group-by", params, {"options": options, "key": key, "steps": flow.bound, "key_name": key_name, "schema": schema})

    # time
    def _timed(self, kind: str, member: str, what: str, micros: int, t0: int | None, **bind):
        return self._add(kind, {member: 10 * positive(what, micros)}, {what.removesuffix("_micros"): micros, "t0": t0, **bind})

    def initial_delay(self, delay_micros: int, t0: int | None = None):
        return self._timed("initial-delay", "durationTicks", "delay_micros", delay_micros, t0)

    def delay(self, delay_micros: int, holdback: BufferOptions | None = None):
        if holdback:
            holdback.check()
        more = {"capacity": holdback.capacity, "overflowPolicy": str(holdback.overflow_policy)} if holdback else {}
        return self._add("delay", {"delayTicks": 10 * positive("delay_micros", delay_micros), **more}, {"delay": delay_micros, "options": holdback})

    def timeout(self, gap_micros: int, t0: int | None = None):
        return self._timed("timeout", "durationTicks", "gap_micros", gap_micros, t0)

    def take_within(self, window_micros: int, t0: int | None = None):
        return self._timed("take-within", "windowTicks", "window_micros", window_micros, t0)

    def skip_within(self, window_micros: int, t0: int | None = None):
        return self._timed("skip-within", "windowTicks", "window_micros", window_micros, t0)

    def throttle(self, options: ThrottleOptions, cost: Expr | None = None, t0: int | None = None):
        options.check()
        params = {"elements": options.elements, "perTicks": 10 * options.per_micros, "maximumBurst": options.burst, "mode": str(ThrottleMode(options.mode)), **_said(cost)}
        return self._add("throttle", params, {"options": options, "cost": cost, "t0": t0})

    def buffer(self, options: BufferOptions, service_micros: int | None = None):
        """service_micros: the consumer's time for an element, which other policies than backpressure need: losses depend on it."""
        options.check()
        if options.overflow_policy != OverflowPolicy.BACKPRESSURE and service_micros is None:
            raise ValueError(f"the policy {options.overflow_policy} needs service_micros")
        return self._add("buffer", {"capacity": options.capacity, "overflowPolicy": str(OverflowPolicy(options.overflow_policy))}, {"options": options, "service": service_micros})

    def valve(self, control_name: str, mode: ValveMode = ValveMode.OPEN, control: Valve | None = None):
        """control: a handle to move the valve by; by default it stays as mode says."""
        return self._add("valve", {"control": identity.segment("control name", control_name), "mode": str(mode)}, {"control": control or Valve(ValveMode(mode) == ValveMode.OPEN)})

    def feedback(self, flow: Flow, again: Expr, options: BufferOptions, most_rounds: int = 1000):
        """A cycle: elements for which `again` holds behind the flow go back to its input, the others go on.

        What goes back waits in a buffer; one that only pushes back would never be relieved, so that policy is refused. The
        buffer holds what one round sends back, in order; most_rounds bounds a cycle that does not end."""
        options.check()
        if options.overflow_policy == OverflowPolicy.BACKPRESSURE:
            raise ValueError("a cycle through a buffer that pushes back can't move; choose another policy")
        _admit("feedback", flow, ("select", "where", "select-many"))
        params = {"capacity": options.capacity, "overflowPolicy": str(OverflowPolicy(options.overflow_policy)), "mostRounds": at_least("most_rounds", most_rounds, 1), "flow": [{"stage": k, "parameters": p} for k, p, _ in flow.steps], **_said(again)}
        return self._add("feedback", params, {"fn": again, "steps": flow.bound, "options": options, "most": most_rounds})

    # scopes
    def supervised(self, options: SupervisionOptions, flow: Flow, fallback: Any = NO_FALLBACK, schema: str | None = None):
        """fallback: the element that the recover form ends with; null is one."""
        options.check()
        if (options.form == SupervisionForm.RECOVER) != (fallback is not NO_FALLBACK):
            raise ValueError("fallback belongs to the recover form, which needs it")
        fallback = None if fallback is NO_FALLBACK else fallback
        _admit("supervised", flow, ADMITTED)
        params = {"form": str(options.form), "flow": [{"stage": k, "parameters": p} for k, p, _ in flow.steps]}
        if options.form == SupervisionForm.RETRY:
            params |= {"maxAttempts": options.max_attempts, "backoffTicks": [10 * x for x in options.backoff_micros], "onExhaustion": str(options.on_exhaustion)}
        return self._add("supervised", params, {"options": options, "steps": flow.bound, "fallback": fallback, "schema": schema})

    def durable(self, flow: Flow):
        _admit("durable", flow, ("select", "where", "scan", "take", "skip", "fault-point"))
        for kind, _, b in flow.steps:
            if kind == "scan" and b["fold"].kind == "python" and "export" not in b:
                raise ValueError("a fold in a durable scope needs export and restore")
        return self._add("durable", {"flow": [{"stage": k, "parameters": p} for k, p, _ in flow.steps]}, {"steps": flow.bound})


class Valve:
    """The handle of a valve. open() and close() set its state; open(at) and close(at) move it at a time of the stream, in
    microseconds."""

    def __init__(self, is_open: bool):
        self.is_open = is_open
        self.moves: list[tuple[int, bool]] = []

    def open(self, at: int | None = None) -> None:
        self._move(True, at)

    def close(self, at: int | None = None) -> None:
        self._move(False, at)

    def _move(self, state: bool, at: int | None) -> None:
        if at is None:
            self.is_open, self.moves = state, []
        elif self.moves and at <= self.moves[-1][0]:
            raise ValueError("a valve moves in the order of time")
        else:
            self.moves.append((at, state))

    def closed_spans(self) -> list[tuple[int | None, int | None]]:
        """When it is closed: since, until; None: from the start, or for good."""
        out, since, shut = [], None, not self.is_open
        for at, state in self.moves:
            if shut and state:
                out.append((since, at))
            elif not shut and not state:
                since = at
            shut = not state
        return [*out, (since, None)] if shut else out


def _admit(what: str, flow: Flow, kinds: tuple[str, ...]) -> None:
    for kind, _, _ in flow.steps:
        if kind not in kinds:
            raise ValueError(f"{what} does not admit {kind} inside")


@dataclass(frozen=True)
class Flow(Operators):
    """A reusable open chain of stages."""

    steps: tuple[tuple[str, dict, dict], ...] = ()
    names: tuple[str | None, ...] = ()

    def _add(self, kind: str, params: dict, bind: dict) -> Flow:
        return Flow((*self.steps, (kind, params, bind)), (*self.names, None))

    def named(self, name: str) -> Flow:
        if not self.steps or self.names[-1]:
            raise ValueError("there is no stage without a name to be named")
        return replace(self, names=(*self.names[:-1], identity.node_id(name)))

    def via(self, flow: Flow) -> Flow:
        return Flow(self.steps + flow.steps, self.names + flow.names)

    @property
    def bound(self) -> list[tuple[str, dict]]:
        return [(k, b) for k, _, b in self.steps]

    def to(self, sink: Sink, slot: str | None = None) -> Branch:
        return Branch(self, sink, slot)


@dataclass(frozen=True)
class Sink:
    kind: str
    params: dict = field(default_factory=dict)
    bind: dict = field(default_factory=dict)
    has_result: bool = False
    name: str | None = None

    def named(self, name: str) -> Sink:
        if self.name:
            raise ValueError("the sink has a name already")
        return replace(self, name=identity.node_id(name))

    def to_sink(self) -> Sink:
        """The same work without its value."""
        return replace(self, has_result=False)

    @staticmethod
    def ignore() -> Sink:
        return Sink("ignore")

    @staticmethod
    def for_each(callback: Callable[[dict], Any]) -> Sink:
        """On the driver, in order, a row at a time."""
        return Sink("for-each", {}, {"fn": callback})

    @staticmethod
    def for_each_async(options: ParallelismOptions, callback: Callable[[dict], Any]) -> Sink:
        """In the tasks, with up to max_concurrency calls at once in each."""
        options.check()
        return Sink("for-each-async", {"maxConcurrency": options.max_concurrency}, {"fn": callback, "options": options})

    @staticmethod
    def to_channel(channel) -> Sink:
        return Sink("to-channel", {}, {"channel": channel})

    @staticmethod
    def count() -> Sink:
        return Sink("count", has_result=True)

    @staticmethod
    def first() -> Sink:
        return Sink("first", has_result=True)

    @staticmethod
    def first_or_default(default: Any = None) -> Sink:
        return Sink("first-or-default", {}, {"default": default}, True)

    @staticmethod
    def last() -> Sink:
        return Sink("last", has_result=True)

    @staticmethod
    def last_or_default(default: Any = None) -> Sink:
        return Sink("last-or-default", {}, {"default": default}, True)

    @staticmethod
    def collect(options: CollectOptions) -> Sink:
        options.check()
        return Sink("collect", {"maxElements": options.max_elements}, {"options": options}, True)

    @staticmethod
    def aggregate(fold: Fold) -> Sink:
        return Sink("fold", _fold_params(fold), {"fold": fold}, True)

    @staticmethod
    def aggregate_async(fold: Fold) -> Sink:
        return Sink("fold-async", _fold_params(fold), {"fold": fold}, True)

    @staticmethod
    def registered(registry, stage: str, name: str, **params) -> Sink:
        entry = registry.sink(stage)
        return Sink("registered-sink", params, {"write": entry.fn, "params": params, "ref": entry.ref}, name=name)

    @staticmethod
    def registered_terminal(registry, stage: str, name: str, **params) -> Sink:
        """A provider's terminal, whose result is the slot's value."""
        entry = registry.terminal(stage)
        return Sink("registered-terminal", params, {"finish": entry.fn, "params": params, "ref": entry.ref}, True, name)


@dataclass(frozen=True)
class Branch:
    """A flow that ends in a sink: the leg of a junction."""

    flow: Flow
    sink: Sink
    slot: str | None = None


@dataclass(frozen=True)
class Fork:
    """Two derivations of one stream that wait to be joined again."""

    left: Source
    right: Source

    def zip(self, combine=None) -> Source:
        return self.left.zip(self.right, combine)


@dataclass(frozen=True)
class Source(Operators):
    """An ordered stream with one open output."""

    node: Node
    port: str = "out"

    def _add(self, kind: str, params: dict, bind: dict) -> Source:
        return Source(Node(kind, params, bind, ((self.node, self.port),), ref=bind.get("ref")))

    def named(self, name: str) -> Source:
        if self.node.name:
            raise ValueError("the stage has a name already")
        return Source(replace(self.node, name=identity.node_id(name)), self.port)

    def via(self, flow: Flow) -> Source:
        s = self
        for (kind, params, bind), name in zip(flow.steps, flow.names, strict=True):
            s = s._add(kind, params, bind)
            s = s.named(name) if name else s
        return s

    # closing
    def to(self, sink: Sink, slot: str | None = None) -> Graph:
        return Graph((self._terminal(sink, slot),))

    def _terminal(self, sink: Sink, slot: str | None) -> Node:
        if slot is not None and not sink.has_result:
            raise ValueError(f"{sink.kind} has no result for the slot {slot}")
        return Node(sink.kind, sink.params, sink.bind, ((self.node, self.port),), sink.name, sink.bind.get("ref"), slot)

    def _fan(self, kind: str, n: int, params: dict | None = None, bind: dict | None = None, name: str | None = None) -> list[Source]:
        if not 2 <= n <= vocabulary.MAX_LEGS:
            raise ValueError(f"a junction has 2 to {vocabulary.MAX_LEGS} legs, not {n}")
        node = Node(kind, {"legs": n, **(params or {})}, {"legs": n, **(bind or {})}, ((self.node, self.port),), name)
        return [Source(node, f"out-{i + 1}") for i in range(n)]

    @staticmethod
    def _close(legs: list[Source], branches: tuple[Branch, ...]) -> Graph:
        return Graph(tuple(leg.via(b.flow)._terminal(b.sink, b.slot) for leg, b in zip(legs, branches, strict=True)))

    def broadcast_to(self, *branches: Branch, name: str | None = None) -> Graph:
        return self._close(self._fan("broadcast", len(branches), name=name), branches)

    def balance_to(self, *branches: Branch, name: str | None = None) -> Graph:
        return self._close(self._fan("balance", len(branches), name=name), branches)

    def partition_to(self, router: Expr, *branches: Branch, name: str | None = None) -> Graph:
        return self._close(self._fan("partition", len(branches), _said(router), {"fn": router}, name), branches)

    def unzip_to(self, left: Branch, right: Branch, name: str | None = None, sides: tuple[str, str] = ("first", "second")) -> Graph:
        return self._close(self._fan("unzip", 2, {}, {"sides": sides}, name), (left, right))

    def fan_out_to(self, registry, stage: str, name: str, *branches: Branch, **params) -> Graph:
        entry = registry.fan_out(stage)
        legs = self._fan(entry.kind, len(branches), params, entry.bind(params), name)
        return self._close(legs, branches)

    # legs that stay open
    def also_to(self, branch: Branch) -> Source:
        main, side = self._fan("broadcast", 2)
        return Tapped(main.node, main.port, (*_sides(main), side.via(branch.flow)._terminal(branch.sink, branch.slot)))

    def divert_to(self, fn: Expr, branch: Branch) -> Source:
        from pyspark.sql import functions as F

        from .functions import column

        sql = f"CASE WHEN ({fn}) THEN 1 ELSE 0 END" if isinstance(fn, str) else (lambda: F.when(F.coalesce(column(fn), F.lit(False)), 1).otherwise(0))
        main, side = self._fan("partition", 2, _said(sql), {"fn": sql})
        return Tapped(main.node, main.port, (*_sides(main), side.via(branch.flow)._terminal(branch.sink, branch.slot)))

    # joining
    def _join(self, kind: str, others: tuple[Source, ...], params: dict | None = None, bind: dict | None = None, name: str | None = None) -> Source:
        ins = (self, *others)
        if len(ins) > vocabulary.MAX_LEGS:
            raise ValueError(f"a junction has at most {vocabulary.MAX_LEGS} inputs")
        return _carry(ins, Source(Node(kind, params or {}, bind or {}, tuple((s.node, s.port) for s in ins), name)))

    def merge(self, *others: Source) -> Source:
        return self._join("merge", others)

    def concat(self, *others: Source) -> Source:
        return self._join("concat", others)

    def interleave(self, other: Source, segment_size: int) -> Source:
        return self._join("interleave", (other,), {"segmentSize": at_least("segment_size", segment_size, 1)}, {"size": segment_size})

    def zip(self, other: Source, combine=None) -> Source:
        return self._join("zip", (other,), _said(combine), {"combine": combine})

    def combine_latest(self, other: Source, combine=None) -> Source:
        return self._join("combine-latest", (other,), _said(combine), {"combine": combine})

    def prepend(self, *others: Source) -> Source:
        return others[0].concat(*others[1:], self)

    def append(self, *others: Source) -> Source:
        return self.concat(*others)

    def fan_in(self, registry, stage: str, name: str, *others: Source, **params) -> Source:
        entry = registry.fan_in(stage)
        return self._join(entry.kind, others, params, entry.bind(params), name)

    def fork(self, left: Flow, right: Flow, name: str | None = None) -> Fork:
        a, b = self._fan("broadcast", 2, name=name)
        return Fork(a.via(left), b.via(right))

    def fork_merge(self, left: Flow, right: Flow, name: str | None = None) -> Source:
        f = self.fork(left, right, name)
        return f.left.merge(f.right)


@dataclass(frozen=True)
class Tapped(Source):
    """A source with a side branch that runs with whatever closes it."""

    side: tuple[Node, ...] = ()

    def _add(self, kind: str, params: dict, bind: dict) -> Source:
        s = super()._add(kind, params, bind)
        return Tapped(s.node, s.port, self.side)

    def named(self, name: str) -> Source:
        s = super().named(name)
        return Tapped(s.node, s.port, self.side)

    def to(self, sink: Sink, slot: str | None = None) -> Graph:
        g = Source(self.node, self.port).to(sink, slot)
        return Graph((*g.terminals, *_sides(self)))

    def _fan(self, *args, **kw) -> list[Source]:
        legs = super()._fan(*args, **kw)
        return [Tapped(legs[0].node, legs[0].port, self.side), *legs[1:]]


def _sides(s: Source) -> tuple[Node, ...]:
    return s.side if isinstance(s, Tapped) else ()


def _carry(ins: tuple[Source, ...], out: Source) -> Source:
    sides = tuple(n for s in ins for n in _sides(s))
    return Tapped(out.node, out.port, sides) if sides else out


@dataclass(frozen=True)
class Graph:
    """A closed graph: everything its terminals need, and the document that says so."""

    terminals: tuple[Node, ...]
    graph_id: str = "anonymous"
    revision: int = 1

    def nodes(self) -> list[Node]:
        """From sources to terminals, each once."""
        seen: dict[int, Node] = {}
        done: list[Node] = []
        stack = [(t, False) for t in reversed(self.terminals)]
        while stack:
            n, ready = stack.pop()
            if ready:
                done.append(n)
            elif id(n) not in seen:
                seen[id(n)] = n
                stack.append((n, True))
                stack += [(m, False) for m, _ in reversed(n.inputs)]
        return done

    @property
    def document(self) -> GraphDocument:
        nodes = self.nodes()
        ids: dict[int, str] = {}
        taken = [n.name for n in nodes if n.name]
        if len(set(taken)) != len(taken):
            raise ValueError("two stages have one name")
        count = 0
        for n in nodes:
            if not n.name:
                count += 1
            ids[id(n)] = n.name or identity.automatic_name(count)
        caps = set()
        if count:
            caps.add(EPHEMERAL)
        if any(n.opaque for n in nodes):
            caps.add(NONDEPLOYABLE)
        if any(n.kind == "durable" for n in nodes):
            caps.add(DURABLE_STATE)
        ref = lambda n: n.ref or StageRef(vocabulary.PROVIDER, n.kind)
        contract = lambda n: Contract(f"{ref(n).stage_id}-parameters") if n.ref else vocabulary.parameters(n.kind)
        made = tuple(StageNode(ids[id(n)], ref(n), contract(n), {k: v for k, v in n.params.items() if not (k == "legs")}) for n in nodes)
        edges = tuple(GraphEdge(Port(ids[id(m)], port), Port(ids[id(n)], "in" if len(n.inputs) == 1 and n.kind not in vocabulary.FAN_IN else f"in-{i + 1}")) for n in nodes for i, (m, port) in enumerate(n.inputs))
        slots = tuple(ResultSlot(n.slot, vocabulary.RESULT, Port(ids[id(n)], "result")) for n in nodes if n.slot)
        return GraphDocument(self.graph_id, self.revision, made, edges, slots, tuple(sorted(caps)))

    @property
    def fingerprint(self) -> str:
        return self.document.fingerprint

    def as_pipeline(self, graph_id: str, revision: int) -> Graph:
        """A deployable definition: no functions that a document cannot hold, and a name for every stage."""
        from .errors import PipelineRejectedError

        nodes = self.nodes()
        wrong = [f"{n.name or n.kind}: holds a function" for n in nodes if n.opaque] + [f"{n.kind}: has no name" for n in nodes if not n.name]
        if wrong:
            raise PipelineRejectedError("; ".join(wrong))
        return replace(self, graph_id=identity.segment("graph id", graph_id), revision=identity.major_version("revision", revision))


def frame_source(make: Callable[[Any], DataFrame], order: list[str | Column], kind: str = "from-enumerable", params: dict | None = None, time: str | None = None, **bind) -> Source:
    """A source whose rows are those of make(spark), in the given order; time names the column of arrival times."""
    return Source(Node(kind, params or {}, {"frame": make, "order": order, "time": time, **bind}))
