"""Named, versioned stages of other providers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from .document import Contract, StageRef
from .validate import Catalog, StagePort, StageSpec
from .vocabulary import ELEMENT, RESULT


@dataclass(frozen=True)
class Entry:
    ref: StageRef
    fn: Callable[..., Any] | None = None
    kind: str = ""
    bind: Callable[[dict], dict] = lambda params: {}


class Registry:
    """provider/stage@vN -> what it does.

    A source is fn(**params) -> (make(spark) -> DataFrame, order columns); a flow is fn(context, stream, params) -> stream;
    a sink is fn(DataFrame, params); a terminal is fn(DataFrame, params) -> the run's result; junctions name a built-in kind and how parameters bind to it."""

    def __init__(self):
        self._entries: dict[tuple[str, str], Entry] = {}
        self.catalog = Catalog()

    @staticmethod
    def _ref(stage: str) -> StageRef:
        name, _, version = stage.partition("@v")
        provider, _, stage_id = name.partition("/")
        return StageRef(provider, stage_id, int(version or 1))

    def _put(self, role: str, stage: str, entry: Entry, ins: int, outs: int, check, results: tuple = ()) -> None:
        if (role, stage) in self._entries:
            raise ValueError(f"{stage} is registered already")
        port = lambda p, optional=False: StagePort(p, ELEMENT, optional)
        many = lambda p, n: () if n == 0 else (port(p),) if n == 1 else tuple(port(f"{p}-{i + 1}", i > 1) for i in range(n))
        self._entries[role, stage] = entry
        self.catalog.add(StageSpec(entry.ref, many("in", ins), many("out", outs), results, Contract(f"{entry.ref.stage_id}-parameters"), (), check))

    def add_source(self, stage: str, fn, check=None) -> None:
        self._put("source", stage, Entry(self._ref(stage), fn), 0, 1, check)

    def add_flow(self, stage: str, fn, check=None) -> None:
        self._put("flow", stage, Entry(self._ref(stage), fn), 1, 1, check)

    def add_sink(self, stage: str, fn, check=None) -> None:
        self._put("sink", stage, Entry(self._ref(stage), fn), 1, 0, check)

    def add_terminal(self, stage: str, fn, check=None) -> None:
        self._put("terminal", stage, Entry(self._ref(stage), fn), 1, 0, check, (StagePort("result", RESULT, True),))

    def add_fan_out(self, stage: str, kind: str, bind=lambda params: {}, check=None) -> None:
        self._put("fan-out", stage, Entry(self._ref(stage), None, kind, bind), 1, 8, check)

    def add_fan_in(self, stage: str, kind: str, bind=lambda params: {}, check=None) -> None:
        self._put("fan-in", stage, Entry(self._ref(stage), None, kind, bind), 8, 1, check)

    def _get(self, role: str, stage: str) -> Entry:
        if (role, stage) not in self._entries:
            raise KeyError(f"no {role} named {stage}")
        return self._entries[role, stage]

    def source(self, stage: str) -> Entry:
        return self._get("source", stage)

    def flow(self, stage: str) -> Entry:
        return self._get("flow", stage)

    def sink(self, stage: str) -> Entry:
        return self._get("sink", stage)

    def terminal(self, stage: str) -> Entry:
        return self._get("terminal", stage)

    def fan_out(self, stage: str) -> Entry:
        return self._get("fan-out", stage)

    def fan_in(self, stage: str) -> Entry:
        return self._get("fan-in", stage)
