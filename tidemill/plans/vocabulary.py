"""The local vocabulary: every built-in stage kind with its ports, as a catalog."""

from __future__ import annotations

from .document import Contract, StageRef
from .validate import Catalog, StagePort, StageSpec

PROVIDER = "local"
ELEMENT, RESULT = Contract("row"), Contract("result")
MAX_LEGS = 8

SOURCES = "from-enumerable empty single repeat range from-task failed unfold from-async-enumerable from-factory from-async-factory never cycle unfold-async queue from-channel tick".split()
FLOWS = (
    "select where scan take skip take-while take-through skip-while distinct deduplicate-consecutive select-many merge-map scan-async grouped sliding "
    "grouped-within grouped-weighted-within group-by buffer select-async select-async-unordered select-value-task-async select-value-task-async-unordered "
    "delay initial-delay timeout take-within skip-within throttle valve fault-point supervised durable feedback"
).split()
FAN_OUT = "broadcast balance partition unzip".split()
FAN_IN = "merge concat interleave zip combine-latest".split()
SINKS = "fold fold-async ignore for-each for-each-async first first-or-default count last last-or-default collect to-channel".split()


def parameters(kind: str) -> Contract:
    return Contract(f"{kind}-parameters")


def spec(kind: str) -> StageSpec:
    port = lambda p, optional=False: StagePort(p, ELEMENT, optional)
    legs = lambda p: tuple(port(f"{p}-{i}", i > 2) for i in range(1, MAX_LEGS + 1))
    ins: tuple = () if kind in SOURCES else legs("in") if kind in FAN_IN else (port("in"),)
    outs: tuple = () if kind in SINKS else legs("out") if kind in FAN_OUT else (port("out"),)
    return StageSpec(StageRef(PROVIDER, kind), ins, outs, (StagePort("result", RESULT, True),) if kind in SINKS else (), parameters(kind))


def local_catalog() -> Catalog:
    return Catalog(tuple(spec(k) for k in (*SOURCES, *FLOWS, *FAN_OUT, *FAN_IN, *SINKS)))
