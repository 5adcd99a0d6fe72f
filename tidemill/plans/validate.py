"""Stage catalog and the rules a document is held against before it runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from .document import Contract, GraphDocument, StageRef

# The rule ids, in the order in which they are reported.
RULES = (
    "unknown-stage",
    "unknown-output-port",
    "unknown-input-port",
    "unknown-result-port",
    "element-contract-mismatch",
    "result-contract-mismatch",
    "parameter-contract-mismatch",
    "invalid-parameters",
    "unconnected-input-port",
    "unconnected-output-port",
    "undeclared-capability",
)


@dataclass(frozen=True)
class StagePort:
    port_id: str
    contract: Contract
    optional: bool = False


@dataclass(frozen=True)
class StageSpec:
    ref: StageRef
    inputs: tuple[StagePort, ...]
    outputs: tuple[StagePort, ...]
    results: tuple[StagePort, ...]
    parameter_contract: Contract
    required_capabilities: tuple[str, ...] = ()
    check: Callable[[Any], str | None] | None = None


@dataclass(frozen=True)
class Diagnostic:
    rule: str
    subject: str
    message: str


class Catalog:
    """Stage specifications by reference."""

    def __init__(self, specs: tuple[StageSpec, ...] = ()):
        self.specs: dict[StageRef, StageSpec] = {}
        for s in specs:
            self.add(s)

    def add(self, spec: StageSpec) -> None:
        if spec.ref in self.specs:
            raise ValueError(f"{spec.ref} is already in the catalog")
        self.specs[spec.ref] = spec

    def find(self, ref: StageRef) -> StageSpec | None:
        return self.specs.get(ref)


def validate(document: GraphDocument, catalog: Catalog) -> list[Diagnostic]:
    """Every violation, in the order of RULES and then of subjects. Nothing is run."""
    found: list[Diagnostic] = []
    say = lambda rule, subject, message: found.append(Diagnostic(rule, subject, message))
    known = {}
    for n in document.nodes:
        spec = catalog.find(n.stage_ref)
        if spec is None:
            say("unknown-stage", n.node_id, f"no stage {n.stage_ref.provider_id}/{n.stage_ref.stage_id}@v{n.stage_ref.major_version}")
            continue
        known[n.node_id] = spec
        if n.parameter_contract != spec.parameter_contract:
            say("parameter-contract-mismatch", n.node_id, f"parameters are {n.parameter_contract}, the stage takes {spec.parameter_contract}")
        elif spec.check and (wrong := spec.check(n.parameters)):
            say("invalid-parameters", n.node_id, wrong)
        for c in spec.required_capabilities:
            if c not in document.capabilities:
                say("undeclared-capability", n.node_id, f"the stage needs the capability {c}")
    ids = {n.node_id for n in document.nodes}
    used_in, used_out = set(), set()
    for e in document.edges:
        out = port = None
        for end, side, rule, used in ((e.source, "outputs", "unknown-output-port", used_out), (e.target, "inputs", "unknown-input-port", used_in)):
            used.add((end.node_id, end.port_id))
            if end.node_id in known:
                at = next((p for p in getattr(known[end.node_id], side) if p.port_id == end.port_id), None)
                if at is None:
                    say(rule, f"{end.node_id}.{end.port_id}", "the stage has no such port")
                out, port = (at, port) if side == "outputs" else (out, at)
            elif end.node_id not in ids:
                say(rule, f"{end.node_id}.{end.port_id}", "no such node")
        if out and port and out.contract != port.contract:
            say("element-contract-mismatch", f"{e.source.node_id}.{e.source.port_id}", f"{out.contract} meets {port.contract}")
    for s in document.result_slots:
        spec = known.get(s.producer.node_id)
        port = spec and next((p for p in spec.results if p.port_id == s.producer.port_id), None)
        if port is None:
            if spec or s.producer.node_id not in ids:
                say("unknown-result-port", s.slot_id, "no such result port")
        elif port.contract != s.contract:
            say("result-contract-mismatch", s.slot_id, f"{s.contract} meets {port.contract}")
    for node, spec in known.items():
        for rule, ports, used in (("unconnected-input-port", spec.inputs, used_in), ("unconnected-output-port", spec.outputs, used_out)):
            for p in ports:
                if not p.optional and (node, p.port_id) not in used:
                    say(rule, f"{node}.{p.port_id}", "nothing is connected")
    return sorted(found, key=lambda d: (RULES.index(d.rule), d.subject))
