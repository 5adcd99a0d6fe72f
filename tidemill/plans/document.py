"""Graph documents: the logical plan, without any function bodies."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from tidemill.errors import GraphDocumentFormatError

from . import canonical, identity

FORMAT_VERSION = 1
NONDEPLOYABLE, EPHEMERAL, DURABLE_STATE = "nondeployable", "ephemeral-identity", "durable-state"


@dataclass(frozen=True, order=True)
class Contract:
    contract_id: str
    major_version: int = 1

    def __post_init__(self):
        identity.segment("contract id", self.contract_id)
        identity.major_version("contract version", self.major_version)

    def to_json(self) -> dict:
        return {"contractId": self.contract_id, "majorVersion": self.major_version}


@dataclass(frozen=True, order=True)
class StageRef:
    provider_id: str
    stage_id: str
    major_version: int = 1

    def __post_init__(self):
        identity.segment("provider id", self.provider_id)
        identity.segment("stage id", self.stage_id)
        identity.major_version("stage version", self.major_version)

    def to_json(self) -> dict:
        return {"providerId": self.provider_id, "stageId": self.stage_id, "majorVersion": self.major_version}


@dataclass(frozen=True, order=True)
class Port:
    node_id: str
    port_id: str

    def __post_init__(self):
        identity.node_id(self.node_id)
        identity.segment("port id", self.port_id)

    def to_json(self) -> dict:
        return {"nodeId": self.node_id, "portId": self.port_id}


@dataclass(frozen=True)
class StageNode:
    node_id: str
    stage_ref: StageRef
    parameter_contract: Contract
    parameters: Any = field(default_factory=dict)
    execution_policy_contract: Contract | None = None
    execution_policy: Any = None

    def __post_init__(self):
        identity.node_id(self.node_id)
        canonical.payload(self.parameters)
        if (self.execution_policy_contract is None) != (self.execution_policy is None):
            raise ValueError("an execution policy and its contract come together")


@dataclass(frozen=True, order=True)
class GraphEdge:
    source: Port
    target: Port


@dataclass(frozen=True)
class ResultSlot:
    slot_id: str
    contract: Contract
    producer: Port

    def __post_init__(self):
        identity.segment("result slot id", self.slot_id)


def _ordinal(text: str) -> bytes:
    return text.encode("utf-16-be", "surrogatepass")


@dataclass(frozen=True)
class GraphDocument:
    graph_id: str
    revision: int
    nodes: tuple[StageNode, ...]
    edges: tuple[GraphEdge, ...] = ()
    result_slots: tuple[ResultSlot, ...] = ()
    capabilities: tuple[str, ...] = ()

    def __post_init__(self):
        identity.segment("graph id", self.graph_id)
        identity.major_version("revision", self.revision)
        for c in self.capabilities:
            identity.segment("capability", c)
        for what, ids in (("node", [n.node_id for n in self.nodes]), ("result slot", [s.slot_id for s in self.result_slots]), ("capability", list(self.capabilities))):
            if len(set(ids)) != len(ids):
                raise ValueError(f"a {what} is given twice")
        for ends in ([e.source for e in self.edges], [e.target for e in self.edges]):
            if len(set(ends)) != len(ends):
                raise ValueError("a port has more than one edge")

    def to_text(self) -> str:
        """Canonical: members in schema order, sets sorted ordinally, payload keys sorted."""
        w = lambda x: canonical.write(x, sort=False)

        def node(n: StageNode) -> str:
            policy = "null" if n.execution_policy_contract is None else w(n.execution_policy_contract.to_json())
            body = "null" if n.execution_policy_contract is None else canonical.payload(n.execution_policy)
            return f'{{"nodeId":{w(n.node_id)},"stageRef":{w(n.stage_ref.to_json())},"parameterContract":{w(n.parameter_contract.to_json())},"parameters":{canonical.payload(n.parameters)},"executionPolicyContract":{policy},"executionPolicy":{body}}}'

        nodes = ",".join(node(n) for n in sorted(self.nodes, key=lambda n: _ordinal(n.node_id)))
        key = lambda e: tuple(_ordinal(x) for x in (e.source.node_id, e.source.port_id, e.target.node_id, e.target.port_id))
        edges = w([{"from": e.source.to_json(), "to": e.target.to_json()} for e in sorted(self.edges, key=key)])
        slots = w([{"resultSlotId": s.slot_id, "resultContract": s.contract.to_json(), "producer": s.producer.to_json()} for s in sorted(self.result_slots, key=lambda s: _ordinal(s.slot_id))])
        caps = w(sorted(self.capabilities, key=_ordinal))
        return f'{{"formatVersion":{FORMAT_VERSION},"graphId":{w(self.graph_id)},"revision":{self.revision},"capabilities":{caps},"nodes":[{nodes}],"edges":{edges},"resultSlots":{slots}}}'

    def to_bytes(self) -> bytes:
        return self.to_text().encode()

    @property
    def fingerprint(self) -> str:
        return canonical.fingerprint(self.to_bytes())


def _members(value: Any, what: str, names: list[str]) -> list:
    if not isinstance(value, dict) or list(value) != names and set(value) != set(names):
        raise GraphDocumentFormatError(f"{what} must have the members {', '.join(names)}")
    return [value[n] for n in names]


def parse(data: str | bytes) -> GraphDocument:
    """Read a document strictly: unknown or missing members and other format versions are refused."""
    value = canonical.read(data)
    if not isinstance(value, dict) or value.get("formatVersion") != FORMAT_VERSION:
        raise GraphDocumentFormatError(f"format version {value.get('formatVersion') if isinstance(value, dict) else None!r} is not supported")
    contract = lambda v: Contract(*_members(v, "contract", ["contractId", "majorVersion"]))
    port = lambda v: Port(*_members(v, "port", ["nodeId", "portId"]))
    try:
        _, graph, revision, caps, nodes, edges, slots = _members(value, "document", ["formatVersion", "graphId", "revision", "capabilities", "nodes", "edges", "resultSlots"])
        out_nodes = []
        for n in nodes:
            i, ref, pc, p, ec, ep = _members(n, "node", ["nodeId", "stageRef", "parameterContract", "parameters", "executionPolicyContract", "executionPolicy"])
            out_nodes.append(StageNode(i, StageRef(*_members(ref, "stage reference", ["providerId", "stageId", "majorVersion"])), contract(pc), p, None if ec is None else contract(ec), ep))
        out_edges = [GraphEdge(port(a), port(b)) for a, b in (_members(e, "edge", ["from", "to"]) for e in edges)]
        out_slots = [ResultSlot(i, contract(c), port(p)) for i, c, p in (_members(s, "result slot", ["resultSlotId", "resultContract", "producer"]) for s in slots)]
        return GraphDocument(graph, revision, tuple(out_nodes), tuple(out_edges), tuple(out_slots), tuple(caps))
    except (ValueError, TypeError) as e:
        raise GraphDocumentFormatError(str(e)) from e
