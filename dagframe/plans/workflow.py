"""Workflows: operators with properties, and links between their ports."""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field
from typing import Any

from ..operators.registry import REGISTRY


class PlanError(ValueError):
    """A workflow that cannot be run; the message names the operator or link."""


@dataclass(frozen=True)
class Link:
    origin: str
    destination: str
    origin_port: int = 0
    destination_port: int | None = None


@dataclass
class Node:
    id: str
    type: str
    properties: dict[str, Any] = field(default_factory=dict)


class Workflow:
    """A directed acyclic graph of operators.

    Links keep their order: the first link into a join is its inner (build) side unless ports say
    otherwise. Ids are unique, links join existing operators and ports, and no link occurs twice.
    """

    def __init__(self):
        self.nodes: dict[str, Node] = {}
        self.links: list[Link] = []

    # Editing

    def add(self, type: str, id: str | None = None, **properties: Any) -> str:
        if type not in REGISTRY:
            raise PlanError(f"unknown operator type {type!r}" + (f" of {id}" if id else ""))
        id = id or f"{type}-{len(self.nodes)}"
        if id in self.nodes:
            raise PlanError(f"operator {id} exists already")
        defaults = {k: p["default"] for k, p in REGISTRY[type].properties.items() if "default" in p}
        self.nodes[id] = Node(id, type, defaults | properties)
        return id

    def link(self, origin: str, destination: str, destination_port: int | None = None, origin_port: int = 0) -> Workflow:
        for id in (origin, destination):
            self.node(id)
        made = Link(origin, destination, origin_port, destination_port)
        if any((x.origin, x.origin_port, x.destination, x.destination_port) == (origin, origin_port, destination, destination_port) for x in self.links):
            raise PlanError(f"link {origin} -> {destination} exists already")
        spec = REGISTRY[self.nodes[destination].type]
        if destination_port is not None and not 0 <= destination_port < spec.inputs or not spec.inputs:
            raise PlanError(f"{destination} has no input port {destination_port or 0}")
        if not 0 <= origin_port < REGISTRY[self.nodes[origin].type].outputs:
            raise PlanError(f"{origin} has no output port {origin_port}")
        self.links.append(made)
        return self

    def chain(self, *ids: str) -> Workflow:
        for a, b in zip(ids, ids[1:]):
            self.link(a, b)
        return self

    def delete(self, id: str) -> None:
        """Removes an operator and its links."""
        self.node(id)
        del self.nodes[id]
        self.links = [x for x in self.links if id not in (x.origin, x.destination)]

    def unlink(self, origin: str, destination: str) -> None:
        kept = [x for x in self.links if (x.origin, x.destination) != (origin, destination)]
        if len(kept) == len(self.links):
            raise PlanError(f"no link {origin} -> {destination}")
        self.links = kept

    def set_properties(self, id: str, **properties: Any) -> None:
        self.node(id).properties = dict(properties)

    # Reading

    def node(self, id: str) -> Node:
        if id not in self.nodes:
            raise PlanError(f"no operator {id}")
        return self.nodes[id]

    def inputs(self, id: str) -> list[list[str]]:
        """Origins by input port, in link order. Without ports a two-input operator takes its links in turn."""
        spec = REGISTRY[self.node(id).type]
        ports: list[list[str]] = [[] for _ in range(spec.inputs)]
        for k, x in enumerate(x for x in self.links if x.destination == id):
            port = x.destination_port if x.destination_port is not None else min(k, spec.inputs - 1) if spec.inputs > 1 else 0
            ports[port].append(x.origin)
        return ports

    def consumers(self, id: str) -> list[str]:
        return [x.destination for x in self.links if x.origin == id]

    def sinks(self) -> list[str]:
        return [id for id in self.nodes if not self.consumers(id)]

    def order(self) -> list[str]:
        """A topological order that keeps the order of insertion where it can."""
        waiting, out, into = {id: 0 for id in self.nodes}, [], defaultdict(list)
        for x in self.links:
            waiting[x.destination] += 1
            into[x.origin].append(x.destination)
        ready = [id for id, n in waiting.items() if not n]
        while ready:
            id = ready.pop(0)
            out.append(id)
            for d in into[id]:
                waiting[d] -= 1
                if not waiting[d]:
                    ready.append(d)
        if len(out) < len(self.nodes):
            raise PlanError(f"the links of {sorted(set(self.nodes) - set(out))} form a cycle")
        return out

    # Validity

    def problems(self, id: str, editor: bool = False) -> list[str]:
        """What is wrong with an operator. ``editor``: each port takes one link and outputs are linked too."""
        node, spec = self.node(id), REGISTRY[self.node(id).type]
        found = [f"{id}: property {p} is required" for p in spec.required if node.properties.get(p) in (None, "", [])]
        for name, p in spec.properties.items():
            value = node.properties.get(name)
            if value is not None and "enum" in p and value not in p["enum"]:
                found.append(f"{id}: {name} must be one of {', '.join(p['enum'])}, not {value!r}")
        for k, origins in enumerate(self.inputs(id)):
            if not origins:
                found.append(f"{id}: input port {k} is not linked")
            elif len(origins) > 1 and (editor or spec.inputs > 1):
                found.append(f"{id}: input port {k} has {len(origins)} links")
        if editor and spec.outputs and not self.consumers(id):
            found.append(f"{id}: its output is not linked")
        return found

    def validate(self, editor: bool = False) -> Workflow:
        self.order()
        if not self.nodes:
            raise PlanError("the workflow is empty")
        if found := [p for id in self.nodes for p in self.problems(id, editor)]:
            raise PlanError("; ".join(found))
        return self

    # The logical plan as JSON

    def to_plan(self) -> dict:
        """Operators with their properties and links without ports, as clients submit them."""
        return {
            "operators": [{**n.properties, "operatorID": n.id, "operatorType": n.type} for n in self.nodes.values()],
            "links": [{"origin": x.origin, "destination": x.destination} for x in sorted(self.links, key=lambda x: (x.destination_port or 0) if REGISTRY[self.nodes[x.destination].type].inputs > 1 else 0)],
        }

    @classmethod
    def from_plan(cls, plan: dict | str) -> Workflow:
        plan = json.loads(plan) if isinstance(plan, str) else plan
        plan = plan.get("logicalPlan", plan)
        out = cls()
        for op in plan.get("operators", []):
            if "operatorID" not in op or "operatorType" not in op:
                raise PlanError("an operator has no operatorID or operatorType")
            out.add(op["operatorType"], op["operatorID"], **{k: v for k, v in op.items() if k not in ("operatorID", "operatorType")})
        for x in plan.get("links", []):
            out.link(x["origin"], x["destination"], x.get("destinationPort"), x.get("originPort", 0))
        return out

    @classmethod
    def from_graph(cls, operators: list[dict], links: list[dict]) -> Workflow:
        """From an editor's graph: ``operatorProperties``, and links with ``source`` and ``target`` ports."""
        out, ports = cls(), {}
        for op in operators:
            out.add(op["operatorType"], op["operatorID"], **op.get("operatorProperties", {}))
            ports[op["operatorID"]] = op.get("inputPorts", []), op.get("outputPorts", [])
        for x in links:
            s, t = x["source"], x["target"]
            for end, side in ((s, 1), (t, 0)):
                if end["operatorID"] not in ports or end["portID"] not in ports[end["operatorID"]][side]:
                    raise PlanError(f"no port {end.get('portID')} of {end['operatorID']}")
            many = REGISTRY[out.node(t["operatorID"]).type].inputs > 1
            out.link(s["operatorID"], t["operatorID"], ports[t["operatorID"]][0].index(t["portID"]) if many else None)
        return out
