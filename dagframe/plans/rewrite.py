"""Rewrites of a workflow before it becomes DataFrames."""

from __future__ import annotations

from .workflow import Link, Node, Workflow


def fuse_group_bys(flow: Workflow) -> Workflow:
    """A local group-by that only feeds a global one of the same function becomes one aggregate.

    Spark splits that into a partial and a final half itself. Unequal pairs stay apart.
    """
    out = Workflow()
    out.nodes, out.links = dict(flow.nodes), list(flow.links)
    for final in [n for n in flow.nodes.values() if n.type == "GroupByFinal"]:
        origins = flow.inputs(final.id)[0]
        if len(origins) != 1:
            continue
        local = flow.nodes[origins[0]]
        same = local.type == "GroupBy" and local.properties.get("aggregationFunction") == final.properties.get("aggregationFunction")
        if same and flow.consumers(local.id) == [final.id]:
            out.nodes[final.id] = Node(final.id, "GroupByFused", local.properties)
            del out.nodes[local.id]
            out.links = [
                Link(x.origin, final.id, x.origin_port, x.destination_port) if x.destination == local.id else x for x in out.links if x.origin != local.id
            ]
    return out
