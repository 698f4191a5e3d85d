"""Graph editing, validation and plans; no session is needed."""

import json

import pytest

from dagframe.plans import PlanError, Workflow, samples
from dagframe.plans.rewrite import fuse_group_bys


def small() -> Workflow:
    w = Workflow()
    w.add("ScanSource", "1", tableName="t")
    w.add("SentimentAnalysis", "2", targetAttribute="text")
    w.add("ViewResults", "3")
    return w.chain("1", "2", "3")


def test_add_and_read():
    w = small()
    assert set(w.nodes) == {"1", "2", "3"} and w.consumers("1") == ["2"] and w.inputs("3") == [["2"]] and w.sinks() == ["3"]


@pytest.mark.parametrize(
    "change",
    [
        lambda w: w.add("ScanSource", "1"), lambda w: w.add("Nothing", "9"), lambda w: w.link("1", "2"), lambda w: w.link("1", "9"),
        lambda w: w.link("9", "1"), lambda w: w.delete("9"), lambda w: w.link("2", "1"), lambda w: w.link("3", "2"), lambda w: w.unlink("1", "3"),
        lambda w: w.link("1", "3", 1), lambda w: w.node("9"),
    ],
)
def test_invalid_changes(change):
    with pytest.raises(PlanError):
        change(small())


def test_delete_takes_links():
    w = small()
    w.delete("2")
    assert not w.links and set(w.nodes) == {"1", "3"}


def test_unlink_then_link_again():
    w = small()
    w.unlink("1", "2")
    assert w.problems("2")
    w.link("1", "2")
    assert not w.problems("2")


def test_valid_when_linked_and_complete():
    w = small()
    assert not any(w.problems(id, editor=True) for id in w.nodes)
    w.set_properties("1")
    assert "tableName" in w.problems("1")[0]


def test_isolated_source_is_invalid_in_an_editor():
    w = Workflow()
    w.add("ScanSource", "1", tableName="t")
    assert not w.problems("1") and w.problems("1", editor=True)


def test_one_link_a_port():
    w = Workflow()
    for id in "ab":
        w.add("ScanSource", id, tableName=id)
    w.add("Aggregation", "n")
    w.link("a", "n").link("b", "n")
    assert not w.problems("n") and w.problems("n", editor=True)
    w.add("HashJoin", "j", innerTableAttribute="k", outerTableAttribute="k")
    assert len(w.problems("j")) == 2
    w.link("a", "j").link("b", "j")
    assert not w.problems("j") and w.inputs("j") == [["a"], ["b"]]


def test_enum_is_checked():
    w = Workflow()
    w.add("ScanSource", "s", tableName="t")
    w.chain("s", w.add("InsertionSort", "o", attributeName="x", attributeType="decimal"))
    assert "attributeType" in w.problems("o")[0]


def test_cycle_and_empty():
    w = Workflow()
    for id in "ab":
        w.add("Projection", id, projectionAttributes="_c0")
    w.link("a", "b").link("b", "a")
    with pytest.raises(PlanError, match="cycle"):
        w.validate()
    with pytest.raises(PlanError, match="empty"):
        Workflow().validate()


def test_defaults_are_filled():
    w = Workflow()
    assert w.nodes[w.add("ViewResults")].properties == {"limit": 10, "offset": 0}


def test_plan_round_trip():
    w = samples.order_count_distribution()
    plan = w.to_plan()
    again = Workflow.from_plan(json.dumps({"logicalPlan": plan, "workflowID": "x"}))
    assert again.to_plan() == plan and again.order() == w.order()


def test_plan_without_ids():
    with pytest.raises(PlanError):
        Workflow.from_plan({"operators": [{"operatorType": "ScanSource"}], "links": []})


def test_graph_with_ports_becomes_a_plan():
    ops = [
        {"operatorID": "a", "operatorType": "ScanSource", "operatorProperties": {"tableName": "t"}, "inputPorts": [], "outputPorts": ["o0"]},
        {"operatorID": "b", "operatorType": "ScanSource", "operatorProperties": {"tableName": "u"}, "inputPorts": [], "outputPorts": ["o0"]},
        {"operatorID": "j", "operatorType": "HashJoin", "operatorProperties": {"innerTableAttribute": "x", "outerTableAttribute": "y"}, "inputPorts": ["i0", "i1"], "outputPorts": ["o0"]},
    ]
    link = lambda s, t, p: {"source": {"operatorID": s, "portID": "o0"}, "target": {"operatorID": t, "portID": p}}
    w = Workflow.from_graph(ops, [link("a", "j", "i1"), link("b", "j", "i0")])
    assert w.inputs("j") == [["b"], ["a"]]
    assert [x["origin"] for x in w.to_plan()["links"]] == ["b", "a"]
    with pytest.raises(PlanError):
        Workflow.from_graph(ops, [link("a", "j", "i9")])


def test_fusion_needs_equal_functions_and_one_consumer():
    w = samples.quantity_by_flag()
    assert [n.type for n in fuse_group_bys(w).nodes.values()].count("GroupByFused") == 1
    w.nodes["local"].properties["aggregationFunction"] = "count"
    assert "local" in fuse_group_bys(w).nodes
    w = samples.quantity_by_flag()
    w.chain("local", w.add("ViewResults"))
    assert "local" in fuse_group_bys(w).nodes
