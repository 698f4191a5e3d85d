import json
import threading
import urllib.request

import pytest

from dagframe.engine import Engine
from dagframe.plans import PlanError, Workflow, samples
from dagframe.service import Service, serve
from dagframe.streaming.control import BatchRun, Breakpoint, State, StreamRun, stream_join


@pytest.fixture
def engine(spark):
    return Engine(spark, {"t": spark.createDataFrame([(k, k % 3, f"text {k}") for k in range(30)], "k int, g int, s string")})


def plan():
    w = Workflow()
    return w.chain(w.add("ScanSource", "scan", tableName="t"), w.add("Comparison", "big", attributeName="k", attributeType="int", comparisonType=">=", compareTo=10), w.add("GroupBy", "local", groupByAttribute="g", aggregationAttribute="k", aggregationFunction="count"), w.add("GroupByFinal", "global", aggregationFunction="count"))


def test_result_envelope(engine):
    got = engine.result(plan())
    assert got["code"] == 0 and {(r["_c0"], r["_c1"]) for r in got["result"]} == {("0", "6"), ("1", "7"), ("2", "7")}
    bad = plan()
    bad.nodes["big"].properties["attributeName"] = "none"
    assert engine.result(bad)["code"] == 1 and "big" in engine.result(bad)["message"]


def test_filter_reaches_the_scan(spark):
    e = Engine.over(spark, "/root/testdata/sf0.001")
    w = Workflow()
    w.chain(w.add("ScanSource", tableName="lineitem"), w.add("Comparison", attributeName="l_quantity", attributeType="double", comparisonType=">", compareTo=25), w.add("Projection", "p", projectionAttributes="l_orderkey"))
    text = e.execute(w)["p"]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,25.0)" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_fused_group_by_shuffles_once(engine):
    text = engine.execute(plan())["global"]._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1


def test_several_sinks(engine):
    w = plan()
    w.chain("big", w.add("ViewResults", "view", limit=3))
    assert {k: df.count() for k, df in engine.execute(w).items()} == {"global": 3, "view": 3}


def test_checkpoint_mode_gives_the_same(engine, tmp_path):
    engine._work_dir = str(tmp_path)
    assert sorted(engine.execute(plan(), checkpoint=True)["global"].collect()) == sorted(engine.execute(plan())["global"].collect())
    assert len(list(tmp_path.iterdir())) == 1


def test_schema_follows_links_and_properties(engine):
    w = plan()
    assert engine.schema_of(w)["big"] == ["k", "g", "s"] and engine.schema_of(w)["global"] == ["g", "count_k"]
    w.unlink("scan", "big")
    assert engine.schema_of(w) == {"scan": ["k", "g", "s"], "big": [], "local": [], "global": []}


def test_metadata(engine):
    known = {o["operatorType"]: o for o in engine.operator_metadata()["operators"]}
    assert {"ScanSource", "Comparison", "Aggregation", "KeywordMatcher", "CrossRippleJoin", "HashRippleJoin", "HashJoin", "InsertionSort", "GroupBy", "GroupByFinal", "Projection", "SentimentAnalysis"} <= set(known)
    assert known["HashJoin"]["additionalMetadata"]["numInputPorts"] == 2 and "attributeType" in known["InsertionSort"]["jsonSchema"]["required"]
    assert engine.table_metadata()[0]["schema"]["attributes"][0] == {"attributeName": "k", "attributeType": "int"}


def test_download(engine, spark, tmp_path):
    engine.download(plan(), str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_service(engine):
    server = serve(Service(engine), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/api/"

    def ask(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        with urllib.request.urlopen(urllib.request.Request(url + path, data)) as r:
            return json.load(r)

    assert len(ask("queryplan/execute", {"logicalPlan": plan().to_plan(), "workflowID": "w"})["result"]) == 3
    assert ask("queryplan/autocomplete", {"logicalPlan": plan().to_plan()})["result"]["scan"] == ["k", "g", "s"]
    assert ask("resources/operator-metadata")["operators"] and ask("resources/table-metadata")
    assert ask("pause", {"workflowID": "none"})["code"] == 1
    server.shutdown()


@pytest.fixture
def slow(spark):
    """An engine whose table takes a second to read."""
    import time

    from pyspark.sql import functions as F

    wait = F.udf(lambda k: time.sleep(1) or k, "int")
    return Engine(spark, {"t": spark.createDataFrame([(k, k % 3) for k in range(30)], "k int, g int").coalesce(1).select(F.when(F.col("k") == 0, wait("k")).otherwise(F.col("k")).alias("k"), "g")})


def test_pause_and_resume_over_http(slow, tmp_path):
    """A workflow with one sink is held while it runs, and loses nothing."""
    import time

    server = serve(Service(slow, str(tmp_path)), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, **body):
        url = f"http://127.0.0.1:{server.server_port}/api/{path}"
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode())) as r:
            return json.load(r)

    assert ask("queryplan/execute", logicalPlan=plan().to_plan(), workflowID="w", wait=False)["code"] == 0
    assert ask("pause", workflowID="w")["state"] in ("Pausing", "Paused")
    for _ in range(600):
        if (state := ask("status", workflowID="w"))["state"] == "Paused":
            break
        time.sleep(0.1)
    assert state["state"] == "Paused" and state["operatorStates"]["global"] in ("Ready", "Paused")
    assert ask("queryplan/result", workflowID="w")["result"] == []
    assert ask("resume", workflowID="w")["code"] == 0
    for _ in range(600):
        if (state := ask("status", workflowID="w"))["state"] == "Completed":
            break
        time.sleep(0.1)
    got = ask("queryplan/result", workflowID="w")
    assert {(r["_c0"], r["_c1"]) for r in got["result"]} == {("0", "6"), ("1", "7"), ("2", "7")} and not got["more"]
    assert state["operatorStatistics"]["big"] == {"inputCount": 30, "outputCount": 20, "speed": state["operatorStatistics"]["big"]["speed"]}
    assert set(state["operatorStates"].values()) == {"Completed"}
    assert ask("deactivate", workflowID="w")["code"] == 0 and list(tmp_path.iterdir()) == []
    server.shutdown()


def test_messages_queue_in_order(slow, tmp_path):
    run = BatchRun(slow, plan(), str(tmp_path)).start()
    for _ in range(3):
        run.pause()
        run.resume()
    assert run.wait().state is State.COMPLETED and run.results["global"].count() == 3


def test_lowering_writes_nothing(engine, tmp_path):
    w = Workflow()
    w.chain(w.add("ScanSource", tableName="t"), w.add("LocalMaterializer", "m", fileName=str(tmp_path / "x")))
    low = engine.lower(w)
    assert not (tmp_path / "x").exists()
    low.write()
    assert engine.spark.read.parquet(str(tmp_path / "x")).count() == 30
    assert BatchRun(engine, w, str(tmp_path / "run")).start().wait().status()["operatorStates"]["m"] == "Completed"


def test_pages_of_a_result(engine):
    w = Workflow()
    w.chain(w.add("ScanSource", tableName="t"), w.add("InsertionSort", attributeName="k", attributeType="int"))
    page = engine.result(w, offset=10, limit=5)
    assert [r["_c0"] for r in page["result"]] == ["10", "11", "12", "13", "14"] and page["more"]
    assert not engine.result(w, offset=25)["more"] and len(engine.result(w)["result"]) == 30


def test_tables_of_a_folder(spark):
    known = {t["tableName"]: t["schema"]["attributes"] for t in Engine.over(spark, "/root/testdata/sf0.001").table_metadata()}
    assert {"orders", "lineitem", "region"} <= set(known) and known["region"][0]["attributeName"] == "r_regionkey"


def test_batch_run(engine, tmp_path):
    w = plan()
    w.chain("big", w.add("ViewResults", "view", limit=3))
    run = BatchRun(engine, w, str(tmp_path))
    with pytest.raises(PlanError):
        run.pause()
    run.start()
    run.pause()
    assert run.state in (State.PAUSING, State.PAUSED, State.COMPLETED)
    run.resume()
    run.wait()
    assert run.state is State.COMPLETED and {k: df.count() for k, df in run.results.items()} == {"global": 3, "view": 3}
    status = run.status()
    assert status["operatorStates"]["global"] == "Completed" and status["operatorStatistics"]["global"]["outputCount"] == 3
    assert run.preview(Breakpoint("big", 4)).count() == 4 and run.preview(Breakpoint("big", predicate="k > 20")).count() == 1


def test_failed_run(engine, spark, tmp_path):
    w = Workflow()
    w.add("ScanSource", "s", tableName="u")
    bad = Engine(spark, {"u": spark.range(1).selectExpr("raise_error('no') AS x")})
    run = BatchRun(bad, w, str(tmp_path)).start()
    with pytest.raises(Exception):
        run.wait()
    assert run.state is State.FAILED


def files(spark, tmp_path, n=4):
    for k in range(n):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(str(tmp_path / "raw" / str(k)))
    (tmp_path / "in").mkdir()
    for k in range(n):
        (part,) = (tmp_path / "raw" / str(k)).glob("part-*.parquet")
        part.rename(tmp_path / "in" / f"{k}.parquet")
    return str(tmp_path / "in")


def streamed(spark, tmp_path, **options):
    e = Engine(spark, {"s": files(spark, tmp_path)})
    w = Workflow()
    w.chain(w.add("ScanSource", "scan", tableName="s"), w.add("Comparison", "even", attributeName="id", attributeType="int", comparisonType="≠", compareTo=5))
    return StreamRun(e, w, "scan", str(tmp_path / "run"), **options)


def test_stream_delivers_all(spark, tmp_path):
    run = streamed(spark, tmp_path).start().wait()
    assert run.state is State.COMPLETED and run.results().count() == 39


def test_count_breakpoint_then_resume(spark, tmp_path):
    run = streamed(spark, tmp_path, breakpoints=[Breakpoint("even", count=15)]).start().wait()
    assert run.state is State.BREAKPOINT and run.counts["even"] == 19 and run.results().count() == 19
    run.resume()
    run.wait()
    assert run.state is State.COMPLETED and run.results().count() == 39 and run.results().distinct().count() == 39


def test_predicate_breakpoint(spark, tmp_path):
    run = streamed(spark, tmp_path, breakpoints=[Breakpoint("even", predicate="id = 25")]).start().wait()
    assert run.state is State.BREAKPOINT and run.counts["even"] == 29


def test_pause_and_resume(spark, tmp_path):
    run = streamed(spark, tmp_path)
    with pytest.raises(PlanError):
        run.pause()
    run.start()
    run.pause()
    assert run.state in (State.PAUSED, State.COMPLETED)
    run.resume()
    run.wait()
    assert run.state is State.COMPLETED and run.results().distinct().count() == 39


def test_group_by_over_a_stream_merges_all_files(spark, tmp_path):
    e = Engine(spark, {"s": files(spark, tmp_path)})
    w = Workflow()
    w.add("ScanSource", "scan", tableName="s")
    w.add("Comparison", "some", attributeName="id", attributeType="int", comparisonType="<", compareTo=35)
    w.add("Aggregation", "count")
    w.chain("scan", "some", "count")
    run = StreamRun(e, w, "scan", str(tmp_path / "run"), breakpoints=[Breakpoint("some", count=15)]).start().wait()
    assert run.delivered == "some" and run.state is State.BREAKPOINT and run.results().first()[0] == 20
    run.resume()
    assert run.wait().results().first()[0] == 35
    with pytest.raises(PlanError):
        StreamRun(e, w, "scan", str(tmp_path / "no"), breakpoints=[Breakpoint("count", count=1)])


def test_stream_join(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(5).withColumnRenamed("id", name).write.parquet(str(tmp_path / name))
    a, b = (spark.readStream.schema(f"{n} long").parquet(str(tmp_path / n)) for n in "ab")
    q = stream_join(spark, a, b, "a", "b").writeStream.format("memory").queryName("joined").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("joined").count() == 5


def test_samples(spark):
    e = Engine.over(spark, "/root/testdata/sf0.001")
    for w in (samples.sorted_quantities(), samples.order_count_distribution(), samples.quantity_by_flag()):
        assert next(iter(e.execute(w).values())).count() > 0


def test_command_line(spark, tmp_path, capsys):
    from dagframe.__main__ import main

    (tmp_path / "plan.json").write_text(json.dumps({"logicalPlan": samples.quantity_by_flag().to_plan()}))
    assert main([str(tmp_path / "plan.json"), "--tables", "/root/testdata/sf0.001"]) == 0
    assert len(json.loads(capsys.readouterr().out)["result"]) == 3
    assert main([str(tmp_path / "plan.json"), "--tables", "/root/testdata/sf0.001", "--out", str(tmp_path / "out"), "--format", "parquet"]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    (tmp_path / "bad.json").write_text('{"operators": [], "links": []}')
    assert main([str(tmp_path / "bad.json")]) == 1
