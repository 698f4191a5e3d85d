"""Runs that can be paused, resumed, stopped at breakpoints and watched.

``BatchRun`` runs a plan in steps: the inputs of joins and global group-bys are written to the work folder
as they become ready, then the sinks. A pause takes effect before the next step, a stop cancels the
running jobs and deletes what was written. Control messages queue and are taken in order at each step.
``StreamRun`` feeds one source file by file through Structured Streaming: a pause takes effect after the
running micro-batch, and resuming continues from the checkpoint with nothing lost or repeated. Counts
for breakpoints are exact at the end of each micro-batch.
"""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import REGISTRY
from ..plans.workflow import Node, PlanError, Workflow


#: Operators that need all rows of their input.
WHOLE = ("GroupBy", "GroupByFinal", "Aggregation", "InsertionSort", "ViewResults", "LocalMaterializer", "HashBasedMaterializer")


class State(Enum):
    UNINITIALIZED = "UnInitialized"
    READY = "Ready"
    RUNNING = "Running"
    PAUSING = "Pausing"
    PAUSED = "Paused"
    BREAKPOINT = "LocalBreakpointTriggered"
    COMPLETED = "Completed"
    FAILED = "Failed"


@dataclass
class Breakpoint:
    """Stops when the operator has put out ``count`` rows in all, or a row that meets ``predicate`` (SQL)."""

    operator: str
    count: int | None = None
    predicate: str | None = None


class BatchRun:
    """A plan run in the background, step by step; ``results`` has a table for each sink that is done."""

    def __init__(self, engine: Engine, plan: Workflow | dict | str, work_dir: str, checkpoint: bool = True):
        self.work_dir, self.tag = work_dir.rstrip("/"), f"run-{uuid.uuid4().hex}"
        self.state, self.error, self.results, self.seconds = State.UNINITIALIZED, None, {}, {}
        self.engine = Engine(engine.spark, engine.tables, engine._sentiment, f"{self.work_dir}/{self.tag}", engine.folder)
        self.plan, self.checkpoint = plan, checkpoint
        self.low = engine.lower(plan)
        self._steps: list[tuple[str, float]] = []
        self._stats: dict[str, int] = {}
        self._messages: queue.Queue[str] = queue.Queue()
        self._cancelled = False
        self._lock = threading.RLock()
        self.state = State.READY

    def start(self) -> BatchRun:
        if self.state is not State.READY:
            raise PlanError(f"a run that is {self.state.value} cannot start")
        self.state = State.RUNNING
        self._thread = InheritableThread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def _step(self, id: str) -> None:
        """Takes the messages that wait, holds while paused, and notes which operator is put out next."""
        while True:
            try:
                message = self._messages.get(block=self.state is State.PAUSED)
            except queue.Empty:
                break
            with self._lock:
                if message == "stop":
                    raise _Held
                self.state = State.PAUSED if message == "pause" else State.RUNNING
        self._steps.append((id, time.monotonic()))

    def _run(self) -> None:
        spark = self.engine.spark
        spark.sparkContext.addJobTag(self.tag)
        try:
            self._step("")
            low = self.engine.lower(self.plan, checkpoint=self.checkpoint, observe=True, step=self._step)
            self.low = low
            low.write()
            for id in low.flow.sinks():
                self._step(id)
                began, path = time.monotonic(), f"{self.work_dir}/{self.tag}/sink-{len(self.results)}"
                low.frames[id].write.parquet(path)
                self.results[id] = spark.read.schema(low.frames[id].schema).parquet(path)
                self.seconds[id] = time.monotonic() - began
            with self._lock:
                self.state = State.COMPLETED
        except _Held:
            pass
        except Exception as e:
            if not self._cancelled:
                self.state, self.error = State.FAILED, e
        finally:
            spark.sparkContext.removeJobTag(self.tag)
            if self._cancelled:
                self._delete()

    def _send(self, message: str) -> None:
        with self._lock:
            if self.state in (State.UNINITIALIZED, State.READY):
                raise PlanError("the run has not started")
            if self.state in (State.RUNNING, State.PAUSING, State.PAUSED):
                if message == "pause" and self.state is State.RUNNING:
                    self.state = State.PAUSING
                self._messages.put(message)

    def pause(self) -> None:
        """Holds the run before its next step. Pausing what is paused or over changes nothing."""
        self._send("pause")

    def resume(self) -> None:
        self._send("resume")

    def deactivate(self) -> None:
        """Cancels the run's jobs, lets go of its results and deletes what it wrote."""
        self._cancelled, self.results = True, {}
        running = getattr(self, "_thread", None)
        if running and running.is_alive():
            self._messages.put("stop")
            self.engine.spark.sparkContext.cancelJobsWithTag(self.tag)
        else:
            self._delete()

    def _delete(self) -> None:
        path = self.engine.spark._jvm.org.apache.hadoop.fs.Path(f"{self.work_dir}/{self.tag}")
        path.getFileSystem(self.engine.spark._jsc.hadoopConfiguration()).delete(path, True)

    def wait(self, seconds: float | None = None) -> BatchRun:
        self._thread.join(seconds)
        if self.error:
            raise self.error
        return self

    def status(self) -> dict:
        """The state of each operator, and rows in and out of those that are done; others are ``Ready`` until their step begins."""
        flow, low = self.low.flow, self.low
        above = lambda ids: {o for id in ids for port in flow.inputs(id) for o in port}
        steps = [id for id, _ in list(self._steps) if id in flow.nodes]
        over = self.state is State.COMPLETED
        done, now = set(self.results) | set(steps if over else steps[:-1]), set() if over else set(steps[-1:])
        for some in (done, now):
            while grown := above(some) - some:
                some |= grown
        rows = {}
        for id in done & set(low.counts):
            if id not in self._stats:
                # A materialiser puts out nothing, which Spark may not even run.
                self._stats[id] = 0 if REGISTRY[flow.nodes[id].type].group == "Storage" else int(low.counts[id].get.get("rows", 0))
            rows[id] = self._stats[id]
        begun = self._steps[0][1] if self._steps else 0.0
        total = sum(self.seconds.values()) if over else (time.monotonic() - begun if begun else 0.0)
        stats = {id: {"inputCount": sum(rows.get(o, 0) for port in flow.inputs(id) for o in port), "outputCount": n, "speed": n / total if total else 0.0} for id, n in rows.items()}
        idle = State.READY if self.state in (State.RUNNING, State.PAUSING, State.PAUSED) else self.state
        states = {id: State.COMPLETED.value if id in done else (self.state if id in now else idle).value for id in flow.nodes}
        return {"state": self.state.value, "operatorStates": states, "operatorStatistics": stats, "seconds": total}

    def preview(self, breakpoint: Breakpoint) -> DataFrame:
        """What the operator puts out up to the breakpoint: its first rows, or the first that meets the predicate."""
        df = self.low.frames[breakpoint.operator]
        return df.where(breakpoint.predicate).limit(1) if breakpoint.predicate else df.limit(breakpoint.count or 0)


class StreamRun:
    """A plan over a folder of files that is read ``files_per_batch`` at a time.

    ``source`` names the scan that streams; the others are read whole. Each micro-batch runs the plan and
    appends the sink's rows to a folder of the batch's number, written over if the batch is repeated,
    so that each row is delivered once. Row-wise operators and joins with static sides run on each
    micro-batch. From the first operator on that needs all rows (an aggregate, a sort, a page, a join of the
    stream with itself) the plan runs over what has been delivered, when ``results`` are asked for;
    ``delivered`` is the operator whose rows the micro-batches deliver.
    """

    def __init__(self, engine: Engine, plan: Workflow | dict | str, source: str, work_dir: str, files_per_batch: int = 1, breakpoints: list[Breakpoint] | None = None, on_batch: Callable[[DataFrame, int], None] | None = None):
        self.engine, self.flow, self.source = engine, (plan if isinstance(plan, Workflow) else Workflow.from_plan(plan)).validate(), source
        if len(self.flow.sinks()) != 1:
            raise PlanError("a streamed workflow has one sink")
        self.sink = self.flow.sinks()[0]
        self.delivered = self._cut(source)
        for b in breakpoints or ():
            if b.operator not in self._before:
                raise PlanError(f"{b.operator} runs on results only and has no breakpoints in the stream")
        self.work_dir, self.files_per_batch, self.on_batch = work_dir.rstrip("/"), files_per_batch, on_batch
        self.breakpoints, self.hit = list(breakpoints or []), None
        self.counts: dict[str, int] = {id: 0 for id in self.flow.nodes}
        self._seen: dict[int, dict[str, int]] = {}
        self.state, self._query, self._pause = State.READY, None, False

    def _cut(self, source: str) -> str:
        """The last operator that sees single rows of the stream only; all that is behind it needs all rows."""
        fed, at = {source}, source
        while at != self.sink:
            following = self.flow.consumers(at)
            if len(following) != 1 or self.flow.nodes[following[0]].type in WHOLE:
                break
            at = following[0]
            fed.add(at)
        self._before = fed
        while grown := {o for id in self._before for port in self.flow.inputs(id) for o in port} - self._before:
            self._before |= grown
        return at

    def _path(self) -> str:
        name = self.flow.nodes[self.source].properties["tableName"]
        return self.engine.tables.get(name, name)

    def start(self) -> StreamRun:
        spark, path = self.engine.spark, self._path()
        schema = spark.read.parquet(path).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_batch).parquet(path)
        self._pause = False
        self.state = State.RUNNING
        self._query = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.work_dir}/checkpoint").trigger(availableNow=True).start()
        return self

    def _batch(self, rows: DataFrame, number: int) -> None:
        if self._pause or self.state is State.BREAKPOINT:
            raise _Held()
        name = self.flow.nodes[self.source].properties["tableName"]
        local = Engine(rows.sparkSession, dict(self.engine.tables) | {name: rows}, self.engine._sentiment, self.work_dir)
        low = local.lower(self._part(self._before), observe=True, fuse=False)
        low.write()
        out = low.frames[self.delivered]
        out.write.mode("overwrite").parquet(f"{self.work_dir}/out/batch={number}")
        if self.on_batch:
            self.on_batch(out, number)
        watched = {b.operator for b in self.breakpoints} | {self.delivered}
        self._seen[number] = {id: int(low.counts[id].get.get("rows", 0)) for id in watched}
        for id in watched:
            self.counts[id] = sum(s.get(id, 0) for s in self._seen.values())
        for b in self.breakpoints:
            if b.count is not None and self.counts[b.operator] >= b.count or b.predicate and not low.frames[b.operator].where(b.predicate).isEmpty():
                self.hit, self.state = b, State.BREAKPOINT

    def _part(self, ids: set[str]) -> Workflow:
        part = Workflow()
        part.nodes = {id: n for id, n in self.flow.nodes.items() if id in ids}
        part.links = [x for x in self.flow.links if x.origin in ids and x.destination in ids]
        return part

    def pause(self) -> None:
        """Stops after the running micro-batch."""
        if self._query is None:
            raise PlanError("the run has not started")
        if self.state is State.RUNNING:
            self.state, self._pause = State.PAUSING, True
            self._settle()

    def resume(self) -> None:
        """Continues from the checkpoint; a breakpoint that was hit is taken away."""
        if self._query is None:
            raise PlanError("the run has not started")
        self._settle()
        if self.state in (State.PAUSED, State.BREAKPOINT):
            self.breakpoints = [b for b in self.breakpoints if b is not self.hit]
            self.hit = None
            self.start()

    def _settle(self) -> None:
        try:
            self._query.awaitTermination()
        except Exception:
            if not self._pause and self.state is not State.BREAKPOINT:
                self.state = State.FAILED
                raise
        if self.state is not State.BREAKPOINT:
            held = self._query.exception() is not None
            self.state = State.PAUSED if held else State.COMPLETED

    def wait(self) -> StreamRun:
        """Until all files are read, or a breakpoint or pause holds the run."""
        self._settle()
        return self

    def results(self) -> DataFrame:
        """The plan's result over what has been delivered so far."""
        name, spark = self.flow.nodes[self.source].properties["tableName"], self.engine.spark
        whole = Engine(spark, dict(self.engine.tables) | {name: spark.read.parquet(self._path())}, self.engine._sentiment, self.work_dir)
        schema = whole.lower(self._part(self._before), fuse=False).frames[self.delivered].schema
        rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.work_dir}/out")
        if self.delivered == self.sink:
            return rows
        rest = self._part((set(self.flow.nodes) - self._before) | {self.delivered})
        rest.nodes[self.delivered] = Node(self.delivered, "ScanSource", {"tableName": "delivered rows"})
        return Engine(spark, dict(self.engine.tables) | {"delivered rows": rows}, self.engine._sentiment, self.work_dir, self.engine.folder).execute(rest)[self.sink]


class _Held(Exception):
    """Ends a micro-batch before it begins; it is read again when the run resumes."""


def stream_join(spark, inner: DataFrame, outer: DataFrame, inner_key: str, outer_key: str) -> DataFrame:
    """The symmetric join of two streams: the inner row, then the outer row without its key; either side may come first."""
    right = outer.withColumnRenamed(outer_key, "_outer_key")
    return inner.join(right, F.col(inner_key) == F.col("_outer_key")).drop("_outer_key")
