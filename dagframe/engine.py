"""The engine: workflows to DataFrames, one per operator, and their results."""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import sentiment
from .operators import REGISTRY
from .plans.rewrite import fuse_group_bys
from .plans.workflow import PlanError, Workflow
from .sources.tables import read_table

#: Rows of a page of results, which the driver holds.
RESULT_ROWS = 10_000


class Engine:
    """Runs workflows on a session. ``tables``: names to paths or DataFrames; other names are paths or catalog tables."""

    def __init__(self, spark: SparkSession, tables: dict[str, str | DataFrame] | None = None, sentiment_scorer=sentiment.label, work_dir: str | None = None, folder: str | None = None):
        self.folder = folder and folder.rstrip("/")
        self.spark, self.tables, self._sentiment, self._work_dir = spark, dict(tables or {}), sentiment_scorer, work_dir

    @classmethod
    def over(cls, spark: SparkSession, folder: str, **options) -> Engine:
        """An engine whose table names are the parquet tables of a folder."""
        return cls(spark, folder=folder, **options)

    # What operators use

    def table(self, name: str, columns: list | None = None, n_columns: int | None = None) -> DataFrame:
        known = self.tables.get(name)
        if known is None and self.folder and "/" not in name and "." not in name:
            known = f"{self.folder}/{name}.parquet"
        if isinstance(known, DataFrame):
            return known if columns is None else known.select(*(known.columns[c] if isinstance(c, int) else c for c in columns))
        if known is None and "/" not in name and "." not in name and self.spark.catalog.tableExists(name):
            df = self.spark.table(name)
            return df if columns is None else df.select(*(df.columns[c] if isinstance(c, int) else c for c in columns))
        return read_table(self.spark, known or name, columns, n_columns)

    def sentiment(self, text: Column) -> Column:
        return self._sentiment(text)

    def defer(self, write: Callable[[], None]) -> None:
        """What a materialiser does once its plan runs; lowering a plan writes nothing."""
        self._writes.append(write)

    # Plans

    def lower(self, plan: Workflow | dict | str, checkpoint: bool = False, observe: bool = False, fuse: bool = True, step: Callable[[str], None] | None = None) -> Lowered:
        """All operators of a plan as DataFrames. Catalyst optimises what a sink needs; nothing runs or is written yet.

        ``checkpoint``: the inputs of joins and global group-bys are written to the work folder and read
        back, which runs them; ``step`` is called with the id of the operator put out before each is written.
        ``observe``: each operator counts its rows as they pass.
        """
        session = copy.copy(self)
        session._writes = []
        flow = (plan if isinstance(plan, Workflow) else Workflow.from_plan(plan)).validate()
        fused = fuse_group_bys(flow) if fuse else flow
        frames: dict[str, DataFrame] = {}
        counts: dict[str, Observation] = {}
        for id in fused.order():
            node, spec = fused.nodes[id], REGISTRY[fused.nodes[id].type]
            inputs = [self._united(id, [frames[o] for o in origins]) for origins in fused.inputs(id)]
            if checkpoint and spec.blocking:
                for k, origins in enumerate(fused.inputs(id)):
                    for o in origins if step else ():
                        step(o)
                    inputs[k] = self._written(inputs[k])
            try:
                df = spec.lower(session, inputs, node.properties)
            except (KeyError, ValueError, TypeError) as e:
                raise PlanError(f"{id} ({node.type}): {e.args[0] if e.args else e}") from e
            if observe:
                counts[id] = Observation()
                df = df.observe(counts[id], F.count(F.lit(1)).alias("rows"))
            frames[id] = df
        return Lowered(fused, frames, counts, session._writes)

    def _united(self, id: str, frames: list[DataFrame]) -> DataFrame:
        """Several links into one port are the union of their rows, by position."""
        if len({len(f.columns) for f in frames}) > 1:
            raise PlanError(f"{id}: its inputs have different numbers of columns")
        return reduce(DataFrame.union, frames)

    def _written(self, df: DataFrame) -> DataFrame:
        root = self._work_dir or self.spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            raise PlanError("checkpoint mode needs a work folder or spark.checkpoint.dir")
        path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def execute(self, plan: Workflow | dict | str, **options) -> dict[str, DataFrame]:
        """The sinks' DataFrames by operator id. Materialisers write now."""
        low = self.lower(plan, **options)
        low.write()
        return {id: low.frames[id] for id in low.flow.sinks()}

    def result(self, plan: Workflow | dict | str, offset: int = 0, limit: int = RESULT_ROWS) -> dict:
        """``{code, result, resultID, more}``: a page of the sinks' rows, as strings by place; an error has code 1 and a message.

        ``more`` tells whether rows follow the page. Whole results go to files by ``download``.
        """
        try:
            return self.envelope(self.execute(plan).values(), offset, limit)
        except PlanError as e:
            return {"code": 1, "message": str(e)}

    @staticmethod
    def envelope(sinks: Iterable[DataFrame], offset: int = 0, limit: int = RESULT_ROWS) -> dict:
        rows: list[dict] = []
        for df in sinks:
            page = df.select(*(F.col("`" + c.replace("`", "``") + "`").cast("string").alias(f"_c{k}") for k, c in enumerate(df.columns)))
            got = page.limit(offset + limit + 1 - len(rows)).toLocalIterator()
            rows += [{k: "" if v is None else v for k, v in r.asDict().items()} for r in got]
        return {"code": 0, "result": rows[offset : offset + limit], "resultID": uuid.uuid4().hex, "more": len(rows) > offset + limit}

    def download(self, plan: Workflow | dict | str, path: str, kind: str = "csv") -> None:
        """Writes the only sink's rows as csv, json or parquet."""
        sinks = self.execute(plan)
        if len(sinks) != 1:
            raise PlanError("a download needs a workflow with one sink")
        (df,) = sinks.values()
        writer = df.write.mode("overwrite")
        {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()

    # What there is

    def schema_of(self, plan: Workflow | dict | str) -> dict[str, list[str]]:
        """The attributes of each operator's output; an operator whose inputs are not valid has none."""
        flow, out = plan if isinstance(plan, Workflow) else Workflow.from_plan(plan), {}
        frames: dict[str, DataFrame] = {}
        for id in flow.order():
            node = flow.nodes[id]
            if flow.problems(id) or any(o not in frames for origins in flow.inputs(id) for o in origins) or REGISTRY[node.type].group == "Storage":
                out[id] = []
                continue
            try:
                frames[id] = REGISTRY[node.type].lower(self, [self._united(id, [frames[o] for o in origins]) for origins in flow.inputs(id)], node.properties)
                out[id] = frames[id].columns
            except (KeyError, ValueError, PlanError):
                out[id] = []
        return out

    @staticmethod
    def operator_metadata() -> dict:
        shown = [s for s in REGISTRY.values() if s.type != "GroupByFused"]
        return {"operators": [s.metadata() for s in shown], "groups": sorted({s.group for s in shown})}

    def table_metadata(self) -> list[dict]:
        """Registered tables, those of the catalog and the parquet tables of the engine's folder."""
        names = {n: self.table(n) for n in self.tables}
        names |= {t.name: self.spark.table(t.name) for t in self.spark.catalog.listTables()}
        if self.folder:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            for status in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path):
                name, _, kind = status.getPath().getName().rpartition(".")
                if kind == "parquet" and name not in names:
                    names[name] = self.table(name)
        return [{"tableName": n, "schema": {"attributes": [{"attributeName": f.name, "attributeType": f.dataType.simpleString()} for f in df.schema]}} for n, df in sorted(names.items())]


class Lowered:
    """DataFrames of a plan's operators, the counts that observed ones collect when they run, and what materialisers have to write."""

    def __init__(self, flow: Workflow, frames: dict[str, DataFrame], counts: dict[str, Observation], writes: list[Callable[[], None]]):
        self.flow, self.frames, self.counts, self.writes = flow, frames, counts, writes

    def write(self) -> None:
        while self.writes:
            self.writes.pop(0)()
