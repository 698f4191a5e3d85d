"""The HTTP surface: routes as a function of method, path and body, and a small server around it."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .engine import Engine
from .plans.workflow import PlanError
from .streaming.control import BatchRun


class Service:
    """``handle(method, path, body)`` gives a status and a JSON value. Runs are known by their workflow ids.

    A plan that is executed with a ``workflowID`` is a run that other requests may pause, resume, watch and
    stop meanwhile; with ``wait`` false its execution answers at once and its result is asked for by id.
    """

    def __init__(self, engine: Engine, work_dir: str | None = None):
        self.engine, self.runs = engine, {}
        self.work_dir = work_dir or engine._work_dir or engine.spark.conf.get("spark.checkpoint.dir", None)

    def _execute(self, body: dict) -> dict:
        page = {k: int(body[k]) for k in ("offset", "limit") if k in body}
        id = body.get("workflowID")
        if id is None or not self.work_dir:
            return self.engine.result(body["logicalPlan"], **page)
        if id in self.runs:
            self.runs[id].deactivate()
        self.runs[id] = run = BatchRun(self.engine, body["logicalPlan"], self.work_dir).start()
        if not body.get("wait", True):
            return {"code": 0, "workflowID": id, "state": run.state.value}
        try:
            return self._result(run.wait(), page)
        except Exception as e:
            return {"code": 1, "message": str(e), "state": run.state.value}

    def _result(self, run: BatchRun, page: dict) -> dict:
        return Engine.envelope(run.results.values(), **page) | {"state": run.state.value}

    def _run(self, body: dict) -> BatchRun:
        if body.get("workflowID") not in self.runs:
            raise PlanError("no such workflow runs")
        return self.runs[body["workflowID"]]

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict | list]:
        body = body or {}
        route = (method.upper(), path.strip("/"))
        try:
            if route == ("POST", "api/queryplan/execute"):
                return 200, self._execute(body)
            if route == ("POST", "api/queryplan/result"):
                return 200, self._result(self._run(body), {k: int(body[k]) for k in ("offset", "limit") if k in body})
            if route == ("POST", "api/queryplan/download"):
                self.engine.download(body["logicalPlan"], body["path"], body.get("format", "csv"))
                return 200, {"code": 0, "path": body["path"]}
            if route == ("POST", "api/queryplan/autocomplete"):
                return 200, {"code": 0, "result": self.engine.schema_of(body["logicalPlan"])}
            if route == ("GET", "api/resources/operator-metadata"):
                return 200, self.engine.operator_metadata()
            if route == ("GET", "api/resources/table-metadata"):
                return 200, self.engine.table_metadata()
            if route in (("POST", "api/pause"), ("POST", "api/resume"), ("POST", "api/deactivate")):
                run = self._run(body)
                getattr(run, route[1].removeprefix("api/"))()
                return 200, {"code": 0, "state": run.state.value}
            if route == ("POST", "api/status"):
                return 200, {"code": 0, **self._run(body).status()}
            if route == ("GET", "api/status"):
                return 200, {id: run.status() for id, run in self.runs.items()}
        except (PlanError, KeyError) as e:
            return 200, {"code": 1, "message": str(e)}
        return 404, {"code": 1, "message": f"no route {method} {path}"}


def serve(service: Service, host: str = "127.0.0.1", port: int = 7070) -> ThreadingHTTPServer:
    """A server that is ready for ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size)) if size else {}
                status, value = service.handle(self.command, self.path, body)
            except ValueError as e:
                status, value = 400, {"code": 1, "message": str(e)}
            data = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = answer

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
