"""Workflow graphs, rewrites and sample plans."""

from .. import operators  # noqa: F401
from .workflow import Link, Node, PlanError, Workflow  # noqa: F401
