"""Operators; importing this package registers them all."""

from . import aggregation, joins, relational, sources  # noqa: F401
from .registry import REGISTRY, OperatorSpec, register_operator  # noqa: F401
