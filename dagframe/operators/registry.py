"""What operators there are: their properties, ports and how they become DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

#: ``lower(session, inputs, properties)``; the session gives ``spark`` and ``table(name)``.
Lower = Callable[[Any, list[DataFrame], dict[str, Any]], DataFrame]


@dataclass
class OperatorSpec:
    type: str
    lower: Lower
    title: str
    about: str
    group: str = "Utilities"
    inputs: int = 1
    outputs: int = 1
    #: JSON-schema fragments by property: type, enum, default.
    properties: dict[str, dict] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    #: Inputs are cut off by a written table in checkpoint mode.
    blocking: bool = False

    def metadata(self) -> dict:
        return {
            "operatorType": self.type,
            "jsonSchema": {"type": "object", "properties": self.properties, "required": list(self.required)},
            "additionalMetadata": {
                "userFriendlyName": self.title, "operatorDescription": self.about, "operatorGroupName": self.group,
                "numInputPorts": self.inputs, "numOutputPorts": self.outputs,
            },
        }


REGISTRY: dict[str, OperatorSpec] = {}


def register_operator(type: str, **spec: Any) -> Callable[[Lower], Lower]:
    """Adds an operator; user code extends the engine through this decorator."""

    def add(lower: Lower) -> Lower:
        if type in REGISTRY:
            raise ValueError(f"operator type {type} exists already")
        spec.setdefault("title", type)
        spec.setdefault("about", (lower.__doc__ or "").strip().split("\n")[0])
        REGISTRY[type] = OperatorSpec(type, lower, **spec)
        return lower

    return add
