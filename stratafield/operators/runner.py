"""Operators as registered, parameterised, recorded runs."""

from __future__ import annotations

import ast
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from datetime import datetime, timezone

from pyspark.sql import DataFrame


class OperatorError(Exception):
    """A failed run; the message begins with the operator's name."""


@dataclass
class RunResult:
    data: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    events: list[dict] = field(default_factory=list)


@dataclass(frozen=True)
class Operator:
    name: str
    apply: Callable[..., DataFrame | RunResult]
    params: type | None = None
    requires: tuple[str, ...] = ()
    description: str = ""

    def problems(self, df: DataFrame) -> list[str]:
        return [f"missing column {c}" for c in self.requires if c not in df.columns]


class Registry:
    """Operators by name; a later registration of a name replaces the earlier."""

    def __init__(self) -> None:
        self._held: dict[str, Operator] = {}

    def register(self, operator: Operator) -> Operator:
        self._held[operator.name] = operator
        return operator

    def names(self, recent: list[str] = ()) -> list[str]:
        """Recent ones first, the rest by name."""
        known = [n for n in recent if n in self._held]
        return known + sorted(set(self._held) - set(known))

    def get(self, name: str) -> Operator:
        if name not in self._held:
            raise OperatorError(f"{name}: no such operator")
        return self._held[name]


def from_nested(params: type, nested: dict) -> object:
    """A parameter dataclass from {section: {name: {"value": v}}}; what is
    missing keeps its default, unknown names are ignored."""
    flat = {k: v["value"] if isinstance(v, dict) and "value" in v else v for section in nested.values() if isinstance(section, dict) for k, v in section.items()}
    return params(**{f.name: flat[f.name] for f in fields(params) if f.name in flat})


def check_value(value, kind: str, low: float | None = None, high: float | None = None, choices: list | None = None):
    """A parameter value of kind bool, int, float, choice, file or directory."""
    if kind == "bool":
        return bool(value)
    if kind in ("int", "float"):
        number = int(value) if kind == "int" else round(float(value), 3)
        if not (0 if low is None else low) <= number <= (100 if high is None else high):
            raise ValueError(f"{number} is out of range")
        return number
    if kind == "choice" and value not in (choices or []):
        raise ValueError(f"{value!r} is no choice")
    return value


def event(kind: str, **data) -> dict:
    return {"event_id": str(uuid.uuid4()), "timestamp": datetime.now(timezone.utc).isoformat(), "event_type": kind, "event_data": data}


def run(operator: Operator, df: DataFrame, params: object | None = None) -> RunResult:
    """Validate on the driver, build the lazy plan, record start and end."""
    started = event("processing.started", script_id=operator.name)
    if found := operator.problems(df):
        raise OperatorError(f"{operator.name}: {', '.join(found)}")
    begun = time.monotonic()
    try:
        out = operator.apply(df, params or operator.params()) if operator.params else operator.apply(df)
    except Exception as e:
        raise OperatorError(f"{operator.name}: {e}") from e
    result = out if isinstance(out, RunResult) else RunResult(out)
    result.metrics["processing_time"] = time.monotonic() - begun
    result.metrics["run_id"] = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    result.events = [started, event("processing.completed", status="success", script_id=operator.name)]
    return result


METHODS = ("name", "description", "get_parameters", "execute", "get_metadata")


def check_script(source: str, allowed: set[str]) -> tuple[list[str], list[str]]:
    """Errors and warnings of a user script by reading its syntax tree; it is
    never run.  Imports must be allowed, SCRIPT_CLASS must be set, three of the
    five methods must be there."""
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        return [f"syntax error in line {e.lineno}"], []
    roots, names, methods, warnings = set(), set(), set(), []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            roots |= {a.name.split(".")[0] for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
            roots.add(node.module.split(".")[0])
        elif isinstance(node, ast.Assign):
            names |= {t.id for t in node.targets if isinstance(t, ast.Name)}
        elif isinstance(node, ast.FunctionDef):
            methods.add(node.name)
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("eval", "exec", "compile", "__import__"):
            warnings.append(f"line {node.lineno} calls {node.func.id}")
    errors = [f"import of {r} is not allowed" for r in sorted(roots - allowed)]
    if "SCRIPT_CLASS" not in names:
        errors.append("SCRIPT_CLASS is missing")
    if len(methods & set(METHODS)) < 3:
        errors.append("fewer than three of the script methods")
    return errors, warnings
