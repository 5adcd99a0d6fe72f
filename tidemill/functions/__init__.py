"""Functional parameters: column expressions that Catalyst sees, recognised folds, and Python functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A SQL string, a Column, or a function that makes a Column from the columns in scope.
Expr = str | Column | Callable[[], Column]


def column(e: Expr) -> Column:
    return F.expr(e) if isinstance(e, str) else e() if callable(e) and not isinstance(e, Column) else e


@dataclass(frozen=True)
class Py:
    """A Python function of one element (a dict of its columns). schema: DDL of what it returns, where it makes elements."""

    fn: Callable[..., Any]
    schema: str | None = None


@dataclass(frozen=True)
class Fold:
    """A fold that has a window and an aggregate form: sum, count, min, max, last; or Python: step(state, element)."""

    kind: str
    value: Expr | None = None
    seed: Any = 0
    step: Callable[[Any, dict], Any] | None = None
    schema: str = "long"


def total(value: Expr, seed: Any = 0) -> Fold:
    return Fold("sum", value, seed)


def counting(seed: int = 0) -> Fold:
    return Fold("count", None, seed)


def least(value: Expr) -> Fold:
    return Fold("min", value, None)


def greatest(value: Expr) -> Fold:
    return Fold("max", value, None)


def latest(value: Expr) -> Fold:
    return Fold("last", value, None)


def fold(seed: Any, step: Callable[[Any, dict], Any], schema: str = "long") -> Fold:
    """Any fold; runs one element at a time in one task for each key."""
    return Fold("python", None, seed, step, schema)
