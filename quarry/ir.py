"""The logical form of a query: what a builder records and the compiler lowers to a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

OPERATORS = ("=", "==", "===", "!=", "<>", "!==", "<", ">", "<=", ">=", "like", "not like")
DATE_OPERATORS = ("=", "!=", "<>", "<", ">", "<=", ">=")


@dataclass(frozen=True)
class Constraint:
    """One condition: how it joins the one before it, and whether it is negated."""

    conjunction: str = "and"
    negated: bool = False


@dataclass(frozen=True)
class Basic(Constraint):
    column: str = ""
    operator: str = "="
    value: Any = None


@dataclass(frozen=True)
class Like(Constraint):
    column: str = ""
    pattern: Any = ""
    case_sensitive: bool = False


@dataclass(frozen=True)
class In(Constraint):
    column: str = ""
    values: tuple = ()


@dataclass(frozen=True)
class Null(Constraint):
    column: str = ""


@dataclass(frozen=True)
class Between(Constraint):
    column: str = ""
    low: Any = None
    high: Any = None


@dataclass(frozen=True)
class Compared(Constraint):
    first: str = ""
    operator: str = "="
    second: str = ""


@dataclass(frozen=True)
class Day(Constraint):
    column: str = ""
    operator: str = "="
    value: Any = None


@dataclass(frozen=True)
class Part(Constraint):
    column: str = ""
    part: str = "year"
    operator: str = "="
    value: Any = None


@dataclass(frozen=True)
class Time(Constraint):
    column: str = ""
    operator: str = "="
    value: str = "00:00:00"


@dataclass(frozen=True)
class JsonContains(Constraint):
    column: str = ""
    values: tuple = ()


@dataclass(frozen=True)
class JsonLength(Constraint):
    column: str = ""
    operator: str = "="
    value: Any = 0


@dataclass(frozen=True)
class Nested(Constraint):
    constraints: tuple[Constraint, ...] = ()


@dataclass(frozen=True)
class Order:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class On:
    first: str
    operator: str
    second: str
    conjunction: str = "and"


@dataclass(frozen=True)
class JoinClause:
    table: str
    kind: str
    conditions: tuple[On, ...] = ()


@dataclass(frozen=True)
class Query:
    table: str
    constraints: tuple[Constraint, ...] = ()
    orders: tuple[Order, ...] = ()
    random: bool = False
    limit: int | None = None
    offset: int = 0
    columns: tuple[str, ...] = ()
    distinct: bool = False
    joins: tuple[JoinClause, ...] = ()

    def but(self, **changes: Any) -> Query:
        return replace(self, **changes)

    def bare(self) -> Query:
        """Without order and paging, which aggregates ignore."""
        return replace(self, orders=(), random=False, limit=None, offset=0)


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    type: str
    nullable: bool = False
    default: Any = None
    has_default: bool = False
    primary: bool = False
    increments: bool = False
    places: int | None = None
    values: tuple[str, ...] | None = None


@dataclass(frozen=True)
class IndexSchema:
    name: str
    columns: tuple[str, ...]
    unique: bool = False
    multi_entry: bool = False


@dataclass(frozen=True)
class TableSchema:
    table: str
    columns: tuple[ColumnSchema, ...] = ()
    key: str | None = None
    increments: bool = False
    timestamps: bool = False
    indexes: tuple[IndexSchema, ...] = field(default=())

    def column(self, name: str) -> ColumnSchema | None:
        return next((c for c in self.columns if c.name == name), None)


def one_of(operator: str, allowed: Sequence[str] = OPERATORS) -> str:
    if operator not in allowed:
        raise ValueError(f"[{operator}] is not an operator here; these are: {', '.join(allowed)}")
    return operator
