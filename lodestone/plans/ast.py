"""Statements and expressions as the parser leaves them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    var: str
    name: str


@dataclass(frozen=True)
class ListExpr:
    items: tuple


@dataclass(frozen=True)
class Bin:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Not:
    arg: Any


@dataclass(frozen=True)
class IsNull:
    arg: Any
    negated: bool


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass
class NodePattern:
    var: str | None
    labels: list[str]
    props: list[tuple[str, Any]]


@dataclass
class EdgePattern:
    var: str | None
    label: str | None
    props: list[tuple[str, Any]]
    direction: str  # out, in, any
    quantifier: tuple[int, int | None] | None = None


@dataclass
class Pattern:
    start: NodePattern
    steps: list[tuple[EdgePattern, NodePattern]] = field(default_factory=list)


@dataclass
class Item:
    expr: Any
    alias: str | None
    text: str


@dataclass
class Return:
    items: list[Item]  # empty: *
    distinct: bool = False
    order: list[tuple[Any, bool]] = field(default_factory=list)  # (expression, ascending)
    offset: Any = None
    limit: Any = None
    star: bool = False


@dataclass
class Optional:
    patterns: list[Pattern]
    where: Any


@dataclass
class With:
    items: list[Item]
    distinct: bool
    where: Any
    star: bool = False


@dataclass
class Query:
    """MATCH, OPTIONAL MATCH, WITH, UNWIND, CALL in any mix that the language has, then RETURN."""

    patterns: list[Pattern] = field(default_factory=list)
    mode: str = "WALK"
    where: Any = None
    optional_only: bool = False
    optionals: list[Optional] = field(default_factory=list)
    with_: With | None = None
    unwind: tuple[Any, str] | None = None
    call: CallStmt | None = None
    returns: Return | None = None


@dataclass
class CallStmt:
    name: str
    args: dict[str, Any]
    yields: list[str] | None


@dataclass
class Union:
    parts: list[Any]
    all: bool


@dataclass
class Insert:
    elements: list[Pattern]
    patterns: list[Pattern] = field(default_factory=list)
    where: Any = None
    unwind: tuple[Any, str] | None = None


@dataclass
class Update:
    kind: str  # SET, REMOVE, DELETE
    patterns: list[Pattern]
    where: Any
    props: list[tuple[str, str, Any]] = field(default_factory=list)
    labels: list[tuple[str, str]] = field(default_factory=list)
    variables: list[str] = field(default_factory=list)
    detach: bool = False


@dataclass
class Admin:
    """Indexes, constraints, CSV and TRUNCATE: kind and its words."""

    kind: str
    label: str | None = None
    prop: str | None = None
    extra: str | None = None
