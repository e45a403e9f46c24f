"""Syntax trees.  Expressions share one node; each statement has a class."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    """kind: literal, column, star, unary, binary, in, between, like, vector or call."""

    kind: str
    value: object = None
    args: tuple = ()
    qualifier: str | None = None
    negated: bool = False


@dataclass
class Select:
    items: list[tuple[Node, str | None]]
    table: str
    where: Node | None = None
    order: list[tuple[Node, bool]] = field(default_factory=list)  # (key, descending)
    limit: int | None = None
    offset: int | None = None


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    values: list[Node]


@dataclass
class Update:
    table: str
    sets: list[tuple[str, Node]]
    where: Node | None


@dataclass
class Delete:
    table: str
    where: Node | None


@dataclass
class ColumnDef:
    name: str
    type: str
    size: int | None
    nullable: bool = True
    unique: bool = False
    default: Node | None = None
    comment: str = ""


@dataclass
class Create:
    kind: str  # database, collection, index or vindex
    name: str
    if_not_exists: bool
    columns: list[ColumnDef] = field(default_factory=list)
    comment: str = ""
    table: str | None = None
    column: str | None = None
    unique: bool = False
    options: dict[str, object] = field(default_factory=dict)


@dataclass
class Drop:
    kind: str
    name: str
    if_exists: bool
    table: str | None = None


@dataclass
class Use:
    database: str


@dataclass
class Show:
    kind: str  # databases, collections, indexes or vindexes
    name: str | None = None


@dataclass
class Describe:
    table: str
