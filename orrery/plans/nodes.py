"""Syntax trees of statements and expressions."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: int | float | str | bool | None


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None


@dataclass(frozen=True)
class Unary:
    op: str  # NOT, -
    operand: object


@dataclass(frozen=True)
class Binary:
    op: str  # + - * / = <> < <= > >= AND OR
    left: object
    right: object


@dataclass(frozen=True)
class IsNull:
    operand: object
    negated: bool


@dataclass(frozen=True)
class Aggregate:
    function: str  # COUNT SUM AVG MIN MAX
    argument: object | None  # None: COUNT(*)


@dataclass(frozen=True)
class Item:
    expression: object
    alias: str | None


@dataclass(frozen=True)
class Relation:
    table: str
    alias: str | None

    @property
    def label(self) -> str:
        return self.alias or self.table


@dataclass(frozen=True)
class Join:
    kind: str  # INNER LEFT RIGHT CROSS
    relation: Relation
    condition: object | None


@dataclass(frozen=True)
class OrderKey:
    name: Name
    descending: bool


@dataclass
class Select:
    items: list[Item] | None  # None: *
    relation: Relation
    joins: list[Join] = field(default_factory=list)
    where: object | None = None
    group_by: list[Name] = field(default_factory=list)
    order_by: list[OrderKey] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


@dataclass
class Explain:
    select: Select


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list[Literal]]


@dataclass
class Update:
    table: str
    changes: list[tuple[str, object]]
    where: object | None


@dataclass
class Delete:
    table: str
    where: object | None


@dataclass
class CreateTable:
    table: str
    columns: list  # of types.ColumnSpec


@dataclass
class DropTable:
    table: str


@dataclass
class CreateIndex:
    index: str
    table: str
    columns: list[str]
    unique: bool


@dataclass
class DropIndex:
    index: str
    table: str | None
