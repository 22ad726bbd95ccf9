"""Syntax tree of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Name:
    """A column, with the table or alias that it is qualified by."""

    column: str
    table: str = ""


@dataclass(frozen=True)
class Literal:
    value: str | None  # None: NULL
    text: bool = True


@dataclass(frozen=True)
class Call:
    function: str
    arguments: tuple[Expression, ...]


@dataclass(frozen=True)
class Binary:
    """Arithmetic, ||, comparisons, LIKE, AND, OR."""

    operator: str
    left: Expression
    right: Expression


@dataclass(frozen=True)
class Not:
    value: Expression


@dataclass(frozen=True)
class IsNull:
    value: Expression


@dataclass(frozen=True)
class OneOf:
    value: Expression
    options: tuple[Expression, ...]


@dataclass(frozen=True)
class Over:
    """A ranking function or an aggregate over a window."""

    function: Call | Aggregate
    partition: tuple[Name, ...]
    order: tuple[tuple[Name, bool], ...]


@dataclass(frozen=True)
class Aggregate:
    function: str
    argument: Expression | None  # None: *
    distinct: bool = False

    @property
    def default_name(self) -> str:
        return f"{self.function}_{'*' if self.argument is None else getattr(self.argument, 'column', 'value')}"


@dataclass(frozen=True)
class Source:
    table: str
    alias: str = ""
    query: Query | None = None  # a subquery in FROM

    @property
    def name(self) -> str:
        return self.alias or self.table


@dataclass(frozen=True)
class ScalarQuery:
    aggregate: Aggregate
    source: Source
    left: Name
    right: Name


@dataclass(frozen=True)
class Item:
    value: Expression | Aggregate | ScalarQuery
    name: str = ""


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, full, cross, natural
    source: Source
    left: Name | None = None
    right: Name | None = None
    more: tuple[tuple[Name, Name], ...] = ()  # further equalities of ON


@dataclass(frozen=True)
class Equals:
    column: Name
    value: str


@dataclass(frozen=True)
class Among:
    column: Name
    inner: Name
    source: Source
    where: tuple[Equals, ...]
    negated: bool = False


@dataclass(frozen=True)
class Exists:
    source: Source
    left: Name
    right: Name
    negated: bool = False


@dataclass(frozen=True)
class Test:
    """Any other condition on the rows of FROM."""

    value: Expression


@dataclass(frozen=True)
class Having:
    aggregate: Aggregate
    operator: str
    value: str


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...] | None  # None: *
    source: Source
    joins: tuple[Join, ...] = ()
    where: tuple[Equals | Among | Exists | Test, ...] = ()
    group_by: tuple[Name, ...] = ()
    having: Having | None = None
    order_by: tuple[tuple[Name, bool], ...] = ()  # and: descending?
    no_lock: bool = False
    distinct: bool = False
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class SetOperation:
    kind: str  # union, intersect, except
    all: bool
    left: Query
    right: Query
    order_by: tuple[tuple[Name, bool], ...] = ()
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Common:
    """A named query of WITH, and names for its columns."""

    name: str
    columns: tuple[str, ...]
    query: Query


@dataclass(frozen=True)
class With:
    recursive: bool
    tables: tuple[Common, ...]
    query: Query


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    rows: tuple[tuple[str | None, ...], ...]


@dataclass(frozen=True)
class Update:
    table: str
    changes: tuple[tuple[str, str | None], ...]
    where: tuple[Equals | Test, ...] = ()


@dataclass(frozen=True)
class Delete:
    table: str
    where: tuple[Equals | Test, ...] = ()


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    width: int = 0
    scale: int = 0


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    referenced: str


@dataclass(frozen=True)
class CreateDatabase:
    name: str
    options: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    max_shard_size: int | None = None


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class CreateView:
    name: str
    query: Query
    text: str


@dataclass(frozen=True)
class DropView:
    name: str


@dataclass(frozen=True)
class AlterTable:
    """kind add: the column; drop: its name; rename: its name and the new one."""

    table: str
    kind: str
    column: Column | str
    to: str = ""


Expression = Name | Literal | Call | Binary | Not | IsNull | OneOf | Over
Query = Select | SetOperation | With
Statement = Query | Insert | Update | Delete | CreateDatabase | CreateTable | CreateIndex | CreateView | DropView | AlterTable
