"""Recursive descent over the tokens of one statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import TypeVar

from tidemark.errors import ParseError, ValidationError
from tidemark.sql import tree as T
from tidemark.sql.lexer import Token, tokens

# Words that can't name a table or column, types, and aggregate functions.
RESERVED = frozenset("SELECT FROM WHERE INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE AND JOIN ON GROUP BY HAVING".split())
SIZED_TYPES = {"CHAR", "VARCHAR"}
PLAIN_TYPES = {"INT", "TINYINT", "BIGINT", "BIT"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "ANY_VALUE"}
RANKINGS = {"ROW_NUMBER", "RANK", "DENSE_RANK"}
JOINS = {"INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "JOIN"}
SET_OPERATIONS = {"UNION", "INTERSECT", "EXCEPT"}
#: Words that end a table reference, so that they aren't its alias.
CLAUSES = {"ON", "WHERE", "GROUP", "HAVING", "ORDER", "WITH", "LIMIT", "OFFSET"} | JOINS | SET_OPERATIONS

FUNCTIONS = {"LPAD", "RPAD", "TRIM", "LTRIM", "RTRIM", "CHAR_LENGTH", "OCTET_LENGTH", "GREATEST", "LEAST", "UPPER", "LOWER", "COALESCE", "ROUND", "SUBSTRING", "ABS"}
COMPARISONS = ("=", "<>", "!=", "<", ">", "<=", ">=")

V = TypeVar("V")


def parse(sql: str) -> T.Statement:
    """The statement in sql; text after it is an error."""
    return _Parser(tokens(sql)).statement()


class _Parser:
    def __init__(self, found: list[Token]):
        self.found, self.at = found, 0

    def text_between(self, begin: int, end: int) -> str:
        """The tokens as text that parses to the same."""
        quoted = lambda t: "'" + t.value.replace("\\", "\\\\").replace("'", "''") + "'" if t.kind == "text" else f"[{t.value}]" if t.kind == "bracket" else t.value
        return " ".join(quoted(t) for t in self.found[begin:end])

    # Tokens

    @property
    def now(self) -> Token:
        return self.found[self.at]

    def ahead(self, n: int) -> Token:
        return self.found[min(self.at + n, len(self.found) - 1)]

    def fail(self, message: str) -> ParseError:
        return ParseError(message, self.now.line, self.now.column)

    def step(self) -> Token:
        token = self.now
        self.at = min(self.at + 1, len(self.found) - 1)
        return token

    def word(self, *words: str) -> bool:
        """Take one of the words if it is next."""
        if self.now.is_word(*words):
            self.step()
            return True
        return False

    def sign(self, value: str) -> bool:
        if self.now.kind == "sign" and self.now.value == value:
            self.step()
            return True
        return False

    def need_word(self, *words: str) -> str:
        if not self.now.is_word(*words):
            raise self.fail(f"Expected {' or '.join(words)}, got '{self.now.value}'")
        return self.step().value.upper()

    def need_sign(self, value: str) -> None:
        if not self.sign(value):
            raise self.fail(f"Expected '{value}', got '{self.now.value}'")

    def listed(self, one: Callable[[], V]) -> tuple[V, ...]:
        out = [one()]
        while self.sign(","):
            out.append(one())
        return tuple(out)

    def enclosed(self, one: Callable[[], V]) -> tuple[V, ...]:
        self.need_sign("(")
        out = self.listed(one)
        self.need_sign(")")
        return out

    # Names and values

    def identifier(self, what: str = "a name") -> str:
        if self.now.kind == "bracket":
            if not self.now.value.strip():
                raise ValidationError("A name can't be empty")
            return self.step().value
        if self.now.kind != "word":
            raise self.fail(f"Expected {what}, got '{self.now.value}'")
        if self.now.value.upper() in RESERVED:
            raise ValidationError(f"'{self.now.value}' is a reserved word")
        return self.step().value

    def name(self) -> T.Name:
        first = self.identifier("a column")
        return T.Name(self.identifier("a column"), first) if self.sign(".") else T.Name(first)

    def literal(self) -> str | None:
        if self.word("NULL"):
            return None
        if self.sign("-"):
            return f"-{self.number()}"
        if self.now.kind not in ("text", "number"):
            raise self.fail(f"Expected a value, got '{self.now.value}'")
        return self.step().value

    def number(self) -> str:
        if self.now.kind != "number":
            raise self.fail(f"Expected a number, got '{self.now.value}'")
        return self.step().value

    def whole(self) -> int:
        if self.now.kind != "number" or "." in self.now.value:
            raise self.fail(f"Expected a whole number, got '{self.now.value}'")
        return int(self.step().value)

    def source(self) -> T.Source:
        query = None
        if self.sign("("):
            query = self.query()
            self.need_sign(")")
            self.word("AS")
            return T.Source("", self.identifier("a name for the subquery"), query)
        table = self.identifier("a table")
        plain = self.now.kind == "word" and self.now.value.upper() not in CLAUSES | RESERVED
        return T.Source(table, self.step().value if plain else "")

    def equality(self) -> tuple[T.Name, T.Name]:
        left = self.name()
        self.need_sign("=")
        return left, self.name()

    # Statements

    def statement(self) -> T.Statement:
        kinds = {"INSERT": self.insert, "UPDATE": self.update, "DELETE": self.delete, "CREATE": self.create, "DROP": self.drop, "ALTER": self.alter}
        if self.now.is_word("SELECT", "WITH") or self.now.kind == "sign" and self.now.value == "(":
            out = self.query()
        elif self.now.kind == "word" and self.now.value.upper() in kinds:
            out = kinds[self.step().value.upper()]()
        else:
            raise self.fail(f"Expected a statement, got '{self.now.value}'")
        self.sign(";")
        if self.now.kind != "end":
            raise self.fail(f"Unexpected '{self.now.value}' after the statement")
        return out

    # Queries

    def query(self) -> T.Query:
        """WITH, set operations (INTERSECT first), then what orders and limits the whole."""
        if self.word("WITH"):
            recursive = self.word("RECURSIVE")
            return T.With(recursive, self.listed(self.common), self.query())
        out = self.intersections()
        while self.now.is_word("UNION", "EXCEPT"):
            out = T.SetOperation(self.step().value.lower(), self.all(), out, self.intersections())
        order_by: tuple[tuple[T.Name, bool], ...] = ()
        if self.word("ORDER"):
            self.need_word("BY")
            order_by = self.listed(self.sorting)
        limit = self.whole() if self.word("LIMIT") else None
        offset = self.whole() if self.word("OFFSET") else 0
        if not (order_by or limit is not None or offset):
            return out
        if isinstance(out, T.With) or out.order_by or out.limit is not None:
            raise self.fail("A query is ordered and limited once")
        return replace(out, order_by=order_by, limit=limit, offset=offset)

    def common(self) -> T.Common:
        name = self.identifier("a name")
        columns = self.enclosed(self.identifier) if self.now.value == "(" else ()
        self.need_word("AS")
        self.need_sign("(")
        query = self.query()
        self.need_sign(")")
        return T.Common(name, columns, query)

    def all(self) -> bool:
        if self.word("ALL"):
            return True
        self.word("DISTINCT")
        return False

    def intersections(self) -> T.Query:
        out = self.part()
        while self.word("INTERSECT"):
            out = T.SetOperation("intersect", self.all(), out, self.part())
        return out

    def part(self) -> T.Query:
        if self.sign("("):
            out = self.query()
            self.need_sign(")")
            return out
        self.need_word("SELECT")
        return self.select()

    def sorting(self) -> tuple[T.Name, bool]:
        return self.name(), self.now.is_word("ASC", "DESC") and self.need_word("ASC", "DESC") == "DESC"

    def select(self) -> T.Select:
        distinct = self.word("DISTINCT")
        items = None if self.sign("*") else self.listed(self.item)
        self.need_word("FROM")
        source, joins = self.source(), []
        while self.now.is_word(*JOINS):
            joins.append(self.join())
        no_lock = False
        if self.word("WITH"):
            self.enclosed(lambda: self.need_word("NOLOCK"))
            no_lock = True
        where = self.conditions() if self.word("WHERE") else ()
        group_by: tuple[T.Name, ...] = ()
        if self.word("GROUP"):
            self.need_word("BY")
            group_by = self.listed(self.name)
        having = None
        if self.word("HAVING"):
            aggregate = self.aggregate()
            if self.now.kind != "sign" or self.now.value not in COMPARISONS:
                raise self.fail("HAVING needs a comparison")
            having = T.Having(aggregate, self.step().value.replace("!=", "<>"), self.literal())
        return T.Select(items, source, tuple(joins), where, group_by, having, (), no_lock, distinct)

    def join(self) -> T.Join:
        kind = self.step().value.lower()
        if kind in ("left", "right", "full"):
            self.word("OUTER")
        if kind != "join":
            self.need_word("JOIN")
        joined = self.source()
        if kind in ("cross", "natural"):
            return T.Join(kind, joined)
        self.need_word("ON")
        first, more = self.equality(), []
        while self.word("AND"):
            more.append(self.equality())
        return T.Join("inner" if kind == "join" else kind, joined, *first, tuple(more))

    def item(self) -> T.Item:
        if self.now.value == "(" and self.now.kind == "sign" and self.ahead(1).is_word("SELECT"):
            self.step()
            value = self.scalar()
            self.need_sign(")")
            self.word("AS")
            return T.Item(value, self.identifier("a name for the subquery"))
        value = self.expression()
        if isinstance(value, (T.Name, T.Aggregate)):
            return T.Item(value, self.identifier() if self.word("AS") else "")
        self.need_word("AS")
        return T.Item(value, self.identifier())

    def calls(self, words: set[str]) -> bool:
        return self.now.is_word(*words) and self.ahead(1).value == "(" and self.ahead(1).kind == "sign"

    def aggregate(self) -> T.Aggregate:
        function = self.need_word(*AGGREGATES)
        self.need_sign("(")
        distinct = self.word("DISTINCT")
        argument = None if function == "COUNT" and not distinct and self.sign("*") else self.expression()
        self.need_sign(")")
        return T.Aggregate(function, argument, distinct)

    def scalar(self) -> T.ScalarQuery:
        self.need_word("SELECT")
        aggregate = self.aggregate()
        self.need_word("FROM")
        source = self.source()
        self.need_word("WHERE")
        return T.ScalarQuery(aggregate, source, *self.equality())

    # Expressions, the loosest first

    def conditions(self) -> tuple:
        """What AND joins at the top: equalities with a literal and subqueries as such, the rest as tests."""
        return tuple(self.parts_of(self.expression()))

    def parts_of(self, e) -> list:
        if isinstance(e, T.Binary) and e.operator == "AND":
            return self.parts_of(e.left) + self.parts_of(e.right)
        if isinstance(e, T.Binary) and e.operator == "=" and isinstance(e.left, T.Name) and isinstance(e.right, T.Literal) and e.right.value is not None:
            return [T.Equals(e.left, e.right.value)]
        return [e if isinstance(e, (T.Exists, T.Among)) else T.Test(e)]

    def expression(self):
        out = self.conjunction()
        while self.word("OR"):
            out = T.Binary("OR", out, self.conjunction())
        return out

    def conjunction(self):
        out = self.negation()
        while self.word("AND"):
            out = T.Binary("AND", out, self.negation())
        return out

    def negation(self):
        if not self.word("NOT"):
            return self.predicate()
        value = self.negation()
        return replace(value, negated=not value.negated) if isinstance(value, (T.Exists, T.Among)) else T.Not(value)

    def predicate(self):
        if self.word("EXISTS"):
            return self.exists()
        left = self.sum()
        if self.now.kind == "sign" and self.now.value in COMPARISONS:
            return T.Binary(self.step().value.replace("!=", "<>"), left, self.sum())
        if self.word("IS"):
            negated = self.word("NOT")
            self.need_word("NULL")
            return T.Not(T.IsNull(left)) if negated else T.IsNull(left)
        negated = self.now.is_word("NOT") and self.ahead(1).is_word("IN", "LIKE", "BETWEEN") and self.word("NOT")
        if self.word("LIKE"):
            out = T.Binary("LIKE", left, self.sum())
        elif self.word("BETWEEN"):
            low = self.sum()
            self.need_word("AND")
            out = T.Binary("AND", T.Binary(">=", left, low), T.Binary("<=", left, self.sum()))
        elif self.word("IN"):
            if self.ahead(1).is_word("SELECT"):
                if not isinstance(left, T.Name):
                    raise self.fail("IN with a subquery needs a column")
                return self.among(left, negated)
            out = T.OneOf(left, self.enclosed(self.sum))
        else:
            return left
        return T.Not(out) if negated else out

    def exists(self) -> T.Exists:
        self.need_sign("(")
        self.need_word("SELECT")
        if not self.sign("*"):
            self.step() if self.now.kind == "number" else self.name()
        self.need_word("FROM")
        source = self.source()
        self.need_word("WHERE")
        left, right = self.equality()
        self.need_sign(")")
        return T.Exists(source, left, right)

    def among(self, column: T.Name, negated: bool) -> T.Among:
        self.need_sign("(")
        self.need_word("SELECT")
        inner = self.name()
        self.need_word("FROM")
        source = self.source()
        where = self.conditions() if self.word("WHERE") else ()
        self.need_sign(")")
        return T.Among(column, inner, source, where, negated)

    def sum(self):
        out = self.product()
        while self.now.kind == "sign" and self.now.value in ("+", "-", "||"):
            out = T.Binary(self.step().value, out, self.product())
        return out

    def product(self):
        out = self.primary()
        while self.now.kind == "sign" and self.now.value in ("*", "/", "%"):
            out = T.Binary(self.step().value, out, self.primary())
        return out

    def primary(self):
        if self.sign("("):
            out = self.expression()
            self.need_sign(")")
            return out
        if self.sign("-"):
            return T.Literal(f"-{self.number()}", False)
        if self.now.kind in ("text", "number"):
            return T.Literal(self.now.value, self.step().kind == "text")
        if self.word("NULL"):
            return T.Literal(None)
        if self.calls(AGGREGATES):
            out = self.aggregate()
            return self.over(out) if self.now.is_word("OVER") else out
        if self.calls(RANKINGS):
            function = T.Call(self.step().value.upper(), ())
            self.need_sign("(")
            self.need_sign(")")
            return self.over(function)
        if self.calls(FUNCTIONS):
            return T.Call(self.step().value.upper(), self.enclosed(self.sum))
        return self.name()

    def over(self, function) -> T.Over:
        self.need_word("OVER")
        self.need_sign("(")
        partition: tuple[T.Name, ...] = ()
        order: tuple[tuple[T.Name, bool], ...] = ()
        if self.word("PARTITION"):
            self.need_word("BY")
            partition = self.listed(self.name)
        if self.word("ORDER"):
            self.need_word("BY")
            order = self.listed(self.sorting)
        self.need_sign(")")
        return T.Over(function, partition, order)

    # Changes

    def insert(self) -> T.Insert:
        self.need_word("INTO")
        table = self.identifier("a table")
        columns = self.enclosed(self.identifier)
        self.need_word("VALUES")
        return T.Insert(table, columns, self.listed(lambda: self.enclosed(self.literal)))

    def update(self) -> T.Update:
        table = self.identifier("a table")
        self.need_word("SET")

        def change():
            column = self.identifier("a column")
            self.need_sign("=")
            return column, self.literal()

        changes = self.listed(change)
        return T.Update(table, changes, self.rows_meant())

    def delete(self) -> T.Delete:
        self.need_word("FROM")
        table = self.identifier("a table")
        return T.Delete(table, self.rows_meant())

    def rows_meant(self) -> tuple:
        where = self.conditions() if self.word("WHERE") else ()
        if any(isinstance(c, (T.Exists, T.Among)) for c in where):
            raise ValidationError("UPDATE and DELETE take no subqueries")
        return where

    def drop(self) -> T.Statement:
        self.need_word("VIEW")
        return T.DropView(self.identifier("a view"))

    def alter(self) -> T.Statement:
        self.need_word("TABLE")
        table = self.identifier("a table")
        kind = self.need_word("ADD", "DROP", "RENAME")
        self.word("COLUMN")
        if kind == "ADD":
            return T.AlterTable(table, "add", self.column())
        name = self.identifier("a column")
        if kind == "DROP":
            return T.AlterTable(table, "drop", name)
        self.need_word("TO")
        return T.AlterTable(table, "rename", name, self.identifier("a column"))

    def create(self) -> T.Statement:
        kind = self.need_word("DATABASE", "TABLE", "UNIQUE", "INDEX", "VIEW")
        if kind == "VIEW":
            name = self.identifier("a view")
            self.need_word("AS")
            begin = self.at
            query = self.query()
            return T.CreateView(name, query, self.text_between(begin, self.at))
        if kind == "DATABASE":
            return T.CreateDatabase(self.identifier("a database"), dict(self.options()))
        if kind == "TABLE":
            return self.table()
        if kind == "UNIQUE":
            self.need_word("INDEX")
        name = self.identifier("an index")
        self.need_word("ON")
        return T.CreateIndex(name, self.identifier("a table"), self.enclosed(self.identifier), kind == "UNIQUE")

    def options(self) -> tuple[tuple[str, str], ...]:
        def option():
            key = self.identifier("an option")
            self.need_sign("=")
            return key.lower(), self.step().value if self.now.kind in ("word", "text", "number") else self.literal()

        return self.enclosed(option) if self.word("WITH") else ()

    def table(self) -> T.CreateTable:
        name = self.identifier("a table")
        columns: list[T.Column] = []
        primary: list[str] = []
        unique: list[tuple[str, ...]] = []
        foreign: list[T.ForeignKey] = []

        def part():
            if self.word("PRIMARY"):
                self.need_word("KEY")
                primary.extend(self.enclosed(self.identifier))
            elif self.now.is_word("UNIQUE") and self.ahead(1).value == "(":
                self.step()
                unique.append(self.enclosed(self.identifier))
            elif self.word("FOREIGN"):
                self.need_word("KEY")
                (column,) = self.enclosed(self.identifier)
                self.need_word("REFERENCES")
                parent = self.identifier("a table")
                (referenced,) = self.enclosed(self.identifier)
                foreign.append(T.ForeignKey(column, parent, referenced))
            else:
                column = self.column()
                columns.append(column)
                if self.word("PRIMARY"):
                    self.need_word("KEY")
                    primary.append(column.name)
                elif self.word("UNIQUE"):
                    unique.append((column.name,))

        self.enclosed(part)
        size = dict(self.options()).get("maxshardsize")
        return T.CreateTable(name, tuple(columns), tuple(primary), tuple(unique), tuple(foreign), int(size) if size else None)

    def column(self) -> T.Column:
        name = self.identifier("a column")
        kind = self.need_word(*sorted(SIZED_TYPES | PLAIN_TYPES | {"DECIMAL"}))
        if kind in PLAIN_TYPES:
            return T.Column(name, kind)
        sizes = self.enclosed(self.whole)
        if kind in SIZED_TYPES and len(sizes) == 1:
            if sizes[0] <= 0:
                raise self.fail(f"{kind} needs a positive length")
            return T.Column(name, kind, sizes[0])
        if kind == "DECIMAL" and len(sizes) == 2:
            return T.Column(name, kind, *sizes)
        raise self.fail(f"Wrong number of sizes for {kind}")
