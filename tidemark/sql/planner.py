"""Syntax tree to DataFrame, under the rules of a profile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, Window, functions as F, types as Types

from tidemark.errors import SchemaError, ValidationError
from tidemark.functions.text import folded, number, plain_number, same_text
from tidemark.sql import tree as T


@dataclass(frozen=True)
class Profile:
    """Whose rules hold: typed values and real nulls, or texts that are compared without case.

    ``compat`` folds case and null in joins, filters, EXISTS and sorting, takes
    what isn't a number as 0 in SUM, AVG, MIN and MAX, divides AVG by all rows,
    gives unknown columns as null, looks a name up in the other tables when its
    own has no value, and formats aggregates as text.
    """

    compat: bool = False

    def equal(self, a: Column, b: Column) -> Column:
        return folded(a) == folded(b) if self.compat else a == b

    def compared(self, operator: str, a: Column, b: Column) -> Column:
        """A comparison of two values; in compat = and <> fold, the others take numbers where both are."""
        if self.compat and operator in ("=", "<>"):
            a, b = folded(a), folded(b)
        elif self.compat:
            x, y = (v.cast("string").try_cast("double") for v in (a, b))
            as_numbers = x.isNotNull() & y.isNotNull()
            return F.when(as_numbers, _compare(operator, x, y)).otherwise(_compare(operator, folded(a), folded(b)))
        return _compare(operator, a, b)

    def matches(self, a: Column, literal: str, kind: Types.DataType) -> Column:
        return self.compared("=", a, F.lit(literal) if self.compat else typed_literal(literal, kind))

    def member(self, a: Column, b: Column) -> Column:
        return same_text(a, b) if self.compat else a == b

    def sort_key(self, c: Column, descending: bool) -> Column:
        key = folded(c) if self.compat else c
        return key.desc() if descending else key.asc()

    def aggregate(self, function: str, argument: Column | None, distinct: bool = False) -> Column:
        if distinct:
            if function not in ("COUNT", "SUM", "AVG"):
                distinct = False
            elif self.compat and function != "COUNT":
                raise ValidationError(f"{function} takes no DISTINCT here")
            else:
                return {"COUNT": F.count_distinct, "SUM": F.sum_distinct, "AVG": lambda c: F.try_divide(F.sum_distinct(c), F.count_distinct(c))}[function](argument)
        if function == "COUNT":
            return F.count("*") if argument is None else F.count(argument)
        if function == "ANY_VALUE":
            return F.any_value(argument)
        if argument is None:
            raise ValidationError(f"{function} needs a column")
        if not self.compat:
            return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[function](argument)
        value = number(argument)
        return {"SUM": F.sum(value), "AVG": F.sum(value) / F.count("*"), "MIN": F.min(value), "MAX": F.max(value)}[function]

    def shown(self, function: str, value: Column) -> Column:
        return plain_number(value) if self.compat and function not in ("COUNT", "ANY_VALUE") else value


def _compare(operator: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[operator]


def typed_literal(literal: str | None, kind: Types.DataType) -> Column:
    """A literal as a value that compares with a column of a type without loss; one that can't be is an error."""
    if literal is None:
        return F.lit(None).cast(kind)
    try:
        if isinstance(kind, Types.BooleanType):
            return F.lit({"1": True, "true": True, "0": False, "false": False}[literal.lower()])
        if isinstance(kind, Types.DateType):
            return F.lit(date.fromisoformat(literal[:10]))
        if isinstance(kind, (Types.TimestampType, Types.TimestampNTZType)):
            return F.lit(datetime.fromisoformat(literal)).cast(kind)
        if isinstance(kind, (Types.FloatType, Types.DoubleType)):
            return F.lit(float(literal))
        if isinstance(kind, Types.NumericType):
            value = Decimal(literal.strip())
            if not value.is_finite():
                raise ValueError(literal)
            return F.lit(int(value)) if value == value.to_integral_value() and abs(value) < 1 << 62 else F.lit(value)
        return F.lit(literal)
    except (KeyError, ValueError, InvalidOperation):
        raise ValidationError(f"'{literal}' doesn't compare with a {kind.simpleString()} column") from None


TYPED, COMPAT = Profile(), Profile(compat=True)


class _Scope:
    """The tables of a FROM clause, in order; names are looked up without case."""

    def __init__(self, profile: Profile):
        self.profile = profile
        self.columns: dict[str, list[str]] = {}
        #: Of NATURAL joins: shared columns that a bare name means, each in one table.
        self.merged: dict[str, str] = {}

    def add(self, source: T.Source, columns: list[str]) -> None:
        if source.name.lower() in self.columns:
            raise ValidationError(f"The name '{source.name}' is used twice")
        self.columns[source.name.lower()] = columns

    @staticmethod
    def physical(table: str, column: str) -> str:
        return f"{table.lower()}\x1f{column.lower()}"

    def places(self, name: T.Name) -> list[str]:
        """Physical columns that the name may mean, its own table's first."""
        has = lambda t: name.column.lower() in (x.lower() for x in self.columns[t])
        own = name.table.lower()
        if not own and name.column.lower() in self.merged:
            return [self.merged[name.column.lower()]]
        if own and own not in self.columns:
            raise SchemaError(f"Unknown table '{name.table}'")
        tables = ([own] if own else []) + ([t for t in self.columns if t != own] if self.profile.compat or not own else [])
        return [self.physical(t, name.column) for t in tables if has(t)]

    def column(self, name: T.Name) -> Column:
        places = self.places(name)
        if not places:
            if self.profile.compat:
                return F.lit(None).cast("string")
            raise SchemaError(f"Unknown column '{name.table + '.' if name.table else ''}{name.column}'")
        if self.profile.compat:
            return F.coalesce(*[F.col(f"`{p}`").cast("string") for p in places]) if len(places) > 1 else F.col(f"`{places[0]}`")
        if len(places) > 1:
            raise ValidationError(f"The column '{name.column}' is ambiguous")
        return F.col(f"`{places[0]}`")

    def knows(self, name: T.Name) -> bool:
        return bool(self.places(name)) if not name.table or name.table.lower() in self.columns else False


FUNCTIONS = {
    "LPAD": lambda a, n, p=" ": F.lpad(a, n, p), "RPAD": lambda a, n, p=" ": F.rpad(a, n, p), "TRIM": F.trim, "LTRIM": F.ltrim, "RTRIM": F.rtrim, "CHAR_LENGTH": F.char_length, "OCTET_LENGTH": F.octet_length,
    "GREATEST": F.greatest, "LEAST": F.least, "UPPER": F.upper, "LOWER": F.lower, "COALESCE": F.coalesce, "ROUND": F.round, "SUBSTRING": F.substring, "ABS": F.abs,
}
#: Functions whose later arguments are constants, and rankings.
CONSTANTS = {"LPAD": (int, str), "RPAD": (int, str), "ROUND": (int,), "SUBSTRING": (int, int)}
RANKINGS = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}
#: Rounds of a recursive query before it is given up.
MOST_ROUNDS = 100


class Planner:
    """Plans queries over tables that ``load`` finds by name; ``keep`` writes the rounds of a recursive query where all executors read them."""

    def __init__(self, load: Callable[[str], DataFrame], profile: Profile = TYPED, keep: Callable[[DataFrame], DataFrame] | None = None):
        self.load, self.profile, self.keep = load, profile, keep

    def _read(self, source: T.Source) -> tuple[DataFrame, list[str]]:
        df = self.plan(source.query) if source.query else self.load(source.table)
        return df.select([F.col(f"`{x}`").alias(_Scope.physical(source.name, x)) for x in df.columns]), df.columns

    def plan(self, q: T.Query) -> DataFrame:
        if isinstance(q, T.With):
            return self._with(q)
        if isinstance(q, T.SetOperation):
            left, right = self.plan(q.left), self.plan(q.right)
            if len(left.columns) != len(right.columns):
                raise ValidationError(f"{q.kind.upper()} needs as many columns on both sides")
            out = {"union": left.union, "intersect": left.intersectAll if q.all else left.intersect, "except": left.exceptAll if q.all else left.subtract}[q.kind](right)
            return self._limited(self._by_names(out.distinct() if q.kind == "union" and not q.all else out, q.order_by), q)
        return self._limited(self._select(q), q)

    @staticmethod
    def _limited(df: DataFrame, q) -> DataFrame:
        df = df.offset(q.offset) if q.offset else df
        return df if q.limit is None else df.limit(q.limit)

    def _with(self, q: T.With) -> DataFrame:
        """Named queries are tables for what follows; a recursive one grows by rounds until a round adds nothing."""
        named: dict[str, DataFrame] = {}
        inner = Planner(lambda name: named[name.lower()] if name.lower() in named else self.load(name), self.profile, self.keep)
        for c in q.tables:
            shaped = lambda df, c=c: df.toDF(*c.columns) if c.columns else df
            if not (q.recursive and isinstance(c.query, T.SetOperation) and c.query.kind == "union"):
                named[c.name.lower()] = shaped(inner.plan(c.query))
                continue
            if self.keep is None:
                raise ValidationError("Recursive queries need a folder for their rounds")
            whole = fresh = self.keep(shaped(inner.plan(c.query.left)) if c.query.all else shaped(inner.plan(c.query.left)).distinct())
            for _ in range(MOST_ROUNDS):
                named[c.name.lower()] = fresh
                step = inner.plan(c.query.right).toDF(*whole.columns)
                step = step.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in whole.schema])
                fresh = self.keep(step if c.query.all else step.subtract(whole))
                if fresh.isEmpty():
                    break
                whole = whole.union(fresh)
            else:
                raise ValidationError(f"'{c.name}' doesn't end within {MOST_ROUNDS} rounds")
            named[c.name.lower()] = whole
        return inner.plan(q.query)

    def _select(self, s: T.Select) -> DataFrame:
        scope = _Scope(self.profile)
        df, columns = self._read(s.source)
        scope.add(s.source, columns)
        for join in s.joins:
            df = self._joined(df, join, scope)
        for condition in s.where:
            df = self._filter(df, condition, scope)
        if s.group_by:
            return self._grouped(df, s, scope)
        aggregates = bool(s.items) and all(isinstance(i.value, T.Aggregate) for i in s.items)
        if aggregates and not self.profile.compat:
            return self._grouped(df, s, scope)
        if s.having:
            raise ValidationError("HAVING needs GROUP BY or aggregates")
        scalars = []
        for k, item in enumerate(s.items or ()):
            if isinstance(item.value, T.ScalarQuery):
                df = self._with_scalar(df, item.value, f"\x1fscalar{k}", scope)
            scalars.append(f"`\x1fscalar{k}`")
        # A name of the result sorts by what it stands for, another by its column of FROM.
        shown = {i.name.lower(): F.col(scalars[k]) if isinstance(i.value, T.ScalarQuery) else None for k, i in enumerate(s.items or ()) if i.name}
        meant = {i.name.lower(): i.value for i in s.items or () if i.name and not isinstance(i.value, (T.ScalarQuery, T.Aggregate))}

        def sorting(n: T.Name) -> Column:
            name = n.column.lower()
            if not n.table and shown.get(name) is not None:
                return shown[name]
            return self._value(meant[name], scope, df) if not n.table and name in meant else scope.column(n)

        if s.order_by and not s.distinct:
            df = df.orderBy(*[self.profile.sort_key(sorting(n), down) for n, down in s.order_by])
        if s.items is None:
            natural = [x for j in s.joins if j.kind == "natural" for x in scope.columns[j.source.name.lower()]] if s.joins and all(j.kind == "natural" for j in s.joins) else []
            own = scope.columns[s.source.name.lower()]
            out = [F.col(f"`{_Scope.physical(s.source.name, x)}`").alias(x) for x in own]
            return self._distinct(df.select(out + [scope.column(T.Name(x)).alias(x) for x in natural if x.lower() not in (y.lower() for y in own)]), s)
        out = []
        for item, scalar in zip(s.items, scalars, strict=True):
            if isinstance(item.value, T.Aggregate):
                if self.profile.compat:
                    out.append(self._per_row(item.value, scope, df).alias(item.name or item.value.default_name))
                    continue
                raise ValidationError("Columns beside an aggregate need GROUP BY")
            value = F.col(scalar) if isinstance(item.value, T.ScalarQuery) else self._value(item.value, scope, df)
            out.append(value.alias(item.name or item.value.column))
        return self._distinct(df.select(out), s)

    def _distinct(self, df: DataFrame, s: T.Select) -> DataFrame:
        return self._by_names(df.distinct(), s.order_by) if s.distinct else df

    def _by_names(self, df: DataFrame, order_by) -> DataFrame:
        """Sorted by columns of the result."""
        have = {x.lower(): x for x in df.columns}
        missing = [n.column for n, _ in order_by if n.column.lower() not in have]
        if missing and not self.profile.compat:
            raise SchemaError(f"ORDER BY '{missing[0]}' isn't in the result")
        keys = [self.profile.sort_key(F.col(f"`{have[n.column.lower()]}`"), down) for n, down in order_by if n.column.lower() in have]
        return df.orderBy(*keys) if keys else df

    def _joined(self, df: DataFrame, join: T.Join, scope: _Scope) -> DataFrame:
        right, columns = self._read(join.source)
        if join.kind == "natural":
            shared = [x for x in columns if scope.places(T.Name(x))]
            pairs = [(scope.column(T.Name(x)), F.col(f"`{_Scope.physical(join.source.name, x)}`")) for x in shared]
            merged = {x.lower(): scope.places(T.Name(x))[0] for x in shared}
            scope.add(join.source, columns)
            scope.merged |= merged
            return df.join(right, [self.profile.equal(a, b) for a, b in pairs], "inner") if pairs else df.crossJoin(right)
        scope.add(join.source, columns)
        if join.kind == "cross":
            return df.crossJoin(right)
        # Either side of an ON equality may be the joined table's.
        on = [self.profile.equal(scope.column(a), scope.column(b)) for a, b in ((join.left, join.right), *join.more)]
        return df.join(right, on, join.kind)

    # Expressions

    def _value(self, e: T.Expression, scope: _Scope, df: DataFrame) -> Column:
        of = lambda x: self._value(x, scope, df)
        if isinstance(e, T.Name):
            return scope.column(e)
        if isinstance(e, T.Literal):
            return F.lit(e.value) if e.text else F.lit(int(e.value) if "." not in e.value else Decimal(e.value))
        if isinstance(e, T.Not):
            return ~of(e.value)
        if isinstance(e, T.IsNull):
            return of(e.value).isNull()
        if isinstance(e, T.OneOf):
            tests = [self._value(T.Binary("=", e.value, x), scope, df) for x in e.options]
            out = tests[0]
            for t in tests[1:]:
                out = out | t
            return out
        if isinstance(e, T.Over):
            window = Window.partitionBy(*[scope.column(n) for n in e.partition]).orderBy(*[self.profile.sort_key(scope.column(n), down) for n, down in e.order]) if e.order else Window.partitionBy(*[scope.column(n) for n in e.partition])
            return (RANKINGS[e.function.function]() if isinstance(e.function, T.Call) else self._aggregate(e.function, scope, df)).over(window)
        if isinstance(e, T.Call):
            return self._call(e, of)
        if isinstance(e, T.Binary):
            if e.operator in ("AND", "OR"):
                return of(e.left) & of(e.right) if e.operator == "AND" else of(e.left) | of(e.right)
            if e.operator == "LIKE":
                pattern = e.right.value if isinstance(e.right, T.Literal) else None
                if pattern is None:
                    raise ValidationError("LIKE needs a text")
                text = of(e.left).cast("string")
                return text.ilike(pattern) if self.profile.compat else text.like(pattern)
            if e.operator in ("=", "<>", "<", ">", "<=", ">="):
                return self.profile.compared(e.operator, *self._sides_of(e, scope, df))
            a, b = of(e.left), of(e.right)
            if e.operator == "||":
                return F.concat(a.cast("string"), b.cast("string"))
            if self.profile.compat:
                a, b = number(a), number(b)
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[e.operator]
        if isinstance(e, T.Aggregate):
            raise ValidationError("An aggregate can't stand here")
        raise ValidationError("A subquery can't stand beside OR or NOT")

    def _sides_of(self, e: T.Binary, scope: _Scope, df: DataFrame) -> tuple[Column, Column]:
        """Both sides of a comparison; a literal becomes a value of the other side's type."""
        sides = [e.left, e.right]
        fixed = [isinstance(x, T.Literal) for x in sides]
        values = [None if f else self._value(x, scope, df) for x, f in zip(sides, fixed, strict=True)]
        for k in (0, 1):
            if fixed[k]:
                other = values[1 - k]
                kind = Types.StringType() if other is None or self.profile.compat else df.select(other).schema[0].dataType
                values[k] = self._value(sides[k], scope, df) if other is None else typed_literal(sides[k].value, kind)
        return values[0], values[1]

    def _call(self, e: T.Call, of) -> Column:
        kinds = CONSTANTS.get(e.function, ())
        first = len(e.arguments) - len(kinds) if not kinds else 1
        try:
            rest = [kind(x.value) for kind, x in zip(kinds, e.arguments[1:], strict=False)] if kinds else []
            return FUNCTIONS[e.function](*[of(x) for x in e.arguments[: first if kinds else None]], *rest)
        except (AttributeError, TypeError, ValueError):
            raise ValidationError(f"{e.function} doesn't take these arguments") from None

    def condition(self, where: tuple, df: DataFrame, table: str) -> Column:
        """The conditions of UPDATE and DELETE on the plain columns of a table."""
        scope = _Scope(self.profile)
        scope.add(T.Source(table), df.columns)
        scope.physical = lambda _, column: next(x for x in df.columns if x.lower() == column.lower())
        out = F.lit(True)
        for c in where:
            out = out & self._test(c, scope, df)
        return F.coalesce(out, F.lit(False))

    def _test(self, c: T.Equals | T.Test, scope: _Scope, df: DataFrame) -> Column:
        if isinstance(c, T.Test):
            return self._value(c.value, scope, df)
        column = scope.column(c.column)
        return self.profile.matches(column, c.value, Types.StringType() if self.profile.compat else df.select(column).schema[0].dataType)

    def _filter(self, df: DataFrame, condition, scope: _Scope) -> DataFrame:
        if isinstance(condition, (T.Equals, T.Test)):
            return df.where(self._test(condition, scope, df))
        inner, columns = self._read(condition.source)
        within = _Scope(self.profile)
        within.add(condition.source, columns)
        if isinstance(condition, T.Among):
            for c in condition.where:
                inner = self._filter(inner, c, within)
            keys = inner.select(within.column(condition.inner).alias("\x1fkey"))
            match = self.profile.member(scope.column(condition.column), F.col("`\x1fkey`"))
            if not condition.negated:
                return df.join(keys, match, "left_semi")
            # A null key matches nothing and rules everything out, unless there are no keys at all.
            counts = keys.agg(F.count("*").alias("\x1fall"), F.count("\x1fkey").alias("\x1fknown"))
            own = scope.column(condition.column)
            out = df.join(keys, match, "left_anti").crossJoin(F.broadcast(counts))
            keeps = (F.col("`\x1fall`") == 0) | own.isNotNull() & (F.col("`\x1fall`") == F.col("`\x1fknown`"))
            return out.where(keeps).drop("\x1fall", "\x1fknown")
        own, outer = self._sides(condition.left, condition.right, within)
        keys = inner.select(within.column(own).alias("\x1fkey"))
        return df.join(keys, self.profile.equal(F.col("`\x1fkey`"), scope.column(outer)), "left_anti" if condition.negated else "left_semi")

    @staticmethod
    def _sides(left: T.Name, right: T.Name, within: _Scope) -> tuple[T.Name, T.Name]:
        """Which side of a correlated equality is the inner table's."""
        if within.knows(left):
            return left, right
        if within.knows(right):
            return right, left
        raise SchemaError(f"Neither '{left.column}' nor '{right.column}' belongs to the subquery's table")

    def _with_scalar(self, df: DataFrame, q: T.ScalarQuery, name: str, scope: _Scope) -> DataFrame:
        inner, columns = self._read(q.source)
        within = _Scope(self.profile)
        within.add(q.source, columns)
        own, outer = self._sides(q.left, q.right, within)
        key = lambda c: F.upper(c.cast("string")) if self.profile.compat else c
        if self.profile.compat and q.aggregate.function in ("MIN", "MAX"):
            value = {"MIN": F.min, "MAX": F.max}[q.aggregate.function](self._value(q.aggregate.argument, within, inner).cast("string"))
        else:
            value = self.profile.shown(q.aggregate.function, self._aggregate(q.aggregate, within, inner))
        sums = inner.groupBy(key(within.column(own)).alias("\x1fkey")).agg(value.alias(name))
        match = F.col("`\x1fkey`").eqNullSafe(key(scope.column(outer))) if self.profile.compat else F.col("`\x1fkey`") == scope.column(outer)
        df = df.join(sums, match, "left").drop("\x1fkey")
        if q.aggregate.function == "COUNT":
            return df.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit(0).cast("long")))
        if self.profile.compat:
            return df.withColumn(name, F.coalesce(F.col(f"`{name}`"), F.lit("" if q.aggregate.function in ("MIN", "MAX") else "0")))
        return df

    def _aggregate(self, a: T.Aggregate, scope: _Scope, df: DataFrame) -> Column:
        return self.profile.aggregate(a.function, None if a.argument is None else self._value(a.argument, scope, df), a.distinct)

    def _per_row(self, a: T.Aggregate, scope: _Scope, df: DataFrame) -> Column:
        """An aggregate without GROUP BY in compat: over each row by itself."""
        if a.argument is None:
            return F.lit(1).cast("long")
        value = self._value(a.argument, scope, df)
        if a.function == "COUNT":
            return value.isNotNull().cast("long")
        return value if a.function == "ANY_VALUE" else plain_number(number(value))

    def _grouped(self, df: DataFrame, s: T.Select, scope: _Scope) -> DataFrame:
        """Groups, or one group of all rows without GROUP BY; keys are told apart by table and column."""
        if s.items is None:
            raise ValidationError("SELECT * can't be grouped")
        if any(isinstance(i.value, T.ScalarQuery) for i in s.items):
            raise ValidationError("A grouped query takes no scalar subquery")
        keys = [scope.column(n).alias(f"\x1fkey{k}") for k, n in enumerate(s.group_by)]
        places = [tuple(scope.places(n)) for n in s.group_by]

        def key_of(name: T.Name) -> int | None:
            """Which key a name means; an ambiguous bare name is an error, but in compat the first of that name."""
            scope.column(name)
            mine = tuple(scope.places(name))
            if mine in places:
                return places.index(mine)
            same = [k for k, n in enumerate(s.group_by) if n.column.lower() == name.column.lower()]
            return same[0] if same and self.profile.compat else None

        values: dict[T.Aggregate, str] = {}
        wanted = [i.value for i in s.items if isinstance(i.value, T.Aggregate)] + ([s.having.aggregate] if s.having else [])
        for a in wanted:
            values.setdefault(a, f"\x1fvalue{len(values)}")
        aggregates = [self._aggregate(a, scope, df).alias(name) for a, name in values.items()] or [F.count("*").alias("\x1frows")]
        out = df.groupBy(*keys).agg(*aggregates)
        if s.having:
            out = out.where(self._having(F.col(f"`{values[s.having.aggregate]}`"), s.having, out))
        shown = []
        for item in s.items:
            if isinstance(item.value, T.Aggregate):
                shown.append(self.profile.shown(item.value.function, F.col(f"`{values[item.value]}`")).alias(item.name or item.value.default_name))
            elif isinstance(item.value, T.Name) and (k := key_of(item.value)) is not None:
                shown.append(F.col(f"`\x1fkey{k}`").alias(item.name or item.value.column))
            elif not self.profile.compat:
                raise ValidationError("Every plain column must be in GROUP BY")
        out = out.select(shown)
        return self._by_names(out.distinct() if s.distinct else out, s.order_by)

    def _having(self, value: Column, having: T.Having, out: DataFrame) -> Column:
        kind = out.select(value).schema[0].dataType
        if not isinstance(kind, Types.NumericType):
            return self.profile.compared(having.operator, value, typed_literal(having.value, kind))
        try:
            literal = float(having.value)
        except (TypeError, ValueError):
            raise ValidationError(f"'{having.value}' isn't a number") from None
        value = value.cast("double")
        equal = F.abs(value - literal) < 1e-9
        return {"=": equal, "<>": ~equal}[having.operator] if having.operator in ("=", "<>") else _compare(having.operator, value, F.lit(literal))
