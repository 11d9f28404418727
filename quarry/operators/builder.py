"""The fluent query builder. Methods of a chain change the builder and return it; ``clone`` copies.

Names are in snake case, and each has an alias in camel case.
"""

from __future__ import annotations

import copy
import math
import time
from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ir
from ..events import QueryExecuted
from ..exceptions import MultipleRecordsFoundException, RecordsNotFoundException, SchemaException
from ..functions import literals, names
from ..plans.compile import Compiled, Source, access, output
from .grouping import Grouping, aggregate
from .join import Join
from .rows import decoded, value

if TYPE_CHECKING:
    from ..database.connection import Connection

_TYPES = (list, tuple, dict, set)


class Builder:
    def __init__(self, connection: Connection, table: str):
        self._connection = connection
        self._query = ir.Query(table)

    # --- conditions ------------------------------------------------------------------------------------------------

    @property
    def _tz(self) -> str:
        return self._connection.timezone

    def _add(self, c: ir.Constraint) -> Builder:
        self._query = self._query.but(constraints=(*self._query.constraints, c))
        return self

    def _nested(self, fill: Callable[[Builder], Any], conjunction: str, negated: bool) -> Builder:
        inner = Builder(self._connection, self._query.table)
        fill(inner)
        return self._add(ir.Nested(conjunction, negated, inner._query.constraints)) if inner._query.constraints else self

    def _where(self, args: tuple, conjunction: str, negated: bool = False) -> Builder:
        first = args[0]
        if callable(first):
            return self._nested(first, conjunction, negated)
        if isinstance(first, dict):
            return self._nested(lambda q: [q._where((k, v), conjunction) for k, v in first.items()], conjunction, negated)
        return self._add(self._basic(args, conjunction, negated))

    @staticmethod
    def _basic(args: tuple, conjunction: str, negated: bool) -> ir.Constraint:
        if len(args) == 2:
            column, operator, given = args[0], "=", args[1]
        else:
            column, operator, given = args
        ir.one_of(operator)
        if given is None and operator in ("=", "==", "==="):
            return ir.Null(conjunction, negated, column)
        if given is None and operator in ("!=", "<>", "!=="):
            return ir.Null(conjunction, not negated, column)
        return ir.Basic(conjunction, negated, column, operator, literals.flattened(given) if isinstance(given, _TYPES) else given)

    def where(self, *args: Any) -> Builder:
        return self._where(args, "and")

    def or_where(self, *args: Any) -> Builder:
        return self._where(args, "or")

    def where_not(self, *args: Any) -> Builder:
        return self._where(args, "and", True)

    def or_where_not(self, *args: Any) -> Builder:
        return self._where(args, "or", True)

    def _in(self, column: str, values: Sequence, conjunction: str, negated: bool) -> Builder:
        values = tuple(values)
        if any(isinstance(v, _TYPES) for v in values):
            raise TypeError("a list to look in holds single values")
        return self._add(ir.In(conjunction, negated, column, values))

    def _between(self, column: str, bounds: Sequence, conjunction: str, negated: bool) -> Builder:
        low, high = (*literals.all_flattened(list(bounds)), None, None)[:2]
        return self._add(ir.Between(conjunction, negated, column, low, high))

    def _across(self, columns: Sequence[str], args: tuple, conjunction: str, inner: str, negated: bool = False) -> Builder:
        return self._nested(lambda q: [q._where((c, *args), inner) for c in columns], conjunction, negated)

    @staticmethod
    def _dated(args: tuple) -> tuple[str, Any]:
        operator, given = ("=", args[0]) if len(args) == 1 else args
        return ir.one_of(operator, ir.DATE_OPERATORS), literals.flattened(given) if isinstance(given, _TYPES) else given

    def _part(self, part: str, column: str, args: tuple, conjunction: str) -> Builder:
        operator, given = self._dated(args)
        if isinstance(given, str):
            if not given.strip().lstrip("+-").isdigit():
                raise SchemaException(f"A {part} is a whole number, not [{given}].")
            given = int(given)
        return self._add(ir.Part(conjunction, False, column, part, operator, given))

    def _day(self, column: str, args: tuple, conjunction: str) -> Builder:
        return self._add(ir.Day(conjunction, False, column, *self._dated(args)))

    def _time(self, column: str, args: tuple, conjunction: str) -> Builder:
        operator, given = self._dated(args)
        text = str(given)
        return self._add(ir.Time(conjunction, False, column, operator, f"{text}:00" if text.count(":") == 1 else text))

    def _column(self, args: tuple, conjunction: str) -> Builder:
        first, operator, second = args if len(args) == 3 else (args[0], "=", args[1])
        return self._add(ir.Compared(conjunction, False, first, ir.one_of(operator), second))

    def _contains(self, column: str, given: Any, conjunction: str, negated: bool) -> Builder:
        return self._add(ir.JsonContains(conjunction, negated, column, tuple(given) if isinstance(given, (list, tuple)) else (given,)))

    def _length(self, column: str, args: tuple, conjunction: str) -> Builder:
        operator, given = ("=", args[0]) if len(args) == 1 else args
        return self._add(ir.JsonLength(conjunction, False, column, ir.one_of(operator), literals.flattened(given) if isinstance(given, _TYPES) else given))

    def where_in(self, column: str, values: Sequence) -> Builder:
        return self._in(column, values, "and", False)

    def or_where_in(self, column: str, values: Sequence) -> Builder:
        return self._in(column, values, "or", False)

    def where_not_in(self, column: str, values: Sequence) -> Builder:
        return self._in(column, values, "and", True)

    def or_where_not_in(self, column: str, values: Sequence) -> Builder:
        return self._in(column, values, "or", True)

    def where_null(self, column: str) -> Builder:
        return self._add(ir.Null("and", False, column))

    def or_where_null(self, column: str) -> Builder:
        return self._add(ir.Null("or", False, column))

    def where_not_null(self, column: str) -> Builder:
        return self._add(ir.Null("and", True, column))

    def or_where_not_null(self, column: str) -> Builder:
        return self._add(ir.Null("or", True, column))

    def where_between(self, column: str, bounds: Sequence) -> Builder:
        return self._between(column, bounds, "and", False)

    def or_where_between(self, column: str, bounds: Sequence) -> Builder:
        return self._between(column, bounds, "or", False)

    def where_not_between(self, column: str, bounds: Sequence) -> Builder:
        return self._between(column, bounds, "and", True)

    def or_where_not_between(self, column: str, bounds: Sequence) -> Builder:
        return self._between(column, bounds, "or", True)

    def where_like(self, column: str, pattern: str, case_sensitive: bool = False) -> Builder:
        return self._add(ir.Like("and", False, column, pattern, case_sensitive))

    def or_where_like(self, column: str, pattern: str, case_sensitive: bool = False) -> Builder:
        return self._add(ir.Like("or", False, column, pattern, case_sensitive))

    def where_not_like(self, column: str, pattern: str, case_sensitive: bool = False) -> Builder:
        return self._add(ir.Like("and", True, column, pattern, case_sensitive))

    def or_where_not_like(self, column: str, pattern: str, case_sensitive: bool = False) -> Builder:
        return self._add(ir.Like("or", True, column, pattern, case_sensitive))

    def where_date(self, column: str, *args: Any) -> Builder:
        return self._day(column, args, "and")

    def or_where_date(self, column: str, *args: Any) -> Builder:
        return self._day(column, args, "or")

    def where_year(self, column: str, *args: Any) -> Builder:
        return self._part("year", column, args, "and")

    def or_where_year(self, column: str, *args: Any) -> Builder:
        return self._part("year", column, args, "or")

    def where_month(self, column: str, *args: Any) -> Builder:
        return self._part("month", column, args, "and")

    def or_where_month(self, column: str, *args: Any) -> Builder:
        return self._part("month", column, args, "or")

    def where_day(self, column: str, *args: Any) -> Builder:
        return self._part("day", column, args, "and")

    def or_where_day(self, column: str, *args: Any) -> Builder:
        return self._part("day", column, args, "or")

    def where_time(self, column: str, *args: Any) -> Builder:
        return self._time(column, args, "and")

    def or_where_time(self, column: str, *args: Any) -> Builder:
        return self._time(column, args, "or")

    def where_column(self, *args: str) -> Builder:
        return self._column(args, "and")

    def or_where_column(self, *args: str) -> Builder:
        return self._column(args, "or")

    def where_any(self, columns: Sequence[str], *args: Any) -> Builder:
        return self._across(columns, args, "and", "or")

    def or_where_any(self, columns: Sequence[str], *args: Any) -> Builder:
        return self._across(columns, args, "or", "or")

    def where_all(self, columns: Sequence[str], *args: Any) -> Builder:
        return self._across(columns, args, "and", "and")

    def or_where_all(self, columns: Sequence[str], *args: Any) -> Builder:
        return self._across(columns, args, "or", "and")

    def where_none(self, columns: Sequence[str], *args: Any) -> Builder:
        return self._across(columns, args, "and", "or", True)

    def or_where_none(self, columns: Sequence[str], *args: Any) -> Builder:
        return self._across(columns, args, "or", "or", True)

    def where_json_contains(self, column: str, given: Any) -> Builder:
        return self._contains(column, given, "and", False)

    def or_where_json_contains(self, column: str, given: Any) -> Builder:
        return self._contains(column, given, "or", False)

    def where_json_doesnt_contain(self, column: str, given: Any) -> Builder:
        return self._contains(column, given, "and", True)

    def or_where_json_doesnt_contain(self, column: str, given: Any) -> Builder:
        return self._contains(column, given, "or", True)

    def where_json_length(self, column: str, *args: Any) -> Builder:
        return self._length(column, args, "and")

    def or_where_json_length(self, column: str, *args: Any) -> Builder:
        return self._length(column, args, "or")

    # --- joins -----------------------------------------------------------------------------------------------------

    def _join(self, kind: str, table: str, args: tuple) -> Builder:
        own = Join()
        if args and callable(args[0]):
            args[0](own)
        elif args:
            own.on(*args)
        return self._set(joins=(*self._query.joins, ir.JoinClause(table, kind, tuple(own.conditions))))

    def join(self, table: str, *args: Any) -> Builder:
        return self._join("inner", table, args)

    def left_join(self, table: str, *args: Any) -> Builder:
        return self._join("left", table, args)

    def right_join(self, table: str, *args: Any) -> Builder:
        return self._join("right", table, args)

    def cross_join(self, table: str) -> Builder:
        return self._join("cross", table, ())

    # --- shape -----------------------------------------------------------------------------------------------------

    def _set(self, **changes: Any) -> Builder:
        self._query = self._query.but(**changes)
        return self

    def select(self, *columns: Any) -> Builder:
        flat = [x for c in columns for x in (c if isinstance(c, (list, tuple)) else [c])]
        return self._set(columns=tuple(flat))

    def distinct(self, on: bool = True) -> Builder:
        return self._set(distinct=on)

    def group_by(self, *columns: Any) -> Grouping:
        flat = tuple(x for c in columns for x in (c if isinstance(c, (list, tuple)) else [c]))
        return Grouping(self.clone(), flat)

    def order_by(self, column: str, direction: str = "asc") -> Builder:
        return self._set(orders=(*self._query.orders, ir.Order(column, direction.lower() == "desc")))

    def latest(self, column: str = "created_at") -> Builder:
        return self.order_by(column, "desc")

    def oldest(self, column: str = "created_at") -> Builder:
        return self.order_by(column)

    def in_random_order(self) -> Builder:
        return self._set(random=True)

    def reorder(self, column: str | None = None, direction: str = "asc") -> Builder:
        self._set(orders=(), random=False)
        return self if column is None else self.order_by(column, direction)

    def limit(self, n: float) -> Builder:
        return self._set(limit=int(n)) if isinstance(n, (int, float)) and math.isfinite(n) and n >= 0 else self

    def offset(self, n: float) -> Builder:
        return self._set(offset=int(n) if isinstance(n, (int, float)) and math.isfinite(n) and n > 0 else 0)

    take, skip = limit, offset

    def for_page(self, page: int, per_page: int = 15) -> Builder:
        return self.offset((page - 1) * per_page).limit(per_page)

    def when(self, test: Any, then: Callable[[Builder, Any], Any], otherwise: Callable[[Builder, Any], Any] | None = None) -> Builder:
        given = test(self) if callable(test) else test
        if given:
            then(self, given)
        elif otherwise is not None:
            otherwise(self, given)
        return self

    def unless(self, test: Any, then: Callable[[Builder, Any], Any], otherwise: Callable[[Builder, Any], Any] | None = None) -> Builder:
        given = test(self) if callable(test) else test
        if not given:
            then(self, given)
        elif otherwise is not None:
            otherwise(self, given)
        return self

    def tap(self, look: Callable[[Builder], Any]) -> Builder:
        look(self)
        return self

    def clone(self) -> Builder:
        return copy.copy(self)

    def dump(self) -> Builder:
        print(self._query)
        return self

    # --- reading ---------------------------------------------------------------------------------------------------

    def _sources(self) -> dict[str, Source]:
        return {t: self._connection._source(t) for t in (self._query.table, *[j.table for j in self._query.joins])}

    def _compiled(self, bare: bool = False, **changes: Any) -> Compiled:
        query = self._query.bare() if bare else self._query
        return Compiled(query.but(**changes), self._sources(), self._tz)

    def _timed(self, run: Callable[[], Any], count: Callable[[Any], int]) -> Any:
        begun = time.perf_counter()
        out = run()
        q = self._query
        plan = self.explain()
        self._connection._dispatch(QueryExecuted(self._connection.name, q.table, plan, q.constraints, q.orders, q.limit, (time.perf_counter() - begun) * 1000, count(out)))
        return out

    def explain(self) -> str:
        """What serves the query by its declared key and indexes; ``to_df().explain()`` shows Spark's plan."""
        return access(self._query, self._connection._source(self._query.table))

    def to_df(self) -> DataFrame:
        """The query as a DataFrame, lazily."""
        return self._compiled().rows()

    def get(self) -> list[dict[str, Any]]:
        compiled = self._compiled()
        df, kinds = compiled.rows(in_order=True), compiled.kinds()
        return self._timed(lambda: [decoded(r, kinds) for r in df.collect()], len)

    def _limited(self, n: int) -> list[dict[str, Any]]:
        own = self._query.limit
        return self.clone()._set(limit=n if own is None else min(n, own)).get()

    def first(self) -> dict[str, Any] | None:
        return next(iter(self._limited(1)), None)

    def first_or_fail(self) -> dict[str, Any]:
        row = self.first()
        if row is None:
            raise RecordsNotFoundException(self._query.table)
        return row

    def sole(self) -> dict[str, Any]:
        rows = self._limited(2)
        if not rows:
            raise RecordsNotFoundException(self._query.table)
        if len(rows) > 1:
            raise MultipleRecordsFoundException(self._query.table)
        return rows[0]

    def find(self, key: Any) -> dict[str, Any] | None:
        schema = self._connection._source(self._query.table).schema
        if schema.key is None or key is None or isinstance(key, (bool, dict)):
            return None
        own = Builder(self._connection, self._query.table)
        own._query = self._query.bare().but(distinct=False)
        inner = ir.Nested("and", False, own._query.constraints) if own._query.constraints else None
        own._query = own._query.but(constraints=tuple(x for x in (inner, ir.Basic("and", False, f"{self._query.table}.{schema.key}", "=", key)) if x))
        return own.first()

    def find_or_fail(self, key: Any) -> dict[str, Any]:
        row = self.find(key)
        if row is None:
            raise RecordsNotFoundException(self._query.table)
        return row

    def _selected(self, column: str) -> str:
        """The column behind a name of the selection."""
        if not self._query.columns:
            return column
        by = {a: c for c, a in map(names.projected, self._query.columns)}
        name = column if column in by else names.parse(column).last
        if name not in by:
            raise SchemaException(f"The selection leaves out [{column}].")
        return by[name]

    def value(self, column: str) -> Any:
        row = self.clone()._set(columns=(f"{self._selected(column)} as value",)).first()
        return None if row is None else row["value"]

    def pluck(self, column: str, key: str | None = None) -> Any:
        """A list of values; with ``key`` a mapping, in which the last value of a repeated key stands."""
        wanted = [f"{self._selected(column)} as value"] + ([f"{self._selected(key)} as key"] if key is not None else [])
        rows = self.clone()._set(columns=tuple(wanted)).get()
        return [r["value"] for r in rows] if key is None else {str(r["key"]): r["value"] for r in rows}

    def exists(self) -> bool:
        return self._timed(lambda: not self._compiled(bare=True).matched().isEmpty(), int)

    def doesnt_exist(self) -> bool:
        return not self.exists()

    def count(self) -> int:
        compiled = self._compiled(bare=True)
        unique = self._query.distinct and (self._query.columns or not compiled.scope.keys() or compiled.scope.joined)
        df = compiled.rows() if unique else compiled.matched()
        return self._timed(df.count, int)

    def _aggregate(self, function: str, column: str) -> Any:
        compiled = self._compiled(bare=True)
        ref = compiled.scope.resolve(self._selected(column) if self._query.columns and column not in [c for s in compiled.scope.sources for c in compiled.scope.visible(s.name)] and "." not in column else column)
        df, kind = compiled.matched(), ref.kind
        out = aggregate(function, ref, keys=compiled.scope.keys())
        if self._query.distinct and function in ("sum", "avg"):
            df = df.select(output(ref).alias("v")).distinct()
            out = aggregate(function, type(ref)(F.try_parse_json("v") if kind == "variant" else F.col("v"), kind))
        return value(self._timed(lambda: df.agg(out.alias("v")).first()[0], lambda _: 1), "json" if kind == "variant" and function in ("min", "max") else kind)

    def sum(self, column: str) -> Any:
        return self._aggregate("sum", column)

    def avg(self, column: str) -> Any:
        return self._aggregate("avg", column)

    def min(self, column: str) -> Any:
        return self._aggregate("min", column)

    def max(self, column: str) -> Any:
        return self._aggregate("max", column)

    def paginate(self, page: float = 1, per_page: int = 15) -> dict[str, Any]:
        if not isinstance(per_page, int) or isinstance(per_page, bool) or per_page < 1:
            raise SchemaException("A page holds a whole number of rows, one at least.")
        page = int(page) if isinstance(page, (int, float)) and math.isfinite(page) and page >= 1 else 1
        total = self.count()
        rows = self.clone().for_page(page, per_page).get()
        return {"data": rows, "total": total, "per_page": per_page, "current_page": page, "last_page": max(1, -(-total // per_page))}

    @staticmethod
    def _sized(size: Any) -> int:
        if not isinstance(size, int) or isinstance(size, bool) or size < 1:
            raise SchemaException("A size is a whole number, one at least.")
        return size

    def _pages(self, size: int) -> Iterator[list[dict[str, Any]]]:
        """Pages over one snapshot of the table, brought to the driver partition by partition."""
        compiled = self._compiled()
        kinds, page = compiled.kinds(), []
        for row in compiled.rows(in_order=True).toLocalIterator():
            page.append(decoded(row, kinds))
            if len(page) == size:
                yield page
                page = []
        if page:
            yield page

    def chunk(self, size: int, look: Callable[[list[dict[str, Any]], int], Any]) -> bool:
        for number, page in enumerate(self._pages(self._sized(size)), 1):
            if look(page, number) is False:
                return False
        return True

    def lazy(self, size: int = 100) -> Iterator[dict[str, Any]]:
        self._sized(size)
        return (row for page in self._pages(size) for row in page)

    def each(self, look: Callable[[dict[str, Any], int], Any], size: int = 1000) -> bool:
        self._sized(size)
        for i, row in enumerate(self.lazy(size)):
            if look(row, i) is False:
                return False
        return True

    # --- writing ---------------------------------------------------------------------------------------------------

    def _writer(self) -> Any:
        from .writer import Writer

        return Writer(self)

    def insert(self, rows: Any) -> int:
        return self._writer().insert(rows)[0]

    def insert_or_ignore(self, rows: Any) -> int:
        return self._writer().insert(rows, ignore=True)[0]

    def insert_get_id(self, row: dict[str, Any]) -> Any:
        return self._writer().insert(row)[1]

    def update(self, values: dict[str, Any]) -> int:
        return self._writer().update(values)

    def update_or_insert(self, attributes: dict[str, Any], values: Any = None) -> bool:
        there = self.clone().where(attributes)
        exists = there.exists()
        given = values(exists) if callable(values) else values or {}
        if exists:
            if given:
                there.limit(1).update(given)
        else:
            Builder(self._connection, self._query.table).insert({**attributes, **given})
        return True

    def upsert(self, rows: Any, unique_by: Any, update: Sequence[str] | None = None) -> int:
        return self._writer().upsert(rows, unique_by, update)

    def increment(self, column: str, amount: float = 1, extra: dict[str, Any] | None = None) -> int:
        return self._writer().step(column, amount, extra or {})

    def decrement(self, column: str, amount: float = 1, extra: dict[str, Any] | None = None) -> int:
        return self._writer().step(column, -amount if isinstance(amount, (int, float)) else amount, extra or {})

    def delete(self) -> int:
        return self._writer().delete()

    def truncate(self) -> None:
        self._writer().truncate()


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


for _name, _method in list(vars(Builder).items()):
    if not _name.startswith("_") and "_" in _name:
        setattr(Builder, _camel(_name), _method)
