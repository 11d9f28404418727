"""Queries lowered to DataFrames: filter, distinct, sort, page, project.

Nothing is scheduled by hand. Joins are equi-joins wherever a condition allows it, so Catalyst picks their strategy
and AQE splits skew; predicates stay sargable; columns that nobody reads are pruned by the optimizer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from types import MappingProxyType
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ir
from ..exceptions import SchemaException
from ..functions import names, predicate
from ..functions.predicate import Ref

HIDDEN = "__key"


@dataclass(frozen=True)
class Source:
    """A table that queries read: its schema, and its rows. ``key`` orders rows that nothing else orders."""

    name: str
    schema: ir.TableSchema
    frame: Callable[[], DataFrame]
    key: tuple[str, ...] = ()


def kind_of_type(t: T.DataType) -> str:
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(t, T.ArrayType):
        return "array"
    return "variant" if isinstance(t, T.VariantType) else "other"


def schema_of(name: str, df: DataFrame, key: tuple[str, ...] = (), json: tuple[str, ...] = ()) -> ir.TableSchema:
    """The schema of a DataFrame that comes from elsewhere; texts in ``json`` hold JSON."""
    kinds = {"array": "json", "variant": "json", "other": "json"}
    columns = tuple(ir.ColumnSchema(f.name, "json" if f.name in json else kinds.get(k := kind_of_type(f.dataType), k), nullable=True) for f in df.schema)
    return ir.TableSchema(name, columns, key[0] if len(key) == 1 else None)


class Scope:
    """The tables that a query reads, their columns, and how a name resolves to an expression."""

    def __init__(self, sources: list[Source]):
        self.sources = sources
        self.joined = len(sources) > 1
        if len({s.name for s in sources}) < len(sources):
            raise SchemaException("A table can be joined once, as tables have no aliases.")
        self.frames, self.kinds = {}, {}
        for s in sources:
            df = s.frame()
            # Instants become UTC wall clocks, so that no session zone has a say.
            declared = {c.name: c.type for c in s.schema.columns}
            kinds = {}
            outputs = []
            for f in df.schema:
                kind = kind_of_type(f.dataType)
                want = declared.get(f.name)
                if want in ("json", "decimal", "date") and kind not in ("array", "variant", "other"):
                    kind = want
                c = F.col(names.quoted(f.name))
                if isinstance(f.dataType, T.TimestampType):
                    c = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
                elif isinstance(f.dataType, T.DateType):
                    c = c.cast("timestamp_ntz")
                kinds[f.name] = kind
                outputs.append(c.alias(self.physical(s.name, f.name)))
            changed = self.joined or any(isinstance(f.dataType, (T.TimestampType, T.DateType)) for f in df.schema)
            self.frames[s.name] = df.select(*outputs) if changed else df
            self.kinds[s.name] = kinds

    def physical(self, table: str, column: str) -> str:
        return f"{table}.{column}" if self.joined else column

    def visible(self, table: str) -> list[str]:
        return [c for c in self.kinds[table] if c != HIDDEN]

    def owner(self, name: names.Name) -> str:
        if name.table is not None:
            if name.table not in self.kinds:
                raise SchemaException(f"This query doesn't read table [{name.table}].")
            if name.column not in self.kinds[name.table]:
                raise SchemaException(f"Table [{name.table}] has no column [{name.column}].")
            return name.table
        owners = [t for t in self.kinds if name.column in self.visible(t)]
        if len(owners) > 1:
            raise SchemaException(f"Column [{name.column}] could be of {' or '.join(owners)}; name its table.")
        if not owners:
            raise SchemaException(f"No table of this query has a column [{name.column}].")
        return owners[0]

    def inside(self, text: str) -> tuple[str, tuple[str, ...]] | None:
        """The column and the steps of a path into JSON."""
        name = names.parse(text)
        table = self.owner(name)
        return (self.physical(table, name.column), name.steps) if name.steps and self.kinds[table][name.column] != "other" else None

    def document(self, column: str) -> Column:
        """A column of JSON, parsed."""
        kind = next(k[c] for t, k in self.kinds.items() for c in k if self.physical(t, c) == column)
        c = F.col(names.quoted(column))
        return F.try_parse_json(c) if kind in ("json", "string") else c

    def resolve(self, text: str, read: Mapping[tuple[str, tuple[str, ...]], Column] = MappingProxyType({})) -> Ref:
        """A column by its name; ``read`` has documents (under no steps) and paths that were read before."""
        name = names.parse(text)
        table = self.owner(name)
        kind = self.kinds[table][name.column]
        c = F.col(names.quoted(self.physical(table, name.column)))
        if not name.steps:
            return Ref(c, kind)
        if kind == "other":  # a native struct
            for s in name.steps:
                c = c.getField(s)
            return Ref(c, "string")
        column = self.physical(table, name.column)
        if (column, name.steps) in read:
            return Ref(read[column, name.steps], "variant", True)
        v = read[column, ()] if (column, ()) in read else self.document(column)
        return Ref(F.try_variant_get(v, names.json_path(name.steps), "variant"), "variant")

    def keys(self) -> list[Column]:
        """What orders rows that nothing else orders."""
        return [F.col(names.quoted(self.physical(s.name, k))) for s in self.sources for k in (s.key or ((HIDDEN,) if HIDDEN in self.kinds[s.name] else ()))]


def sorted_by(ref: Ref, descending: bool) -> list[Column]:
    """Absent values first; in JSON as ``predicate.order_key`` says."""
    c = predicate.order_key(ref)
    return [c.desc_nulls_last() if descending else c.asc_nulls_first()]


def output(ref: Ref) -> Column:
    """A column as a result: values inside JSON come as JSON text."""
    return F.to_json(ref.expr) if ref.kind == "variant" else ref.expr


def same(ref: Ref) -> Column:
    """A column as rows are told apart by it: equal JSON values have one text, whatever the order of their keys."""
    return F.coalesce(F.to_json(F.try_parse_json(ref.expr)), ref.expr) if ref.kind == "json" else output(ref)


class Compiled:
    """A query over its scope, up to the point that the caller needs."""

    def __init__(self, query: ir.Query, sources: Mapping[str, Source], tz: str):
        self.query, self.tz = query, tz
        self.scope = Scope([sources[query.table], *[sources[j.table] for j in query.joins]])
        self._matched: DataFrame | None = None

    def matched(self) -> DataFrame:
        """Rows that satisfy the constraints, with all columns."""
        if self._matched is None:
            df = self.scope.frames[self.query.table]
            for j in self.query.joins:
                df = self._joined(df, j)
            condition = self.condition()
            self._matched = df if condition is None else df.where(condition)
        return self._matched

    def condition(self) -> Column | None:
        """All constraints. Those that read the same JSON read it together; the others stay apart, to be pushed down."""
        every = self.query.constraints
        if any(c.conjunction == "or" for c in every[1:]):
            return self._reading_once(every)
        alike: dict[Any, list[ir.Constraint]] = {}
        for i, c in enumerate(every):
            documents = frozenset(p[0] for x in predicate.reads(c) if (p := self.scope.inside(x)))
            tables = frozenset(self.scope.owner(names.parse(x)) for x in predicate.reads(c))
            alike.setdefault((documents, tables) if documents else i, []).append(c)
        parts = [one for group in alike.values() if (one := self._reading_once(group)) is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None

    def _reading_once(self, constraints: Sequence[ir.Constraint]) -> Column | None:
        """Constraints as a condition. A JSON column, which may stand for a long expression, is parsed once a row, however
        many paths lead into it, and a path is reached once."""
        paths = Counter(p for c in constraints for x in predicate.reads(c) if (p := self.scope.inside(x)))
        documents = [d for d, n in Counter(d for d, _ in paths.elements()).items() if n > 1]
        shared = [p for p, n in paths.items() if n > 1]

        def over(*parsed: Column) -> Column | None:
            read = {(d, ()): v for d, v in zip(documents, parsed, strict=True)}
            values = [F.try_variant_get(read[d, ()], names.json_path(steps), "variant") for d, steps in shared]
            return predicate.let_all(values, lambda *found: predicate.compile_all(constraints, lambda x: self.scope.resolve(x, read | dict(zip(shared, found, strict=True))), self.tz))

        return predicate.let_all([self.scope.document(d) for d in documents], over)

    def _joined(self, df: DataFrame, j: ir.JoinClause) -> DataFrame:
        other = self.scope.frames[j.table]
        if j.kind == "cross":
            return df.crossJoin(other)
        if not j.conditions:
            raise SchemaException(f"The join of [{j.table}] has no condition.")
        groups: list[list[Column]] = [[]]
        for on in j.conditions:
            if on.conjunction == "or" and groups[-1]:
                groups.append([])
            groups[-1].append(predicate.joined(self._operand(on.first), on.operator, self._operand(on.second)))
        condition = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, g) for g in groups])
        return df.join(other, condition, {"inner": "inner", "left": "left", "right": "right"}[j.kind])

    def _operand(self, text: str) -> Ref:
        """Operands of a join are qualified; a bare name matches nothing."""
        return self.scope.resolve(text) if names.parse(text).table else Ref(F.lit(None).cast("string"), "string")

    def projection(self) -> dict[str, Ref]:
        """Result names in order; of equal names the last value stands at the first place."""
        out: dict[str, Ref] = {}
        if self.query.columns:
            for text in self.query.columns:
                source, alias = names.projected(text)
                out[alias] = self.scope.resolve(source)
            return out
        for s in self.scope.sources:
            for c in self.scope.visible(s.name):
                out[c] = Ref(F.col(names.quoted(self.scope.physical(s.name, c))), self.scope.kinds[s.name][c])
        return out

    def kinds(self) -> dict[str, str]:
        return {k: "json" if r.kind == "variant" else r.kind for k, r in self.projection().items()}

    def _orders(self, rows_needed_in_order: bool) -> list[Column]:
        if self.query.random:
            return [F.rand()]
        orders = [c for o in self.query.orders for c in sorted_by(self.scope.resolve(o.column), o.descending)]
        if orders or rows_needed_in_order or self.query.limit is not None or self.query.offset:
            orders += [k.asc_nulls_first() for k in self.scope.keys()]
        return orders

    def rows(self, in_order: bool = False) -> DataFrame:
        """Sorted, distinct and paged rows, projected."""
        q, df = self.query, self.matched()
        wanted = self.projection()
        outputs = [output(r).alias(a) for a, r in wanted.items()]
        unique = q.distinct and (q.columns or not self.scope.keys() or self.scope.joined)
        if unique:
            if q.orders or ((in_order or q.limit is not None or q.offset) and (q.random or self.scope.keys())):
                # Of rows that are alike in the result, the first in order stands.
                values = [(predicate.order_key(self.scope.resolve(o.column)), o.descending) for o in q.orders] + [(k, False) for k in self.scope.keys()]
                flat = df.select(*[same(r).alias(f"__o{i}") for i, r in enumerate(wanted.values())], *[c.alias(f"__s{i}") for i, (c, _) in enumerate(values)])
                sorts = [F.col(f"__s{i}").desc_nulls_last() if descending else F.col(f"__s{i}").asc_nulls_first() for i, (_, descending) in enumerate(values)] or [F.rand()]
                first = flat.withColumn("__n", F.row_number().over(W.partitionBy(*[f"__o{i}" for i in range(len(wanted))]).orderBy(*sorts))).where("__n = 1")
                return self._paged(first.orderBy(*([F.rand()] if q.random else sorts))).select(*[F.col(f"__o{i}").alias(a) for i, a in enumerate(wanted)])
            return self._paged(df.select(*[same(r).alias(a) for a, r in wanted.items()]).distinct())
        orders = self._orders(in_order)
        if orders:
            df = df.orderBy(*orders)
        return self._paged(df).select(*outputs)

    def _paged(self, df: DataFrame) -> DataFrame:
        if self.query.offset:
            df = df.offset(self.query.offset)
        return df if self.query.limit is None else df.limit(self.query.limit)


def access(query: ir.Query, source: Source) -> str:
    """What would serve the query: ``join``, ``key``, ``index:<name>`` or ``scan``."""
    if query.joins:
        return "join"
    if any(c.conjunction == "or" for c in query.constraints[1:]):
        return "scan"
    schema = source.schema

    def usable(c: ir.Constraint) -> str | None:
        if c.negated or "->" in getattr(c, "column", "->"):
            return None
        if isinstance(c, (ir.In, ir.Between, ir.Day)) or (isinstance(c, ir.Basic) and c.operator in ("=", "==", "===", "<", ">", "<=", ">=")):
            return names.parse(c.column).column
        return None

    reached = [c for c in map(usable, query.constraints) if c]
    if schema.key in reached:
        return "key"
    for unique in (True, False):
        for index in schema.indexes:
            if index.unique == unique and not index.multi_entry and index.columns[0] in reached:
                return f"index:{index.name}"
    for c in query.constraints:
        if isinstance(c, ir.JsonContains) and not c.negated and len(c.values) == 1:
            for index in schema.indexes:
                if index.multi_entry and index.columns == (c.column,):
                    return f"index:{index.name}"
    if query.orders and not query.random:
        first = names.parse(query.orders[0].column).column
        if first == schema.key:
            return "key"
        for index in schema.indexes:
            if len(query.orders) == 1 and index.columns == (first,) and not index.multi_entry and schema.column(first) is not None and not schema.column(first).nullable:
                return f"index:{index.name}"
    return "scan"
