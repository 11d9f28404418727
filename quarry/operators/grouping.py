"""Grouped aggregates: hash aggregation with partial sums before the shuffle, then having, order and paging."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ir
from ..exceptions import SchemaException
from ..functions import literals, names, predicate
from ..functions.predicate import Ref
from ..plans.compile import Compiled, output, same, sorted_by
from .rows import decoded

if TYPE_CHECKING:
    from .builder import Builder

FUNCTIONS = ("count", "sum", "avg", "min", "max")


def extreme(function: str, ref: Ref, keys: list[Column]) -> Column:
    """The least or greatest JSON value in the order of ``order_by``. Objects tie: the first row's stands for them."""
    present, out = ~predicate.absent(ref), output(ref)
    pairs = F.when(present, F.struct(predicate.order_key(ref).alias("key"), out.alias("value")))
    best = (F.min if function == "min" else F.max)(pairs)
    if not keys:
        return best["value"]
    is_object = present & predicate.is_object(ref)
    first = F.min_by(F.when(is_object, out), F.when(is_object, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])))
    return F.when(best["key"]["rank"] == predicate.OBJECT, first).otherwise(best["value"])


def aggregate(function: str, ref: Ref | None, distinct: bool = False, keys: list[Column] | None = None) -> Column:
    """An aggregate of present values: the sum of none is 0, the other functions of none are null."""
    if ref is None:
        return F.count(F.lit(1))
    if function == "count":
        return F.count(F.when(~predicate.absent(ref), F.lit(1)))
    if function in ("sum", "avg"):
        n = ref.expr if ref.kind in predicate.NUMBERS else predicate.as_number(ref)
        if function == "avg":
            return F.avg_distinct(n) if hasattr(F, "avg_distinct") and distinct else F.avg(n)
        zero = F.lit(0) if ref.kind in ("integer", "decimal") else F.lit(0.0)
        return F.coalesce(F.sum_distinct(n) if distinct else F.sum(n), zero)
    if ref.kind in ("variant", "json"):
        return extreme(function, ref, keys or [])
    return {"min": F.min, "max": F.max}[function](ref.expr)


class Grouping:
    def __init__(self, builder: Builder, columns: tuple[str, ...]):
        self._builder, self._columns = builder, columns
        self._aggregates: dict[str, tuple[str, str]] = {}
        self._having: list[ir.Constraint] = []
        self._orders: list[ir.Order] = []
        self._limit: int | None = None
        self._offset = 0

    def aggregate(self, aggregates: Mapping[str, Mapping[str, str]]) -> Grouping:
        """Named aggregates: ``{"total": {"sum": "price"}, "n": {"count": "*"}}``. Another call replaces them."""
        out = {}
        for alias, spec in aggregates.items():
            ((function, column),) = spec.items()
            if function not in FUNCTIONS:
                raise SchemaException(f"There is no aggregate [{function}].")
            out[alias] = (function, column)
        self._aggregates = out
        return self

    def having(self, column: str, *args: Any) -> Grouping:
        return self._have(column, args, "and")

    def or_having(self, column: str, *args: Any) -> Grouping:
        return self._have(column, args, "or")

    def _have(self, column: str, args: tuple, conjunction: str) -> Grouping:
        operator, value = ("=", args[0]) if len(args) == 1 else args
        self._having.append(ir.Basic(conjunction, False, column, ir.one_of(operator), literals.flattened(value)))
        return self

    def order_by(self, column: str, direction: str = "asc") -> Grouping:
        self._orders.append(ir.Order(column, direction.lower() == "desc"))
        return self

    def limit(self, n: float) -> Grouping:
        if isinstance(n, (int, float)) and math.isfinite(n) and n >= 0:
            self._limit = int(n)
        return self

    take = limit

    def offset(self, n: float) -> Grouping:
        self._offset = int(n) if isinstance(n, (int, float)) and math.isfinite(n) and n > 0 else 0
        return self

    skip = offset

    def _built(self, in_order: bool) -> tuple[DataFrame, dict[str, str]]:
        compiled: Compiled = self._builder._compiled(bare=True)
        scope, df = compiled.scope, compiled.matched()
        aliases = {a: c for c, a in map(names.projected, self._builder._query.columns)}
        groups: dict[str, Ref] = {}
        spoken: dict[str, str] = {}
        for text in self._columns:
            source, alias = names.projected(text)
            known = not names.parse(source).table and any(source in scope.visible(s.name) for s in scope.sources)
            if source in aliases and not known:
                source, alias = aliases[source], source
            ref = scope.resolve(source)
            groups[alias] = ref
            spoken[text] = spoken[source] = spoken[alias] = alias
        keys = [same(r).alias(a) for a, r in groups.items()]
        outputs = {a: aggregate(f, None if c == "*" else scope.resolve(c), keys=scope.keys()) for a, (f, c) in self._aggregates.items()}
        first = scope.keys()
        ordered = in_order and not self._orders and first
        hidden = [F.min(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(first)])).alias("__first")] if ordered else []
        total = [F.count(F.lit(1)).alias("__rows")] if not keys else []
        aggs = [c.alias(a) for a, c in outputs.items()] + hidden + total
        out = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
        if not keys:
            out = out.where("__rows > 0").drop("__rows")
        kinds = {a: "json" if r.kind == "variant" else r.kind for a, r in groups.items()}
        for a, (f, c) in self._aggregates.items():
            kind = None if c == "*" else scope.resolve(c).kind
            kinds[a] = "integer" if f == "count" or (f == "sum" and kind in ("integer", "decimal")) else "float" if f in ("sum", "avg") else "json" if kind == "variant" else kind or "string"

        def resolve(text: str) -> Ref:
            name = text if text in kinds else spoken.get(text)
            if name is None:
                return Ref(F.lit(None).cast("string"), "string")
            return Ref(F.col(names.quoted(name)), kinds[name])

        condition = predicate.compile_all(self._having, resolve, self._builder._tz)
        if condition is not None:
            out = out.where(condition)
        orders = [c for o in self._orders for c in sorted_by(resolve(o.column), o.descending)]
        if orders:  # groups are told apart by their names, which so settle ties
            orders += [F.col(names.quoted(a)).asc_nulls_first() for a in groups if kinds[a] not in ("other", "array")]
        elif ordered:
            orders = [F.col("__first")]
        if orders:
            out = out.orderBy(*orders)
        if self._offset:
            out = out.offset(self._offset)
        if self._limit is not None:
            out = out.limit(self._limit)
        return out.drop("__first"), kinds

    def to_df(self) -> DataFrame:
        return self._built(False)[0]

    def get(self) -> list[dict[str, Any]]:
        df, kinds = self._built(True)
        return self._builder._timed(lambda: [decoded(r, kinds) for r in df.collect()], len)

    def first(self) -> dict[str, Any] | None:
        kept, self._limit = self._limit, 1 if self._limit is None else min(1, self._limit)
        try:
            return next(iter(self.get()), None)
        finally:
            self._limit = kept

    def count(self) -> int:
        """Groups after having and paging."""
        return self.to_df().count()

    orHaving, orderBy, toDf = or_having, order_by, to_df


GroupFunction = Callable[[Grouping], Any]
