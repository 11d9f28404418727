"""Constraints lowered to boolean columns under three-valued logic.

Every lowering keeps Catalyst free to push it down: constants are converted first, days become half-open ranges, and
no expression casts a column where its own type will do.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import ir
from ..exceptions import SchemaException
from . import literals as lt

NUMBERS = ("integer", "decimal", "float")
INSTANTS = ("date", "datetime")
#: Kinds of JSON values in the order in which whole JSON columns compare.
RANKS = {"number": 1, "string": 2, "object": 3, "array": 4, "boolean": 5}


@dataclass(frozen=True)
class Ref:
    """A resolved column: its expression and the kind of its values.

    Kinds are the declared types, and ``variant`` for a value inside JSON, ``array`` and ``other`` for native columns.
    ``once`` says that the expression is a value computed before, which may be used freely.
    """

    expr: Column
    kind: str
    once: bool = False


Resolver = Callable[[str], Ref]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once a row, however often ``body`` uses it. No optimizer spells it out again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read_once(ref: Ref, body: Callable[[Ref], Column]) -> Column:
    """``body`` over a column; a value inside JSON is parsed and reached once."""
    return let(ref.expr, lambda v: body(Ref(v, "variant", True))) if ref.kind == "variant" and not ref.once else body(ref)


def let_all(values: list[Column], body: Callable[..., Column]) -> Column:
    """``let`` for several values, which ``body`` takes in their order."""
    return let(values[0], lambda v: let_all(values[1:], lambda *more: body(v, *more))) if values else body()


def unknown() -> Column:
    return F.lit(None).cast("boolean")


def compile_all(constraints: Iterable[ir.Constraint], resolve: Resolver, tz: str) -> Column | None:
    """AND binds tighter than OR: a flat list is split at its ORs. Empty groups add nothing."""
    groups: list[list[Column]] = [[]]
    for c in constraints:
        one = compile_one(c, resolve, tz)
        if one is None:
            continue
        if c.conjunction == "or" and groups[-1]:
            groups.append([])
        groups[-1].append(one)
    ands = [reduce(lambda a, b: a & b, g) for g in groups if g]
    return reduce(lambda a, b: a | b, ands) if ands else None


def reads(c: ir.Constraint) -> list[str]:
    """The columns that a constraint reads, each as often as it's named."""
    match c:
        case ir.Nested():
            return [x for one in c.constraints for x in reads(one)]
        case ir.Compared():
            return [c.first, c.second]
    return [c.column]


def compile_one(c: ir.Constraint, resolve: Resolver, tz: str) -> Column | None:
    out = _lowered(c, resolve, tz)
    return out if out is None or not c.negated else ~out


def _lowered(c: ir.Constraint, resolve: Resolver, tz: str) -> Column | None:
    match c:
        case ir.Nested():
            return compile_all(c.constraints, resolve, tz)
        case ir.Basic():
            return read_once(resolve(c.column), lambda r: compare(r, c.operator, c.value, tz))
        case ir.Like():
            return read_once(resolve(c.column), lambda r: like(r, c.pattern, c.case_sensitive))
        case ir.In():
            return read_once(resolve(c.column), lambda r: among(r, c.values, tz))
        case ir.Null():
            return read_once(resolve(c.column), absent)
        case ir.Between():
            return read_once(resolve(c.column), lambda r: compare(r, ">=", c.low, tz) & compare(r, "<=", c.high, tz))
        case ir.Compared():
            return read_once(resolve(c.first), lambda a: read_once(resolve(c.second), lambda b: columns(a, c.operator, b)))
        case ir.Day():
            return day(resolve(c.column), c.operator, c.value, tz)
        case ir.Part():
            return part(resolve(c.column), c.part, c.operator, c.value, tz)
        case ir.Time():
            return applied(time_of(resolve(c.column), tz), c.operator, F.lit(c.value))
        case ir.JsonContains():
            return contains(resolve(c.column), c.values)
        case ir.JsonLength():
            return let(length(resolve(c.column)), lambda n: compare(Ref(n, "integer"), c.operator, c.value, tz))
    raise TypeError(f"no lowering for {type(c).__name__}")


def applied(a: Column, operator: str, b: Column) -> Column:
    match operator:
        case "=" | "==" | "===":
            return a == b
        case "!=" | "<>" | "!==":
            return a != b
        case "<":
            return a < b
        case ">":
            return a > b
        case "<=":
            return a <= b
        case ">=":
            return a >= b
    raise ValueError(f"[{operator}] does not compare values")


def is_unequal(operator: str) -> bool:
    return operator in ("!=", "<>", "!==")


def constant(ref: Ref, value: bool) -> Column:
    """``value`` for present values, unknown for absent ones."""
    return F.when(~absent(ref), F.lit(value))


def absent(ref: Ref) -> Column:
    if ref.kind == "variant":
        return ref.expr.isNull() | F.coalesce(F.is_variant_null(ref.expr), F.lit(False))
    if ref.kind == "json":
        return ref.expr.isNull() | (ref.expr == "null")
    return ref.expr.isNull()


def js_number(text: Column) -> Column:
    """The number that a text stands for: 0 for blank ones, null for none."""
    t = F.btrim(text)
    out = F.when(t == "", F.lit(0.0)).when(t.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)$"), t.try_cast("double"))
    for base, digits in ((16, "[xX][0-9a-fA-F]"), (8, "[oO][0-7]"), (2, "[bB][01]")):
        out = out.when(t.rlike(f"^0{digits}+$"), _in_base(F.substr(t, F.lit(3)), base))
    return out


def _in_base(digits: Column, base: int) -> Column:
    """Whole numbers of any length, as doubles."""
    each = F.filter(F.split(digits, ""), lambda d: d != "")
    return F.aggregate(each, F.lit(0.0), lambda n, d: n * base + F.conv(d, 16, 10).cast("double"))


def epoch_millis(at: Column) -> Column:
    """Milliseconds since 1970 of a UTC wall clock."""
    return F.timestamp_diff("MICROSECOND", lt.column(lt.EPOCH), at) / F.lit(1000)


def same_kind(ref: Ref, value: Any) -> bool:
    if ref.kind in NUMBERS:
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if ref.kind in INSTANTS:
        return isinstance(value, (datetime, date))
    if ref.kind == "boolean":
        return isinstance(value, bool)
    return isinstance(value, str)


def compare(ref: Ref, operator: str, value: Any, tz: str) -> Column:
    """A column against a constant, converted to its type where it can be."""
    if operator in ("like", "not like"):
        out = like(ref, value, False)
        return ~out if operator == "not like" else out
    if value is None:
        return unknown()
    if ref.kind == "variant":
        return _loose_variant(ref, operator, value)
    if ref.kind == "json":
        return _by_kind(ref, operator, value)
    if ref.kind in ("array", "other"):
        return constant(ref, is_unequal(operator))
    if operator in ("===", "!==") and not same_kind(ref, value):
        return constant(ref, operator == "!==")
    if isinstance(value, float) and math.isnan(value):
        return constant(ref, is_unequal(operator))
    if ref.kind in NUMBERS:
        n = lt.number(value)
        if math.isnan(n):
            return constant(ref, is_unequal(operator))
        whole = n.is_integer() and abs(n) < 2**63
        exact = value if isinstance(value, int) and not isinstance(value, bool) else int(n) if whole else n
        if ref.kind == "float":
            return _no_nan(ref.expr, operator, float(exact)) if operator in (">", ">=") else applied(ref.expr, operator, F.lit(float(exact)))
        return applied(ref.expr, operator, F.lit(exact)) if -(2**63) <= exact < 2**63 else applied(ref.expr.cast("double"), operator, F.lit(float(exact)))
    if ref.kind in INSTANTS:
        at = lt.instant(value, tz)
        if at is not None:
            return applied(ref.expr, operator, lt.column(at))
        n = lt.number(value)
        return constant(ref, is_unequal(operator)) if math.isnan(n) else applied(epoch_millis(ref.expr), operator, F.lit(n))
    if ref.kind == "boolean":
        return applied(ref.expr.cast("int"), operator, F.lit(int(lt.truthy(value)))) if operator in ("<", ">", "<=", ">=") else applied(ref.expr, operator, F.lit(lt.truthy(value)))
    if isinstance(value, str):
        return applied(ref.expr, operator, F.lit(value))
    n = lt.number(value)
    if math.isnan(n):
        return constant(ref, is_unequal(operator))
    return F.when(ref.expr.isNull(), unknown()).otherwise(F.coalesce(applied(js_number(ref.expr), operator, F.lit(n)), F.lit(is_unequal(operator))))


def _no_nan(c: Column, operator: str, n: float) -> Column:
    """Spark holds NaN to be above all numbers; here it is above none."""
    return applied(c, operator, F.lit(n)) & ~F.isnan(c)


def like(ref: Ref, pattern: Any, case_sensitive: bool) -> Column:
    """Unknown for anything but texts."""
    text = ref.expr
    if ref.kind == "variant":
        text = F.when(kind_of(ref.expr) == "string", F.try_variant_get(ref.expr, "$", "string"))
    elif ref.kind == "json":
        text = let(F.try_parse_json(ref.expr), lambda v: F.when(kind_of(v) == "string", F.try_variant_get(v, "$", "string")))
    elif ref.kind != "string":
        return unknown()
    if not isinstance(pattern, str):
        return unknown()
    p = lt.like_pattern(pattern)
    return text.like(p) if case_sensitive else text.ilike(p)


def among(ref: Ref, values: tuple, tz: str) -> Column:
    """Unknown for absent values; a null in the list leaves misses unknown."""
    for v in values:
        if isinstance(v, (list, tuple, dict, set)):
            raise TypeError("a list to look in holds single values")
    given = [v for v in dict.fromkeys(values) if v is not None and not (isinstance(v, float) and math.isnan(v))]
    plain: list[Any] = []
    others: list[Column] = []
    for v in given:
        if ref.kind in NUMBERS and not math.isnan(n := lt.number(v)):
            plain.append(float(n) if ref.kind == "float" else v if isinstance(v, int) and not isinstance(v, bool) else int(n) if n.is_integer() else n)
        elif ref.kind in INSTANTS and (at := lt.instant(v, tz)) is not None:
            plain.append(at)
        elif ref.kind == "string" and isinstance(v, str):
            plain.append(v)
        elif ref.kind == "boolean":
            plain.append(lt.truthy(v))
        else:
            others.append(compare(ref, "=", v, tz))
    hits = list(others)
    if plain:
        hits.append(ref.expr.isin(*[lt.column(x) for x in dict.fromkeys(plain)]))
    hit = reduce(lambda a, b: a | b, hits) if hits else F.lit(False)
    if hits and None not in values and ref.kind not in ("variant", "json"):
        return hit  # unknown for null by itself, and pushed down
    return F.when(~absent(ref), F.when(hit, F.lit(True)).otherwise(unknown() if None in values else F.lit(False)))


def columns(a: Ref, operator: str, b: Ref) -> Column:
    """Two columns; numbers meet texts as numbers, instants as milliseconds, booleans as 0 and 1."""
    if operator in ("like", "not like"):
        out = unknown() if a.kind != "string" or b.kind != "string" else F.lower(a.expr).like(F.lower(b.expr))
        return ~out if operator == "not like" else out
    if a.kind == b.kind == "json" and operator not in ("<", ">", "<=", ">="):
        text = lambda r: F.when(~absent(r), F.coalesce(F.to_json(F.try_parse_json(r.expr)), r.expr))
        return applied(text(a), operator, text(b))
    if _family(a) == _family(b) and a.kind not in ("variant",):
        if a.kind == "boolean" and operator in ("<", ">", "<=", ">="):
            return applied(a.expr.cast("int"), operator, b.expr.cast("int"))
        return applied(a.expr, operator, b.expr)
    if operator in ("===", "!==") and "variant" not in (a.kind, b.kind):
        return F.when(~absent(a) & ~absent(b), F.lit(operator == "!=="))
    if a.kind == "variant" and b.kind == "variant":
        return F.when(~absent(a) & ~absent(b), let(kind_of(a.expr), lambda j: let(kind_of(b.expr), lambda k: _two_variants(a, j, operator, b, k))))
    if "variant" in (a.kind, b.kind) and "string" in (a.kind, b.kind):
        text = lambda r: F.try_variant_get(r.expr, "$", "string") if r.kind == "variant" else r.expr
        inner = a if a.kind == "variant" else b
        return F.when(absent(a) | absent(b), unknown()).when(kind_of(inner.expr) == "string", applied(text(a), operator, text(b))).otherwise(F.coalesce(applied(as_number(a), operator, as_number(b)), F.lit(is_unequal(operator))))
    return F.when(absent(a) | absent(b), unknown()).otherwise(F.coalesce(applied(as_number(a), operator, as_number(b)), F.lit(is_unequal(operator))))


def _family(ref: Ref) -> str:
    return "number" if ref.kind in NUMBERS else "instant" if ref.kind in INSTANTS else ref.kind


def joined(a: Ref, operator: str, b: Ref) -> Column:
    """Two columns as a condition of a join. It keeps unknown pairs no more than false ones, so an equality has the form
    that Spark joins by: an expression of each side."""
    kinds = (a.kind, b.kind)
    if operator not in ("=", "==", "==="):
        return columns(a, operator, b)
    if "variant" in kinds and (a.kind == b.kind or "string" in kinds):
        return (_meeting(a) == _meeting(b)) & columns(a, operator, b)
    if _family(a) == _family(b):
        return columns(a, operator, b)
    if operator == "===" and "variant" not in kinds:
        return F.lit(False)
    return as_number(a) == as_number(b)


def _meeting(ref: Ref) -> Column:
    """A text that values inside JSON, or one and a text, have in common if they are equal: the number that a value stands
    for, else the value."""
    named = lambda n, text: F.coalesce(F.concat(F.lit("n"), F.when(n == 0, F.lit(0.0)).otherwise(n).cast("string")), F.concat(F.lit("t"), text))
    if ref.kind == "string":
        return named(js_number(ref.expr), ref.expr)
    text = lambda v, k: F.when(k == "string", F.try_variant_get(v, "$", "string")).when(k.isin("array", "object"), F.to_json(v))
    return let(ref.expr, lambda v: let(kind_of(v), lambda k: let(_number_of(v, k), lambda n: named(n, text(v, k)))))


def _two_variants(a: Ref, j: Column, operator: str, b: Ref, k: Column) -> Column:
    """Two values inside JSON of kinds ``j`` and ``k``. Arrays and objects are equal by content; only plain arrays have an
    order, above numbers and texts."""
    loose = F.coalesce(applied(_number_of(a.expr, j), operator, _number_of(b.expr, k)), F.lit(is_unequal(operator)))
    texts = applied(F.try_variant_get(a.expr, "$", "string"), operator, F.try_variant_get(b.expr, "$", "string"))
    both = j.isin("array", "object") & k.isin("array", "object")
    if operator in ("<", ">", "<=", ">="):
        ordered = lambda v, x: x.isin("number", "string") | _plain(v, x, DEPTH)
        structured = F.when(ordered(a.expr, j) & ordered(b.expr, k), applied(order_key(a), operator, order_key(b)))
    else:
        structured = (both & (F.to_json(a.expr) == F.to_json(b.expr))) == F.lit(not is_unequal(operator))
        if operator in ("===", "!=="):
            loose = F.when(j == k, loose).otherwise(F.lit(operator == "!=="))
    return F.when(j.isin("array", "object") | k.isin("array", "object"), structured).when((j == k) & (j == "string"), texts).otherwise(loose)


def as_number(ref: Ref) -> Column:
    """The number that a value stands for, or null."""
    if ref.kind in NUMBERS:
        return ref.expr.cast("double")
    if ref.kind in INSTANTS:
        return epoch_millis(ref.expr).cast("double")
    if ref.kind == "boolean":
        return ref.expr.cast("double")
    if ref.kind == "string":
        return js_number(ref.expr)
    if ref.kind in ("variant", "json"):
        v = ref.expr if ref.kind == "variant" else F.try_parse_json(ref.expr)
        return let(v, lambda x: let(kind_of(x), lambda k: _number_of(x, k)))
    return F.lit(None).cast("double")


def _number_of(v: Column, k: Column) -> Column:
    """The number that a value of kind ``k`` inside JSON stands for, or null."""
    return F.when(k == "string", js_number(F.try_variant_get(v, "$", "string"))).when(k == "boolean", F.try_variant_get(v, "$", "boolean").cast("double")).when(k == "number", F.try_variant_get(v, "$", "double"))


# --- days and times ------------------------------------------------------------------------------------------------


def _instants_only(ref: Ref) -> bool:
    return ref.kind in INSTANTS


def day(ref: Ref, operator: str, value: Any, tz: str) -> Column:
    """Whole days in the connection's zone, as ranges that Parquet statistics can use."""
    if value is None:
        return unknown()
    at = lt.instant(value, tz)
    if at is None or not _instants_only(ref):
        return constant(ref, False) if _instants_only(ref) or ref.kind == "string" else unknown()
    local = at.replace(tzinfo=lt.zone("UTC")).astimezone(lt.zone(tz))
    midnight = datetime(local.year, local.month, local.day)
    begin, end = (lt.column(lt.to_utc(d, tz)) for d in (midnight, midnight + timedelta(days=1)))
    c = ref.expr
    match operator:
        case "=":
            return (c >= begin) & (c < end)
        case "!=" | "<>":
            return (c < begin) | (c >= end)
        case "<":
            return c < begin
        case "<=":
            return c < end
        case ">":
            return c >= end
        case ">=":
            return c >= begin
    raise ValueError(f"[{operator}] does not compare days")


def wall_clock(ref: Ref, tz: str) -> Column:
    zone = "UTC" if tz.upper() in ("UTC", "Z", "GMT") else str(lt.zone(tz)) if tz == "local" else tz
    return ref.expr if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), ref.expr)


def part(ref: Ref, which: str, operator: str, value: Any, tz: str) -> Column:
    if isinstance(value, str):
        if not value.strip().lstrip("+-").isdigit():
            raise SchemaException(f"A {which} is a whole number, not [{value}].")
        value = int(value)
    if value is None or not _instants_only(ref):
        return unknown()
    take = {"year": F.year, "month": F.month, "day": F.dayofmonth}[which]
    return applied(take(wall_clock(ref, tz)), operator, F.lit(value))


def time_of(ref: Ref, tz: str) -> Column:
    if not _instants_only(ref):
        return F.lit(None).cast("string")
    return F.date_format(wall_clock(ref, tz), "HH:mm:ss")


# --- JSON ----------------------------------------------------------------------------------------------------------


def kind_of(v: Column) -> Column:
    def named(s: Column) -> Column:
        return F.when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("number")

    return let(F.schema_of_variant(v), named)


def _loose_variant(ref: Ref, operator: str, value: Any) -> Column:
    """A value inside JSON against a constant: as texts if both are, else as numbers."""
    if isinstance(value, (datetime, date)):
        value = millis_of(value)
    n = lt.number(value)
    structured = F.lit(False) if operator in ("=", "==") else F.lit(True) if is_unequal(operator) else unknown()
    if operator in ("<", ">", "<=", ">=") and not isinstance(value, bool) and not (isinstance(value, float) and math.isnan(value)):
        structured = F.when(_plain(ref.expr, kind_of(ref.expr), DEPTH), F.lit(operator in (">", ">=")))  # above all numbers and texts
    want = "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"

    def against(k: Column) -> Column:
        if operator in ("===", "!=="):
            return F.when(k == want, _loose_variant(ref, "=" if operator == "===" else "!=", value)).otherwise(F.lit(operator == "!=="))
        numeric = F.lit(is_unequal(operator)) if math.isnan(n) else F.coalesce(applied(_number_of(ref.expr, k), operator, F.lit(n)), F.lit(is_unequal(operator)))
        out = F.when(k.isin("object", "array"), structured)
        if isinstance(value, str):
            out = out.when(k == "string", applied(F.try_variant_get(ref.expr, "$", "string"), operator, F.lit(value)))
        return out.otherwise(numeric)

    return F.when(~absent(ref), let(kind_of(ref.expr), against))


def millis_of(value: datetime | date) -> float:
    at = lt.instant(value, "UTC")
    assert at is not None
    return lt.millis(at)


def _by_kind(ref: Ref, operator: str, value: Any) -> Column:
    """A whole JSON value against a constant: kinds first, values within a kind."""
    if isinstance(value, (dict, list)):
        return F.when(absent(ref), unknown()).otherwise(applied(ref.expr, operator, F.lit(canonical(value)))) if operator in ("=", "==", "===", "!=", "<>", "!==") else unknown()
    want = "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
    plain = "=" if operator in ("==", "===") else "!=" if operator in ("<>", "!==") else operator

    def against(v: Column, k: Column) -> Column:
        rank = reduce(lambda out, kv: out.when(k == kv[0], kv[1]), list(RANKS.items())[1:], F.when(k == "number", 1))
        return F.when(k == want, _loose_variant(Ref(v, "variant"), plain, value)).otherwise(applied(rank, plain, F.lit(RANKS[want])))

    return F.when(absent(ref), unknown()).otherwise(let(F.try_parse_json(ref.expr), lambda v: let(kind_of(v), lambda k: against(v, k))))


def canonical(value: Any) -> str:
    """One text for all JSON values that are equal: keys in order, no blanks, whole numbers without a fraction."""
    import json

    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in sorted(x.items(), key=lambda kv: str(kv[0]))}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        if isinstance(x, float):
            return None if not math.isfinite(x) else int(x) if x.is_integer() and abs(x) < 1e15 else x
        if isinstance(x, (datetime, date)):
            at = lt.instant(x, "UTC")
            return at.isoformat(timespec="milliseconds") + "Z" if at else None
        return x

    return json.dumps(plain(value), separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def as_array(ref: Ref) -> tuple[Column, str]:
    """The elements of an array and whether they are variants; null for anything else."""
    if ref.kind == "array":
        return ref.expr, "native"
    v = F.try_parse_json(ref.expr) if ref.kind == "json" else ref.expr
    if ref.kind not in ("json", "variant"):
        return F.lit(None).cast("array<variant>"), "variant"
    return let(v, lambda x: F.when(kind_of(x) == "array", F.try_variant_get(x, "$", "array<variant>"))), "variant"


def contains(ref: Ref, values: tuple) -> Column:
    """Whether an array holds every one of the values, by kind and value; unknown for anything but arrays."""
    array, how = as_array(ref)

    def held(a: Column) -> Column:
        hits = [F.lit(True)]
        for value in values:
            if how == "native":
                hits.append(F.coalesce(F.array_contains(a, value), F.lit(False)) if value is not None and not isinstance(value, (dict, list)) else F.exists(a, lambda e: e.isNull()) if value is None else F.lit(False))
            elif value is None:
                hits.append(F.exists(a, lambda e: e.isNull() | F.coalesce(F.is_variant_null(e), F.lit(False))))
            elif isinstance(value, bool):
                hits.append(_holds(a, "boolean", "boolean", value))
            elif isinstance(value, (int, float)):
                hits.append(_holds(a, "number", "double", float(value)))
            elif isinstance(value, str):
                hits.append(_holds(a, "string", "string", value))
            else:
                hits.append(F.lit(False))
        return F.when(a.isNotNull(), reduce(lambda x, y: x & y, hits))

    return let(array, held)


def _holds(array: Column, kind: str, cast: str, value: Any) -> Column:
    def same(e: Column) -> Column:
        return F.when(F.try_variant_get(e, "$", cast) == F.lit(value), kind_of(e) == kind).otherwise(F.lit(False))

    return F.exists(array, same)


def length(ref: Ref) -> Column:
    return let(as_array(ref)[0], lambda a: F.when(a.isNotNull(), F.size(a)))


# --- order ---------------------------------------------------------------------------------------------------------

#: Ranks of kinds of JSON values in an order; arrays of numbers, texts and such arrays come before booleans.
ABSENT, NUMBER, TEXT, PLAIN_ARRAY, BOOLEAN, ARRAY, OBJECT = range(7)
#: Arrays within arrays are told apart to this depth in an order.
DEPTH = 3


def order_key(ref: Ref) -> Column:
    """What a column is ordered by: itself, or of a JSON value its rank, number, text and elements, in this order.

    Absent values come first, then numbers, texts, arrays that hold only such values, false, true and other arrays,
    arrays element by element. Objects tie.
    """
    if ref.kind == "variant":
        return _json_key(ref.expr, DEPTH)
    return _json_key(F.try_parse_json(ref.expr), DEPTH) if ref.kind == "json" else ref.expr


def is_object(ref: Ref) -> Column:
    """Whether a JSON value is an object."""
    return kind_of(ref.expr if ref.kind == "variant" else F.try_parse_json(ref.expr)) == "object"


def _json_key(v: Column, depth: int) -> Column:
    def key(x: Column, k: Column) -> Column:
        plain = _plain(x, k, depth)
        rank = F.when(x.isNull() | (k == "null"), ABSENT).when(k == "number", NUMBER).when(k == "string", TEXT).when(plain, PLAIN_ARRAY).when(k == "boolean", BOOLEAN).when(k == "array", ARRAY).otherwise(OBJECT)
        number = F.when(k == "number", F.try_variant_get(x, "$", "double")).when(k == "boolean", F.try_variant_get(x, "$", "boolean").cast("double"))
        parts = [rank.alias("rank"), number.alias("number"), F.when(k == "string", F.try_variant_get(x, "$", "string")).alias("text")]
        if depth:
            parts.append(F.when(k == "array", F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda e: _json_key(e, depth - 1))).alias("elements"))
        return F.struct(*parts)

    return let(v, lambda x: let(kind_of(x), lambda k: key(x, k)))


def _plain(v: Column, k: Column, depth: int) -> Column:
    """Whether an array holds but numbers, texts and such arrays."""

    def fits(e: Column) -> Column:
        return let(kind_of(e), lambda x: e.isNotNull() & (x.isin("number", "string") | (_plain(e, x, depth - 1) if depth else F.lit(False))))

    return (k == "array") & F.coalesce(F.forall(F.try_variant_get(v, "$", "array<variant>"), fits), F.lit(False))
