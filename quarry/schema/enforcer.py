"""What a write stores for a value: coerced to the column's type, or refused."""

from __future__ import annotations

import json
import math
from datetime import date, datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ir
from ..exceptions import CheckConstraintViolationException, NotNullConstraintViolationException
from ..functions import literals, names
from ..functions.predicate import canonical

TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "decimal": T.LongType(), "boolean": T.BooleanType(),
    "date": T.TimestampNTZType(), "datetime": T.TimestampNTZType(), "json": T.StringType(), "enum": T.StringType(),
}
ABSENT = object()


def struct(schema: ir.TableSchema) -> T.StructType:
    return T.StructType([T.StructField(c.name, TYPES[c.type], True, {"type": c.type}) for c in schema.columns])


def text(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    if isinstance(value, (datetime, date)):
        at = literals.instant(value, "UTC")
        return at.isoformat(timespec="milliseconds") + "Z" if at else str(value)
    if isinstance(value, (dict, list, tuple)):
        return canonical(value)
    return str(value)


def coerced(value: Any, column: ir.ColumnSchema, table: str, tz: str, strict: bool) -> Any:
    """The stored form of a value. What can't be stored raises if ``strict``, else becomes null."""
    if value is None:
        return None
    kind = column.type

    def refused(why: str) -> Any:
        if strict:
            raise TypeError(f"Column [{column.name}] of table [{table}] can't store [{value!r}]: {why}.")
        return None

    if kind == "string":
        return text(value)
    if kind == "enum":
        out = text(value)
        if out in (column.values or ()):
            return out
        if strict:
            raise CheckConstraintViolationException(table, column.name, value, list(column.values or ()))
        return None
    if kind in ("integer", "decimal", "float"):
        if isinstance(value, str) and not value.strip():
            return None
        if isinstance(value, (list, dict, tuple)):
            return refused("it is no number")
        if kind != "float" and isinstance(value, int):
            return int(value)
        n = literals.number(value)
        if not math.isfinite(n):
            return refused("it is no finite number")
        if kind == "float":
            return n
        if not n.is_integer():
            return refused("it is no whole number" + (" of the smallest unit" if kind == "decimal" else "")) if strict else math.floor(n + 0.5)
        return int(n)
    if kind == "boolean":
        return literals.truthy(value)
    if kind in ("date", "datetime"):
        if isinstance(value, str) and not value.strip():
            return None
        at = literals.instant(value, tz)
        return refused("it is no time") if at is None else at
    if kind == "json":
        if isinstance(value, str):
            try:
                value = json.loads(value)
            except ValueError:
                return refused("it is no JSON text")
        return None if value is None else canonical(value)
    raise ValueError(kind)


def now() -> datetime:
    at = datetime.now(timezone.utc).replace(tzinfo=None)
    return at.replace(microsecond=at.microsecond // 1000 * 1000)


def record(row: dict[str, Any], schema: ir.TableSchema, tz: str, strict: bool, at: datetime) -> dict[str, Any]:
    """The stored form of a row to insert: defaults and timestamps filled in, every column coerced and checked."""
    out: dict[str, Any] = {}
    for c in schema.columns:
        given = row.get(c.name, ABSENT)
        if given is ABSENT and schema.timestamps and c.name in ("created_at", "updated_at"):
            given = at
        if given is ABSENT and c.has_default:
            given = c.default
        v = None if given is ABSENT else coerced(given, c, schema.table, tz, strict)
        if v is None and not c.nullable and not (c.increments and (given is ABSENT or given is None)):
            raise NotNullConstraintViolationException(schema.table, c.name)
        out[c.name] = v
    return out


def frame(df: DataFrame, schema: ir.TableSchema, tz: str, strict: bool, at: datetime) -> tuple[DataFrame, list[tuple[Column, Exception]]]:
    """The stored form of a DataFrame's rows, and conditions under which one is refused, each with its error."""
    given = {f.name: f.dataType for f in df.schema.fields}
    outputs: list[Column] = []
    faults: list[tuple[Column, Exception]] = []
    for c in schema.columns:
        if c.name not in given:
            stamp = schema.timestamps and c.name in ("created_at", "updated_at")
            value = literals.column(coerced(at if stamp else c.default, c, schema.table, tz, True) if stamp or c.has_default else None).cast(TYPES[c.type])
        else:
            held = F.col(names.quoted(c.name))
            value = _stored(held, given[c.name], c, tz)
            if strict and c.type == "enum":
                faults.append((held.isNotNull() & value.isNull(), CheckConstraintViolationException(schema.table, c.name, "a value of a DataFrame", list(c.values or ()))))
            elif strict:
                blank = isinstance(given[c.name], T.StringType) and c.type not in ("string", "json")
                present = held.isNotNull() & (F.btrim(held) != "") if blank else held.isNotNull() & (held != "null") if c.type == "json" and isinstance(given[c.name], T.StringType) else held.isNotNull()
                whole = F.lit(False)
                if c.type in ("integer", "decimal") and isinstance(given[c.name], (T.FloatType, T.DoubleType, T.DecimalType)):
                    whole = held != F.floor(held)
                faults.append((F.coalesce(present & (value.isNull() | whole), F.lit(False)), TypeError(f"Column [{c.name}] of table [{schema.table}] can't store a value of the DataFrame.")))
        if not c.nullable and not c.increments:
            faults.append((value.isNull(), NotNullConstraintViolationException(schema.table, c.name)))
        outputs.append(value.alias(c.name))
    stored = df.select(*outputs, *[x.alias(f"__f{i}") for i, (x, _) in enumerate(faults)])
    return stored, [(F.col(f"__f{i}"), e) for i, (_, e) in enumerate(faults)]


def _stored(held: Column, kind: T.DataType, c: ir.ColumnSchema, tz: str) -> Column:
    """A column of a DataFrame as the column of a table holds it; null for what can't be stored."""
    if c.type == "enum":
        return F.when(held.cast("string").isin(*(c.values or ())), held.cast("string"))
    if c.type == "json":
        value = F.to_json(F.try_parse_json(held) if isinstance(kind, T.StringType) else F.to_variant_object(held))
        return F.when(value != "null", value)
    if c.type in ("date", "datetime"):
        if isinstance(kind, T.TimestampType):
            out = F.convert_timezone(F.current_timezone(), F.lit("UTC"), held.cast("timestamp_ntz"))
        else:
            out = held.try_cast("timestamp_ntz")
            if tz.upper() not in ("UTC", "Z", "GMT") and not isinstance(kind, T.TimestampNTZType):
                out = F.convert_timezone(F.lit(str(literals.zone(tz)) if tz == "local" else tz), F.lit("UTC"), out)
        return F.timestamp_add("MICROSECOND", -F.pmod(F.timestamp_diff("MICROSECOND", literals.column(literals.EPOCH), out), F.lit(1000)), out)
    if c.type in ("integer", "decimal") and isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.floor(held + F.lit(0.5)).try_cast("long")
    if c.type == "float":
        out = held.try_cast("double")
        return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), out)
    return held.try_cast(TYPES[c.type])


def changes(values: dict[str, Any], schema: ir.TableSchema, tz: str, strict: bool) -> dict[str, Any]:
    """The stored form of the values of an update."""
    out: dict[str, Any] = {}
    for name, given in values.items():
        c = schema.column(name)
        assert c is not None
        v = coerced(given, c, schema.table, tz, strict)
        if v is None and not c.nullable:
            raise NotNullConstraintViolationException(schema.table, name)
        out[name] = v
    return out
