"""Changes of the schema, inside migrations, and questions about it anywhere.

A change of a table reads and writes it once at most: values that a default fills are part of the same pass.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import ir
from ..exceptions import ReservedTableException, SchemaException, TableNotFoundException, UniqueConstraintViolationException
from ..functions import literals, names
from ..operators.writer import entries, rules
from ..sources.store import schema_from_json, schema_to_json
from . import enforcer
from .blueprint import Blueprint, Plan

if TYPE_CHECKING:
    from ..database.connection import Connection

RESERVED = ("migrations", "schema")


class SchemaBuilder:
    """The schema of one connection."""

    def __init__(self, connection: Connection):
        self.connection = connection

    def _entry(self, table: str) -> dict[str, Any]:
        entry = self.connection._catalog()["tables"].get(table)
        if entry is None:
            raise TableNotFoundException(table)
        return entry

    def _migrating(self) -> None:
        if not self.connection._migrating:
            raise SchemaException("The schema changes in migrations only.")

    # --- questions -------------------------------------------------------------------------------------------------

    def get_tables(self) -> list[str]:
        return sorted(self.connection._catalog()["tables"])

    def has_table(self, table: str) -> bool:
        return table in self.connection._catalog()["tables"]

    def get_columns(self, table: str) -> list[ir.ColumnSchema]:
        return list(schema_from_json(self._entry(table)["schema"]).columns)

    def has_column(self, table: str, column: str) -> bool:
        return any(c.name == column for c in self.get_columns(table))

    def get_indexes(self, table: str) -> list[ir.IndexSchema]:
        return list(schema_from_json(self._entry(table)["schema"]).indexes)

    # --- changes ---------------------------------------------------------------------------------------------------

    def create(self, table: str, declare: Callable[[Blueprint], Any]) -> None:
        self._migrating()
        if table in RESERVED:
            raise ReservedTableException(table)
        if self.has_table(table):
            raise SchemaException(f"There is a table [{table}] already.")
        blueprint = Blueprint(table)
        declare(blueprint)
        schema = Plan(blueprint, None, self.connection.timezone).schema()
        self.connection._change(table, {"schema": schema_to_json(schema), "segments": [], "next_id": 1})

    def table(self, table: str, declare: Callable[[Blueprint], Any]) -> None:
        self._migrating()
        entry = self._entry(table)
        blueprint = Blueprint(table)
        declare(blueprint)
        plan = Plan(blueprint, schema_from_json(entry["schema"]), self.connection.timezone)
        schema = plan.schema()
        new = {**entry, "schema": schema_to_json(schema)}
        if entry["segments"]:
            new["segments"] = self._rewritten(entry, plan, schema)
        self.connection._change(table, new)

    def _rewritten(self, entry: dict[str, Any], plan: Plan, schema: ir.TableSchema) -> list[str]:
        df = self.connection._store.frame(entry)
        types = {f.name: f.dataType for f in enforcer.struct(schema).fields}
        outputs: list[Column] = []
        lacking: list[tuple[str, Column]] = []
        narrowed: list[tuple[str, Column]] = []
        same = True
        for c in schema.columns:
            source = plan.source.get(c.name)
            held = F.col(names.quoted(source)).cast(types[c.name]) if source in df.columns else F.lit(None).cast(types[c.name])
            value = held
            before = plan.changed.get(c.name)
            new = c.name in plan.added or before is not None
            if new and c.has_default and (not c.nullable or c.name in plan.added and source not in df.columns):
                value = F.coalesce(held, literals.column(enforcer.coerced(c.default, c, schema.table, self.connection.timezone, True)).cast(types[c.name]))
                same = False
            elif new and not c.nullable and (before is None or before.nullable):
                lacking.append((c.name, held.isNull()))
            if before is not None and c.values is not None:
                narrowed.append((c.name, held.isNotNull() & ~held.isin(*c.values)))
            same = same and source == c.name and source in df.columns
            outputs.append(value.alias(c.name))
        hidden = [c for c in df.columns if c == "__key"]
        if lacking or narrowed:
            some = df.agg(*[F.count_if(x) for _, x in lacking + narrowed]).first()
            short = [n for (n, _), k in zip(lacking, some, strict=False) if k]
            if short:
                raise SchemaException(f"Columns [{', '.join(short)}] of table [{schema.table}] need a value or a default, and rows hold none: {max(some[: len(lacking)])}.")
            for (n, _), k in zip(narrowed, some[len(lacking) :], strict=True):
                if k:
                    raise SchemaException(f"Column [{n}] of table [{schema.table}] holds values that it no longer accepts, in {k} rows.")
        out = df.select(*outputs, *hidden)
        self._check_unique(out, schema, plan.new_unique)
        if same and len(outputs) + len(hidden) == len(df.columns):
            return entry["segments"]
        return [self.connection._store.write(schema.table, out)]

    def _check_unique(self, df: Any, schema: ir.TableSchema, which: list[str]) -> None:
        for i in schema.indexes:
            if i.name in which:
                found = entries(df, i)
                n = found.groupBy(*found.columns).count().where("count > 1").count()
                if n:
                    raise SchemaException(f"Index [{i.name}] of table [{schema.table}] would not be unique: {n} values repeat.")

    def drop(self, table: str) -> None:
        self._migrating()
        self._entry(table)
        self.connection._change(table, None)

    def drop_if_exists(self, table: str) -> None:
        self._migrating()
        if self.has_table(table):
            self.drop(table)

    def rename(self, old: str, new: str) -> None:
        """No row moves: the catalog names the same segments under the new name."""
        self._migrating()
        entry = self._entry(old)
        if new in RESERVED:
            raise ReservedTableException(new)
        if self.has_table(new):
            raise SchemaException(f"There is a table [{new}] already.")
        self.connection._change(old, None)
        self.connection._change(new, {**entry, "schema": {**entry["schema"], "table": new}})

    def coerce(self, table: str, columns: list[str] | None = None) -> int:
        """Rewrite what rows hold as a write would store it; the number of rows that changed.

        Rows of this store are typed, so what differs is texts of enumerated columns, and times beyond milliseconds.
        """
        self._migrating()
        entry = self._entry(table)
        schema = schema_from_json(entry["schema"])
        for n in columns or []:
            c = schema.column(n)
            if c is None or c.primary:
                raise SchemaException(f"[{n}] is no column of table [{table}] that can be coerced.")
        if not entry["segments"]:
            return 0
        df = self.connection._store.frame(entry)
        sets: dict[str, Column] = {}
        bad: list[Column] = []
        for c in schema.columns:
            if c.primary or c.type == "json" or columns is not None and c.name not in columns:
                continue
            held = F.col(names.quoted(c.name))
            if c.type == "enum":
                fits = held.isNull() | held.isin(*(c.values or ()))
                bad.append(~fits)
                sets[c.name] = F.when(fits, held)
            elif c.type in ("date", "datetime"):
                sets[c.name] = F.timestamp_add("MICROSECOND", -F.pmod(F.timestamp_diff("MICROSECOND", literals.column(literals.EPOCH), held), F.lit(1000)), held)
            elif c.type == "float":
                fits = held.isNull() | (~F.isnan(held) & (F.abs(held) < float("inf")))
                bad.append(~fits)
                sets[c.name] = F.when(fits, held)
            if not c.nullable:
                bad.append(held.isNull())
        if bad and self.connection.strict:
            n = df.where(_any(bad)).count()
            if n:
                raise SchemaException(f"Table [{table}] holds values that a write would refuse, in {n} rows.")
        differs = [~sets[c].eqNullSafe(F.col(names.quoted(c))) for c in sets]
        n = df.where(_any(differs)).count() if differs else 0
        if n:
            out = df.select(*[sets[c].alias(c) if c in sets else F.col(names.quoted(c)) for c in df.columns])
            for rule in rules(schema):
                if set(rule.columns) & set(sets):
                    found = entries(out, rule)
                    if not found.groupBy(*found.columns).count().where("count > 1").isEmpty():
                        raise UniqueConstraintViolationException(table, rule.name)
            self.connection._change(table, {**entry, "segments": [self.connection._store.write(table, out)]})
        return n

    getTables, hasTable, getColumns, hasColumn, getIndexes, dropIfExists = get_tables, has_table, get_columns, has_column, get_indexes, drop_if_exists


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


class Schema:
    """The schema of the connection that is migrating, or of the default connection."""

    @staticmethod
    def _builder() -> SchemaBuilder:
        from ..database.manager import DB

        return SchemaBuilder(DB.connection())


def _forward(name: str) -> Callable[..., Any]:
    def call(*args: Any, **more: Any) -> Any:
        return getattr(Schema._builder(), name)(*args, **more)

    call.__name__ = name
    return call


for _n in [n for n in vars(SchemaBuilder) if not n.startswith("_")]:
    setattr(Schema, _n, staticmethod(_forward(_n)))

