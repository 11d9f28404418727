"""Blueprints: what a migration declares about a table, and the checks on it."""

from __future__ import annotations

import enum
import re
from collections.abc import Iterable, Sequence
from dataclasses import replace
from typing import Any

from .. import ir
from ..exceptions import QuarryException, SchemaException
from ..functions.names import checked_name
from . import enforcer

_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")


class ColumnDefinition:
    """One declared column; its modifiers return it."""

    def __init__(self, schema: ir.ColumnSchema):
        self.schema = schema
        self.changes = self.indexed = self.is_unique = self.is_multi = False

    def _set(self, **changes: Any) -> ColumnDefinition:
        self.schema = replace(self.schema, **changes)
        return self

    def nullable(self, on: bool = True) -> ColumnDefinition:
        return self._set(nullable=on)

    def default(self, value: Any) -> ColumnDefinition:
        return self._set(default=value.value if isinstance(value, enum.Enum) else value, has_default=True)

    def primary(self) -> ColumnDefinition:
        return self._set(primary=True)

    def increments(self) -> ColumnDefinition:
        return self._set(increments=True)

    def index(self) -> ColumnDefinition:
        self.indexed = True
        return self

    def unique(self) -> ColumnDefinition:
        self.indexed = self.is_unique = True
        return self

    def multi_entry(self) -> ColumnDefinition:
        self.indexed = self.is_multi = True
        return self

    def change(self) -> ColumnDefinition:
        self.changes = True
        return self

    multiEntry = multi_entry


class Blueprint:
    def __init__(self, table: str):
        self.table = table
        self.steps: list[tuple[str, Any]] = []

    def _column(self, name: str, kind: str, **more: Any) -> ColumnDefinition:
        out = ColumnDefinition(ir.ColumnSchema(checked_name(name), kind, **more))
        self.steps.append(("column", out))
        return out

    def id(self, name: str = "id") -> ColumnDefinition:
        return self._column(name, "integer", primary=True, increments=True)

    def uuid(self, name: str = "uuid") -> ColumnDefinition:
        return self._column(name, "string")

    def string(self, name: str) -> ColumnDefinition:
        return self._column(name, "string")

    def integer(self, name: str) -> ColumnDefinition:
        return self._column(name, "integer")

    def float(self, name: str) -> ColumnDefinition:
        return self._column(name, "float")

    def boolean(self, name: str) -> ColumnDefinition:
        return self._column(name, "boolean")

    def date(self, name: str) -> ColumnDefinition:
        return self._column(name, "date")

    def datetime(self, name: str) -> ColumnDefinition:
        return self._column(name, "datetime")

    def json(self, name: str) -> ColumnDefinition:
        return self._column(name, "json")

    def decimal(self, name: str, places: Any = 2) -> ColumnDefinition:
        if isinstance(places, bool) or not isinstance(places, int) or places < 0:
            raise SchemaException("A scale counts decimal places: a whole number, 0 at least.")
        return self._column(name, "decimal", places=places)

    def enum(self, name: str, values: Any) -> ColumnDefinition:
        if isinstance(values, type) and issubclass(values, enum.Enum):
            values = [m.value for m in values]
        elif isinstance(values, dict):
            values = list(values.values())
        if any(not isinstance(v, str) for v in values):
            raise SchemaException("The values of an enumerated column are texts.")
        if not values:
            raise SchemaException(f"Enumerated column [{name}] accepts no value.")
        return self._column(name, "enum", values=tuple(dict.fromkeys(values)))

    def timestamps(self) -> None:
        self.steps.append(("timestamps", None))
        for name in ("created_at", "updated_at"):
            self._column(name, "datetime").nullable()

    def index(self, columns: str | Sequence[str], name: str | None = None) -> None:
        self.steps.append(("index", self._index(columns, name, False)))

    def unique(self, columns: str | Sequence[str], name: str | None = None) -> None:
        self.steps.append(("index", self._index(columns, name, True)))

    def _index(self, columns: str | Sequence[str], name: str | None, unique: bool, multi: bool = False) -> ir.IndexSchema:
        covered = (columns,) if isinstance(columns, str) else tuple(columns)
        return ir.IndexSchema(name or index_name(self.table, covered, unique), covered, unique, multi)

    def drop_column(self, *names: str) -> None:
        self.steps += [("drop", n) for n in names]

    def rename_column(self, old: str, new: str) -> None:
        self.steps.append(("rename", (old, checked_name(new))))

    def drop_index(self, name: str) -> None:
        self.steps.append(("drop-index", name))

    dropColumn, renameColumn, dropIndex = drop_column, rename_column, drop_index


def index_name(table: str, columns: Iterable[str], unique: bool) -> str:
    return "_".join([table, *columns, "unique" if unique else "index"])


class Plan:
    """A blueprint applied to a table's schema: the next schema, and what its rows need."""

    def __init__(self, blueprint: Blueprint, old: ir.TableSchema | None, tz: str):
        self.table, self.old, self.tz = blueprint.table, old, tz
        self.columns: dict[str, ir.ColumnSchema] = {c.name: c for c in old.columns} if old else {}
        self.indexes: dict[str, ir.IndexSchema] = {i.name: i for i in old.indexes} if old else {}
        self.timestamps = bool(old and old.timestamps)
        self.source: dict[str, str | None] = {c: c for c in self.columns}  # new name to the old column that fills it
        self.added: list[str] = []
        self.changed: dict[str, ir.ColumnSchema] = {}  # new name to what it was
        self.new_unique: list[str] = []
        self.dropped: set[str] = set()
        declared: set[str] = set()
        late: list[tuple[str, ir.IndexSchema]] = []
        for what, x in blueprint.steps:
            if what == "timestamps":
                self.timestamps = True
            elif what == "column":
                self._declare(x, declared)
                if x.indexed:
                    late.append((x.schema.name, blueprint._index(x.schema.name, None, x.is_unique, x.is_multi)))
            elif what == "index":
                late.append(("", x))
            elif what == "drop":
                self._drop(x)
            elif what == "rename":
                self._rename(*x)
            elif what == "drop-index":
                if x not in self.indexes:
                    raise SchemaException(f"Table [{self.table}] has no index [{x}].")
                del self.indexes[x]
        for _, index in late:
            self._index(index)
        self._finish()

    @property
    def creating(self) -> bool:
        return self.old is None

    def _declare(self, d: ColumnDefinition, declared: set[str]) -> None:
        c = d.schema
        if c.name in declared:
            raise SchemaException(f"Column [{c.name}] of table [{self.table}] is declared twice.")
        declared.add(c.name)
        before = self.columns.get(c.name)
        if d.changes:
            if before is None or self.creating:
                raise SchemaException(f"Table [{self.table}] has no column [{c.name}] to change.")
            if before.primary or c.primary:
                raise SchemaException(f"The key of table [{self.table}] can't be changed.")
            if before.type != c.type:
                raise SchemaException(f"Column [{c.name}] of table [{self.table}] can't change its type.")
            if before.places != c.places:
                raise SchemaException(f"Column [{c.name}] of table [{self.table}] can't change its scale.")
            self.changed[c.name] = before
            self.indexes = {n: i for n, i in self.indexes.items() if i.columns != (c.name,)}
        elif before is not None:
            raise SchemaException(f"Table [{self.table}] has a column [{c.name}] already.")
        elif not self.creating and c.primary:
            raise SchemaException(f"The key of table [{self.table}] is set when it is created.")
        else:
            self.added.append(c.name)
            self.source[c.name] = c.name if c.name not in self.dropped else None
        self.columns[c.name] = c

    def _held(self, name: str) -> ir.ColumnSchema:
        c = self.columns.get(name)
        if c is None:
            raise SchemaException(f"Table [{self.table}] has no column [{name}].")
        if c.primary:
            raise SchemaException(f"The key [{name}] of table [{self.table}] stays as it is.")
        return c

    def _drop(self, name: str) -> None:
        self._held(name)
        for i in list(self.indexes.values()):
            if name in i.columns:
                if any(c in self.columns and c != name for c in i.columns):
                    raise SchemaException(f"Column [{name}] of table [{self.table}] can't be dropped while index [{i.name}] covers it.")
                del self.indexes[i.name]
        del self.columns[name]
        self.dropped.add(name)
        self.source.pop(name, None)
        self.added = [c for c in self.added if c != name]

    def _rename(self, old: str, new: str) -> None:
        c = self._held(old)
        if new in self.columns:
            raise SchemaException(f"Table [{self.table}] has a column [{new}] already.")
        self.columns = {new if n == old else n: replace(c, name=new) if n == old else x for n, x in self.columns.items()}
        self.source[new] = self.source.pop(old, None)
        self.dropped.add(old)
        self.added = [new if n == old else n for n in self.added]
        if old in self.changed:
            self.changed[new] = self.changed.pop(old)
        renamed = {}
        for i in self.indexes.values():
            if old in i.columns:
                columns = tuple(new if x == old else x for x in i.columns)
                generated = i.name == index_name(self.table, i.columns, i.unique)
                i = ir.IndexSchema(index_name(self.table, columns, i.unique) if generated else i.name, columns, i.unique, i.multi_entry)
            renamed[i.name] = i
        self.indexes = renamed

    def _index(self, i: ir.IndexSchema) -> None:
        if i.name in self.indexes:
            raise SchemaException(f"Table [{self.table}] has an index [{i.name}] already.")
        for name in i.columns:
            c = self.columns.get(name)
            if c is None:
                raise SchemaException(f"Index [{i.name}] covers column [{name}], which table [{self.table}] lacks.")
            if c.type == "boolean":
                raise SchemaException(f"Index [{i.name}] of table [{self.table}] covers boolean column [{name}].")
            if not _IDENTIFIER.fullmatch(name):
                raise SchemaException(f"Column [{name}] of table [{self.table}] can't be indexed under its name.")
        self.indexes[i.name] = i
        if i.unique:
            self.new_unique.append(i.name)

    def _finish(self) -> None:
        keys = [c for c in self.columns.values() if c.primary]
        if len(keys) > 1:
            raise SchemaException(f"Table [{self.table}] declares more than one key.")
        for c in keys:
            if c.nullable or c.type == "boolean" or not _IDENTIFIER.fullmatch(c.name):
                raise SchemaException(f"Column [{c.name}] can't be the key of table [{self.table}].")
        for name in [*self.added, *self.changed]:
            c = self.columns[name]
            if c.has_default:
                try:
                    stored = enforcer.coerced(c.default, c, self.table, self.tz, True)
                except (TypeError, QuarryException) as e:
                    raise SchemaException(f"Column [{name}] of table [{self.table}] can't store its default: {e}") from e
                if stored is None and not c.nullable:
                    raise SchemaException(f"Column [{name}] of table [{self.table}] needs a value, and its default is none.")

    def schema(self) -> ir.TableSchema:
        key = next((c for c in self.columns.values() if c.primary), None)
        return ir.TableSchema(self.table, tuple(self.columns.values()), key.name if key else None, bool(key and key.increments), self.timestamps, tuple(self.indexes.values()))
