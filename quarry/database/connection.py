"""A connection: one database of versioned tables, with its migrations, transactions and zone.

DataFrames from elsewhere can be registered as read-only tables beside the stored ones.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame, SparkSession

from .. import ir
from ..events import DatabaseBlocked, DatabaseVersionChanged, SeederEnded, SeederStarted, SeedingEnded, SeedingStarted, TransactionBeginning, TransactionCommitted, TransactionRolledBack
from ..exceptions import DatabaseBlockedException, SchemaException, TableNotFoundException, TransactionClosedException
from ..functions import literals
from ..operators.builder import Builder
from ..plans.compile import Source, schema_of
from ..schema.schema import SchemaBuilder
from ..sources.store import Store, schema_from_json
from . import migrations as mg

if TYPE_CHECKING:
    from .manager import DatabaseManager


class Transaction:
    """Reads and writes of one transaction; it may be limited to the tables that it names."""

    def __init__(self, connection: Connection, tables: tuple[str, ...] | None):
        self._connection, self._tables, self.open = connection, tables, True

    def table(self, name: str) -> Builder:
        if not self.open:
            raise TransactionClosedException("The transaction has ended.")
        self._connection._in_scope(name)
        return Builder(self._connection, name)


class Connection:
    def __init__(self, manager: DatabaseManager, name: str, config: dict[str, Any]):
        self.manager, self.name = manager, name
        self.database = config.get("database", name)
        self.migrations = list(config.get("migrations", ()))
        self.seeders = list(config.get("seeders", ()))
        self.strict = bool(config.get("strict", True))
        self.timezone = config.get("timezone", "UTC")
        literals.zone(self.timezone)  # an unknown zone fails here
        self._root = config.get("path")
        self.single_writer = bool(config.get("single_writer", False))
        self._frames: dict[str, Source] = {}
        self._working: dict[str, Any] | None = None
        self._current: dict[str, Any] | None = None
        self._scope: tuple[str, ...] | None = None
        self._migrating = False
        self._opened = False
        self._opened_store: Store | None = None

    @property
    def spark(self) -> SparkSession:
        session = SparkSession.getActiveSession()
        if session is None:
            raise RuntimeError("there is no active Spark session")
        return session

    @property
    def _store(self) -> Store:
        if self._opened_store is None or self._opened_store.spark is not self.spark:
            warehouse = self.spark.conf.get("spark.sql.warehouse.dir")
            self._opened_store = Store(self.spark, f"{self._root or warehouse}/{self.database}.quarry", self.single_writer)
        return self._opened_store

    def _dispatch(self, event: Any) -> None:
        self.manager._dispatch(event)

    # --- catalog ---------------------------------------------------------------------------------------------------

    def _catalog(self) -> dict[str, Any]:
        if self._working is not None:
            return self._working
        version = self._store.version()
        if self._current is None or self._current["version"] != version:
            if self._current is not None:
                self._dispatch(DatabaseVersionChanged(self.database, version or None))
            self._current = self._store.load()
        return self._current

    def _commit(self, catalog: dict[str, Any]) -> dict[str, Any]:
        try:
            return self._store.commit(catalog)
        except DatabaseBlockedException:
            self._dispatch(DatabaseBlocked(self.database))
            raise

    def _open(self) -> None:
        """Pending migrations run before the first use."""
        if not self._opened and not self._migrating:
            self._opened = True
            try:
                if self.migrations:
                    mg.migrate(self)
            except BaseException:
                self._opened = False
                raise

    def _change(self, table: str, entry: dict[str, Any] | None) -> None:
        """Record a table's next version: in the transaction that runs, or at once."""
        if self._working is not None:
            if entry is None:
                self._working["tables"].pop(table, None)
            else:
                self._working["tables"][table] = entry
            return
        catalog = copy.deepcopy(self._catalog())
        if entry is None:
            catalog["tables"].pop(table, None)
        else:
            catalog["tables"][table] = entry
        self._current = self._commit(catalog)

    def _record(self, migration: str) -> None:
        assert self._working is not None
        self._working["migrations"].append(migration)

    def _in_scope(self, table: str) -> None:
        if self._scope is not None and table not in self._scope:
            raise SchemaException(f"The transaction didn't declare table [{table}].")

    def _stored(self, table: str) -> tuple[dict[str, Any], ir.TableSchema]:
        self._open()
        self._in_scope(table)
        entry = self._catalog()["tables"].get(table)
        if entry is None:
            if table in self._frames:
                raise SchemaException(f"Table [{table}] is a registered DataFrame, which is only read.")
            raise TableNotFoundException(table)
        return entry, schema_from_json(entry["schema"])

    def _source(self, table: str) -> Source:
        if table in self._frames:
            return self._frames[table]
        entry, schema = self._stored(table)
        store = self._store
        return Source(table, schema, lambda: store.frame(entry), (schema.key,) if schema.key else ())

    # --- public ----------------------------------------------------------------------------------------------------

    def register(self, name: str, df: DataFrame, key: str | tuple[str, ...] = (), json: tuple[str, ...] = ()) -> Connection:
        """Read ``df`` under a name. ``key`` columns are unique and order rows that nothing else orders."""
        keys = (key,) if isinstance(key, str) else tuple(key)
        self._frames[name] = Source(name, schema_of(name, df, keys, json), lambda: df, keys)
        return self

    def table(self, name: str, transaction: Transaction | None = None) -> Builder:
        return transaction.table(name) if transaction is not None else Builder(self, name)

    def schema(self) -> SchemaBuilder:
        self._open()
        return SchemaBuilder(self)

    def migrate(self) -> list[str]:
        self._opened = True
        return mg.migrate(self)

    def status(self) -> list[dict[str, Any]]:
        """Registered migrations and whether they ran; never migrates."""
        recorded, waiting = mg.pending(self)
        return [{"migration": n, "ran": True} for n in recorded] + [{"migration": m.name(), "ran": False} for m in waiting]

    def fresh(self, seed: bool = False) -> None:
        self._store.erase()
        self._current = None
        self.migrate()
        if seed:
            self.seed()

    def seed(self, *seeders: type[mg.Seeder]) -> None:
        self._open()
        chosen = list(seeders) or self.seeders
        if not chosen:
            return
        names = tuple(s.__name__ for s in chosen)
        self._dispatch(SeedingStarted(self.name, names))
        with self.manager._as_default(self):
            for seeder in chosen:
                one = seeder()
                one.connection = self
                self._dispatch(SeederStarted(seeder.__name__))
                one.run()
                self._dispatch(SeederEnded(seeder.__name__))
        self._dispatch(SeedingEnded(self.name, names))

    def transaction(self, run: Callable[[Transaction], Any], tables: tuple[str, ...] | list[str] | None = None) -> Any:
        """Run a callback whose writes become visible together, or not at all. One inside another joins it."""
        self._open()
        if self._working is not None:
            return run(Transaction(self, None))
        for t in tables or ():
            if t not in self._catalog()["tables"] and t not in self._frames:
                raise TableNotFoundException(t)
        self._dispatch(TransactionBeginning(self.name))
        own = Transaction(self, tuple(tables) if tables is not None else None)
        try:
            with self._pending(own._tables):
                out = run(own)
        except BaseException as e:
            self._dispatch(TransactionRolledBack(self.name, e))
            raise
        finally:
            own.open = False
        self._dispatch(TransactionCommitted(self.name))
        return out

    @contextmanager
    def _pending(self, scope: tuple[str, ...] | None) -> Iterator[None]:
        before = self._catalog()
        self._working, self._scope = copy.deepcopy(before), scope
        try:
            yield
            done, self._working, self._scope = self._working, None, None
            if done != before:
                self._current = self._commit(done)
        finally:
            self._working = self._scope = None

    @contextmanager
    def _as_migration(self) -> Iterator[None]:
        self._migrating = True
        try:
            with self.manager._as_default(self), self._pending(None):
                yield
        finally:
            self._migrating = False

    def compact(self, table: str) -> None:
        """Rewrite a table that many writes left in many segments as one."""
        entry, _ = self._stored(table)
        if len(entry["segments"]) > 1 or entry.get("without"):
            self._change(table, {**entry, "segments": [self._store.write(table, self._store.frame(entry))], "without": []})

    def estimate(self) -> dict[str, int | None]:
        """The bytes that the database takes; the store sets no quota."""
        return {"usage": self._store.size(), "quota": None}

    def persist(self) -> bool:
        """Stored tables stay until they are dropped."""
        return True

    persisted = persist

    def delete(self) -> None:
        self._store.erase()
        self._current, self._opened = None, False

    def get_tables(self) -> list[str]:
        return self.schema().get_tables()

    def get_columns(self, table: str) -> list[ir.ColumnSchema]:
        return self.schema().get_columns(table)

    def get_indexes(self, table: str) -> list[ir.IndexSchema]:
        return self.schema().get_indexes(table)

    getTables, getColumns, getIndexes = get_tables, get_columns, get_indexes
