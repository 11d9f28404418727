"""Events, their listeners and the query log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class QueryExecuted:
    connection: str
    table: str
    plan: str
    constraints: tuple = ()
    orders: tuple = ()
    limit: int | None = None
    duration: float = 0.0
    records: int = 0
    key = "query"


@dataclass(frozen=True)
class TransactionBeginning:
    connection: str
    key = "transaction-beginning"


@dataclass(frozen=True)
class TransactionCommitted:
    connection: str
    key = "transaction-committed"


@dataclass(frozen=True)
class TransactionRolledBack:
    connection: str
    reason: BaseException | None = None
    key = "transaction-rolled-back"


@dataclass(frozen=True)
class MigrationsStarted:
    connection: str
    migrations: tuple = ()
    key = "migrations-started"


@dataclass(frozen=True)
class MigrationStarted:
    migration: str
    key = "migration-started"


@dataclass(frozen=True)
class MigrationEnded:
    migration: str
    key = "migration-ended"


@dataclass(frozen=True)
class MigrationsEnded:
    connection: str
    migrations: tuple = ()
    key = "migrations-ended"


@dataclass(frozen=True)
class NoPendingMigrations:
    connection: str
    key = "no-pending-migrations"


@dataclass(frozen=True)
class SeedingStarted:
    connection: str
    seeders: tuple = ()
    key = "seeding-started"


@dataclass(frozen=True)
class SeederStarted:
    seeder: str
    key = "seeder-started"


@dataclass(frozen=True)
class SeederEnded:
    seeder: str
    key = "seeder-ended"


@dataclass(frozen=True)
class SeedingEnded:
    connection: str
    seeders: tuple = ()
    key = "seeding-ended"


@dataclass(frozen=True)
class DatabaseBlocked:
    database: str
    key = "database-blocked"


@dataclass(frozen=True)
class DatabaseVersionChanged:
    database: str
    version: int | None = None
    key = "database-version-changed"


EVENTS = {
    e.key: e
    for e in (
        QueryExecuted, TransactionBeginning, TransactionCommitted, TransactionRolledBack, MigrationsStarted, MigrationStarted, MigrationEnded, MigrationsEnded,
        NoPendingMigrations, SeedingStarted, SeederStarted, SeederEnded, SeedingEnded, DatabaseBlocked, DatabaseVersionChanged,
    )
}

Listener = Callable[[Any], None]


@dataclass
class Dispatcher:
    listeners: dict[str, list[tuple[Listener, bool]]] = field(default_factory=dict)

    def listen(self, key: str, listener: Listener, once: bool = False) -> None:
        if key not in EVENTS:
            raise KeyError(f"there is no event [{key}]")
        own = self.listeners.setdefault(key, [])
        if all(x is not listener for x, _ in own):
            own.append((listener, once))

    def forget(self, key: str, listener: Listener | None = None) -> None:
        self.listeners[key] = [] if listener is None else [x for x in self.listeners.get(key, []) if x[0] is not listener]

    def dispatch(self, event: Any) -> None:
        for listener, once in list(self.listeners.get(event.key, [])):
            if once:
                self.forget(event.key, listener)
            listener(event)


@dataclass
class QueryLog:
    entries: list[dict[str, Any]] = field(default_factory=list)
    on: bool = False

    def record(self, event: QueryExecuted) -> None:
        if self.on:
            self.entries.append({"connection": event.connection, "table": event.table, "plan": event.plan, "duration": event.duration, "records": event.records})
