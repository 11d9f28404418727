"""Migrations and seeders."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from ..events import MigrationEnded, MigrationsEnded, MigrationsStarted, MigrationStarted, NoPendingMigrations, SeederEnded, SeederStarted
from ..exceptions import MigrationMismatchException

if TYPE_CHECKING:
    from .connection import Connection


class Migration:
    """One step of the schema; it only ever goes forward."""

    def name(self) -> str:
        return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", type(self).__name__).lower()

    def up(self) -> None:
        raise NotImplementedError


class Seeder:
    """Rows to begin with. Seeders run whenever they are asked to."""

    connection: Connection

    def run(self) -> None:
        raise NotImplementedError

    def call(self, *seeders: type[Seeder]) -> None:
        for seeder in seeders:
            one = seeder()
            one.connection = self.connection
            self.connection._dispatch(SeederStarted(seeder.__name__))
            one.run()
            self.connection._dispatch(SeederEnded(seeder.__name__))


def pending(connection: Connection) -> tuple[list[str], list[Migration]]:
    """Recorded names, and the registered migrations after them."""
    all_ = [m() if isinstance(m, type) else m for m in connection.migrations]
    names = [m.name() for m in all_]
    recorded = connection._catalog()["migrations"]
    if names[: len(recorded)] != recorded:
        raise MigrationMismatchException(recorded, names)
    return recorded, all_[len(recorded) :]


def migrate(connection: Connection) -> list[str]:
    """Run all pending migrations in one transaction."""
    _, waiting = pending(connection)
    if not waiting:
        connection._dispatch(NoPendingMigrations(connection.name))
        return []
    names = tuple(m.name() for m in waiting)
    connection._dispatch(MigrationsStarted(connection.name, names))
    with connection._as_migration():
        for m in waiting:
            connection._dispatch(MigrationStarted(m.name()))
            m.up()
            connection._record(m.name())
            connection._dispatch(MigrationEnded(m.name()))
    connection._dispatch(MigrationsEnded(connection.name, names))
    return list(names)
