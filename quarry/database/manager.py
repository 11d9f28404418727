"""The registry of connections, and the entry to everything: ``DB``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial
from typing import Any

from ..events import EVENTS, Dispatcher, QueryExecuted, QueryLog
from ..exceptions import ConnectionNotConfiguredException
from ..operators.builder import Builder
from .connection import Connection


class DatabaseManager:
    def __init__(self) -> None:
        self._connections: dict[str, Connection] = {}
        self._default: str | None = None
        self._standing_in: list[Connection] = []
        self._dispatcher = Dispatcher()
        self._log = QueryLog()

    def configure(self, config: dict[str, Any]) -> DatabaseManager:
        """``{"default": name, "connections": {name: {"database", "path", "migrations", "seeders", "strict", "timezone"}}}``."""
        self._connections = {n: Connection(self, n, c) for n, c in config["connections"].items()}
        self._default = config.get("default") or next(iter(self._connections))
        return self

    def connection(self, name: str | None = None) -> Connection:
        if name is None and self._standing_in:
            return self._standing_in[-1]
        name = name or self._default
        if name is None or name not in self._connections:
            raise ConnectionNotConfiguredException(str(name))
        return self._connections[name]

    def get_default_connection(self) -> str | None:
        return self._default

    def set_default_connection(self, name: str) -> None:
        self.connection(name)
        self._default = name

    def get_connections(self) -> list[str]:
        return list(self._connections)

    def table(self, name: str) -> Builder:
        return self.connection().table(name)

    def transaction(self, run: Callable[..., Any], tables: Any = None) -> Any:
        return self.connection().transaction(run, tables)

    def migrate(self, name: str | None = None) -> list[str]:
        return self.connection(name).migrate()

    def status(self, name: str | None = None) -> list[dict[str, Any]]:
        return self.connection(name).status()

    def fresh(self, name: str | None = None, seed: bool = False) -> None:
        self.connection(name).fresh(seed)

    def seed(self, name: str | None = None) -> None:
        self.connection(name).seed()

    def estimate(self) -> dict[str, int | None]:
        return self.connection().estimate()

    def persist(self) -> bool:
        return self.connection().persist()

    persisted = persist

    @contextmanager
    def _as_default(self, connection: Connection) -> Iterator[None]:
        self._standing_in.append(connection)
        try:
            yield
        finally:
            self._standing_in.pop()

    # --- events and the log ----------------------------------------------------------------------------------------

    def _dispatch(self, event: Any) -> None:
        if isinstance(event, QueryExecuted):
            self._log.record(event)
        self._dispatcher.dispatch(event)

    def listen(self, key: str, listener: Callable[[Any], None], once: bool = False) -> None:
        self._dispatcher.listen(key, listener, once)

    def forget(self, key: str, listener: Callable[[Any], None] | None = None) -> None:
        self._dispatcher.forget(key, listener)

    def enable_query_log(self) -> None:
        self._log.on = True

    def disable_query_log(self) -> None:
        self._log.on = False

    def get_query_log(self) -> list[dict[str, Any]]:
        return list(self._log.entries)

    def flush_query_log(self) -> None:
        self._log.entries.clear()

    def logging(self) -> bool:
        return self._log.on

    def __getattr__(self, name: str) -> Any:
        """``on_query_executed`` and its like listen for the event of that class; camel case works too."""
        snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
        for key, event in EVENTS.items():
            if snake == "on_" + re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", event.__name__).lower():
                return partial(self.listen, key)
        if snake != name and not name.startswith("_"):
            return getattr(self, snake)
        raise AttributeError(name)


DB = DatabaseManager()
