"""How columns are named in queries: ``table.column->step->step as alias``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..exceptions import SchemaException

_AS = re.compile(r"^(.*?)\s+as\s+(\S.*?)\s*$", re.IGNORECASE | re.DOTALL)


@dataclass(frozen=True)
class Name:
    table: str | None
    column: str
    steps: tuple[str, ...] = ()

    @property
    def last(self) -> str:
        return self.steps[-1] if self.steps else self.column


def parse(text: str) -> Name:
    head, *steps = text.split("->")
    table, dot, column = head.rpartition(".")
    return Name(table if dot else None, column, tuple(steps))


def projected(text: str) -> tuple[str, str]:
    """The column of a selection and the name of its result."""
    m = _AS.match(text)
    return (m[1].strip(), m[2]) if m else (text, parse(text).last)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def json_path(steps: tuple[str, ...]) -> str:
    return "$" + "".join("['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']" for s in steps)


def checked_name(name: str) -> str:
    if not name.strip() or "." in name or "->" in name or re.search(r"\sas\s", name, re.IGNORECASE):
        raise SchemaException(f"[{name}] can't be the name of a column.")
    return name
