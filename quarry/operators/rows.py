"""Collected rows as Python values."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Row


def decoded(row: Row, kinds: dict[str, str]) -> dict[str, Any]:
    return {k: value(v, kinds.get(k, "string")) for k, v in zip(row.__fields__, row, strict=True)}


def value(v: Any, kind: str) -> Any:
    if kind == "json" and isinstance(v, str):
        try:
            return json.loads(v)
        except ValueError:
            return v
    return v
