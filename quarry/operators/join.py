"""The conditions of one join."""

from __future__ import annotations

from .. import ir


class Join:
    def __init__(self) -> None:
        self.conditions: list[ir.On] = []

    def on(self, first: str, operator: str, second: str | None = None) -> Join:
        return self._add(first, operator, second, "and")

    def or_on(self, first: str, operator: str, second: str | None = None) -> Join:
        return self._add(first, operator, second, "or")

    orOn = or_on

    def _add(self, first: str, operator: str, second: str | None, conjunction: str) -> Join:
        if second is None:
            operator, second = "=", operator
        self.conditions.append(ir.On(first, ir.one_of(operator), second, conjunction))
        return self
