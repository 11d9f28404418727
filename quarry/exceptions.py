"""Errors of the public interface."""

from __future__ import annotations


class QuarryException(Exception):
    """Base of all errors raised by this package."""


class SchemaException(QuarryException):
    """A schema or query call that the shape of the database can't support."""


class TableNotFoundException(QuarryException):
    def __init__(self, table: str):
        super().__init__(f"There is no table [{table}].")
        self.table = table


class ReservedTableException(QuarryException):
    def __init__(self, table: str):
        super().__init__(f"The name [{table}] is reserved.")
        self.table = table


class ConnectionNotConfiguredException(QuarryException):
    def __init__(self, name: str):
        super().__init__(f"No connection [{name}] is configured.")
        self.name = name


class RecordsNotFoundException(QuarryException):
    def __init__(self, table: str):
        super().__init__(f"No record of [{table}] matches.")
        self.table = table


class MultipleRecordsFoundException(QuarryException):
    def __init__(self, table: str):
        super().__init__(f"More than one record of [{table}] matches.")
        self.table = table


class NotNullConstraintViolationException(QuarryException):
    def __init__(self, table: str, column: str):
        super().__init__(f"Column [{column}] of table [{table}] needs a value.")
        self.table, self.column = table, column


class CheckConstraintViolationException(QuarryException):
    def __init__(self, table: str, column: str, value: object, accepted: list[str]):
        super().__init__(f"Column [{column}] of table [{table}] takes one of [{', '.join(accepted)}], not [{value}].")
        self.table, self.column, self.value = table, column, value


class UniqueConstraintViolationException(QuarryException):
    def __init__(self, table: str, index: str):
        super().__init__(f"A write to table [{table}] collides under [{index}].")
        self.table, self.index = table, index


class MigrationMismatchException(QuarryException):
    def __init__(self, recorded: list[str], registered: list[str]):
        super().__init__(f"Recorded migrations {recorded} don't begin the registered ones {registered}.")


class TransactionClosedException(QuarryException):
    """A transaction was used after it ended."""


class MigrationTransactionClosedException(TransactionClosedException):
    """A migration's transaction was used after it ended."""


class DatabaseBlockedException(QuarryException):
    """Another writer committed first, or holds the database."""


class QuotaExceededException(QuarryException):
    """The storage refused a write for lack of space."""
