"""A PySpark-native query layer: fluent queries lowered to Catalyst plans, declared schemas, migrations and writes."""

from .database.connection import Connection, Transaction
from .database.manager import DB, DatabaseManager
from .database.migrations import Migration, Seeder
from .operators.builder import Builder
from .operators.grouping import Grouping
from .operators.join import Join
from .schema.blueprint import Blueprint, ColumnDefinition
from .schema.schema import Schema

__all__ = ["DB", "Blueprint", "Builder", "ColumnDefinition", "Connection", "DatabaseManager", "Grouping", "Join", "Migration", "Schema", "Seeder", "Transaction"]
