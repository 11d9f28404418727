"""Versioned Parquet tables under one folder, and the catalog that names the current version.

A table is a list of segment folders that are never changed once written, and the names of those of their files that
later versions have replaced. Inserts add a segment; updates and deletes write what they keep of the files that they
touch into a new one. A commit gives the next numbered catalog file its name, which the file system must refuse to do
twice: of two writers that began from the same catalog, one fails. Where it can't (a rename on most object stores
overwrites), a connection must say that it is the only writer.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import ir
from ..exceptions import DatabaseBlockedException, SchemaException
from ..plans.compile import HIDDEN
from ..schema.enforcer import struct


def schema_to_json(s: ir.TableSchema) -> dict[str, Any]:
    return asdict(s)


def schema_from_json(d: dict[str, Any]) -> ir.TableSchema:
    columns = tuple(ir.ColumnSchema(**{**c, "values": tuple(c["values"]) if c["values"] is not None else None}) for c in d["columns"])
    indexes = tuple(ir.IndexSchema(i["name"], tuple(i["columns"]), i["unique"], i["multi_entry"]) for i in d["indexes"])
    return ir.TableSchema(d["table"], columns, d["key"], d["increments"], d["timestamps"], indexes)


#: File systems that never rename onto a file that is there. Local ones link instead.
RENAMES_ONCE = ("hdfs", "viewfs", "abfs", "abfss")


class Store:
    def __init__(self, spark: SparkSession, root: str, single_writer: bool = False):
        self.spark, self.root, self.single_writer = spark, root.rstrip("/"), single_writer
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def version(self) -> int:
        """The number of the current catalog; 0 without one."""
        folder = self._path(f"{self.root}/catalog")
        if not self._fs.exists(folder):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def load(self) -> dict[str, Any]:
        n = self.version()
        if not n:
            return {"version": 0, "tables": {}, "migrations": []}
        stream = self._fs.open(self._path(f"{self.root}/catalog/{n}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {**json.loads(text), "version": n}

    def commit(self, catalog: dict[str, Any]) -> dict[str, Any]:
        n = catalog["version"] + 1
        if self.version() >= n:
            raise DatabaseBlockedException("Another writer committed first.")
        # Hidden until complete, and given a name that must be free.
        draft, target = self._path(f"{self.root}/catalog/_{uuid.uuid4().hex}"), self._path(f"{self.root}/catalog/{n}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({**catalog, "version": n}).encode()))
        out.close()
        try:
            if not self._named(draft, target):
                raise DatabaseBlockedException("Another writer committed first.")
        finally:
            self._fs.delete(draft, False)
        return {**catalog, "version": n}

    def _named(self, draft: Any, target: Any) -> bool:
        """Give a file its name; False if the name is taken."""
        scheme = self._fs.getUri().getScheme()
        if scheme == "file":
            try:  # a link is made once or not at all
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        if scheme not in RENAMES_ONCE and not self.single_writer:
            raise SchemaException(f"A [{scheme}] file system may overwrite another writer's commit. Set single_writer where there is one writer only.")
        return not self._fs.exists(target) and bool(self._fs.rename(draft, target))

    def files(self, segment: str) -> set[str]:
        """The names of a segment's files."""
        return {n for x in self._fs.listStatus(self._path(segment)) if not (n := x.getPath().getName()).startswith(("_", "."))}

    def remove(self, segment: str) -> None:
        self._fs.delete(self._path(segment), True)

    def write(self, table: str, df: DataFrame) -> str:
        path = f"{self.root}/tables/{table}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def frame(self, entry: dict[str, Any]) -> DataFrame:
        schema = struct(schema_from_json(entry["schema"]))
        if entry["schema"]["key"] is None:
            schema = T.StructType([*schema.fields, T.StructField(HIDDEN, T.LongType())])
        if not entry["segments"]:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*entry["segments"])
        return df.where(~F.col("_metadata.file_name").isin(entry["without"])) if entry.get("without") else df

    def size(self) -> int:
        folder = self._path(self.root)
        return int(self._fs.getContentSummary(folder).getLength()) if self._fs.exists(folder) else 0

    def erase(self) -> None:
        self._fs.delete(self._path(self.root), True)
