"""Writes: new segments of a table, checked before the catalog names them.

Rows that the caller gives are a batch in the driver's memory, or a DataFrame. A batch meets the table by a broadcast
of its keys, so a check reads the columns of an index and moves no table rows. Updates, deletes and upserts first find
the files that hold a row to change, and rewrite these alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import ir
from ..exceptions import SchemaException, UniqueConstraintViolationException
from ..functions import literals, names, predicate
from ..plans.compile import HIDDEN
from ..schema import enforcer

if TYPE_CHECKING:
    from .builder import Builder


def rules(schema: ir.TableSchema) -> list[ir.IndexSchema]:
    """What must be unique: the key first, then unique indexes as declared."""
    key = [ir.IndexSchema(schema.key, (schema.key,), True)] if schema.key else []
    return key + [i for i in schema.indexes if i.unique]


#: Up to so many names or keys are constants of a filter, which files and Parquet statistics answer; more are joined.
FILTERED = 1000
#: Rows whose index entries are broadcast at most.
BROADCAST_ROWS = 100_000


def entries(df: DataFrame, rule: ir.IndexSchema) -> DataFrame:
    """The entries of an index, one row each, with ``__row`` where the frame has it. Absent values have none."""
    columns = [F.col(names.quoted(c)).alias(f"e{i}") for i, c in enumerate(rule.columns)]
    keep = [F.col("__row")] if "__row" in df.columns else []
    if rule.multi_entry:
        elements, _ = predicate.as_array(predicate.Ref(F.col(names.quoted(rule.columns[0])), "json"))
        each = F.array_distinct(F.transform(elements, lambda e: F.to_json(e)))
        return df.select(F.explode(each).alias("e0"), *keep).where("e0 <> 'null'")
    return df.select(*columns, *keep).dropna(subset=[f"e{i}" for i in range(len(columns))])


class Writer:
    def __init__(self, builder: Builder):
        self.builder = builder
        self.connection = builder._connection
        self.query = builder._query
        self.table = self.query.table
        self._kept: str | None = None

    # --- shared ----------------------------------------------------------------------------------------------------

    def _entry(self) -> tuple[dict[str, Any], ir.TableSchema]:
        return self.connection._stored(self.table)

    def _own(self, rows: Any) -> list[dict[str, Any]]:
        """Rows with plain column names of this table."""
        out = []
        for row in [rows] if isinstance(rows, dict) else rows:
            own: dict[str, Any] = {}
            for name, v in row.items():
                parsed = names.parse(name)
                if parsed.table not in (None, self.table) or parsed.steps:
                    raise SchemaException(f"[{name}] is no column of [{self.table}].")
                if parsed.column in own:
                    raise SchemaException(f"A row names column [{parsed.column}] twice.")
                own[parsed.column] = v
            out.append(own)
        return out

    def _known(self, schema: ir.TableSchema, columns: Sequence[str]) -> None:
        for c in columns:
            if schema.column(c) is None:
                raise SchemaException(f"Table [{schema.table}] has no column [{c}].")

    def _unjoined(self, what: str) -> None:
        if self.query.joins:
            raise SchemaException(f"A joined query can't {what}.")

    def _batch(self, rows: list[dict[str, Any]], schema: ir.TableSchema, hidden: bool) -> DataFrame:
        from pyspark.sql import types as T

        struct = enforcer.struct(schema)
        if hidden:
            struct = T.StructType([*struct.fields, T.StructField(HIDDEN, T.LongType())])
        return self.connection.spark.createDataFrame([tuple(r.get(f.name) for f in struct.fields) for r in rows], struct)

    @staticmethod
    def _keys_of(row: dict[str, Any], rule: ir.IndexSchema) -> list[tuple]:
        """The entries of one row in an index."""
        import json

        if rule.multi_entry:
            v = row.get(rule.columns[0])
            array = json.loads(v) if isinstance(v, str) else None
            return [(x,) for x in dict.fromkeys(predicate.canonical(e) for e in array if e is not None)] if isinstance(array, list) else []
        key = tuple(row.get(c) for c in rule.columns)
        return [] if any(x is None for x in key) else [key]

    def _taken(self, entry: dict[str, Any], rule: ir.IndexSchema, keys: list[tuple]) -> set[tuple]:
        """Those of some keys that the table holds already."""
        if not keys or not entry["segments"]:
            return set()
        there = entries(self._holding(self.connection._store.frame(entry), rule, keys), rule)
        return {tuple(r) for r in there.join(F.broadcast(self._given(there, keys)), there.columns, "left_semi").distinct().collect()}  # no more than the batch

    def _given(self, there: DataFrame, keys: list[tuple]) -> DataFrame:
        """Keys of the batch as rows shaped like the entries of an index."""
        from pyspark.sql import types as T

        fields = [f for f in there.schema.fields if f.name != "__row"]
        return self.connection.spark.createDataFrame(list(dict.fromkeys(keys)), T.StructType([T.StructField(f.name, f.dataType) for f in fields]))

    def _holding(self, frame: DataFrame, rule: ir.IndexSchema, keys: list[tuple]) -> DataFrame:
        """The rows that may hold one of a few keys, by a filter that reaches Parquet; else all rows."""
        if rule.multi_entry or len(rule.columns) > 1 or len(keys) > FILTERED:
            return frame
        return frame.where(F.col(names.quoted(rule.columns[0])).isin([literals.column(k) for (k,) in dict.fromkeys(keys)]))

    def _key_column(self, schema: ir.TableSchema) -> str:
        return schema.key or HIDDEN

    # --- inserts ---------------------------------------------------------------------------------------------------

    def insert(self, rows: Any, ignore: bool = False) -> tuple[int, Any]:
        """The number of rows written and the last row's key, which a DataFrame doesn't tell."""
        self._unjoined("insert")
        if isinstance(rows, DataFrame):
            return self._insert_frame(rows, ignore), None
        entry, schema = self._entry()
        given = self._own(rows)
        at = enforcer.now()
        for r in given:
            self._known(schema, list(r))
        records = [enforcer.record(r, schema, self.connection.timezone, self.connection.strict, at) for r in given]
        next_id = entry["next_id"]
        for r in records:
            if schema.increments and r.get(schema.key) is None:
                r[schema.key] = next_id
            if schema.increments:
                next_id = max(next_id, r[schema.key] + 1)
            if schema.key is None:
                r[HIDDEN] = next_id
                next_id += 1
        kept = self._not_colliding(entry, schema, records, ignore)
        if kept:
            path = self.connection._store.write(self.table, self._batch(kept, schema, schema.key is None).coalesce(1))
            self.connection._change(self.table, {**entry, "segments": [*entry["segments"], path], "next_id": next_id})
        return len(kept), records[-1].get(self._key_column(schema)) if records else None

    def _insert_frame(self, df: DataFrame, ignore: bool) -> int:
        """Rows of a DataFrame, which never pass the driver: written once, checked, and numbered where the key is to be made."""
        entry, schema = self._entry()
        self._known(schema, df.columns)
        store, connection, at = self.connection._store, self.connection, enforcer.now()
        stored, faults = enforcer.frame(df, schema, connection.timezone, connection.strict, at)
        named = [c for c in stored.columns if not c.startswith("__f")]
        stored = stored.select(*[names.quoted(c) for c in named], *[c.alias(f"__fault{i}") for i, (c, _) in enumerate(faults)])
        incoming = store.write("_incoming", stored.withColumn("__place", F.monotonically_increasing_id()))
        try:
            there = connection.spark.read.parquet(incoming)
            seen = there.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f"__fault{i}")).alias(f"n{i}") for i in range(len(faults))]).first()
            for i, (_, error) in enumerate(faults):
                if seen[f"n{i}"]:
                    raise error
            there = there.drop(*[f"__fault{i}" for i in range(len(faults))])
            for rule in rules(schema):
                mine, held = entries(there, rule), entries(store.frame(entry), rule)
                if ignore:
                    there = self._first_of_each(there, rule, held)
                elif not mine.groupBy(*mine.columns).count().where("count > 1").isEmpty() or not held.join(mine, mine.columns, "left_semi").isEmpty():
                    raise UniqueConstraintViolationException(self.table, rule.name)
            next_id = entry["next_id"]
            key = self._key_column(schema)
            if schema.increments or schema.key is None:
                there, next_id = self._numbered(there, key, next_id, schema.increments)
            path = store.write(self.table, there.drop("__place"))
        finally:
            store.remove(incoming)
        n = connection.spark.read.parquet(path).count()
        if n:
            connection._change(self.table, {**entry, "segments": [*entry["segments"], path], "next_id": next_id})
        return n

    def _first_of_each(self, there: DataFrame, rule: ir.IndexSchema, held: DataFrame) -> DataFrame:
        """Rows without an entry, and of each new entry the first row."""
        if rule.multi_entry:
            raise SchemaException("A DataFrame can't be inserted while ignoring collisions of an index over elements.")
        columns = [F.col(names.quoted(c)) for c in rule.columns]
        none = reduce(lambda a, b: a | b, [c.isNull() for c in columns])
        first = there.where(~none).withColumn("__n", F.row_number().over(W.partitionBy(*columns).orderBy("__place"))).where("__n = 1").drop("__n")
        same = [c == held[f"e{i}"] for i, c in enumerate(columns)]
        return there.where(none).unionByName(first.join(held, reduce(lambda a, b: a & b, same), "left_anti"))

    def _numbered(self, there: DataFrame, key: str, next_id: int, given: bool) -> tuple[DataFrame, int]:
        """Keys without gaps for rows that have none, in the order of the partitions that were written."""
        lacks = F.col(names.quoted(key)).isNull() if given else F.lit(True)
        top = there.agg(F.max(names.quoted(key))).first()[0] if given else None
        base = max(next_id, (top or 0) + 1)
        some = there.where(lacks)
        part = F.shiftright("__place", 33).alias("__part")
        # Rows of a partition are numbered by a window over it; what reaches the driver is a count a partition.
        counts = sorted((r["__part"], r["count"]) for r in some.groupBy(part).count().collect())
        first, total = [], 0
        for p, n in counts:
            first.append((p, base + total - 1))
            total += n
        offsets = self.connection.spark.createDataFrame(first, "__part long, __first long")
        numbered = some.drop(key).withColumn("__part", F.shiftright("__place", 33)).join(F.broadcast(offsets), "__part")
        numbered = numbered.withColumn(key, F.col("__first") + F.row_number().over(W.partitionBy("__part").orderBy("__place"))).drop("__part", "__first")
        rest = there.where(~lacks)
        out = numbered.select(*[names.quoted(c) for c in rest.columns]).unionByName(rest) if given else numbered
        return out, base + total

    def _not_colliding(self, entry: dict[str, Any], schema: ir.TableSchema, records: list[dict[str, Any]], ignore: bool) -> list[dict[str, Any]]:
        all_rules = rules(schema)
        held = [self._taken(entry, rule, [k for r in records for k in self._keys_of(r, rule)]) for rule in all_rules]
        kept = []
        for r in records:
            keys = [self._keys_of(r, rule) for rule in all_rules]
            hit = next((i for i, ks in enumerate(keys) if any(k in held[i] for k in ks)), None)
            if hit is None:
                kept.append(r)
                for i, ks in enumerate(keys):
                    held[i].update(ks)
            elif not ignore:
                raise UniqueConstraintViolationException(self.table, all_rules[hit].name)
        return kept

    def upsert(self, rows: Any, unique_by: Any, update: Sequence[str] | None) -> int:
        """Rows in order, each seeing those before it: an update of the row that holds its conflict key, or an insert."""
        self._unjoined("upsert")
        entry, schema = self._entry()
        target = tuple([unique_by] if isinstance(unique_by, str) else unique_by)
        rule = next((r for r in rules(schema) if set(r.columns) == set(target)), None)
        if rule is None:
            raise SchemaException(f"An upsert needs the key or a unique index over [{', '.join(target)}].")
        if update is not None:
            self._known(schema, update)
            if schema.key in update and target != (schema.key,):
                raise SchemaException("An upsert can't change the key.")
        given = self._own(rows)
        at = enforcer.now()
        for r in given:
            self._known(schema, list(r))
        tz, strict = self.connection.timezone, self.connection.strict
        records = [enforcer.record(r, schema, tz, strict, at) for r in given]
        wanted = [k for r in records for k in self._keys_of(r, rule)]
        frame = self.connection._store.frame(entry)
        holders: dict[tuple, dict[str, Any]] = {}
        if wanted and entry["segments"]:
            columns = [F.col(names.quoted(c)) for c in frame.columns]
            found = entries(self._holding(frame, rule, wanted).withColumn("__row", F.struct(*columns, F.col("_metadata.file_name").alias("__file"))), rule)
            fields = [c for c in found.columns if c != "__row"]
            rows_by_key: dict[Any, dict[str, Any]] = {}
            for hit in found.join(F.broadcast(self._given(found, wanted)), fields, "left_semi").collect():  # no more than the batch
                row = hit["__row"].asDict()
                row = rows_by_key.setdefault(row[self._key_column(schema)], row)
                holders[tuple(hit[c] for c in fields)] = row
        touched: dict[int, dict[str, Any]] = {}
        fresh: dict[int, dict[str, Any]] = {}
        next_id = entry["next_id"]
        for r, own in zip(records, given, strict=True):
            keys = self._keys_of(r, rule)
            held = {id(h): h for k in keys if (h := holders.get(k)) is not None}
            if len(held) > 1:
                raise UniqueConstraintViolationException(self.table, rule.name)
            if held:
                (row,) = held.values()
                for k in self._keys_of(row, rule):
                    holders.pop(k, None)
                for c in update if update is not None else [c for c in own if c not in ("created_at", schema.key)]:
                    if c != schema.key:
                        row[c] = r[c]
                if schema.timestamps and "updated_at" not in own:
                    row["updated_at"] = at
                if id(row) not in fresh:
                    touched[id(row)] = row
            else:
                row = r
                if schema.increments and row.get(schema.key) is None:
                    row[schema.key] = next_id
                if schema.increments:
                    next_id = max(next_id, row[schema.key] + 1)
                if schema.key is None:
                    row[HIDDEN] = next_id
                    next_id += 1
                fresh[id(row)] = row
            for k in self._keys_of(row, rule):
                holders[k] = row
        written = [*touched.values(), *fresh.values()]
        if not written:
            return len(records)
        key = self._key_column(schema)
        batch = self._batch(written, schema, schema.key is None)
        rest = frame
        if touched:
            gone = F.broadcast(self._batch(list(touched.values()), schema, schema.key is None).select(names.quoted(key)))
            rest = frame.join(gone, key, "left_anti")
        self._check(batch, rest, len(written), rules(schema))
        segments = [self.connection._store.write(self.table, batch.coalesce(1))]
        files = sorted({r["__file"] for r in touched.values()})
        if files:
            segments.append(self.connection._store.write(self.table, self._within(frame, files).join(gone, key, "left_anti")))
        self.connection._change(self.table, {**self._replaced(entry, files, segments), "next_id": next_id})
        return len(records)

    # --- changes ---------------------------------------------------------------------------------------------------

    def _check(self, changed: DataFrame, rest: DataFrame, n: int, which: list[ir.IndexSchema]) -> None:
        """Refuse changed or new rows that break a rule among themselves or with the rest, naming the first broken in the
        order of declaration. The rest's rows are shuffled only if there are too many changed ones to broadcast."""
        for rule in which:
            mine = entries(changed, rule)
            small = F.broadcast(mine) if n <= BROADCAST_ROWS else mine
            if not mine.groupBy(*mine.columns).count().where("count > 1").isEmpty() or not entries(rest, rule).join(small, mine.columns, "left_semi").isEmpty():
                raise UniqueConstraintViolationException(self.table, rule.name)

    def _within(self, df: DataFrame, files: list[str], column: str = "_metadata.file_name") -> DataFrame:
        """The rows of some files: few names make a filter by which the others aren't opened."""
        if len(files) <= FILTERED:
            return df.where(F.col(column).isin(files))
        wanted = self.connection.spark.createDataFrame([(f,) for f in files], "__name string")
        return df.join(F.broadcast(wanted), F.col(column) == F.col("__name"), "left_semi")

    def _replaced(self, entry: dict[str, Any], files: list[str], segments: list[str]) -> dict[str, Any]:
        """The table without some files and with more segments; segments without files are left out."""
        without = {*entry.get("without", ()), *files}
        kept = []
        for segment in entry["segments"]:
            names_ = self.connection._store.files(segment) if files else set()
            if names_ and names_ <= without:
                without -= names_
            else:
                kept.append(segment)
        return {**entry, "segments": [*kept, *segments], "without": sorted(without)}

    def _marked(self, entry: dict[str, Any], schema: ir.TableSchema) -> tuple[DataFrame, DataFrame, int, list[str]]:
        """The table; the same with ``__file`` and ``__changed``; how many rows are to change and the files that hold them."""
        frame = self.connection._store.frame(entry)
        there, hit = self._split(schema, frame.withColumn("__file", F.col("_metadata.file_name")))
        marked = there.withColumn("__changed", hit)
        held = marked.where("__changed").groupBy("__file").count().collect()  # a row a file
        return frame, marked, sum(r["count"] for r in held), sorted(r["__file"] for r in held)

    def _matched_keys(self, schema: ir.TableSchema) -> DataFrame:
        """The keys of the rows that the query matches, each once."""
        key = self._key_column(schema)
        q = self.query
        if q.joins and (q.orders or q.random or q.limit is not None or q.offset):
            raise SchemaException("A write through a join takes no order and no limit.")
        plain = self.builder.clone()
        plain._query = q.but(columns=(), distinct=False)
        compiled = plain._compiled()
        df = compiled.matched()
        c = F.col(names.quoted(compiled.scope.physical(self.table, key))).alias("__match")
        if q.limit is not None or q.offset:
            orders = compiled._orders(False)
            df = compiled._paged(df.orderBy(*orders) if orders else df)
        out = df.select(c)
        return out.where("__match is not null").distinct() if q.joins else out

    def _split(self, schema: ir.TableSchema, frame: DataFrame) -> tuple[DataFrame, Column]:
        """The table and a condition that holds for matched rows; a plain filter is no join."""
        q = self.query
        if q.joins or q.limit is not None or q.offset:
            # Written once, as a random order would give others when asked again.
            keys = self._matched_keys(schema)
            self._kept = self.connection._store.write("_keys", keys)
            keys = self.connection.spark.read.schema(keys.schema).parquet(self._kept).withColumn("__hit", F.lit(True))
            key = self._key_column(schema)
            return frame.join(keys, F.col(names.quoted(key)) == F.col("__match"), "left"), F.coalesce(F.col("__hit"), F.lit(False))
        plain = self.builder.clone()
        compiled = plain._compiled(bare=True)
        condition = compiled.condition()
        return frame, F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))

    def _own_columns(self, values: dict[str, Any], schema: ir.TableSchema) -> dict[str, Any]:
        (own,) = self._own(values)
        self._known(schema, list(own))
        if schema.key in own:
            raise SchemaException(f"The key [{schema.key}] can't be changed.")
        return own

    def update(self, values: dict[str, Any]) -> int:
        entry, schema = self._entry()
        own = self._own_columns(values, schema)
        stored = enforcer.changes(own, schema, self.connection.timezone, self.connection.strict)
        types = {f.name: f.dataType for f in enforcer.struct(schema).fields}
        return self._rewrite(entry, schema, {c: literals.column(v).cast(types[c]) for c, v in stored.items()})

    def step(self, column: str, amount: Any, extra: dict[str, Any]) -> int:
        if isinstance(amount, bool) or not isinstance(amount, (int, float)) or not math.isfinite(amount):
            raise TypeError("A step is a finite number.")
        entry, schema = self._entry()
        own = self._own_columns(extra, schema)
        (named,) = self._own({column: 0})
        target = next(iter(named))
        self._own_columns({target: 0}, schema)
        c = schema.column(target)
        stored = enforcer.changes(own, schema, self.connection.timezone, self.connection.strict)
        types = {f.name: f.dataType for f in enforcer.struct(schema).fields}
        sets = {k: literals.column(v).cast(types[k]) for k, v in stored.items()}
        if target not in sets:
            old = F.col(names.quoted(target))
            if c.type in ("integer", "decimal"):
                if float(amount).is_integer():
                    sets[target] = old + F.lit(int(amount))
                elif self.connection.strict:
                    raise TypeError(f"Column [{target}] holds whole numbers.")
                else:
                    sets[target] = F.floor(old + F.lit(float(amount)) + 0.5)
            elif c.type == "float":
                sets[target] = old + F.lit(float(amount))
            else:
                raise TypeError(f"Column [{target}] holds no numbers.")
        return self._rewrite(entry, schema, sets)

    def _rewrite(self, entry: dict[str, Any], schema: ir.TableSchema, sets: dict[str, Column]) -> int:
        if not entry["segments"] or not sets:
            return 0
        if schema.timestamps and "updated_at" not in sets:
            sets = {**sets, "updated_at": literals.column(enforcer.now())}
        try:
            frame, marked, n, files = self._marked(entry, schema)
            if not n:
                return 0
            outputs = [F.when(F.col("__changed"), sets[c]).otherwise(F.col(names.quoted(c))).alias(c) if c in sets else F.col(names.quoted(c)) for c in frame.columns]
            broken = [r for r in rules(schema) if set(r.columns) & set(sets)]
            self._check(marked.where("__changed").select(*outputs), marked.where("not __changed"), n, broken)
            path = self.connection._store.write(self.table, self._within(marked, files, "__file").select(*outputs))
            self.connection._change(self.table, self._replaced(entry, files, [path]))
            return n
        finally:
            self._forget()

    def delete(self) -> int:
        entry, schema = self._entry()
        if not entry["segments"]:
            return 0
        try:
            frame, marked, n, files = self._marked(entry, schema)
            if n:
                rest = self._within(marked, files, "__file").where("not __changed").select(*[names.quoted(c) for c in frame.columns])
                self.connection._change(self.table, self._replaced(entry, files, [self.connection._store.write(self.table, rest)]))
            return n
        finally:
            self._forget()

    def _forget(self) -> None:
        """Delete the keys that a write had matched."""
        if self._kept is not None:
            self.connection._store.remove(self._kept)

    def truncate(self) -> None:
        self._unjoined("truncate")
        entry, _ = self._entry()
        self.connection._change(self.table, {**entry, "segments": [], "without": []})


