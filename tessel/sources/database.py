"""Versioned tables: immutable Parquet folders, described by manifests published whole.

A manifest names the folders, columns, keys and constraints of all tables, the texts of
views and the state of sequences.  Publishing the next one is the only change there is, so
a change of several tables is atomic and readers keep the version they opened.

A table with a primary key is a base, sorted by the key, and a log of changes: folders of
rows put or removed, and removed ranges, which stand in the manifest.  A write adds to the
log and doesn't touch the base; a read shadows the base's keys by the log's; when the log has
LOG_FOLDERS folders they are folded into one, and compact() drains the log into a new base.
An index is a relation of its own, sorted by its columns, written with each base; reads by
it add the rows of the log.
"""

from __future__ import annotations

import copy
import json
import re
import uuid
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import dml, resolve
from ..operators.txn import Staged
from .files import Files

MODES = ("create_or_open", "create_only", "open_existing", "read_only")
EMPTY = {"version": 0, "tables": {}, "views": {}, "sequences": {}, "schemas": ["main"], "batches": {}}
#: Folders of a log before they become one, and keys of an index read that become a filter.
LOG_FOLDERS, FEW_KEYS = 16, 1000
#: Types whose values a manifest can hold as the ends of a removed range.
_PLAIN = ("tinyint", "smallint", "int", "bigint", "string")
PUT, DEL = "put", "del"


class ConflictError(RuntimeError):
    """Another writer published first."""


class Database:
    def __init__(self, spark: SparkSession, path: str, mode: str = "create_or_open"):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), mode == "read_only"
        self.files = Files(spark, path)
        there = bool(self.files.names("manifests"))
        if there and mode == "create_only":
            raise FileExistsError(path)
        if not there and mode in ("open_existing", "read_only"):
            raise FileNotFoundError(path)
        if not there:
            self.files.create(self._manifest_name(0), json.dumps(EMPTY))
        self.refresh()

    # ---- versions

    @staticmethod
    def _manifest_name(version: int) -> str:
        return f"manifests/{version:012d}.json"

    @property
    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("manifests") if n.endswith(".json")]

    @property
    def version(self) -> int:
        return self.manifest["version"]

    def _at(self, version: int) -> dict:
        return json.loads(self.files.read(self._manifest_name(version)))

    def refresh(self) -> None:
        self.manifest = self._at(max(self.versions))

    def lag(self) -> int:
        """How many versions this reader is behind."""
        return max(self.versions) - self.version

    def keep_within(self, most: int) -> bool:
        """Go to the newest version if this reader is more than `most` versions behind."""
        late = self.lag() > most
        if late:
            self.refresh()
        return late

    def snapshot(self, version: int | None = None) -> Database:
        """A reader that stays at a version."""
        other = copy.copy(self)
        other.read_only = True
        other.manifest = self._at(self.version if version is None else version)
        return other

    def pin(self, version: int | None = None) -> str:
        """Keep a version from vacuum until unpin is given the name that this returns."""
        name = f"pins/{self.version if version is None else version}-{uuid.uuid4().hex}"
        self.files.create(name, "")
        return name

    def unpin(self, name: str) -> None:
        self.files.delete(name)

    def _publish(self, manifest: dict) -> None:
        if self.read_only:
            raise PermissionError("opened for reading")
        manifest = {**manifest, "version": self.version + 1}
        if not self.files.create(self._manifest_name(manifest["version"]), json.dumps(manifest)):
            raise ConflictError(f"version {manifest['version']} is there already or being written")
        self.manifest = manifest

    @contextmanager
    def _change(self):
        """A copy of the manifest to edit; it is published unless the block raises."""
        new = copy.deepcopy(self.manifest)
        yield new
        self._publish(new)

    # ---- reads

    def _folder(self, part: dict, meta: dict, *more: str) -> DataFrame:
        """The rows of a folder in the table's present columns."""
        raw, schema = self.spark.read.parquet(f"{self.path}/{part['folder']}"), StructType.fromJson(meta["schema"])
        return raw.select(*(F.col(part["stored"][f.name]).alias(f.name) if f.name in part["stored"] else F.lit(None).cast(f.dataType).alias(f.name) for f in schema), *more)

    def _empty(self, meta: dict) -> DataFrame:
        return self.spark.createDataFrame([], StructType.fromJson(meta["schema"]))

    @staticmethod
    def _live(df: DataFrame, meta: dict, seq: int) -> DataFrame:
        """Without the rows in ranges that were removed after seq."""
        for r in meta["ranges"]:
            if r["seq"] > seq:
                df = dml.range_delete(df, meta["primary_key"][0], r["lo"], r["hi"])
        return df

    def _changes(self, meta: dict) -> DataFrame | None:
        """The newest entry of each key in the log, with _op; no more than the log holds."""
        if not meta["log"]:
            return None
        parts = [self._live(self._folder(p, meta, "_op"), meta, p["seq"]).withColumn("_seq", F.lit(p["seq"])) for p in meta["log"]]
        every = reduce(DataFrame.unionByName, parts)
        if len(parts) > 1:
            every = every.withColumn("_n", F.row_number().over(Window.partitionBy(*meta["primary_key"]).orderBy(F.desc("_seq")))).where("_n = 1").drop("_n")
        return every.drop("_seq")

    def _state(self, meta: dict) -> DataFrame:
        base = self._live(self._folder(meta, meta), meta, -1) if meta["folder"] else self._empty(meta)
        parts = meta["log"]
        if not meta["primary_key"]:
            return reduce(DataFrame.unionByName, [base, *(self._folder(p, meta) for p in parts)])
        changes = self._changes(meta)
        if changes is None:
            return base
        # the log's keys, removed ranges included, shadow the base's
        every = reduce(DataFrame.unionByName, (self._folder(p, meta).select(*meta["primary_key"]) for p in parts))
        live = changes.where(F.col("_op") == PUT).drop("_op")
        return base.join(every, meta["primary_key"], "left_anti").select(*base.columns).unionByName(live) if meta["folder"] else live

    def table(self, name: str) -> DataFrame:
        return self._state(self.manifest["tables"][name])

    def layered(self, name: str, mode: str = "latest") -> DataFrame:
        """The rows a reader of a mode sees: the base alone (trie), or with the log."""
        meta = self.manifest["tables"][name]
        if resolve.READ_MODES[mode] == 0:
            return self._folder(meta, meta) if meta["folder"] else self._empty(meta)
        return self._state(meta)

    def get(self, name: str, mode: str = "latest", **key) -> DataFrame:
        """The row at a key as a mode sees it; the filter reaches the base's and the log's scans."""
        df = self.layered(name, mode)
        for column, value in key.items():
            df = df.where(F.col(column) == F.lit(value))
        return df

    def tables(self) -> list[str]:
        return sorted(self.manifest["tables"])

    def sql(self, text: str, args: Mapping | list | None = None) -> DataFrame:
        """Spark SQL over the tables and views of this version, with parameters.

        INSERT, UPDATE, DELETE and definitions change the database; see sources.sql.
        """
        from . import sql

        done = sql.execute(self, text, args)
        if done is not None:
            return self.spark.createDataFrame([(done,)], "changed long")
        return self.query(text, args)

    def query(self, text: str, args: Mapping | list | None = None) -> DataFrame:
        session = self.spark.newSession()
        own = copy.copy(self)
        own.spark = session
        for name in self.tables():
            own.table(name).createOrReplaceTempView(name.replace(".", "_"))
            if "." in name:
                text = re.sub(rf"(?<![\w.]){re.escape(name)}(?!\w)", name.replace(".", "_"), text)
        for name, view in self.manifest["views"].items():
            session.sql(f"create or replace temporary view {name.replace('.', '_')} as {view}")
        return session.sql(text, args)

    def stats(self, name: str) -> dict:
        """Estimates from the manifest, without reading rows: each put counts as a new row."""
        meta = self.manifest["tables"][name]
        rows = meta.get("rows", 0) + sum(p["puts"] - p["dels"] for p in meta["log"])
        folders = [f for f in (meta["folder"], *(p["folder"] for p in meta["log"]), *(i["folder"] for i in meta["indexes"].values())) if f]
        return {"version": self.version, "rows": max(0, rows), "exact": not meta["log"] and not meta["ranges"], "bytes": sum(map(self.files.size, folders)), "folders": len(folders)}

    # ---- writes

    @staticmethod
    def _meta(primary_key=(), not_null=(), unique=(), checks=None) -> dict:
        return {"primary_key": list(primary_key), "not_null": list(not_null), "unique": [list(u) for u in unique], "checks": dict(checks or {}), "indexes": {}, "folder": None, "stored": {}, "rows": 0, "log": [], "ranges": [], "seq": 0}

    def _write(self, name: str, df: DataFrame, sort: Sequence[str] = ()) -> tuple[str, dict]:
        """(folder, counts) of rows written; counts are taken while they are written."""
        folder = f"data/{name.replace('.', '_')}-{uuid.uuid4().hex}"
        counts = Observation()
        put = F.col("_op") == PUT if "_op" in df.columns else F.lit(True)
        if sort:
            df = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
        df = df.observe(counts, F.count(F.when(put, 1)).alias("puts"), F.count(F.when(~put, 1)).alias("dels"))
        df.write.parquet(f"{self.path}/{folder}")
        return folder, counts.get

    def _check(self, rows: DataFrame, meta: dict) -> None:
        dml.check_rows(rows, [*meta["not_null"], *meta["primary_key"]], meta["checks"])

    def _store(self, name: str, df: DataFrame, meta: dict) -> dict:
        """Write a state as a base, sorted by the key so that statistics prune by it, and check what was written."""
        folder, counts = self._write(name, df, meta["primary_key"])
        meta = {**meta, "folder": folder, "schema": df.schema.jsonValue(), "stored": {c: c for c in df.columns}, "rows": counts["puts"], "log": [], "ranges": []}
        made = self._folder(meta, meta)
        self._check(made, meta)
        keys = [k for k in (meta["primary_key"], *meta["unique"], *(i["columns"] for i in meta["indexes"].values() if i["unique"])) if k]
        dml.check_constraints(made, unique=keys)
        return {**meta, "indexes": {k: self._indexed(name, made, meta, i) for k, i in meta["indexes"].items()}}

    def _indexed(self, name: str, base: DataFrame, meta: dict, index: dict) -> dict:
        """An index with its relation written: its columns and the key, sorted by its columns."""
        columns = list(dict.fromkeys([*index["columns"], *meta["primary_key"]]))
        folder = self._write(f"{name}-index", base.select(*columns), index["columns"])[0] if meta["primary_key"] and meta["folder"] else None
        return {**index, "folder": folder, "stored": {c: c for c in columns}}

    def _append(self, name: str, meta: dict, changes: DataFrame) -> dict:
        """The table with rows (its columns and _op) added to the log, checked once they are written."""
        folder, counts = self._write(name, changes)
        part = {"folder": folder, "stored": {c: c for c in changes.columns if c != "_op"}, "seq": meta["seq"] + 1, "puts": counts["puts"], "dels": counts["dels"]}
        new = {**meta, "log": [*meta["log"], part], "seq": meta["seq"] + 1}
        rows = self._folder(part, meta, "_op")
        if meta["primary_key"]:
            self._check(rows.where(F.col("_op") == PUT).drop("_op"), meta)
            for columns in (*meta["unique"], *(i["columns"] for i in meta["indexes"].values() if i["unique"])):
                touched = rows.where(F.col("_op") == PUT).select(*columns).distinct()
                if not dml.violations_unique(self._state(new).join(touched, list(columns), "left_semi"), columns).isEmpty():
                    raise dml.ConstraintError(f"duplicate key in {', '.join(columns)}")
        else:
            self._check(rows.drop("_op"), meta)
            for columns in meta["unique"]:
                dml.check_constraints(self._state(new), unique=[columns])
        return self._folded(name, new)

    def _folded(self, name: str, meta: dict) -> dict:
        """With the log's folders made one if they are many; ranges still hold for the base."""
        if len(meta["log"]) < LOG_FOLDERS:
            return meta
        if not meta["primary_key"]:
            rows = reduce(DataFrame.unionByName, (self._folder(p, meta, "_op") for p in meta["log"]))
        else:
            entries = self._changes(meta)
            every = reduce(DataFrame.unionByName, (self._folder(p, meta).select(*meta["primary_key"]) for p in meta["log"])).distinct()
            # keys whose newest entry a range removed stay as removed
            rows = every.join(entries, meta["primary_key"], "left").withColumn("_op", F.coalesce("_op", F.lit(DEL))).select(*entries.columns)
        folder, counts = self._write(name, rows)
        part = {"folder": folder, "stored": {c: c for c in rows.columns if c != "_op"}, "seq": meta["seq"], "puts": counts["puts"], "dels": counts["dels"]}
        return {**meta, "log": [part]}

    @contextmanager
    def transaction(self):
        """A Staged view of all tables; its outermost changes are published together.

        Nothing is published if the block raises.
        """
        staged = Staged({n: self.table(n) for n in self.tables()})
        yield staged
        changes = staged.changes
        if changes:
            with self._change() as new:
                for name, df in changes.items():
                    if df is None:
                        del new["tables"][name]
                    else:
                        new["tables"][name] = self._store(name, df, new["tables"].get(name, self._meta()))

    def create_table(self, name: str, source: DataFrame | StructType, primary_key: Sequence[str] = (), not_null: Sequence[str] = (), unique: Sequence[Sequence[str]] = (), if_not_exists: bool = False, checks: Mapping[str, str] | None = None) -> None:
        """An empty table of a schema, or one with the rows of a DataFrame; checks: {name: SQL condition}."""
        if name in self.manifest["tables"]:
            if if_not_exists:
                return
            raise FileExistsError(name)
        if "." in name and name.split(".")[0] not in self.manifest["schemas"]:
            raise KeyError(f"no such schema: {name.split('.')[0]}")
        meta = self._meta(primary_key, not_null, unique, checks)
        with self._change() as new:
            new["tables"][name] = {**meta, "schema": source.jsonValue()} if isinstance(source, StructType) else self._store(name, source, meta)

    def _set(self, name: str, df: DataFrame) -> None:
        with self._change() as new:
            new["tables"][name] = self._store(name, df, new["tables"][name])

    def _fitted(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows in the table's columns, by name; columns that don't come are null."""
        schema = StructType.fromJson(self.manifest["tables"][name]["schema"])
        unknown = set(rows.columns) - set(schema.names)
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))

    def _upserted(self, name: str, rows: DataFrame, meta: dict) -> dict:
        """Rows put into the log; the last of several rows of one key wins."""
        rows, key = self._fitted(name, rows), meta["primary_key"]
        if key:
            turn = F.struct(F.monotonically_increasing_id().alias("_n"), *rows.columns)
            rows = rows.select(*key, turn.alias("_row")).groupBy(*key).agg(F.max_by("_row", "_row._n").alias("_row")).select(*(F.col("_row")[c].alias(c) for c in rows.columns))
        return self._append(name, meta, rows.withColumn("_op", F.lit(PUT)))

    def insert(self, name: str, rows: DataFrame, mode: str = "upsert") -> int:
        """mode: upsert (rows replace those of their key, the last of several wins), unique (an error), ignore.

        Only the rows are written, not the table.  Returns the version that has them.
        """
        meta = self.manifest["tables"][name]
        key = meta["primary_key"]
        if key and mode != "upsert":
            rows = self._fitted(name, rows)
            if mode == "unique":
                dml.insert_unique(self.table(name).limit(0), rows, key)
            there = rows.select(*key).distinct().join(self.table(name).select(*key), key, "left_semi")
            if mode == "unique" and not there.isEmpty():
                raise dml.ConstraintError(f"duplicate key in {', '.join(key)}")
            rows = rows.join(there, key, "left_anti") if mode == "ignore" else rows
        with self._change() as new:
            new["tables"][name] = self._upserted(name, rows, meta)
        return self.version

    def update(self, name: str, condition: Column, values: Mapping[str, Column]) -> int:
        """Set columns where the condition is true; returns the number of rows."""
        meta = self.manifest["tables"][name]
        key = meta["primary_key"]
        if not key:
            n = self.table(name).where(condition).count()
            self._set(name, dml.update_where(self.table(name), condition, values))
            return n
        old = self.table(name).where(condition)
        new_rows = dml.update_where(old, F.lit(True), values).withColumn("_op", F.lit(PUT))
        if set(values) & set(key):
            moved = new_rows.select(*key)
            if not dml.violations_unique(moved, key).isEmpty() or not moved.join(dml.delete(self.table(name), old, key), key, "left_semi").isEmpty():
                raise dml.ConstraintError(f"duplicate key in {', '.join(key)}")
            new_rows = new_rows.unionByName(old.join(moved, key, "left_anti").select(*old.columns).withColumn("_op", F.lit(DEL)))
        with self._change() as new:
            new["tables"][name] = made = self._append(name, meta, new_rows)
        return made["log"][-1]["puts"]

    def delete(self, name: str, condition: Column) -> int:
        """Remove the rows for which the condition is true; returns their number."""
        meta = self.manifest["tables"][name]
        gone = self.table(name).where(condition)
        if not meta["primary_key"]:
            n = gone.count()
            self._set(name, dml.delete_where(self.table(name), condition))
            return n
        kept = [F.col(c) if c in meta["primary_key"] else F.lit(None).cast(t).alias(c) for c, t in gone.dtypes]
        with self._change() as new:
            new["tables"][name] = made = self._append(name, meta, gone.select(*kept, F.lit(DEL).alias("_op")))
        return made["log"][-1]["dels"]

    def remove_range(self, name: str, key: str, low=None, high=None, count: bool = False) -> int | None:
        """Remove low <= key < high; returns the number of rows if asked for, which reads them.

        For the first column of the primary key this is a range in the manifest: nothing
        is read or written.
        """
        meta = self.manifest["tables"][name]
        plain = all(v is None or (isinstance(v, (int, str)) and not isinstance(v, bool)) for v in (low, high))
        if not (meta["primary_key"] and key == meta["primary_key"][0] and plain and StructType.fromJson(meta["schema"])[key].dataType.simpleString() in _PLAIN):
            return self.delete(name, dml.between(F.col(key), low, high))
        n = self.table(name).where(dml.between(F.col(key), low, high)).count() if count else None
        with self._change() as new:
            own = new["tables"][name]
            own["seq"] += 1
            own["ranges"].append({"lo": low, "hi": high, "seq": own["seq"]})
        return n

    def write_batch(self, name: str, log: DataFrame, key: str) -> int:
        """Ordered puts, deletes and range deletes (seq, op, key, key_hi, and value or the table's other columns) in one version."""
        meta = self.manifest["tables"][name]
        base = self.table(name)
        others = [c for c in base.columns if c != key]
        if "value" in log.columns and "value" not in others:
            log = log.withColumnRenamed("value", others[0])
        for c in others:
            if c not in log.columns:
                log = log.withColumn(c, F.lit(None).cast(dict(base.dtypes)[c]))
        entries = log.select(F.col("key"), "op", "key_hi", F.struct(*others).alias("value"), F.col("seq").cast("long"))
        points = resolve.newest(entries.where("op <> 'range'").select("key", "op", "value", "seq"), "key", ["seq"])
        ranges = entries.where("op = 'range'").select(F.col("key").alias("lo"), F.col("key_hi").alias("hi"), "seq")
        kind = dict(base.dtypes)[key]
        plain = [F.col("value")[c].alias(c) for c in others]
        put = resolve.outside(points.where("op = 'put'"), ranges, "key", "seq").select(F.col("key").cast(kind).alias(key), *plain, F.lit(PUT).alias("_op"))
        gone = base.select(F.col(key).alias("key"), F.lit(-1).cast("long").alias("seq")).join(put.select(F.col(key).alias("key")), "key", "left_anti")
        hit = gone.join(resolve.outside(gone, ranges, "key", "seq").select("key"), "key", "left_anti").select("key").unionByName(points.where("op = 'del'").select(F.col("key").cast(kind).alias("key"))).distinct()
        hit = hit.join(put.select(F.col(key).alias("key")), "key", "left_anti")
        removed = hit.select(F.col("key").alias(key), *(F.lit(None).cast(dict(base.dtypes)[c]).alias(c) for c in others), F.lit(DEL).alias("_op"))
        with self._change() as new:
            new["tables"][name] = self._append(name, meta, put.unionByName(removed).select(*base.columns, "_op"))
        return self.version

    def put_rows(self, name: str, rows: DataFrame, op: str = PUT) -> int:
        """Rows put, or keys removed, without a look at the table; one row for each key."""
        meta = self.manifest["tables"][name]
        with self._change() as new:
            new["tables"][name] = self._append(name, meta, self._fitted(name, rows).withColumn("_op", F.lit(op)))
        return self.version

    def write_changes(self, name: str, changes: DataFrame | None, ranges: Sequence[tuple] = ()) -> int:
        """Ranges (of the key's first column) removed, and then rows with _op, as one version."""
        with self._change() as new:
            own = new["tables"][name]
            if ranges:
                own["seq"] += 1
                own["ranges"] += [{"lo": lo, "hi": hi, "seq": own["seq"]} for lo, hi in ranges]
            if changes is not None:
                new["tables"][name] = self._append(name, own, changes)
        return self.version

    def apply_batch(self, name: str, stream: str, batch_id: int, rows: DataFrame) -> bool:
        """Upsert a stream's batch once: the manifest that holds it also holds its number."""
        self.refresh()
        if self.manifest["batches"].get(stream, -1) >= batch_id:
            return False
        with self._change() as new:
            new["tables"][name] = self._upserted(name, rows, new["tables"][name])
            new["batches"][stream] = batch_id
        return True

    def fork(self, name: str, target: str) -> None:
        """Another table with the same files; later changes of either don't show in the other."""
        with self._change() as new:
            new["tables"][target] = copy.deepcopy(new["tables"][name])

    def clear(self, name: str) -> None:
        with self._change() as new:
            new["tables"][name] |= {"folder": None, "stored": {}, "rows": 0, "log": [], "ranges": [], "indexes": {k: {**i, "folder": None} for k, i in new["tables"][name]["indexes"].items()}}

    def compact(self, name: str) -> None:
        """Drain the log into a new base."""
        self._set(name, self.table(name))

    def vacuum(self, retain: int = 1, min_age: float = 3600.0) -> int:
        """Forget all but the last and the pinned versions, and delete the folders that no kept one names.

        Folders younger than min_age seconds stay: another writer may be filling them.
        """
        pinned = {int(n.split("-")[0]) for n in self.files.names("pins")}
        kept = [v for k, v in enumerate(self.versions[::-1]) if k < retain or v in pinned]
        used = set()
        for v in kept:
            for t in self._at(v)["tables"].values():
                used |= {t["folder"], *(p["folder"] for p in t["log"]), *(i["folder"] for i in t["indexes"].values())}
        for v in set(self.versions) - set(kept):
            self.files.delete(self._manifest_name(v))
        for n, age in self.files.entries("_claims").items():
            if age > max(min_age, self.files.LEASE):
                self.files.delete(f"_claims/{n}")
        gone = [f"data/{n}" for n, age in self.files.entries("data").items() if f"data/{n}" not in used and age >= min_age]
        for f in gone:
            self.files.delete(f)
        return len(gone)

    # ---- definitions

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        if if_exists and name not in self.manifest["tables"]:
            return
        with self._change() as new:
            del new["tables"][name]

    def rename_table(self, name: str, to: str) -> None:
        with self._change() as new:
            if to in new["tables"]:
                raise FileExistsError(to)
            new["tables"][to] = new["tables"].pop(name)

    @staticmethod
    def _stored(meta: dict, change) -> None:
        for part in (meta, *meta["log"], *meta["indexes"].values()):
            part["stored"] = change(part["stored"])

    def add_column(self, name: str, column: str, kind: str) -> None:
        """Rows that are there read null."""
        added = StructType.fromDDL(f"`{column}` {kind}")[0]
        with self._change() as new:
            meta = new["tables"][name]
            schema = StructType.fromJson(meta["schema"])
            if column in schema.names:
                raise FileExistsError(column)
            meta["schema"] = StructType([*schema, added]).jsonValue()

    def drop_column(self, name: str, column: str) -> None:
        """A column of the key, a unique constraint or an index stays; other rules of it go with it."""
        with self._change() as new:
            meta = new["tables"][name]
            if column in meta["primary_key"] or any(column in u for u in meta["unique"]) or any(column in i["columns"] for i in meta["indexes"].values()):
                raise ValueError(f"{column} belongs to a key or an index")
            meta["schema"] = StructType([f for f in StructType.fromJson(meta["schema"]) if f.name != column]).jsonValue()
            meta["not_null"] = [c for c in meta["not_null"] if c != column]
            self._stored(meta, lambda s: {k: v for k, v in s.items() if k != column})

    def rename_column(self, name: str, column: str, to: str) -> None:
        with self._change() as new:
            meta = new["tables"][name]
            swap = lambda names: [to if n == column else n for n in names]
            schema = StructType.fromJson(meta["schema"])
            if to in schema.names:
                raise FileExistsError(to)
            for f in schema:
                f.name = to if f.name == column else f.name
            schema.names = swap(schema.names)
            meta["schema"] = schema.jsonValue()
            meta |= {"primary_key": swap(meta["primary_key"]), "not_null": swap(meta["not_null"]), "unique": [swap(u) for u in meta["unique"]]}
            for index in meta["indexes"].values():
                index["columns"] = swap(index["columns"])
            self._stored(meta, lambda s: {to if k == column else k: v for k, v in s.items()})

    def create_index(self, name: str, index: str, columns: Sequence[str], unique: bool = False, if_not_exists: bool = False) -> None:
        """A relation of the columns and the key, sorted by the columns; a constraint too if unique."""
        meta = self.manifest["tables"][name]
        if index in meta["indexes"]:
            if if_not_exists:
                return
            raise FileExistsError(index)
        if unique:
            dml.check_constraints(self.table(name), unique=[list(columns)])
        made = {"columns": list(columns), "unique": unique}
        with self._change() as new:
            base = self._folder(meta, meta) if meta["folder"] else self._empty(meta)
            new["tables"][name]["indexes"][index] = self._indexed(name, base, meta, made)

    def drop_index(self, name: str, index: str) -> None:
        with self._change() as new:
            del new["tables"][name]["indexes"][index]

    def index_entries(self, name: str, index: str) -> DataFrame:
        """The index's relation, of the base alone."""
        own = self.manifest["tables"][name]["indexes"][index]
        raw = self.spark.read.parquet(f"{self.path}/{own['folder']}")
        return raw.select(*(F.col(v).alias(k) for k, v in own["stored"].items()))

    def lookup(self, name: str, index: str, *values) -> DataFrame:
        """All rows with the given values in an index's columns.

        The index gives the keys of the base's rows; few keys become a filter that prunes
        the sorted base, more are joined.  The log's rows are looked at as they are.
        """
        meta = self.manifest["tables"][name]
        own, key = meta["indexes"][index], meta["primary_key"]
        asked = reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in zip(own["columns"], values, strict=True)))
        if not own["folder"]:
            return self.table(name).where(asked)
        keys = self.index_entries(name, index).where(asked).select(*key)
        few = keys.limit(FEW_KEYS + 1).collect()
        base = self._live(self._folder(meta, meta), meta, -1)
        if len(few) <= FEW_KEYS:
            hit = base.where(F.col(key[0]).isin([r[0] for r in few])).where(asked)
        else:
            hit = base.join(keys, key, "left_semi").select(*base.columns)
        changes = self._changes(meta)
        if changes is None:
            return hit
        every = reduce(DataFrame.unionByName, (self._folder(p, meta).select(*key) for p in meta["log"]))
        return hit.join(every, key, "left_anti").select(*base.columns).unionByName(changes.where(F.col("_op") == PUT).drop("_op").where(asked))

    def create_view(self, name: str, text: str, replace: bool = False, if_not_exists: bool = False) -> None:
        if name in self.manifest["views"] and not replace:
            if if_not_exists:
                return
            raise FileExistsError(name)
        with self._change() as new:
            new["views"][name] = text

    def drop_view(self, name: str) -> None:
        with self._change() as new:
            del new["views"][name]

    def create_schema(self, name: str) -> None:
        """Tables named NAME.table belong to it."""
        with self._change() as new:
            new["schemas"] = sorted({*new["schemas"], name})

    def drop_schema(self, name: str, cascade: bool = False) -> None:
        own = [t for t in self.tables() if t.startswith(f"{name}.")]
        if own and not cascade:
            raise ValueError(f"{name} holds {', '.join(own)}")
        with self._change() as new:
            new["schemas"] = [s for s in new["schemas"] if s != name]
            for t in own:
                del new["tables"][t]

    def create_sequence(self, name: str, start: int = 1, step: int = 1) -> None:
        with self._change() as new:
            new["sequences"][name] = {"next": start, "step": step}

    def drop_sequence(self, name: str) -> None:
        with self._change() as new:
            del new["sequences"][name]

    def nextval(self, name: str, n: int = 1) -> int:
        """The next value; with n, the first of n values that one version takes."""
        with self._change() as new:
            got = new["sequences"][name]["next"]
            new["sequences"][name]["next"] = got + n * new["sequences"][name]["step"]
        return got


def open_database(spark: SparkSession, path: str, mode: str = "create_or_open") -> Database:
    return Database(spark, path, mode)
