"""An append-only log of writes to several tables, and its replay after a crash.

A segment is a folder of entries, published by a small file of its number; a segment whose
file isn't there was never written.  Entries are seq, tx_id, root, op (put, del), key, value,
participants (roots that the transaction writes) and is_commit.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import resolve
from .database import DEL, PUT, ConflictError, Database
from .files import Files

ENTRY = ("tx_id", "root", "op", "key", "value", "participants", "is_commit")


class Log:
    def __init__(self, database: Database, name: str = "wal"):
        self.database, self.spark, self.name = database, database.spark, name
        self.files = Files(self.spark, f"{database.path}/{name}")

    @property
    def segments(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("segments") if n.endswith(".json")]

    def append(self, entries: DataFrame, order: str = "seq") -> int:
        """Write entries as the next segment; they are ordered by seq within it.  Returns its number."""
        folder = f"data/{uuid.uuid4().hex}"
        entries.select(F.col(order).cast("long").alias("seq"), *ENTRY).write.parquet(f"{self.files.root}/{folder}")
        number = max(self.segments, default=-1) + 1
        if not self.files.create(f"segments/{number:012d}.json", json.dumps({"folder": folder})):
            raise ConflictError(f"segment {number} is there already or being written")
        return number

    def entries(self, after: int = -1) -> DataFrame | None:
        """All entries of the segments after one, with their segment."""
        parts = [self.spark.read.parquet(f"{self.files.root}/{json.loads(self.files.read(f'segments/{n:012d}.json'))['folder']}").withColumn("segment", F.lit(n)) for n in self.segments if n > after]
        return reduce(DataFrame.unionByName, parts) if parts else None

    @property
    def applied(self) -> int:
        return self.database.manifest["batches"].get(f"log:{self.name}", -1)

    def replay(self) -> int:
        """Apply the complete transactions of segments that weren't applied yet, as one version.

        The newest entry of each key by segment and seq wins.  The version that holds the
        changes also holds the last segment's number, so a replay that runs again changes
        nothing.  Transactions that aren't complete by then are given up.  Tables have the
        columns key and value, and key as their primary key.
        """
        db = self.database
        db.refresh()
        last, found = max(self.segments, default=-1), self.entries(self.applied)
        if found is None:
            return db.version
        whole = resolve.complete(found)
        roots = sorted(r.root for r in whole.select("root").distinct().collect())
        with db._change() as new:
            for root in roots:
                won = resolve.newest(whole.where(F.col("root") == root).select("key", "value", "op", "segment", "seq"), "key", ["segment", "seq"])
                meta = new["tables"][root]
                kinds = {f["name"]: F.col(f["name"]).cast(StructType.fromJson(meta["schema"])[f["name"]].dataType) for f in meta["schema"]["fields"]}
                put = F.col("op") == "put"
                changes = won.select(kinds["key"].alias("key"), F.when(put, kinds["value"]).alias("value"), F.when(put, PUT).otherwise(DEL).alias("_op"))
                new["tables"][root] = db._append(root, meta, changes)
            new["batches"][f"log:{self.name}"] = last
        return db.version

    def truncate(self) -> int:
        """Delete the segments that are applied; returns their number."""
        done = [n for n in self.segments if n <= self.applied]
        for n in done:
            own = f"segments/{n:012d}.json"
            self.files.delete(json.loads(self.files.read(own))["folder"])
            # the last number stays known, so that later segments are still later
            if n != max(self.segments):
                self.files.delete(own)
        return len(done)
