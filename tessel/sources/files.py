"""Small files in any store that Spark reaches, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; on a cluster
    the setting is required, since a machine's own folder isn't seen by the others.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    made = "file://" + tempfile.mkdtemp(prefix="tessel-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Files:
    """A writer that dies between its claim and its file holds others up for LEASE seconds at most."""

    LEASE = 30.0

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def entries(self, folder: str) -> dict[str, float]:
        """Names in a folder, with the seconds since each was written."""
        where, now = self._path(folder), time.time()
        return {s.getPath().getName(): now - s.getModificationTime() / 1000 for s in self.fs.listStatus(where)} if self.fs.exists(where) else {}

    def names(self, folder: str) -> list[str]:
        return sorted(self.entries(folder))

    def size(self, name: str) -> int:
        """Bytes of a file, or of all files of a folder."""
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file whole or not at all; False if it is there already or being written."""
        target = self._path(name)
        turn = None if self.fs.exists(target) else self._claim(name)
        if turn is None:
            return False
        draft = self._path(f"_drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(target.getParent())
        done = turn == max(self._turns(name)) and self._rename(draft, target)
        if not done:
            self.fs.delete(draft, False)
        return done

    def _rename(self, draft, target) -> bool:
        """Rename that fails if the target is there."""
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.gateway.new_array(kinds, 1)
        none[0] = kinds.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.fs.makeQualified(draft), self.fs.makeQualified(target), none)
        except Exception:
            return False
        return True

    def _turns(self, name: str) -> dict[int, float]:
        """Claims of a file by number, with their ages."""
        plain = name.replace("/", "-") + "."
        return {int(n[len(plain) :]): age for n, age in self.entries("_claims").items() if n.startswith(plain)}

    def _claim(self, name: str) -> int | None:
        """The number of the claim if it is ours.

        A file is created without overwriting, which stores do atomically.  A claim whose
        file hasn't come within LEASE is given up for the next number.
        """
        there = self._turns(name)
        if there and there[max(there)] < self.LEASE:
            return None
        turn = max(there, default=-1) + 1
        try:
            self.fs.create(self._path(f"_claims/{name.replace('/', '-')}.{turn}"), False).close()
        except Exception:
            return None
        return turn

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
