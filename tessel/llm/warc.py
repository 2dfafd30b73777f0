"""WARC archives: write, normalise, index and read back.

A writer puts each record of its rows into one file that is a single gzip stream, as a
careless crawler would.  The normaliser inflates such a file once, from front to back,
rewrites every record as a gzip member of its own and writes a sidecar index of offsets
and lengths, so that any record can be read without the others.  Files go to the folder
that the cluster shares, under random names, and no task deletes what another may read: a
task that runs again reads the same input and leaves a file nobody lists.  What a task
wrote is known only from the rows it returns; the streams go when the members are stored.

Defined results: a null payload counts as empty; rows with a null id get a record each,
and are neither revisited nor revisit; of repeated rows of one id the payload's smallest
id is the response for all of them but one: rows of that id itself are responses.  An
empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store, drop, keep, new_path

#: Payloads of fewer bytes are always written whole.
MIN_REVISIT = 100
#: Uncompressed bytes of records in one archive at most, but for one larger record.
ARCHIVE_BYTES, CHUNK = 256 << 20, 1 << 20
_DATE = "2024-01-01T00:00:00Z"


#: Schemes of Hadoop's file systems, and those of the same stores here.
_SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def qualified(spark: SparkSession, folder: str) -> str:
    """The URI of a folder, on the file system that Spark would use for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    made = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if made.split(":", 1)[0] not in _SCHEMES:
        raise ValueError(f"archives can't be written to {made}")
    return made


def _open(uri: str):
    """(file system, path) of a qualified URI."""
    from pyarrow import fs

    scheme, rest = uri.split(":", 1)
    return fs.FileSystem.from_uri(f"{_SCHEMES[scheme]}:{rest if rest.startswith('//') else '//' + rest}")


def record(kind: str, uri: str, name: str, payload: bytes, digest: str, size: int, refers_to: str | None = None) -> bytes:
    """One record; digest and size are those of the full payload."""
    plain = quote(uri, safe="!#$%&'()*+,/:;=?@[]~", errors="surrogatepass")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Bytes: {size}",
        f"X-Page-Id: {name}",
        f"WARC-Target-URI: {plain}",
    ]
    if plain != uri:
        head.append("X-Target-Base64: " + base64.urlsafe_b64encode(uri.encode("utf-8", "surrogatepass")).decode())
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


class Inflating(io.RawIOBase):
    """The bytes of a gzip file of one or more members, inflated in chunks."""

    def __init__(self, source):
        self.source, self.left, self.out = source, b"", bytearray()
        self.box = zlib.decompressobj(31)

    def fill(self, n: int) -> None:
        while len(self.out) < n:
            if self.box.eof:
                self.left = self.box.unused_data or self.source.read(CHUNK)
                if not self.left:
                    return
                self.box = zlib.decompressobj(31)
            data = self.box.unconsumed_tail or self.left or self.source.read(CHUNK)
            self.left = b""
            got = self.box.decompress(data, CHUNK)
            if not data and not got and not self.box.eof:
                raise ValueError("a gzip stream breaks off")
            self.out += got

    def take(self, n: int) -> bytes:
        self.fill(n)
        got = bytes(self.out[:n])
        del self.out[:n]
        return got

    def head(self) -> bytes | None:
        """Up to the blank line after a record's headers; None at the end."""
        n = 4096
        while True:
            self.fill(n)
            at = self.out.find(b"\r\n\r\n")
            if at >= 0:
                return self.take(at + 4)
            if len(self.out) < n:
                if self.out.strip():
                    raise ValueError("a record breaks off")
                return None
            n *= 2


def parse(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(stream: Inflating) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, their bytes, payload) of each record."""
    while (head := stream.head()) is not None:
        fields = parse(head)
        payload = stream.take(int(fields["content-length"]))
        if len(payload) < int(fields["content-length"]) or stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record breaks off")
        yield fields, head, payload


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (id, uri, payload, digest, size, refers_to) as archives of one stream each.

    Returns one row per archive: archive (path), n (records).
    """

    def run(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        out, n, size, path = None, 0, 0, ""
        for batch in batches:
            for row in batch.to_pylist():
                payload = b"" if row["refers_to"] is not None else row["payload"]
                if out is not None and size + len(payload) > ARCHIVE_BYTES:
                    out.close(), sink.close()
                    yield pa.RecordBatch.from_pydict({"archive": [path], "n": [n]})
                    out, n, size = None, 0, 0
                if out is None:
                    path = f"{uuid.uuid4().hex}.warc.gz"
                    sink = fs.open_output_stream(f"{base}/{path}", compression=None)
                    out = gzip.GzipFile(fileobj=sink, mode="wb", compresslevel=4, mtime=0)
                name = "null" if row["id"] is None else str(row["id"])
                refers = None if row["refers_to"] is None else str(row["refers_to"])
                out.write(record("response" if refers is None else "revisit", row["uri"] or "", name, payload, row["digest"], row["size"], refers))
                n, size = n + 1, size + len(payload)
        if out is not None:
            out.close(), sink.close()
            yield pa.RecordBatch.from_pydict({"archive": [path], "n": [n]})

    return rows.select("id", "uri", "payload", "digest", "size", "refers_to").mapInArrow(run, "archive string, n long")


def normalise(archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive record by record as members, with a sidecar index.

    Returns one row per archive: archive, members (of the rewritten file's records).  The
    index of NAME.warc.gz is NAME.idx: lines of offset, length, type and page id.
    """

    def run(batches):
        fs, base = _open(source)
        to_fs, to = _open(target)
        to_fs.create_dir(to, recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new = f"{uuid.uuid4().hex}.warc.gz"
                n = offset = 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as raw, to_fs.open_output_stream(f"{to}/{new}", compression=None) as out, to_fs.open_output_stream(f"{to}/{new[:-8]}.idx", compression=None) as index:
                    for fields, head, payload in records(Inflating(raw)):
                        member = gzip.compress(head + payload + b"\r\n\r\n", 4, mtime=0)
                        out.write(member)
                        index.write(f"{offset} {len(member)} {fields['warc-type']} {fields['x-page-id']}\n".encode())
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"archive": [new], "members": [n]})

    return archives.select("archive").mapInArrow(run, "archive string, members long")


def read(archives: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """The records of normalised archives, each inflated alone from its place in the index.

    Returns id, uri, record_type, digest, size, refers_to, payload (empty for revisits).
    The digest and length of each response's payload must be the stated ones.
    """

    def run(batches):
        fs, base = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name[:-8]}.idx", compression=None) as file:
                    lines = file.read().decode().splitlines()
                found, held = [], 0
                with fs.open_input_file(f"{base}/{name}") as file:
                    for line in lines:
                        offset, length = map(int, line.split(" ")[:2])
                        [(fields, _, payload)] = records(Inflating(io.BytesIO(file.read_at(length, offset))))
                        if fields["warc-type"] == "response" and (f"sha256:{hashlib.sha256(payload).hexdigest()}" != fields["warc-payload-digest"] or len(payload) != int(fields["x-payload-bytes"])):
                            raise ValueError("a payload doesn't have its digest or length")
                        number = fields["x-page-id"]
                        found.append({"id": None if number == "null" else int(number), "uri": base64.urlsafe_b64decode(fields["x-target-base64"]).decode("utf-8", "surrogatepass") if "x-target-base64" in fields else fields["warc-target-uri"], "record_type": fields["warc-type"], "digest": fields["warc-payload-digest"][7:], "size": int(fields["x-payload-bytes"]), "refers_to": int(fields["x-refers-to-page"]) if "x-refers-to-page" in fields else None, "payload": payload})
                        held += len(payload)
                        if len(found) == 1000 or held > 8 * CHUNK:
                            yield _batch(found)
                            found, held = [], 0
                if found:
                    yield _batch(found)

    return archives.select("archive").mapInArrow(run, "id long, uri string, record_type string, digest string, size long, refers_to long, payload binary")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("size", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    return pa.RecordBatch.from_pylist(rows, schema)


def spread(archives: DataFrame) -> DataFrame:
    """One task for nearly each archive; the rows are few and small, so Spark would put them together."""
    return archives.repartition(max(1, 2 * archives.count()), "archive")


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, str]:
    """Write a record per row, normalise the archives, and return (their table, their folder).

    The smallest id of each payload of MIN_REVISIT bytes or more is found on digests alone,
    aggregated before the shuffle, and only digests that several ids have are kept.  Rows
    get it by an outer join, whose exchange Spark may split where one digest is frequent.
    """
    spark = pages.sparkSession
    store = Store(spark, "warc")
    folder = qualified(spark, folder) if folder else keep(qualified(spark, new_path(spark, "warc-files")))
    payload = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).alias("uri"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    large = rows.where((F.col("size") >= MIN_REVISIT) & F.col("id").isNotNull())
    first = store.table("first", large.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") < F.col("last")).select("digest", "first"))
    refers = F.when((F.col("size") >= MIN_REVISIT) & (F.col("first") < F.col("id")), F.col("first"))
    written = store.table("written", write(rows.join(first, "digest", "left").withColumn("refers_to", refers), f"{folder}/streams"))
    made = store.table("made", normalise(spread(written), f"{folder}/streams", f"{folder}/members"))
    drop(spark, f"{folder}/streams")
    store.drop("first", "written")
    return made, f"{folder}/members"


def report(pages: DataFrame) -> DataFrame:
    made, folder = archive(pages)
    found = read(spread(made), folder)
    return found.select(F.col("id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
