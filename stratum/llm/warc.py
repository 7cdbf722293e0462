"""WARC archives as a PySpark Python data source (format ``warc``).

Reading plans one partition per group of files (up to ``PLAN_BYTES``; the written manifest
names them, else the folder's ``*.warc`` and ``*.warc.gz``). A record's headers are parsed
first; predicates on record_type, record_id, target_uri and refers_to are pushed down and
checked on the headers, so a record that no query wants is skipped without decoding its block. The
``payload`` option says what happens to the blocks of the others: ``all`` (default) returns
the payload, ``verify`` checks its digest but keeps it in the task, ``none`` skips it.

Writing takes record_id, record_type, target_uri, payload, payload_digest (hex SHA-1),
payload_bytes and refers_to: a ``response`` carries its payload, a ``revisit`` only HTTP
headers and the id of the record it repeats. Each task writes its own files under new names;
the commit writes a manifest of the files of the tasks that succeeded.

Defined cases: a null payload is empty; a null id, URI or digest writes no such header and
reads as null; control characters in a URI are percent-encoded; an empty table writes an
empty manifest and reads as no rows; a record whose payload differs from its digest raises.
Memory is bounded by the largest record and one batch (``BATCH_BYTES``).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from stratum.session import ship_code

from .common import filesystem, scratch

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
FILE_BYTES, PLAN_BYTES, BATCH_BYTES = 256 << 20, 32 << 20, 4 << 20
LEAST_REVISIT = 1000  # smaller payloads are stored again rather than referred to
MANIFEST = "_manifest.json"
#: FIXED VALUES of the WARC 1.1 format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Column of each header that predicates are pushed to.
PUSHED = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to"}


def _clean(uri: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def record(row: dict) -> bytes:
    """One record's bytes."""
    payload, kind = row["payload"] or b"", row["record_type"]
    size = len(payload) if row["payload_bytes"] is None else row["payload_bytes"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", row["record_id"] and f"<{row['record_id']}>"), ("WARC-Target-URI", row["target_uri"] and _clean(row["target_uri"]))]
    if row["payload_digest"]:
        head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", row["refers_to"] and f"<{row['refers_to']}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.root = options["path"]
        self.gzip = options.get("compression", "gzip") == "gzip"

    def write(self, iterator):
        files, out, size = [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                data = record(row)
                if self.gzip:  # one member per record, so that readers can enter anywhere
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                if out is None or size + len(data) > FILE_BYTES:
                    if out is not None:
                        out.close()
                        files[-1][1] = size
                    name = f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip
                    fs, p = filesystem(self.root)
                    fs.create_dir(p, recursive=True)
                    out, size = fs.open_output_stream(f"{p}/{name}", compression=None), 0
                    files.append([name, 0])
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            files[-1][1] = size
        return Written(files)

    def commit(self, messages):
        fs, p = filesystem(self.root)
        fs.create_dir(p, recursive=True)
        with fs.open_output_stream(f"{p}/{MANIFEST}") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages):
        fs, p = filesystem(self.root)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{p}/{name}")


class _Stream:
    """Buffered bytes of a plain or gzip file."""

    def __init__(self, f, gzip: bool):
        self.f, self.gzip, self.buf, self.z, self.rest = f, gzip, b"", None, b""

    def _more(self) -> bool:
        if not self.gzip:
            got = self.f.read(1 << 20)
            self.buf += got
            return bool(got)
        while True:
            raw = self.rest or self.f.read(1 << 18)
            self.rest = b""
            if not raw:
                if self.z is not None and not self.z.eof:
                    raise ValueError("the archive ends within a record")
                return False
            if self.z is None or self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(raw, 1 << 20)
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                self.buf += got
                return True

    def head(self) -> bytes | None:
        """The next record's header lines; None at the end."""
        while (at := self.buf.find(b"\r\n\r\n")) < 0 or not self.buf.lstrip(b"\r\n"):
            self.buf = self.buf.lstrip(b"\r\n")
            if not self._more():
                if self.buf:
                    raise ValueError("the archive ends within a header")
                return None
        if self.buf[:2] == b"\r\n":
            self.buf = self.buf.lstrip(b"\r\n")
            return self.head()
        got, self.buf = self.buf[:at], self.buf[at + 4 :]
        return got

    def take(self, n: int) -> bytes:
        parts, have = [self.buf], len(self.buf)
        while have < n:
            self.buf = b""
            if not self._more():
                raise ValueError("the archive ends within a record")
            parts.append(self.buf)
            have += len(self.buf)
        data = b"".join(parts)
        self.buf = data[n:]
        return data[:n]

    def skip(self, n: int) -> None:
        """Past n bytes; a plain file is not read there."""
        have = min(n, len(self.buf))
        self.buf, n = self.buf[have:], n - have
        if n and not self.gzip:
            self.f.seek(n, 1)
        while n and self.gzip:
            if not self._more():
                raise ValueError("the archive ends within a record")
            have = min(n, len(self.buf))
            self.buf, n = self.buf[have:], n - have


class Files(InputPartition):
    def __init__(self, files):
        super().__init__(0)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.payload = options.get("payload", "all")
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in PUSHED and isinstance(f, EqualTo | In):
                self.tests.append(("in", PUSHED[column], tuple(f.value) if isinstance(f, In) else (f.value,)))
            elif column in PUSHED and isinstance(f, StringStartsWith):
                self.tests.append(("prefix", PUSHED[column], (f.value,)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs as pafs

        fs, p = filesystem(self.root)
        if fs.get_file_info(f"{p}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_file(f"{p}/{MANIFEST}") as f:
                files = json.loads(f.read())
        else:
            found = fs.get_file_info(pafs.FileSelector(p, recursive=True))
            files = sorted([x.path[len(p) + 1 :], x.size] for x in found if x.path.endswith((".warc", ".warc.gz")))
        groups, size = [[]], 0
        for name, n in files:
            if groups[-1] and size + n > PLAN_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += n
        return [Files(g) for g in groups]

    def _wanted(self, head: dict[str, str]) -> bool:
        for kind, key, values in self.tests:
            got = head.get(key)
            if got is None or not (got in values if kind == "in" else got.startswith(values)):
                return False
        return True

    def read(self, partition):
        fs, p = filesystem(self.root)
        rows, size = [], 0
        for name in partition.files:
            with fs.open_input_stream(f"{p}/{name}", compression=None) if name.endswith(".gz") else fs.open_input_file(f"{p}/{name}") as f:
                s = _Stream(f, name.endswith(".gz"))
                while (raw := s.head()) is not None:
                    # a line that begins with white space goes on with the header before it
                    lines = re.sub("\r\n[ \t]+", " ", raw.decode(errors="replace")).split("\r\n")
                    if not lines[0].startswith("WARC/"):
                        raise ValueError(f"{name}: not a WARC record: {lines[0][:80]!r}")
                    head: dict[str, str] = {}
                    for k, _, v in (x.partition(":") for x in lines[1:]):
                        head.setdefault(k.strip().lower(), v.strip())  # of repeated headers the first counts
                    for k in ("warc-record-id", "warc-refers-to"):
                        if k in head:
                            head[k] = head[k].removeprefix("<").removesuffix(">")
                    length = int(head["content-length"])
                    if not self._wanted(head):
                        s.skip(length)
                        continue
                    rows.append(self._row(s, head, length, name))
                    size += length
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _row(self, s: _Stream, head: dict, length: int, name: str) -> dict:
        digest = head.get("warc-payload-digest", "")
        digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
        payload = n = None
        if self.payload == "none":
            s.skip(length)
        else:
            block = s.take(length)
            if head.get("content-type", "").startswith("application/http"):
                http, _, payload = block.partition(b"\r\n\r\n")
                if m := re.search(rb"(?im)^content-length:\s*(\d+)", http):
                    n = int(m[1])
            else:
                payload, n = block, length
            if head.get("warc-type") == "revisit":
                payload = None
            elif digest is not None and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"{name}: the payload of {head.get('warc-record-id')} differs from its digest")
            else:
                n = len(payload)
        return {
            "record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"),
            "payload_digest": digest, "payload_bytes": n, "headers": list(head.items()), "payload": payload if self.payload == "all" else None,
        }


_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark) -> None:
    ship_code(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", prefix: str = "urn:page:") -> DataFrame:
    """Records to write: of equal payloads of ``LEAST_REVISIT`` bytes or more the largest id is
    the response and the others revisit it (rows that repeat that id are responses too)."""
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    d = d.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    slim = d.filter(F.col("n") >= LEAST_REVISIT).select("id", "digest")
    copied = slim.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    # ids meet their group in narrow rows; whole pages are joined on their own id
    revisits = slim.join(copied, "digest").filter("id IS NULL OR id < first").select("id", "digest", "first").distinct()
    own = d.alias("d").join(revisits.alias("r"), F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.digest") == F.col("r.digest")), "left")
    name = lambda c: F.concat(F.lit(prefix), c.cast("string"))
    again = F.col("r.first").isNotNull()
    return own.select(
        name(F.col("d.id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        F.when(~again, F.col("payload")).alias("payload"), F.col("d.digest").alias("payload_digest"), F.col("n").alias("payload_bytes"), name(F.col("r.first")).alias("refers_to"),
    )


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    register(records.sparkSession)
    records.write.format("warc").option("path", path).option("compression", compression).mode("append").save()


def read(spark, path: str, payload: str = "all") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", payload).load()


def archive(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and read them back: one row a page."""
    spark, root = pages.sparkSession, scratch(pages.sparkSession, "warc")
    write(with_revisits(pages), root)
    own = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS long)")
    return read(spark, root, "verify").select(own("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", own("refers_to").alias("refers_to"))
