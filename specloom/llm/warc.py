"""WARC archives with a two-level capture index: sorted keys in compressed blocks, and a sparse directory of the blocks."""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import math
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import common

#: Lines of an index block, bytes of an archive file, bytes of an archive that one fetching task reads, and the largest gap
#: between records that is read over rather than jumped.
BLOCK_LINES, FILE_BYTES, FETCH_BYTES, GAP = 2000, 1 << 30, 8 << 20, 1 << 16
#: A payload is hot if more than one in so many copied rows have it.
HOT = 1000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LEVEL = 6


def surt(url: str | None) -> str:
    """Sort-friendly key of a URL: host names reversed, then port, path and query; '-' for none."""
    if not url:
        return "-"
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url.strip())
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    if host.startswith("www."):
        host = host[4:]
    host = host if re.fullmatch(r"[\d.]+|.*:.*", host) else ",".join(reversed(host.split(".")))
    port = "" if port in (None, {"http": 80, "https": 443}.get(parts.scheme)) else f":{port}"
    return f"{host}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def gzip_member(data: bytes) -> bytes:
    """One gzip member, the same whenever it is made."""
    c = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def capture(kind: str, page_id: int | None, url: str | None, sha1: str, size: int, payload: bytes | None, refers_to: int | None = None) -> bytes:
    """A response with its payload, or a revisit of the page refers_to without one, as a gzip member."""
    fields = {
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None,
        "WARC-Payload-Digest": f"sha1:{sha1}",
        "WARC-Profile": REVISIT if kind == "revisit" else None,
        "WARC-Refers-To": record_id(refers_to) if kind == "revisit" else None,
        "X-Page-Id": page_id,
        "X-Payload-Length": size,
        "X-Refers-To-Page": refers_to,
        "Content-Type": "application/http; msgtype=response",
    }
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return gzip_member(record(kind, fields, http + (payload or b"")))


@dataclass
class Record:
    kind: str
    fields: dict[str, str]
    payload: bytes


def parse(data: bytes) -> Record:
    """A record from the bytes of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record was cut off")
    return Record(fields["WARC-Type"], fields, block.partition(b"\r\n\r\n")[2])


_MANIFEST = "surt string, page_id long, file string, offset long, length long, record_type string"


def write(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives every row, and returns the manifest: key, page, file, offset, length and type of each record.

    Of rows with equal payloads the one with the smallest page_id is a response, others revisit it. Payloads are compressed
    into records before the shuffle by digest. Digests of more than one in HOT rows are broadcast (HOT at most), so that
    their copies drop the payload before the shuffle and spread over all tasks; other revisits drop it after. Each task
    writes files of its own with unique names; only those of tasks that succeeded are in the manifest, so lost or repeated
    tasks leave no trace in it, just files that nothing refers to.
    """
    spark = pages.sparkSession
    folder = common.qualified(spark, folder)
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.cast("binary").alias("payload"))
    key = F.sha1("payload").alias("sha1")
    groups = rows.groupBy(key).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = common.cut(groups, "digests")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = groups.where(F.col("n") > max(1, total // HOT)).select("sha1", F.col("first").alias("hot_first"), F.lit(True).alias("hot"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, sha1s = (batch.column(i).to_pylist() for i in (0, 1, 3))
            sizes, members = [], []
            for i, u, p, s in zip(ids, urls, batch.column(2), sha1s, strict=True):
                payload = p.as_py()
                sizes.append(len(payload))
                members.append(capture("response", i, u, base64.b32encode(bytes.fromhex(s)).decode(), len(payload), payload))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int64()), pa.array(members, pa.binary())], names=["page_id", "url", "sha1", "size", "member"])

    made = common.arrow_map(rows.withColumn("sha1", key), make, "page_id long, url string, sha1 string, size long, member binary")
    other_than = lambda first: ~F.col("page_id").eqNullSafe(F.col(first))
    made = made.join(F.broadcast(hot), "sha1", "left")  # HOT rows at most
    made = made.withColumn("member", F.when(F.col("hot") & other_than("hot_first"), F.lit(None)).otherwise(F.col("member")))
    # copies of a hot payload are decided, and go anywhere
    made = made.withColumn("at", F.when(F.col("hot"), F.concat(F.lit("hot:"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("sha1")))
    joined = made.join(groups.where(F.col("n") <= max(1, total // HOT)).select(F.col("sha1").alias("at"), "first"), "at", "left")
    joined = joined.withColumn("first", F.when(F.col("hot"), F.col("hot_first")).otherwise(F.col("first"))).withColumn("copied", F.coalesce("hot", F.col("first").isNotNull()))
    member = F.when(F.col("copied") & other_than("first"), F.lit(None)).otherwise(F.col("member")).alias("member")
    joined = joined.select("page_id", "url", "sha1", "size", member, "first")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = common.file_system(folder)
        fs.create_dir(top, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found: list[list] = [[] for _ in range(6)]
                for i, u, s, n, member, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        out, at = fs.open_output_stream(f"{top}/{name}", compression=None), 0
                        info = gzip_member(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date": DATE, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, b"software: specloom\r\nformat: WARC File Format 1.1\r\n"))
                        out.write(info)
                        at += len(info)
                    kind = "response"
                    if member is None:
                        kind, member = "revisit", capture("revisit", i, u, base64.b32encode(bytes.fromhex(s)).decode(), n, None, first)
                    out.write(member)
                    for column, value in zip(found, (surt(u), i, name, at, len(member), kind), strict=True):
                        column.append(value)
                    at += len(member)
                types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types, strict=True)], names=["surt", "page_id", "file", "offset", "length", "record_type"])
        finally:
            if out is not None:
                out.close()

    return common.cut(common.arrow_map(joined, store, _MANIFEST), "manifest")


def index(manifest: DataFrame, folder: str, *, lines: int = BLOCK_LINES) -> list[dict]:
    """Sorts the manifest by key and writes it as index parts; returns the parts: a line for each, in order.

    A part is a file of gzip blocks of so many lines, and a directory file that has the first key, place and size of each
    block. Parts are ranges of keys and as many as Spark's shuffle partitions, so the list of parts stays small.
    """
    spark = manifest.sparkSession
    folder = common.qualified(spark, folder)
    order = [F.col("surt"), F.col("page_id")]
    rows = manifest.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order, "file", "offset")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = common.file_system(folder)
        name = f"cdx-{uuid.uuid4().hex}"
        out, at, block, entries, last = None, 0, [], [], None

        def flush() -> None:
            nonlocal at
            data = gzip_member("".join(f"{json.dumps(x)}\n" for x in block).encode())
            out.write(data)
            entries.append([*block[0][:2], at, len(data), len(block)])
            at += len(data)
            block.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}.gz", compression=None)
                block.append(row)
                last = row
                if len(block) == lines:
                    flush()
        if out is None:
            return
        if block:
            flush()
        out.close()
        with fs.open_output_stream(f"{top}/{name}.dir.gz", compression=None) as f:
            f.write(gzip_member("".join(f"{json.dumps(x)}\n" for x in entries).encode()))
        yield pa.RecordBatch.from_pylist([{"name": name, "first": json.dumps(entries[0][:2]), "last": json.dumps(last[:2]), "blocks": len(entries), "lines": sum(e[4] for e in entries)}])

    parts = common.cut(common.arrow_map(rows, build, "name string, first string, last string, blocks long, lines long"), "parts").collect()  # one row a partition
    return sorted((r.asDict() for r in parts), key=lambda p: sort_key(json.loads(p["first"])))


def sort_key(key: list | tuple) -> tuple:
    """Order of (surt, page_id) as Spark sorts it: by UTF-8, null first."""
    return key[0].encode(), key[1] is not None, key[1] or 0


class Reader:
    """Looks keys up: binary search over parts, over the directory of a part, and in one block, all read by range."""

    def __init__(self, folder: str, parts: list[dict], keep: int = 64):
        self.fs, self.top = common.file_system(folder)
        self.names = [p["name"] for p in parts]
        self.first = [sort_key(json.loads(p["first"])) for p in parts]
        self.keep, self.directories, self.blocks = keep, OrderedDict(), OrderedDict()

    def _held(self, cache: OrderedDict, key, make):
        if key not in cache:
            cache[key] = make()
            if len(cache) > self.keep:
                cache.popitem(last=False)
        cache.move_to_end(key)
        return cache[key]

    def directory(self, name: str) -> tuple[list[tuple], list[list]]:
        def make():
            with self.fs.open_input_file(f"{self.top}/{name}.dir.gz") as f:
                entries = [json.loads(x) for x in zlib.decompress(f.read(), 31).splitlines()]
            return [sort_key(e[:2]) for e in entries], entries

        return self._held(self.directories, name, make)

    def block(self, name: str, offset: int, size: int) -> tuple[list[tuple], list[list]]:
        def make():
            with self.fs.open_input_file(f"{self.top}/{name}.gz") as f:
                f.seek(offset)
                rows = [json.loads(x) for x in zlib.decompress(f.read(size), 31).splitlines()]
            return [sort_key(r[:2]) for r in rows], rows

        return self._held(self.blocks, (name, offset), make)

    def find(self, key: tuple) -> Iterator[list]:
        """All lines with the key; equal keys may run on over blocks and parts."""
        part = max(0, bisect.bisect_left(self.first, key) - 1)
        while part < len(self.names) and self.first[part] <= key:
            keys, entries = self.directory(self.names[part])
            k = max(0, bisect.bisect_left(keys, key) - 1)
            while k < len(entries) and keys[k] <= key:
                own, rows = self.block(self.names[part], *entries[k][2:4])
                i = bisect.bisect_left(own, key)
                while i < len(own) and own[i] == key:
                    yield rows[i]
                    i += 1
                k += 1
            part += 1


def lookup(spark: SparkSession, wanted: DataFrame, folder: str, parts: list[dict]) -> DataFrame:
    """Lines of the index for each distinct (surt, page_id) of wanted. Keys are sorted first, so a task reads a block once."""
    folder = common.qualified(spark, folder)
    order = ["surt", "page_id"]
    rows = wanted.select(*order).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last = Reader(folder, parts), None
        for batch in batches:
            found: list[list] = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != last:
                    found += reader.find(sort_key(key))
                last = key
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["surt", "page_id", "file", "offset", "length", "record_type"])

    return common.arrow_map(rows, run, _MANIFEST)


def fetch_tasks(spark: SparkSession, size: int) -> int:
    """Tasks that read so many bytes of archives: one for each FETCH_BYTES, or the shuffle's partitions if they are more and
    each still has a few bytes to read."""
    return max(1, math.ceil(size / FETCH_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // GAP))


def fetch(spark: SparkSession, lines: DataFrame, folder: str, size: int, *, with_payload: bool = False) -> DataFrame:
    """The records at the given places, read by range: neighbours in a file are read at once. Responses must match their digest.

    size: bytes of the records in all, which sets the number of tasks; the table of places is far smaller than they are.
    """
    folder = common.qualified(spark, folder)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    tasks = fetch_tasks(spark, size)
    chunk = max(GAP, min(FETCH_BYTES, size // (4 * tasks)))  # some chunks a task, so that tasks are even
    rows = lines.select("file", "offset", "length").repartition(tasks, F.col("file"), F.floor(F.col("offset") / chunk)).sortWithinPartitions("file", "offset")

    def spans(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
        own: list[tuple[str, int, int]] = []
        for r in rows:
            if own and (r[0] != own[-1][0] or r[1] - own[-1][1] - own[-1][2] > GAP or r[1] - own[0][1] > FETCH_BYTES):
                yield own
                own = []
            own.append(r)
        if own:
            yield own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = common.file_system(folder)
        for batch in batches:
            for span in spans(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                base = span[0][1]
                with fs.open_input_file(f"{top}/{span[0][0]}") as f:
                    f.seek(base)
                    data = f.read(span[-1][1] + span[-1][2] - base)
                out: list[list] = [[] for _ in names]
                for _, offset, length in span:
                    r = parse(data[offset - base : offset - base + length])
                    sha1 = r.fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(r.fields["X-Payload-Length"])
                    if r.kind == "response" and (digest(r.payload) != sha1 or len(r.payload) != size):
                        raise ValueError(f"payload of {r.fields['WARC-Record-ID']} doesn't match its digest")
                    to_long = lambda k: int(r.fields[k]) if k in r.fields else None  # noqa: B023, E731
                    for column, value in zip(out, (to_long("X-Page-Id"), r.fields.get("WARC-Target-URI"), size, sha1, r.kind, to_long("X-Refers-To-Page"), r.payload), strict=False):
                        column.append(value)
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=names)

    return common.arrow_map(rows, run, schema)


def archive_and_read(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", with_payload: bool = False) -> DataFrame:
    """Writes all pages as WARC, indexes the records, looks every page up by its key and reads its record back.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to; with_payload adds the stored payload, which
    is empty in revisits. One row for each row of pages.

    A null html is an empty payload; a null url has the key '-'; a null page_id sorts first in the index, comes last when the
    original of equal payloads is chosen, and is a revisit unless all ids of its payload are null. Rows that repeat the
    original's page_id and payload are responses as well. An empty table gives no rows. Further columns are ignored.
    """
    spark = pages.sparkSession
    folder = common.shared_folder(spark, "warc")
    manifest = write(pages, folder, page_id=page_id, url=url, html=html)
    parts = index(manifest, folder)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["surt", "page_id"])

    wanted = common.arrow_map(pages.select(F.col(url).cast("string").alias("url"), F.col(page_id).cast("long").alias("page_id")), keys, "surt string, page_id long")
    size = manifest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return fetch(spark, lookup(spark, wanted, folder, parts), folder, size, with_payload=with_payload)
