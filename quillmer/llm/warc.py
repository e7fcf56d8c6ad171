"""WARC archives with chunked records.

Writing: payloads become rows (record, chunk number, bytes) of at most ``CHUNK`` bytes, and each task appends the
chunks of its rows to one archive of gzip members, digesting as it goes.  Of records with equal payloads of at least
``MIN_DUPLICATE`` bytes that with the largest id is a response, the others are revisits of it.

Reading: an archive is inflated piece by piece; a payload comes back as rows of record identifier, chunk number and
the SHA-1 of the payload up to and with that chunk.  No record is held as a whole.

Defined results: a null or empty payload is a response of zero bytes; rows that repeat the largest id of their group
are responses each; a null id is written as such, read as null and never referred to unless all ids of its group
are null, when each is a response; control characters in a URL are percent-coded and a null URL is left out; an
empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize, pick, scratch, thrifty
from .files import publishing, reading

CHUNK = 256 << 10
MIN_DUPLICATE = 1000
DATE = "2000-01-01T00:00:00Z"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
CHUNK_SCHEMA = "page_id long, record_type string, refers_to long, declared_bytes long, declared_digest string, chunk_no long, bytes_so_far long, sha1_so_far string, last boolean"


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_duplicate: int = MIN_DUPLICATE) -> DataFrame:
    """(page_id, url, payload, bytes, digest, refers_to); refers_to is null for responses."""
    rows = pick(pages, page_id=id_col, url=url_col, payload=payload_col)
    rows = rows.withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("bytes") >= min_duplicate).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select("digest", "largest"), "payload-groups")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("largest")), F.lit(None)).otherwise(F.col("largest"))
    return attach(rows, groups, "digest", salt="page_id").select("page_id", "url", "payload", "bytes", "digest", refers.alias("refers_to"))


def chunked(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of :func:`with_roles`: revisits have one empty chunk.  Chunk numbers are laid out first, then each row cuts its own chunk."""
    response = F.col("refers_to").isNull()
    chunks = F.when(response, F.greatest(F.ceil(F.col("bytes") / chunk), F.lit(1))).otherwise(1).cast("int")
    numbered = rows.withColumn("chunks", chunks).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    data = F.when(response, F.substring("payload", (F.col("chunk_no").cast("long") * chunk + 1).cast("int"), F.lit(chunk))).otherwise(F.lit(b""))
    return numbered.select("page_id", F.when(F.col("chunk_no") == 0, F.col("url")).alias("url"), "bytes", "digest", "refers_to", "chunks", "chunk_no", data.alias("data"))


def _urn(page_id: int | None) -> str:
    return "null" if page_id is None else str(page_id)


def _head(page_id, url, size, digest, refers_to) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_urn(page_id)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}", "", ""]
    return ("\r\n".join(lines) + http).encode()


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Write one archive for each task that has rows; (path, records) of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = (b for b in batches if b.num_rows)
        batch = next(filled, None)
        if batch is None:
            return
        path = f"{folder}/pages-{TaskContext.get().partitionId():07d}.warc.gz"
        records = 0
        with publishing(path) as out:
            packer, sha = None, None
            while batch is not None:
                columns = (batch.column(x).to_pylist() for x in ("page_id", "url", "bytes", "digest", "refers_to", "chunks", "chunk_no", "data"))
                for page_id, url, size, digest, refers_to, chunks, number, data in zip(*columns, strict=True):
                    if number == 0:
                        packer, sha = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                        out.write(packer.compress(_head(page_id, url, size, digest, refers_to)))
                        records += 1
                    sha.update(data)
                    out.write(packer.compress(data))
                    if number == chunks - 1:
                        if refers_to is None and sha.hexdigest() != digest:
                            raise ValueError(f"chunks of page {page_id} don't add up to its digest")
                        out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                batch = next(filled, None)
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [records]})

    return materialize(chunks.mapInArrow(thrifty(write), "path string, records long"), "archives")


class _Inflating:
    """Bytes of a file of gzip members, inflated as they are asked for."""

    def __init__(self, src) -> None:
        self.src, self.packed, self.plain, self.member = src, b"", bytearray(), None

    def more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.src.read(64 << 10)
                if not self.packed:
                    return False
            self.member = self.member or zlib.decompressobj(31)
            got = self.member.decompress(self.packed, CHUNK)
            self.packed = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if self.member.eof:
                self.member = None
            if got:
                self.plain += got
                return True

    def upto(self, mark: bytes) -> bytes | None:
        """What comes before ``mark``, which is dropped; None at the end of the file."""
        seen = 0
        while (at := self.plain.find(mark, seen)) < 0:
            seen = max(0, len(self.plain) - len(mark))
            if not self.more():
                if self.plain.strip():
                    raise ValueError("the archive ends within a header")
                return None
        out = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return out

    def take(self, size: int) -> bytes:
        while len(self.plain) < size:
            if not self.more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.plain[:size])
        del self.plain[:size]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def records(path: str, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of CHUNK_SCHEMA and the chunk's bytes."""
    with reading(path) as src:
        stream = _Inflating(src)
        while (head := stream.upto(b"\r\n\r\n")) is not None:
            warc = _fields(head)
            left = int(warc["content-length"])
            if warc["warc-type"] in ("response", "revisit"):
                http = stream.upto(b"\r\n\r\n")
                left -= len(http) + 4
                size, digest = int(_fields(http)["content-length"]), warc["warc-payload-digest"].rpartition(":")[2]
                sha, so_far, number = hashlib.sha1(), 0, 0
                while True:
                    data = stream.take(min(left, chunk))
                    left, so_far = left - len(data), so_far + len(data)
                    sha.update(data)
                    yield _page(warc["warc-record-id"]), warc["warc-type"], _page(warc.get("warc-refers-to")), size, digest, number, so_far, sha.hexdigest(), not left, data
                    number += 1
                    if not left:
                        break
            while left:
                left -= len(stream.take(min(left, chunk)))
            stream.take(4)


def read_archives(archives: DataFrame, with_data: bool = False) -> DataFrame:
    """The chunk rows of all archives."""
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = CHUNK_SCHEMA + (", data binary" if with_data else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                for row in records(path):
                    rows.append(row[: len(names)])
                    held += len(row[9]) if with_data else 100
                    if held > (4 << 20):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return archives.select("path").repartition(parts, "path").mapInArrow(thrifty(read), schema)


def round_trip(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Write archives, read them back: one row per page, taken from what was read.

    A response's length and digest are those of the bytes read, and must be those declared."""
    archives = write_archives(chunked(with_roles(pages, **columns)), folder or scratch(pages.sparkSession, "warc"))
    whole = F.col("record_type") == "revisit"
    sound = whole | ((F.col("bytes_so_far") == F.col("declared_bytes")) & (F.col("sha1_so_far") == F.col("declared_digest")))
    rows = read_archives(archives).where("last")
    size = F.when(sound, F.when(whole, F.col("declared_bytes")).otherwise(F.col("bytes_so_far"))).otherwise(F.raise_error(F.lit("a payload differs from its header")).cast("long"))
    digest = F.when(whole, F.col("declared_digest")).otherwise(F.col("sha1_so_far"))
    return rows.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
