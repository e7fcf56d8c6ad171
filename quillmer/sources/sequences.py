"""FASTA and FASTQ, plain or gzip-compressed, as a Spark data source; lists of files; tables as sequences.

    register(spark); spark.read.format("fastx").load(path)

gives ``RECORDS``.  A partition is one file: records of a compressed stream can't be found from its middle.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans import numbered, small, written

RECORDS = "file string, file_idx int, rec_no long, name string, comment string, seq binary, qual binary"
_BLANK = bytes(b for b in range(256) if not 33 <= b <= 126)


class SequenceError(ValueError):
    """A record that ends too early, or whose qualities don't match its letters."""


class _Cursor:
    """A stream of bytes, read line by line, taken piece by piece."""

    def __init__(self, stream: io.BufferedIOBase) -> None:
        self.lines, self.rest = iter(stream), b""

    def _more(self) -> bool:
        self.rest = self.rest or next(self.lines, b"")
        return bool(self.rest)

    def until(self, marks: re.Pattern) -> tuple[bytes, bytes]:
        """Everything up to the first mark, and the mark; an empty one at the end of the stream."""
        parts = []
        while self._more():
            found = marks.search(self.rest)
            if found:
                parts.append(self.rest[: found.start()])
                self.rest = self.rest[found.end() :]
                return b"".join(parts), found.group()
            parts.append(self.rest)
            self.rest = b""
        return b"".join(parts), b""

    def line(self) -> bytes:
        self._more()
        got, self.rest = self.rest, b""
        return got

    def skip_one(self) -> None:
        if self._more():
            self.rest = self.rest[1:]

    def visible(self, n: int) -> bytes:
        """The next ``n`` visible characters, or what there is."""
        got = b""
        while len(got) < n and self._more():
            here = self.rest.translate(None, _BLANK)
            if len(got) + len(here) < n:
                got, self.rest = got + here, b""
            else:
                need = n - len(got)
                at = next(i for i, seen in enumerate(accumulate(33 <= b <= 126 for b in self.rest), 1) if seen == need)
                got, self.rest = got + here[:need], self.rest[at:]
        return got


_RECORD, _END = re.compile(b"[>@]"), re.compile(b"[>@+]")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[str, str, bytes, bytes | None]]:
    """(name, comment, letters, qualities or None) of each record; FASTA and FASTQ may be mixed.

    A record starts at the next ``>`` or ``@``, wherever it stands.  Its name ends at the first white space, the comment
    with the line.  Letters go on over lines up to the next ``>``, ``@`` or ``+``; behind the line of a ``+`` as many
    qualities follow as there are letters, and what comes after them is skipped up to the next record.
    """
    src = _Cursor(stream)
    mark = src.until(_RECORD)[1]
    while mark:
        head = src.line().rstrip(b"\r\n")
        cut = next((i for i, b in enumerate(head) if b in b" \t\v\f\r"), len(head))
        name, comment = head[:cut].decode("utf-8", "replace"), head[cut + 1 :].decode("utf-8", "replace")
        letters, mark = src.until(_END)
        seq = letters.translate(None, _BLANK)
        if mark != b"+":
            yield name, comment, seq, None
            continue
        src.line()
        qualities = src.visible(len(seq))
        if len(qualities) < len(seq):
            raise SequenceError(f"record {name!r} has {len(seq)} letters but {len(qualities)} qualities")
        yield name, comment, seq, qualities
        src.skip_one()  # what ends the qualities belongs to no record
        mark = src.until(_RECORD)[1]


def open_plain(raw: io.BufferedIOBase) -> io.BufferedIOBase:
    """The stream, inflated if its first bytes are gzip's."""
    raw = raw if hasattr(raw, "peek") else io.BufferedReader(raw)
    return gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def _open(path: str) -> io.BufferedIOBase:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return open_plain(io.BufferedReader(store.open_input_file(at)))


class FastxFile(InputPartition):
    def __init__(self, path: str, index: int) -> None:
        self.path, self.index = path, index


class FastxReader(DataSourceReader):
    BATCH_BYTES = 8 << 20

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [FastxFile(p, i) for i, p in enumerate(self.paths)]

    def read(self, partition: FastxFile) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows, size = [], 0
        with _open(partition.path) as stream:
            for number, (name, comment, seq, qual) in enumerate(parse(stream)):
                rows.append((partition.path, partition.index, number, name, comment, seq, qual))
                size += len(seq) + len(qual or b"") + 100
                if size >= self.BATCH_BYTES:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)


class FastxSource(DataSource):
    """Options: ``path`` of one file or folder, or ``paths``, one a line."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        given = self.options.get("paths") or self.options.get("path") or ""
        paths = [p for p in given.split("\n") if p]
        if not paths:
            raise ValueError("no path given")
        return FastxReader([f for p in paths for f in expand(p)])


def expand(path: str) -> list[str]:
    """The file itself, or the files of a folder by name."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    if store.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    found = sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))
    base = path.rstrip("/")
    return [f"{base}/{f.rpartition('/')[2]}" for f in found]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastxSource)


def read_sequences(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Records of files in the order given."""
    register(spark)
    return spark.read.format("fastx").option("paths", "\n".join(paths)).load()


def read_list(spark: SparkSession, *lists: str) -> list[str]:
    """Paths from files with one path a line."""
    return [r["value"] for path in lists for r in spark.read.text(path).toLocalIterator() if r["value"].strip()]


def from_table(df: DataFrame, seq: str, file: str | None = None, name: str | None = None, comment: str | None = None, order: str | None = None) -> DataFrame:
    """Any table with a text column as records: ``file`` groups rows into files, ``order`` numbers them within."""
    of = F.col(file).cast("string") if file else F.lit("table")
    rows = df.select(of.alias("file"), (F.col(order) if order else F.monotonically_increasing_id()).alias("_order"), (F.col(name).cast("string") if name else F.lit("")).alias("name"), (F.col(comment).cast("string") if comment else F.lit("")).alias("comment"), F.col(seq).cast("binary").alias("seq"))
    # rows are written once, so that their own numbers hold; then keys only are numbered, never texts
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "records")
    places = numbered(rows.select("file", "_order", "name", "_row"), "_place").select("_row", "_place")
    files = numbered(rows.select("file").distinct(), "file_idx")
    first = rows.select("file", "_row").join(places, "_row").groupBy("file").agg(F.min("_place").alias("_first"))
    out = rows.join(places, "_row").join(small(files.join(first, "file")), "file")
    return out.select("file", F.col("file_idx").cast("int").alias("file_idx"), (F.col("_place") - F.col("_first")).alias("rec_no"), "name", "comment", "seq", F.lit(None).cast("binary").alias("qual"))


def write_fasta(records: DataFrame, path: str) -> None:
    """Write ``records(name, comment, seq)`` as FASTA text files."""
    head = F.concat(F.lit(">"), F.col("name"), F.when(F.coalesce(F.col("comment"), F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), F.col("comment"))))
    records.select(F.concat(head, F.lit("\n"), F.col("seq").cast("string")).alias("value")).write.mode("overwrite").text(path)
