"""Token ids in binary files: frequency-ranked, byte-aligned variable length, control bytes apart from data bytes.

A file holds blocks of whole documents.  Ids are replaced by their rank in the corpus (the most frequent is 0);
a rank takes one to four bytes, little-endian, and two bits of a control byte say how many.  A reader looks up the
four lengths of each control byte in a table of 256 rows and gathers all values at once.

Layout, little-endian: ``MAGIC``, u32 number of ranks, u32 id of each rank; then blocks of
u32 documents, u64 ids, u64 data bytes; i64 document ids, u8 flags (1: the id is null), u64 ids of each document;
control bytes (four ids each); data bytes.

Defined results: a null text counts as empty and holds the end id alone; rows with a null id come first, of equal
ids in the order of their token ids; repeated rows are written each; an empty table gives no file and an empty
result; other columns are ignored.  A block is closed at about ``BLOCK_IDS`` ids, so one block and one text bound memory.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, kept, materialize, pick, scratch, text_slices, thrifty
from .files import publishing, reading

MAGIC = b"QTOKIDS1"
BLOCK_IDS = 1 << 20
END_ID = 1
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"

#: Control byte -> lengths of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 values."""
    v = values.astype(np.uint32)
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    quads = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    quads[: len(v)] = code
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    ends = np.cumsum(code.astype(np.int64) + 1)
    at = ends - code - 1
    data = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    data[at] = v & 0xFF
    for k in (1, 2, 3):
        more = np.flatnonzero(code >= k)
        data[at[more] + k] = (v[more] >> (8 * k)) & 0xFF
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lens = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lens, dtype=np.int64) - lens
    padded = np.zeros(len(data) + 3, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    words = np.ndarray((len(data),), "<u4", padded, strides=(1,))
    return words[at] & _MASK[lens]


class WordTokenizer:
    """A tokenizer whose ids of a text are those of its white-space-separated words, one after another; words are remembered.

    Words not seen lately are tokenized many at once, parted by a mark of one id that none of them holds.
    """

    MARK = "\x01"
    MEMO = 500_000

    def __init__(self, raw: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(raw)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        mark = self._ids([self.MARK])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None
        self.ends_word = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of each word.

        A Latin-1 word of letters, or of letters and a stop, is one or two pieces, and a piece's last id has the mark of
        a word's end: such words need nothing between them to be told apart.
        """
        plain, rest, pieces = [], [], []
        for i, w in enumerate(words):
            if max(w) < "\u0100" and (w.isalpha() or (w[-1] in ".,;:!?" and w[:-1].isalpha())):
                plain.append(i)
                pieces.append(1 if w[-1].isalpha() else 2)
            else:
                rest.append(i)
        out: list[bytes] = [b""] * len(words)
        if plain:
            ids = np.array(self._ids(["\n".join([words[i] for i in plain])])[0], self.dtype)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == sum(pieces):
                data = ids.tobytes()
                cut = [0, *(self.dtype.itemsize * ends[np.cumsum(pieces) - 1]).tolist()]
                for i, a, z in zip(plain, cut, cut[1:], strict=False):
                    out[i] = data[a:z]
            else:
                rest += plain
        if rest:
            for i, x in zip(rest, self._marked([words[i] for i in rest]), strict=True):
                out[i] = x
        return out

    def _marked(self, words: list[str]) -> list[bytes]:
        if self.mark is None or any(self.MARK in w for w in words):
            return [np.array(x, self.dtype).tobytes() for x in self._ids(words)]
        ids = np.array(self._ids([f"\n{self.MARK}\n".join(words)])[0], self.dtype)
        cut = self.dtype.itemsize * np.flatnonzero(ids == self.mark)
        if len(cut) != len(words) - 1:
            return [np.array(x, self.dtype).tobytes() for x in self._ids(words)]
        data, begin = ids.tobytes(), [0, *(cut + self.dtype.itemsize).tolist()]
        return [data[a:z] for a, z in zip(begin, [*cut.tolist(), len(data)], strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        lists = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        offsets = lists.offsets.to_numpy()
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.memo) > self.MEMO:
            self.memo, self.old = {}, self.memo
        memo, old = self.memo, self.old
        memo[""] = b""  # between white space at an edge and the edge
        found = list(map(memo.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        ask = []
        for i in missing:
            x = old.get(words[i])
            if x is None:
                ask.append(i)
            else:
                found[i] = memo[words[i]] = x
        for at in range(0, len(ask), 1024):
            part = ask[at : at + 1024]
            for i, x in zip(part, self._new([words[i] for i in part]), strict=True):
                found[i] = memo[words[i]] = x
        flat = np.frombuffer(b"".join(found), self.dtype)
        lens = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        begin = np.cumsum(lens) - lens
        index = coded.indices.to_numpy()
        n = lens[index] if len(index) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1]) + np.repeat(begin[index] - ends + n, n)] if len(n) else flat[:0]
        bounds = np.append(0, ends)
        return ids, bounds[offsets - offsets[0]]


def tokenized(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, width, ids): the ids of each text and the end id, little-endian in ``width`` bytes each."""
    with open(tokenizer_path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = kept(__name__, zlib.crc32(raw.value), lambda: WordTokenizer(raw.value))
        width = tool.dtype.itemsize
        for b in text_slices(batches, "text", 24 << 20):
            ids, bounds = tool.encode(b.column("text"))
            n = b.num_rows
            with_end = np.insert(ids, bounds[1:], end_id)
            offsets = width * (bounds + np.arange(n + 1))
            made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(with_end)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), pa.array(np.full(n, width, np.int8)), made], ["doc_id", "width", "ids"])

    return pick(docs, id=id_col, text=text_col).mapInArrow(thrifty(run), "doc_id long, width byte, ids binary")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, and the number in each row."""
    width = batch.column("width")[0].as_py()
    raw, offsets = buffers(batch.column("ids"))
    return raw.view(f"<u{width}"), np.diff(offsets) // width


def ranking(ids: DataFrame) -> np.ndarray:
    """Ids by descending number in the corpus, then by id.  The driver gets one row for each id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in text_slices(batches, "ids", 16 << 20):
            got = np.bincount(_flat(b)[0])
            if len(got) > len(total):
                got[: len(total)] += total
                total = got
            else:
                total[: len(got)] += got
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    counts = ids.select("width", "ids").mapInArrow(thrifty(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.uint32)


def write_files(ids: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Write (doc_id, width, ids) in ascending order of doc_id; (shard, path, n_docs, n_ids) of each file, in that order."""
    spark = ids.sparkSession
    by_rank = ranking(ids)
    table = spark.sparkContext.broadcast(by_rank)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = table.value
        rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 0, np.uint32)
        rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        slices = text_slices(batches, "ids", 2 * BLOCK_IDS)
        head = next(slices, None)
        if head is None:
            return
        shard = TaskContext.get().partitionId()
        path = f"{folder}/ids-{shard:07d}.bin"
        n_docs = n_ids = 0
        with publishing(path) as out:
            out.write(MAGIC + struct.pack("<I", len(by_rank)) + by_rank.astype("<u4").tobytes())
            block = head
            while block is not None:
                flat, lens = _flat(block)
                control, data = pack(rank[flat])
                names = block.column("doc_id")
                out.write(struct.pack("<IQQ", len(lens), len(flat), len(data)))
                out.write(names.fill_null(0).to_numpy().astype("<i8").tobytes())
                out.write(names.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
                out.write(lens.astype("<u8").tobytes())
                out.write(control)
                out.write(data)
                n_docs, n_ids = n_docs + len(lens), n_ids + len(flat)
                block = next(slices, None)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]}, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    return materialize(ordered.mapInArrow(thrifty(write), "shard long, path string, n_docs long, n_ids long"), "shards")


def blocks(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, null flags, lengths, token ids) of each block of a file."""
    with reading(path) as src:
        if src.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} isn't a file of token ids")
        (size,) = struct.unpack("<I", src.read(4))
        by_rank = np.frombuffer(src.read(4 * size), "<u4")
        while head := src.read(20):
            docs, n, data = struct.unpack("<IQQ", head)
            names = np.frombuffer(src.read(8 * docs), "<i8")
            nulls = np.frombuffer(src.read(docs), np.uint8)
            lens = np.frombuffer(src.read(8 * docs), "<u8").astype(np.int64)
            control = src.read(-(-n // 4))
            yield names, nulls, lens, by_rank[unpack(control, src.read(data), n)]


def read_files(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, and its ids if asked for."""
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = shards.select("path", F.coalesce(before, F.lit(0)).alias("start")).repartition(parts, "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                for names, nulls, lens, ids in blocks(path):
                    data = memoryview(ids.astype("<u4").tobytes())
                    ends = np.cumsum(lens)
                    spans = list(zip((4 * (ends - lens)).tolist(), (4 * ends).tolist(), strict=True))
                    columns = [pa.array(names, pa.int64(), mask=nulls.astype(bool)), pa.array(start + ends - lens), pa.array(lens), pa.array([zlib.crc32(data[a:z]) for a, z in spans], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([bytes(data[a:z]) for a, z in spans], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                    start += int(ends[-1]) if len(ends) else 0

    return starts.mapInArrow(thrifty(read), SCHEMA + (", ids binary" if with_ids else ""))


def round_trip(docs: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, write files, read them back."""
    ids = materialize(tokenized(docs, tokenizer_path, id_col, text_col), "token-ids")
    return read_files(write_files(ids, folder or scratch(docs.sparkSession, "token-files")))
