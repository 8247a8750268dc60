"""Files of bit-packed token ids.

A file holds documents one behind the other as one stream of ids, each in as many bits as the vocabulary's greatest id
needs. The stream is cut into blocks of BLOCK ids. Layout, all numbers little-endian:

    magic                      8 bytes
    blocks                     ids at `width` bits, lowest bit first, each block padded to whole bytes
    block offsets, block crcs  one u64 and one u32 a block
    documents                  i64 doc_id, u8 1 where there is one, u64 number of ids; a column each
    trailer                    u64 ids, u64 documents, u64 blocks, u64 offset of the tables, u32 crc of the tables, u32 block, u32 width, magic

Any stretch of ids is read by one seek to the block offsets it needs and is unpacked with array operations. Documents are
ranged by doc_id over tasks, and each task writes its own files under names that no other attempt uses; only the files
of attempts that Spark commits are listed in the manifest, so a lost executor leaves at most files that nobody reads.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import map_arrow, materialise, shared_dir, text_rows
from marquee.llm.packing import byte_bpe

MAGIC = b"MQBITS01"
TRAILER = struct.Struct("<QQQQIII8s")
#: Ids of a block; a multiple of 8, so that a block ends with a byte.
BLOCK = 4096
#: A file ends behind the document that brings it to so many ids or documents.
FILE_IDS, FILE_DOCUMENTS = 1 << 25, 1 << 20
#: Blocks that a reader unpacks at a time.
CHUNK = 256
#: Files read by one task each, beyond which tasks take several.
READERS = 20_000


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> np.ndarray:
    """The ids at `width` bits each (1 to 32), lowest bit first, as bytes."""
    n = len(ids)
    eight = np.zeros((-(-n // 8), 8), np.uint64)
    eight.reshape(-1)[:n] = ids
    out = np.zeros((len(eight), width), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * width, 8)
        value = eight[:, lane] << np.uint64(shift)
        for k in range(-(-(shift + width) // 8)):
            out[:, byte + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.reshape(-1)[: -(-n * width // 8)]


def unpack_bits(packed: np.ndarray, n: int, width: int) -> np.ndarray:
    """The n ids that pack_bits() wrote."""
    groups = -(-n // 8)
    padded = np.zeros(groups * width, np.uint8)
    padded[: len(packed)] = packed[: len(padded)]
    rows = padded.reshape(groups, width)
    out = np.empty((groups, 8), "<u4")
    mask = np.uint64((1 << width) - 1)
    for lane in range(8):
        byte, shift = divmod(lane * width, 8)
        value = np.zeros(groups, np.uint64)
        for k in range(-(-(shift + width) // 8)):
            value |= rows[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, lane] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class IdWriter:
    """Writes one file as documents come; holds a block of ids and the table of documents."""

    def __init__(self, path: str, width: int, block: int = BLOCK) -> None:
        store, inside = open_store(path)
        store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        self.path, self.width, self.block = path, width, block
        self.out = store.open_output_stream(inside)
        self.out.write(MAGIC)
        self.at, self.ids = len(MAGIC), 0
        self.rest = np.zeros(0, "<u4")
        self.offsets: list[int] = []
        self.crcs: list[int] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def _put(self, ids: np.ndarray) -> None:
        size = -(-self.block * self.width // 8)
        packed = memoryview(pack_bits(ids, self.width))
        for a in range(0, len(packed), size):
            self.offsets.append(self.at + a)
            self.crcs.append(zlib.crc32(packed[a : a + size]))
        self.out.write(packed)
        self.at += len(packed)

    def add(self, docs: list[int | None], ids: list[bytes]) -> None:
        """Append documents, each given by its ids as little-endian 32-bit numbers."""
        self.docs += docs
        self.counts += [len(i) // 4 for i in ids]
        stream = np.concatenate([self.rest, np.frombuffer(b"".join(ids), "<u4")])
        self.ids += len(stream) - len(self.rest)
        whole = len(stream) // self.block * self.block
        if whole:
            self._put(stream[:whole])
        self.rest = stream[whole:].copy()

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        tables = b"".join(
            np.asarray(values, kind).tobytes()
            for values, kind in (
                (self.offsets, "<u8"),
                (self.crcs, "<u4"),
                ([d or 0 for d in self.docs], "<i8"),
                ([d is not None for d in self.docs], "u1"),
                (self.counts, "<u8"),
            )
        )
        self.out.write(tables)
        self.out.write(TRAILER.pack(self.ids, len(self.docs), len(self.offsets), self.at, zlib.crc32(tables), self.block, self.width, MAGIC))
        self.out.close()


class IdReader:
    """Random access to the documents and ids of one file."""

    def __init__(self, path: str) -> None:
        store, inside = open_store(path)
        self.file = store.open_input_file(inside)
        size = self.file.size()
        tail = self.file.read_at(TRAILER.size, size - TRAILER.size) if size >= len(MAGIC) + TRAILER.size else b""
        if tail[-8:] != MAGIC:
            raise ValueError(f"{path}: not a whole file of packed ids")
        self.ids_in_file, n_docs, blocks, self.end, crc, self.block, self.width, _ = TRAILER.unpack(tail)
        tables = self.file.read_at(size - TRAILER.size - self.end, self.end)
        if zlib.crc32(tables) != crc:
            raise ValueError(f"{path}: damaged tables")
        at = 0

        def column(n: int, kind: str) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(tables, kind, n, at)
            at += found.nbytes
            return found

        self.offsets, self.crcs = column(blocks, "<u8").astype(np.int64), column(blocks, "<u4")
        docs, known, counts = column(n_docs, "<i8"), column(n_docs, "u1"), column(n_docs, "<u8")
        self.docs = [d if k else None for d, k in zip(docs.tolist(), known.tolist())]
        self.starts = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])

    def ids(self, start: int, n: int) -> np.ndarray:
        """ids[start : start + n] of the file, fewer at its end; reads the blocks that hold them and no other."""
        n = min(n, self.ids_in_file - start)
        if n <= 0:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (start + n - 1) // self.block
        until = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end
        begin = int(self.offsets[first])
        raw = self.file.read_at(until - begin, begin)
        for k in range(first, last + 1):
            a = int(self.offsets[k]) - begin
            b = int(self.offsets[k + 1]) - begin if k < last else len(raw)
            if zlib.crc32(memoryview(raw)[a:b]) != self.crcs[k]:
                raise ValueError(f"damaged block {k}")
        held = min((last + 1) * self.block, self.ids_in_file) - first * self.block
        return unpack_bits(np.frombuffer(raw, np.uint8), held, self.width)[start - first * self.block :][:n]

    def document(self, n: int) -> np.ndarray:
        """Ids of the file's n-th document."""
        return self.ids(int(self.starts[n]), int(self.starts[n + 1] - self.starts[n]))

    def crc32s(self) -> list[int]:
        """Of each document the crc32 of its ids as little-endian 32-bit numbers; CHUNK blocks in memory at a time."""
        found = [0] * len(self.docs)
        doc, step = 0, CHUNK * self.block
        for a in range(0, self.ids_in_file, step):
            raw = memoryview(self.ids(a, min(step, self.ids_in_file - a)).tobytes())
            end = a + len(raw) // 4
            while doc < len(found):
                begin, until = int(self.starts[doc]), int(self.starts[doc + 1])
                if begin < end:
                    found[doc] = zlib.crc32(raw[4 * (max(begin, a) - a) : 4 * (min(until, end) - a)], found[doc])
                if until > end or begin >= end:
                    break
                doc += 1
        return found


MANIFEST = "part int, number int, path string, n_docs bigint, n_ids bigint"


def write_ids(docs: DataFrame, path: str, folder: str, end: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode docs and write their ids, `end` behind each document's, to files in `folder`; the manifest of the files.

    Files follow each other by (part, number) in ascending doc_id order, rows without doc_id first and repeated doc_ids
    by hash of their text; null text counts as empty. An empty table writes no file. A document is never split over
    files, so a very long one makes its file longer; only a block of it is held beside its text and ids.
    """
    rows = text_rows(docs).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path)
        width = width_of(coder.coder.n_vocab)
        mark = struct.pack("<I", end)
        part, number, writer = TaskContext.get().partitionId(), 0, None

        def closed() -> pa.RecordBatch:
            writer.close()
            columns = zip((part, number, writer.path, len(writer.docs), writer.ids), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in columns], names=["part", "number", "path", "n_docs", "n_ids"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                writer = writer or IdWriter(f"{folder}/part-{part:06d}-{number:05d}-{uuid.uuid4().hex}.ids", width)
                writer.add([doc], [coder.encode(text.as_py()) + mark])
                if writer.ids >= file_ids or len(writer.docs) >= FILE_DOCUMENTS:
                    yield closed()
                    number, writer = number + 1, None
        if writer:
            yield closed()

    return materialise(map_arrow(ranged.select("doc_id", "text"), run, MANIFEST))


def _files(manifest: DataFrame) -> DataFrame:
    """The manifest's files with the number of ids before each, one file a task. One small row a file goes to one task for the running sum."""
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = manifest.select("path", (F.sum("n_ids").over(order) - F.col("n_ids")).alias("first"))
    return placed.repartition(min(READERS, max(1, manifest.count())))


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                file = IdReader(path)
                columns = (file.docs, file.starts[:-1] + first, np.diff(file.starts), file.crc32s())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(_files(manifest), run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids array<bigint>) of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                file = IdReader(path)
                for n, doc in enumerate(file.docs):
                    row = ([doc], [first + int(file.starts[n])], [file.document(n).astype(np.int64)])
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["doc_id", "start", "ids"])

    return map_arrow(_files(manifest), run, "doc_id bigint, start bigint, ids array<bigint>")


def pack_ids(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write docs as files of packed ids and describe what they hold: (doc_id, start, n_tokens, ids_crc32), one row for each row of docs."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/marquee/ids-{uuid.uuid4().hex}"
    return read_digests(write_ids(docs, path, folder))
