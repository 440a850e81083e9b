"""Token ids in files of fixed-width bit packing, written and read by Spark.

Every id takes as many bits as the vocabulary's largest id needs. A file is

* a header: the mark ``TOKBITS1``, then four little-endian 32-bit numbers: bits per id,
  ids per block, the file's number in the order of all files, and 0;
* blocks of ``BLOCK_IDS`` ids (the last may be shorter), least significant bit first,
  each filled up to whole bytes;
* a footer: document ids (64 bits), whether each is known (8 bits), the documents' first
  ids and the end (64 bits each), block offsets (64 bits); then as 64-bit numbers how many
  documents, ids and blocks there are and where the footer starts, and the mark again.

A line feed follows the header, each block and the footer, so that Spark's text writer
can store them: files go to any store that Spark writes to, and a lost task is run again.
Block offsets and equal widths make any id's place computable; a block is unpacked by
numpy in one go (``TokenFile.ids``, ``TokenFile.document``). Ids are those of the
``tokenizers`` library with its defaults, by a faster encoder over the same merges (tested).

Scale: texts are sorted into ranges of the document id, one file each, and are tokenised
by the task that writes them, so nothing is stored in between. Rows of one id are spread by
their place in the input, so a hot id fills several files. A task holds one block and the
footer of a file, and the longest text's ids.
Where files start among all ids is a prefix sum over files, in groups of ``GROUP_FILES``.

Defined cases: a null or empty text has the end id alone; null ids come first and are kept
as null; rows that repeat an id follow each other in any order, each with its own start; a
very long text is one value of its task, over as many blocks as it needs; an empty table
writes one file without documents and gives an empty result; other columns are ignored,
whatever they are called.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.packing import Tokens
from corvane.llm.shared import cut, new_path

MARK = b"TOKBITS1"
BLOCK_IDS = 1 << 16
FILE_BYTES = 16 << 20
#: Bytes of text behind an id, as files are planned.
BYTES_PER_ID = 3
GROUP_FILES = 1024
ROWS = "file long, doc_id long, start long, n_tokens long, ids_crc32 long"


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, ``bits`` each, least significant bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    each = np.unpackbits(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack_bits(data, n: int, bits: int, skip: int = 0) -> np.ndarray:
    """The ``n`` ids after the first ``skip`` ones of packed ``data``, as little-endian 32-bit numbers."""
    if bits == 16:
        return np.frombuffer(data, "<u2", n, 2 * skip).astype("<u4")
    first = skip * bits
    part = np.frombuffer(data, np.uint8)[first // 8 : -(-(first + n * bits) // 8)]
    each = np.unpackbits(part, bitorder="little")[first % 8 : first % 8 + n * bits].reshape(n, bits)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :bits] = each
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(-1)


class TokenFile:
    """Random access to a file's bytes (any buffer: a value, or a memory map)."""

    def __init__(self, data) -> None:
        self.data = memoryview(data)
        tail = struct.calcsize("<4Q8s") + 1
        self.n_docs, self.n_ids, self.n_blocks, footer, mark = struct.unpack("<4Q8s", self.data[-tail:-1])
        head, self.bits, self.block_ids, self.number, _ = struct.unpack("<8s4I", self.data[:24])
        if head != MARK or mark != MARK:
            raise ValueError("not a token file, or one cut short")
        take = lambda kind, n, at: np.frombuffer(self.data, kind, n, at)
        self.doc_ids = take("<i8", self.n_docs, footer)
        self.known = take("u1", self.n_docs, footer + 8 * self.n_docs)
        self.starts = take("<u8", self.n_docs + 1, footer + 9 * self.n_docs)
        self.offsets = take("<u8", self.n_blocks, footer + 17 * self.n_docs + 8)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are touched."""
        out = []
        while start < stop:
            block, skip = divmod(start, self.block_ids)
            n = min(stop - start, self.block_ids - skip)
            out.append(unpack_bits(self.data[int(self.offsets[block]) :], n, self.bits, skip))
            start += n
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self) -> Iterator[np.ndarray]:
        """All documents in order, each block unpacked once."""
        parts, block, held = [], 0, np.zeros(0, "<u4")
        for n in np.diff(self.starts.astype(np.int64)):
            while len(held) < n:
                parts.append(held)
                n -= len(held)
                held = self.ids(block * self.block_ids, min((block + 1) * self.block_ids, self.n_ids))
                block += 1
            yield np.concatenate([*parts, held[:n]]) if parts else held[:n]
            parts, held = [], held[n:]


@lru_cache(maxsize=4)
def width(vocabulary: str, end_id: int) -> int:
    """Bits that the largest id of a tokenizers file, or the end id, needs."""
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    largest = max([end_id, *model["model"]["vocab"].values(), *(t["id"] for t in model.get("added_tokens", []))])
    return max(1, largest.bit_length())


def writer(vocabulary: str, end_id: int):
    """A partition of (doc_id, place, text) rows in order to the rows of one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda data: pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["part"])
        tokens, bits = Tokens(vocabulary), width(vocabulary, end_id)
        end = np.array([end_id], dtype="<u4").tobytes()
        header = struct.pack("<8s4I", MARK, bits, BLOCK_IDS, TaskContext.get().partitionId(), 0)
        yield row(header)
        at, docs, known, starts, offsets = len(header) + 1, array("q"), bytearray(), array("Q", [0]), array("Q")
        held, n_held, last, ids = [], 0, None, np.zeros(0, "<u4")
        for batch in batches:
            docs.extend(batch.column(0).fill_null(0).to_pylist())
            known.extend(batch.column(0).is_valid().to_pylist())
            for text in batch.column(2):
                text = text.as_py() or ""
                if text != last:
                    last, ids = text, np.frombuffer(tokens.of(text) + end, "<u4")
                starts.append(starts[-1] + len(ids))
                held.append(ids)
                n_held += len(ids)
                if n_held >= BLOCK_IDS:
                    together = np.concatenate(held)
                    for k in range(0, n_held - BLOCK_IDS + 1, BLOCK_IDS):
                        data = pack_bits(together[k : k + BLOCK_IDS], bits)
                        offsets.append(at)
                        at += len(data) + 1
                        yield row(data)
                    held = [together[n_held - n_held % BLOCK_IDS :]]
                    n_held = len(held[0])
        if n_held:
            data = pack_bits(np.concatenate(held), bits)
            offsets.append(at)
            at += len(data) + 1
            yield row(data)
        footer = np.array(docs, "<i8").tobytes() + bytes(known) + np.array(starts, "<u8").tobytes() + np.array(offsets, "<u8").tobytes()
        yield row(footer + struct.pack("<4Q8s", len(docs), starts[-1], len(offsets), at, MARK))

    return run


def write_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Tokenises ``docs`` and writes them under ``path`` in ascending order of ids; a file has the ids of
    as many bytes of text as would make ``file_bytes`` at ``BYTES_PER_ID``."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"), F.col(f"`{text_col}`").cast("string").alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = max(1, -(-n_bytes * width(vocabulary, end_id) // (8 * BYTES_PER_ID * file_bytes)))
    rows = texts.repartitionByRange(n_files, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    rows = rows.mapInArrow(writer(vocabulary, end_id), "part binary").select(F.col("part").cast("string").alias("value"))
    rows.write.option("lineSep", "\n").text(path)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            file = TokenFile(content.as_buffer())
            crcs = [zlib.crc32(ids.tobytes()) for ids in file.documents()]
            columns = [
                pa.array(np.full(file.n_docs, file.number, np.int64)), pa.array(file.doc_ids, pa.int64(), mask=file.known == 0),
                pa.array(file.starts[:-1].astype(np.int64)), pa.array(np.diff(file.starts.astype(np.int64))), pa.array(crcs, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files alone."""
    rows = cut(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_rows, ROWS), "token-rows")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("g", F.floor(F.col("file") / GROUP_FILES))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = files.groupBy("g").agg(F.sum("n").alias("n")).select("g", earlier(Window.orderBy("g")).alias("base"))
    inside = files.select("file", "g", earlier(Window.partitionBy("g").orderBy("file")).alias("before"))
    first = inside.join(groups, "g").select("file", (F.col("base") + F.col("before")).alias("first"))
    return rows.join(first, "file").select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, **options) -> DataFrame:
    """``docs`` written as token files under the shared folder, and read back."""
    path = new_path(docs.sparkSession, "token-files")
    write_files(docs, path, vocabulary, end_id, **options)
    return read_files(docs.sparkSession, path)
