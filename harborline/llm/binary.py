"""Token ids in binary files: fixed-width bit packing with block offsets.

A file holds, in this order: the ids in blocks of ``BLOCK`` ids, every id in the minimum
number of bits its vocabulary needs, lowest bit first; the documents' ids (int64) and null
marks (uint8); the end of every document in ids (uint64); the byte offset of every block
and the end of the last (uint64); and a trailer of fixed size. A reader finds the block of
any id by division and unpacks it without reading others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.tokens import default_vocabulary, encoder
from harborline.llm.wordhash import text_slices
from harborline.sources.durable import shared_folder, stored

BLOCK = 8192  # ids; a multiple of 8, so blocks start at a byte
MAGIC = b"HLTOKEN1"
TRAILER = struct.Struct("<QQIIQ8s")  # documents, ids, bits, block, start of the tables, magic
END_ID = 2


def bits_for(vocabulary: int) -> int:
    """Bits that hold any id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # whole bytes, the same layout
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(flags.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little")
    return flags.reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class TokenWriter:
    """Writes one file; it appears under its name only when it is whole."""

    def __init__(self, uri: str, bits: int):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.draft = f"{self.path}.{uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft)
        self.bits = bits
        self.open: list[np.ndarray] = []
        self.held = self.ids = self.at = 0
        self.offsets = [0]
        self.docs: list[tuple[int, bool]] = []
        self.ends: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None))
        self.ids += len(ids)
        self.ends.append(self.ids)
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= 64 * BLOCK:
            self._flush(whole=False)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, np.uint32)
        stop = len(ids) if whole else len(ids) // BLOCK * BLOCK
        for a in range(0, stop, BLOCK):
            data = pack_bits(ids[a : min(a + BLOCK, stop)], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.open, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(whole=True)
        names, nulls = zip(*self.docs) if self.docs else ((), ())
        tables = (
            np.array(names, "<i8").tobytes(), np.array(nulls, np.uint8).tobytes(),
            np.array(self.ends, "<u8").tobytes(), np.array(self.offsets, "<u8").tobytes(),
        )
        for t in tables:
            self.out.write(t)
        self.out.write(TRAILER.pack(len(self.docs), self.ids, self.bits, BLOCK, self.at, MAGIC))
        self.out.close()
        self.fs.move(self.draft, self.path)


class TokenReader:
    """Random access to one file: only the tables and the blocks asked for are read."""

    def __init__(self, uri: str):
        filesystem, path = fs.FileSystem.from_uri(uri)
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        trailer = self.file.read_at(TRAILER.size, size - TRAILER.size)
        self.n_docs, self.n_ids, self.bits, self.block, at, magic = TRAILER.unpack(trailer)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        tables = self.file.read_at(size - TRAILER.size - at, at)
        n = self.n_docs
        self.docs = np.frombuffer(tables, "<i8", n)
        self.nulls = np.frombuffer(tables, np.uint8, n, 8 * n).astype(bool)
        self.ends = np.frombuffer(tables, "<u8", n, 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(tables, "<u8", -1, 17 * n).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        n = min((last + 1) * self.block, self.n_ids) - first * self.block
        return unpack_bits(data, n, self.bits)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(doc_id, start, ids)`` in file order; about ``at_once`` ids are held."""
        starts = np.concatenate([[0], self.ends[:-1]]) if self.n_docs else np.zeros(0, np.int64)
        part = starts // at_once
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), self.n_docs] if self.n_docs else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            base = int(starts[a])
            ids = self.ids(base, int(self.ends[b - 1]))
            for i in range(a, b):
                name = None if self.nulls[i] else int(self.docs[i])
                yield name, int(starts[i]), ids[starts[i] - base : self.ends[i] - base]

    def close(self) -> None:
        self.file.close()


def write_tokens(
    docs: DataFrame,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    vocabulary: str | None = None,
) -> DataFrame:
    """Encodes all texts into files of ``folder`` and returns ``file, n_docs, n_ids, start``.

    Documents lie in ascending order of ids, null first, within and across files; ``start``
    counts the ids in earlier files. Each range of ids is one task and one file. A file is
    written under another name and renamed, so a task that runs twice does no harm.
    """
    path = vocabulary or default_vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        part = TaskContext.get().partitionId()
        name = f"{folder}/tokens-{part:06d}.bin"
        writer = None
        for batch in batches:
            for rows in text_slices(batch):
                ids, bounds = encode.encode(rows.column("text"))
                writer = writer or TokenWriter(name, bits_for(encode.whole.get_vocab_size()))
                for d, a, b in zip(rows.column("doc_id").to_pylist(), bounds[:-1], bounds[1:]):
                    writer.add(d, np.append(ids[a:b], np.uint32(end_id)))
        if writer:
            writer.close()
            row = (part, name, len(writer.docs), writer.ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in row], names=["part", "file", "n_docs", "n_ids"]
            )

    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spread = F.xxhash64("text")  # rows of one id are spread, too
    ranged = texts.repartitionByRange("doc_id", spread).sortWithinPartitions("doc_id", spread)
    written = ranged.mapInArrow(write, "part long, file string, n_docs long, n_ids long")
    files = stored(written.repartition(1))  # a row per file; the list of files is one small file, not one per task
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.select("file", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("start"))


def read_tokens(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, start in zip(frame["file"], frame["start"]):
                reader = TokenReader(name)
                rows = [
                    (d, start + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for d, s, ids in reader.documents()
                ]
                reader.close()
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    listed = stored(files)
    one_each = listed.repartition(max(1, listed.count()), "file")
    return one_each.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all texts to files in the shared folder and reads every document back.

    Null and empty texts are the end id alone. Rows with one id follow each other in the
    order of a hash of their texts. Null ids come first. An empty table writes no file and
    gives no rows. Further columns of the input are not read.
    """
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid4().hex}"
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    return read_tokens(write_tokens(docs, folder, doc_id, text))
