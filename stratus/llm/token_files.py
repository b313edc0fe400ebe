"""Token ids in binary files, with bit-plane shuffling.

A file is a row of chunks of ``block_ids`` ids. A chunk is transposed into planes, the
k-th byte (or bit) of all its ids together, and each plane is compressed with zstandard:
high planes are nearly constant and vanish. Planes that would hold zeros only aren't
stored. A footer has the chunk index (place, ids, plane sizes), so any chunk can be read
alone, and the documents' ids and token counts.

Documents are written in ascending order of their id: they are range-partitioned and
sorted by it, every task writes files of bounded size, and a manifest (a row per file,
written as a table) gives each file the number of ids before it. Reading has a task for
each file and holds one chunk and one document at a time.

Defined cases: a null or empty text has the end id only; a null id comes first; rows that
repeat an id stand together, ordered by a hash of the text; an empty table gives no files
and an empty result; only the id and text columns are stored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stratus.llm import tokens
from stratus.llm.common import new_folder, written
from stratus.llm.files import NewFile, opened

MAGIC = b"STRATUSPLANES1\n\0"
BLOCK_IDS = 1 << 17
#: A file is closed at so many ids or documents.
FILE_IDS, FILE_DOCS = 1 << 24, 1 << 20


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """The planes of little-endian unsigned 32-bit ids, lowest first, without the highest
    planes that are all zero. ``unit``: byte or bit."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if unit == "byte":
        return [np.ascontiguousarray(ids.view(np.uint8)[k::4]).tobytes() for k in range(-(-top // 8))]
    return [np.packbits((ids >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(top)]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    if unit == "byte":
        out = np.zeros((n, 4), dtype=np.uint8)
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, dtype=np.uint8)
        return out.reshape(-1).view("<u4")
    ids = np.zeros(n, dtype="<u4")
    for k, p in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n).astype("<u4") << np.uint32(k)
    return ids


class TokenWriter:
    def __init__(self, folder: str, unit: str = "byte", block_ids: int = BLOCK_IDS):
        import zstandard

        self.file, self.unit, self.block_ids = NewFile(folder, ".planes"), unit, block_ids
        self.zip = zstandard.ZstdCompressor(level=3)
        self.held, self.n_held, self.n_ids, self.chunks = [], 0, 0, []
        self.keys: list[int | str | None] = []
        self.lengths: list[int] = []
        self.file.write(MAGIC)

    def add(self, key: int | str | None, ids: bytes) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = np.frombuffer(b"".join(self.held), dtype="<u4")
        end = len(data) if last else len(data) // self.block_ids * self.block_ids
        for at in range(0, end, self.block_ids):
            block = data[at : min(at + self.block_ids, end)]
            parts = [self.zip.compress(p) for p in to_planes(block, self.unit)]
            self.chunks.append([self.file.write(b"".join(parts)), len(block), [len(p) for p in parts]])
        self.n_ids += end
        self.held, self.n_held = [data[end:].tobytes()], len(data) - end

    def close(self) -> dict:
        self._flush(True)
        footer = {"unit": self.unit, "n_ids": self.n_ids, "chunks": self.chunks, "keys": self.keys, "lengths": self.lengths}
        data = self.zip.compress(json.dumps(footer).encode())
        self.file.write(data + len(data).to_bytes(8, "little") + MAGIC)
        self.file.close()
        return {"path": self.file.uri, "n_docs": len(self.keys), "n_ids": self.n_ids, "n_bytes": self.file.size}


class TokenReader:
    def __init__(self, uri: str):
        import zstandard

        self.file, self.zip = opened(uri), zstandard.ZstdDecompressor()
        size, tail = self.file.size(), 8 + len(MAGIC)
        self.file.seek(size - tail)
        end = self.file.read(tail)
        if end[8:] != MAGIC:
            raise ValueError(f"no token file: {uri}")
        n = int.from_bytes(end[:8], "little")
        self.file.seek(size - tail - n)
        self.index = json.loads(self.zip.decompress(self.file.read(n)))

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.index["chunks"][k]
        self.file.seek(at)
        planes = [self.zip.decompress(self.file.read(s)) for s in sizes]
        return from_planes(planes, n, self.index["unit"])

    def documents(self) -> Iterator[tuple[int | str | None, int, bytes]]:
        """(id, ids before it in the file, its ids), document after document."""
        k, data, at, start = 0, b"", 0, 0
        for key, n in zip(self.index["keys"], self.index["lengths"], strict=True):
            parts, need = [], 4 * n
            while need:
                if at == len(data):
                    data, at, k = self.chunk(k).tobytes(), 0, k + 1
                parts.append(data[at : at + need])
                at += len(parts[-1])
                need -= len(parts[-1])
            yield key, start, b"".join(parts)
            start += n

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, unit: str = "byte", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the files and returns the manifest: path, n_docs, n_ids, n_bytes and start,
    the ids in files before. Ids of documents are integers or strings."""
    path = vocabulary or tokens.default_vocabulary()
    to = folder or new_folder(docs.sparkSession, "token-files")
    end = np.array([tokens.END_ID], dtype="<u4").tobytes()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, writer, done = TaskContext.get().partitionId(), tokens.encoder(path).encode, None, []
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for lo, hi in tokens.slices(texts):
                for key, ids in zip(keys.slice(lo, hi - lo).to_pylist(), encode(texts.slice(lo, hi - lo).to_pylist()), strict=True):
                    writer = writer or TokenWriter(to, unit, block_ids)
                    writer.add(key, ids + end)
                    if writer.n_ids >= FILE_IDS or len(writer.keys) >= FILE_DOCS:
                        done.append(writer.close())
                        writer = None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist([{"part": part, "number": i, **x} for i, x in enumerate(done)], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

    order = [F.col("id").asc_nulls_first(), F.col("tie")]
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    files = held.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    made = written(files.mapInArrow(save, "part int, number int, path string, n_docs long, n_ids long, n_bytes long"), "token-manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "n_docs", "n_ids", "n_bytes", "start")


def read_tokens(manifest: DataFrame, id_type: str = "bigint", id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """A row per document of the files: its id, start, n_tokens, ids_crc32 and, with
    ``with_ids``, ids (little-endian unsigned 32-bit)."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                reader, rows, held = TokenReader(row["path"]), [], 0
                for key, start, ids in reader.documents():
                    rows.append((key, row["start"] + start, len(ids) // 4, zlib.crc32(ids), ids))
                    held += 64 + len(ids) * with_ids
                    if held >= 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                reader.close()
                if rows:
                    yield batch(rows)

    def batch(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        key = pa.array(cols[0], pa.string() if id_type == "string" else pa.int64())
        if id_type in ("int", "smallint", "tinyint"):
            key = key.cast({"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[id_type])
        out = {id_col: key, "start": pa.array(cols[1], pa.int64()), "n_tokens": pa.array(cols[2], pa.int64()), "ids_crc32": pa.array(cols[3], pa.int64())}
        return pa.RecordBatch.from_pydict(out | ({"ids": pa.array(cols[4], pa.binary())} if with_ids else {}))

    n_files = max(1, manifest.count())  # of bounded size each; a task for each
    return manifest.select("path", "start").repartition(n_files).mapInArrow(load, f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def query(spark, sf_dir: str) -> DataFrame:
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_tokens(manifest, with_ids=False)
