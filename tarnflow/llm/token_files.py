"""Token ids in binary files that can be read a document at a time.

A file holds one independent zstandard frame for each document (its ids as little-endian unsigned 32-bit integers), then
an index of the documents in a skippable frame, then a seek table in a last skippable frame, laid out as in the public
seekable zstandard format: compressed size, content size and checksum (low half of XXH64 of the content) of every
frame.  A reader takes the table from the end of the file and decompresses only the frames it wants.

Ranges of ids come from the ids alone.  Documents are encoded into frames, each range goes to a task of its own, which
sorts and writes it as one file, under a name of that attempt alone; only files that a finished task reports count, so retries and lost executors
leave nothing half-written behind.  File lengths are bounded by ``docs_per_file`` (by ids, evenly sampled).

Null or empty text: only the end id.  Null ids come first.  Rows that repeat an id stay separate, next to each other.
An empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.llm import _base, bpe

#: Magic numbers of the zstandard formats.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
LEVEL = 3


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI of the shared folder."""
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


class Writer:
    """Append frames; ``close`` adds index and seek table and moves the file to its name."""

    def __init__(self, path: str):
        self.name = path
        self.fs, self.path = open_fs(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.sizes: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, n: int, checksum: int, frame: bytes) -> None:
        self.out.write(frame)
        self.sizes.append((len(frame), 4 * n, checksum))
        self.docs.append((doc_id or 0, doc_id is not None, n))

    def close(self) -> None:
        index = b"".join(np.array([d[k] for d in self.docs], t).tobytes() for k, t in ((0, "<i8"), (1, "<u1"), (2, "<u4")))
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = np.array([*self.sizes, (len(index) + 8, 0, 0)], "<u4").tobytes() + struct.pack("<IBI", len(self.sizes) + 1, 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


class Reader:
    """Documents of one file, all or by position."""

    def __init__(self, path: str):
        self.file = open_fs(path)[0].open_input_file(open_fs(path)[1])
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError(f"{path}: not a seekable file with checksums")
        table = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.begins = table[:-1], np.concatenate([[0], np.cumsum(table[:, 0])])
        index = self._at(int(self.begins[-2]) + 8, int(table[-1, 0]) - 8)
        k = n - 1
        self.ids, self.valid, self.n_ids = np.frombuffer(index, "<i8", k), np.frombuffer(index, "<u1", k, 8 * k) > 0, np.frombuffer(index, "<u4", k, 9 * k)
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.sizes)

    def raw(self, k: int) -> bytes:
        """The content of one frame, its checksum verified."""
        size, content, checksum = self.sizes[k].tolist()
        data = self.unpack(self._at(int(self.begins[k]), size), max_output_size=content)
        if len(data) != content or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError("a frame is damaged")
        return data

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents with this id."""
        return [np.frombuffer(self.raw(int(k)), "<u4") for k in np.flatnonzero((self.ids == doc_id) & self.valid)]


def _bounds(ids: DataFrame, n_files: int) -> np.ndarray:
    """Largest id of each range but the last: from the ids alone, one number for each file."""
    dealt = ids.where("doc_id IS NOT NULL").repartitionByRange(n_files, "doc_id")
    tops = dealt.groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("top")).toPandas()["top"]
    return np.sort(tops.to_numpy(np.int64))[:-1]


def write(docs: DataFrame, path: str, end_id: int, docs_per_file: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write files in ascending order of ids; returns their list ``(path, first_id, n_docs, n_ids, start)``."""
    spark = docs.sparkSession
    out = _base.scratch(spark, "token-files")
    end = struct.pack("<I", end_id)
    _base.batches_of(spark)
    plain = _base.id_text(docs, id_col, text_col)
    n_files = max(1, -(-plain.count() // docs_per_file))
    bounds = spark.sparkContext.broadcast(_bounds(plain.select("doc_id"), n_files))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pack = bpe.coder("word_end", path), zstandard.ZstdCompressor(level=LEVEL, write_checksum=False).compress
        for b in _base.sliced(batches):
            n, checksums, frames = [], [], []
            for ids in coder.encode(b.column("text")):
                data = ids.tobytes() + end
                n.append(len(data) // 4)
                checksums.append(xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)
                frames.append(pack(data))
            keys = b.column("doc_id")
            part = np.searchsorted(bounds.value, keys.fill_null(-(1 << 63)).to_numpy())
            yield _base.record_batch(["part", "doc_id", "n", "checksum", "frame"], [pa.array(part.astype(np.int64)), keys, pa.array(n, pa.int64()), pa.array(checksums, pa.int64()), pa.array(frames, pa.binary())])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file for each range, from rows sorted by range and id."""
        w, first, total, now = None, None, 0, None

        def done() -> pa.RecordBatch:
            w.close()
            return _base.record_batch(["path", "part", "first_id", "n_docs", "n_ids"], [pa.array([w.name]), pa.array([now], pa.int64()), pa.array([first], pa.int64()), pa.array([len(w.docs)], pa.int64()), pa.array([total], pa.int64())])

        for b in batches:
            for part, doc_id, n, checksum, frame in zip(*(c.to_pylist() for c in b.columns)):
                if part != now:
                    if w is not None:
                        yield done()
                    w, first, total, now = Writer(f"{out}/{uuid.uuid4().hex}.ids.zst"), doc_id, 0, part
                w.add(doc_id, n, checksum, frame)
                total += n
        if w is not None:
            yield done()

    encoded = plain.mapInArrow(encode, "part long, doc_id long, n long, checksum long, frame binary")
    ordered = encoded.repartitionById(n_files, F.col("part").cast("int")).sortWithinPartitions("part", "doc_id", "n", "checksum")
    files = _base.materialize(ordered.mapInArrow(save, "path string, part long, first_id long, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")).drop("part")


def read(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                r = Reader(path)
                crc = [zlib.crc32(r.raw(k)) for k in range(len(r))]
                n = r.n_ids.astype(np.int64)
                yield _base.record_batch(["doc_id", "start", "n_tokens", "ids_crc32"], [pa.array(r.ids, mask=~r.valid), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())])

    spark: SparkSession = files.sparkSession
    return files.select("path", "start").repartition(max(1, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
