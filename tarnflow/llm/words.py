"""Words of whole batches as numbers, and rows of numbers dealt to buckets.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered.  A word's hash sums a random number for each byte times a power of an
odd number for its place, and is finalised; so all words of a batch are hashed by a few passes over its bytes.

Rows that go to the same bucket travel as one block of columns, so a shuffle of very many small rows handles few large
ones.  The number of buckets follows the number of rows, so a bucket has about as many rows at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import _base

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
SLICE = 1 << 16  #: bytes hashed at once
ROWS = 1_000_000  #: of a bucket, about

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BYTES = np.random.default_rng(20_250_101).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[65:91] = _BYTES[97:123]
_BYTES[_BLANK] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * ODD[0]
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts (null: none), and where each text's begin, and the end."""
    size = len(texts)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + size + 1].astype(np.int64)
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    hashes, counts, a = [], [], 0
    while a < size:
        z = max(a + 1, int(np.searchsorted(off, off[a] + SLICE, side="right")) - 1)
        raw, ends = everything[off[a] : off[z]], off[a : z + 1] - off[a]
        blank = _BLANK.take(raw)
        first = ~blank
        first[1:] &= blank[:-1]
        begins = ends[:-1][ends[:-1] < ends[1:]]
        first[begins] = ~blank[begins]
        at = np.flatnonzero(first)
        if len(at):
            place = np.zeros(len(raw), np.int32)
            place[at] = at
            np.maximum.accumulate(place, out=place)
            np.subtract(np.arange(len(raw), dtype=np.int32), place, out=place)
            with np.errstate(over="ignore"):
                parts = _powers(int(place.max()) + 1).take(place)  # blanks count nothing, whatever their place
                parts *= _BYTES.take(raw)
                hashes.append(mix(np.add.reduceat(parts, at)))
        counts.append(np.diff(np.searchsorted(at, ends)))
        a = z
    n = np.concatenate(counts)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


_known = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number, kept for texts of ordinary length."""
    global _known
    if n <= len(_known):
        return _known
    with np.errstate(over="ignore"):
        out = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16) - 1, ODD[2])]), dtype=np.uint64)
    if len(out) <= SLICE:
        _known = out
    return out


def _planes(c: np.ndarray) -> bytes:
    """The first bytes of all numbers, then all second ones, and so on: upper bytes are mostly zero, and the shuffle's
    compression only finds them side by side."""
    return np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes()


def _numbers(block: bytes, kind: np.dtype, n: int, at: int) -> np.ndarray:
    """The numbers of ``_planes`` again."""
    return np.ascontiguousarray(np.frombuffer(block, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T).view(kind).ravel()


def blocks(bucket: np.ndarray, coded: list[np.ndarray], plain: list[np.ndarray]) -> pa.RecordBatch:
    """``(bucket, block)``: the rows of each bucket as one block; ``coded`` columns hold few different values."""
    by = np.argsort(bucket, kind="stable")
    bucket, coded, plain = bucket[by], [c[by] for c in coded], [c[by] for c in plain]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    out = []
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
        parts = [np.array([z - a], "<u4")]
        for c in coded:
            values, at = np.unique(c[a:z], return_inverse=True)
            parts += [np.array([len(values)], "<u4"), values, _planes(at.astype("<u2" if len(values) <= 1 << 16 else "<u4"))]
        out.append(b"".join(x if isinstance(x, bytes) else x.tobytes() for x in (*parts, *(_planes(c[a:z]) for c in plain))))
    return _base.record_batch(["bucket", "block"], [pa.array(bucket[edges[:-1]].astype(np.int64)), pa.array(out, pa.binary())])


def unblocked(block: bytes, n_coded: int, plain: list[str]) -> list[np.ndarray]:
    """The columns of a block again; coded ones are 64-bit integers."""
    n, at, out = int(np.frombuffer(block, "<u4", 1)[0]), 4, []
    for _ in range(n_coded):
        k = int(np.frombuffer(block, "<u4", 1, at)[0])
        values = np.frombuffer(block, "<i8", k, at + 4)
        kind = np.dtype("<u2" if k <= 1 << 16 else "<u4")
        out.append(values[_numbers(block, kind, n, at + 4 + 8 * k)])
        at += 4 + 8 * k + kind.itemsize * n
    for t in map(np.dtype, plain):
        out.append(_numbers(block, t, n, at))
        at += t.itemsize * n
    return out


def dealt(rows: DataFrame) -> DataFrame:
    """The blocks ``(bucket, block)`` of a bucket next to each other; buckets go round the shuffle partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch], n_coded: int, plain: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket."""
    now, parts = None, []
    for b in batches:
        for bucket, block in zip(b.column("bucket").to_pylist(), b.column("block").to_pylist()):
            if bucket != now and parts:
                yield [np.concatenate(c) for c in zip(*parts)]
                parts = []
            now = bucket
            parts.append(unblocked(block, n_coded, plain))
    if parts:
        yield [np.concatenate(c) for c in zip(*parts)]


def buckets(n_rows: int | None, partitions: int) -> int:
    """Enough buckets for rows of this number; a multiple of the partitions."""
    return partitions * max(1, -(-(n_rows or 0) // (ROWS * partitions)))


def bucket_of(x: np.ndarray, n: int) -> np.ndarray:
    """A bucket by the upper bits of hashes."""
    return ((x >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


