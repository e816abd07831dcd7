"""Sum-of-squares packing of token sequences.

A document that fills the sequence length is cut into whole sequences, with the shorter rest in front; the rests and
the short documents are packed.  Each goes where the sum over all gaps of (open sequences with that gap) squared
becomes smallest: closing an open sequence, leaving another gap, or opening a new sequence; ties go to open ones and the
smallest gap.  That rule is planned twice, as it stands and with new sequences only where no open one has room, and
the plan of fewer sequences is taken (on ties the first).  Both see nothing but the histogram of lengths.

The choice depends on nothing but lengths, so the plan is made from the histogram of lengths (at most ``capacity``
rows, whatever the input).  All pieces of one length are placed together in steps of at most ``1 / steps`` of their
number, one at a time where there are few.  The plan says for each run of ranks within a length which sequences and
offsets it gets.  Its size is bounded by ``capacity`` and ``steps`` alone; it is broadcast and looked up by binary
search.  Ranks come from counts of (length, salt), so a length that a third of all pieces have is ranked in many tasks.

Null or empty text: only the end id.  Ids may be null or repeat.  An empty table gives no rows.  Only the id and text
columns are read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm import _base, bpe

STEPS = 48  #: a length is placed in about so many steps at least, if it has so many pieces


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``n`` ids: only the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


class Plan:
    """Where the pieces of each length go; built by placing lengths from long to short.  ``early``: a new sequence may be
    opened while open ones have room."""

    def __init__(self, counts: dict[int, int], capacity: int, steps: int = STEPS, early: bool = True):
        self.capacity, self.sequences, self.early = capacity, 0, early
        self.open = np.zeros(capacity + 1, np.int64)  # sequences by gap
        self.runs: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]  # by gap: first sequence, number
        self.rows: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
        for length in sorted(counts, reverse=True):
            placed, n = 0, int(counts[length])
            step = max(1, -(-n // steps))
            while placed < n:
                placed += self._place(length, placed, min(step, n - placed))
        r = np.array(self.rows, np.int64).reshape(-1, 4)
        r = r[np.lexsort((r[:, 1], r[:, 0]))]
        self.keys, self.first_rank, self.first_sequence, self.offset = (r[:, 0] << 44) | r[:, 1], r[:, 1], r[:, 2], r[:, 3]

    def _place(self, a: int, rank: int, most: int) -> int:
        """Place up to ``most`` pieces of length ``a`` where the sum of squares grows least; returns how many."""
        c, n = self.capacity, self.open
        gaps = a + np.flatnonzero(n[a:c] > 0)
        grows = 2 * (n[gaps - a] - n[gaps] + 1)
        if len(gaps) and gaps[0] == a:
            grows[0] = 1 - 2 * n[a]
        best = int(grows.argmin()) if len(gaps) else -1
        if best >= 0 and not (self.early and (2 * n[c - a] + 1 if a < c else 0) < grows[best]):
            g = int(gaps[best])
            first, size = self.runs[g].popleft()
            k = min(most, size)
            if k < size:
                self.runs[g].appendleft((first + k, size - k))
            n[g] -= k
        else:
            g, k, first = c, most, self.sequences
            self.sequences += k
        if g > a:
            self.runs[g - a].append((first, k))
            n[g - a] += k
        self.rows.append((a, rank, first, c - g))
        return k

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the piece with this rank within its length."""
        k = np.searchsorted(self.keys, (length << 44) | rank, side="right") - 1
        return self.first_sequence[k] + rank - self.first_rank[k], self.offset[k]


def planned(counts: dict[int, int], capacity: int, steps: int = STEPS) -> Plan:
    """The rule's plan, or that without early new sequences where it needs fewer."""
    return min((Plan(counts, capacity, steps, early) for early in (True, False)), key=lambda p: p.sequences)


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = bpe.coder("merges", path), np.array([end_id], "<u4").tobytes()
        for b in _base.sliced(batches):
            rows = []
            for k, ids in enumerate(coder.encode(b.column("text"))):
                data = ids.tobytes() + end
                rows += [(k, p, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for p, (s, n) in enumerate(cut(len(data) // 4, capacity))]
            k, p, s, n, crc = np.array(rows, np.int64).reshape(-1, 5).T
            yield _base.record_batch(["doc_id", "piece", "start", "length", "ids_crc32"], [b.column("doc_id").take(pa.array(k)), pa.array(p.astype(np.int32)), pa.array(s), pa.array(n), pa.array(crc)])

    _base.batches_of(docs.sparkSession)
    return _base.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut_pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, start, length, ids_crc32``."""
    spark = cut_pieces.sparkSession
    salts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = _base.materialize(cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n"))
    plan = spark.sparkContext.broadcast(planned({r.length: r.n for r in by_length.collect()}, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("r", F.row_number().over(within) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("r"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = plan.value.find(*(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank")))
            yield _base.record_batch([*columns, "sequence_id", "offset"], [*(b.column(c) for c in columns), *map(pa.array, where)])

    return ranked.select(*columns, "rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document with its place in a sequence of at most ``capacity`` ids."""
    return pack(pieces(docs, path, end_id, capacity, id_col, text_col), capacity)
