"""Line dedup: lines that many documents share stay only in one of them.

Keys of normalised lines are hashed (128 bits) and exploded, distinct documents are counted for each hash, and lines
over the threshold are dropped from every document but the one with the largest id; the rest is put together again
by position.  A key that a third of all rows hold is counted with partial aggregates and joined with salt, so no task
gets all its rows.  The list that a document gets is bounded by its own lines; texts are shuffled once.

Null or empty text: one empty line.  Null ids count as one document, smaller than all others.  Rows that repeat an id
are one document as far as counting goes, and are cleaned alike.  An empty table gives an empty one.  Extra columns are
carried along untouched; those named like a report column are only in the way if a report is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm import _base

NO_ID = -(1 << 63)
BLANK = b" \t\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SALTS = 16


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of the normalised line; none if it is too short to count."""
    key = line.strip(BLANK)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return blake2b(key, digest_size=16).digest()


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(id, key)``, each once for a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _base.sliced(batches):
            rows, keys = [], []
            for k, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                own = {line_key(x, min_chars) for x in text.translate(LOWER).split(b"\n")} - {None}
                rows += [k] * len(own)
                keys += own
            yield _base.record_batch(["id", "key"], [b.column("id").take(pa.array(rows, pa.int32())), pa.array(keys, pa.binary())])

    return docs.select("id", "text").mapInArrow(run, "id long, key binary")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", report: bool = True) -> DataFrame:
    """``docs`` with the kept text in ``text_col``; with ``report`` also ``n_lines`` and ``n_dropped``."""
    _base.batches_of(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = _base.materialize(_keys(plain, min_chars), "lines")
    shared = keys.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("holder")).where(F.col("n") >= min_docs)
    salted = shared.select("key", "holder", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    drops = (
        keys.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        .join(salted, ["key", "salt"])
        .where("id <> holder")
        .groupBy("id")
        .agg(F.collect_set("key").alias("drop"))
    )
    names = docs.columns
    own = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"))
    joined = own.join(drops, "id", "left").select("row.*", F.col("drop").alias(_base.unused(names)))
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields] + [T.StructField(n, T.LongType()) for n in ("n_lines", "n_dropped") if report])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _base.sliced(batches, text_col):
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(b.column(at).cast(pa.binary()).to_pylist(), b.column(len(names)).to_pylist()):
                lines = (text or b"").split(b"\n")
                if drop:
                    gone = set(drop)
                    stay = [x for x in lines if line_key(x.translate(LOWER), min_chars) not in gone]
                    n_dropped.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay).decode())
                else:
                    n_dropped.append(0)
                    kept.append("" if text is None else text.decode())
                n_lines.append(len(lines))
            columns = [pa.array(kept, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            extra = [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())] if report else []
            yield _base.record_batch([f.name for f in schema.fields], columns + extra)

    return joined.mapInArrow(run, schema)
