"""Helpers shared by the training-data operators: inputs, scratch tables and Arrow batches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.session import ship

#: Fixed value: a word, with no white space but the ASCII kinds.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Text bytes that one vectorised step handles at once in a Python worker.
SLICE_BYTES = 9 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temp folder only where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + os.path.join(tempfile.gettempdir(), f"tarnflow-{os.getuid()}")
        os.makedirs(at.removeprefix("file://"), exist_ok=True)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/tarnflow-{name}-{uuid.uuid4().hex}"


#: Scratch tables that are there, oldest first.
_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder: a lost executor then costs a reread, not a recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _written.append(path)
    return out


def mark() -> int:
    """What ``discard`` takes to leave older tables alone."""
    return len(_written)


def discard(since: int, *keep: DataFrame) -> None:
    """Delete the scratch tables written since a ``mark``, but for those of ``keep``; everything else must have been used.

    Tables in a store that pyarrow cannot open stay there.
    """
    kept = {df._scratch_path for df in keep}
    for path in [p for p in _written[since:] if p not in kept]:
        _written.remove(path)
        try:
            files, at = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        except pa.ArrowInvalid:
            continue
        files.delete_dir(at)


#: Rows of two or three numbers that are broadcast; longer tables are shuffled.
SMALL_ROWS = 500_000


def small(rows: DataFrame) -> DataFrame:
    """A written table of a few numbers a row: broadcast up to a limit, so that wide tables need no shuffle to meet it."""
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows


def batches_of(spark: SparkSession, rows: int = 4000) -> None:
    """Bound the Arrow batches that the JVM hands to Python workers by rows and bytes; workers get this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(24 << 20))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly the columns ``doc_id`` and ``text``; a null text is the empty text. Other columns, whatever their names, stay out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that their texts hold about ``limit`` bytes at most (a single longer text stays whole)."""
    for b in batches:
        if not b.num_rows:
            continue
        if b.nbytes <= limit:
            yield b
            continue
        at = start = total = 0
        for n in pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist():
            if total and total + n > limit:
                yield b.slice(start, at - start)
                start, total = at, 0
            total += n
            at += 1
        if at > start:
            yield b.slice(start, at - start)


def unused(names: list[str]) -> str:
    """A column name that none of ``names`` equals, in any case."""
    name = "c"
    while name in map(str.lower, names):
        name += "c"
    return name


def record_batch(names: list[str], arrays: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrays, names=names)
