"""Byte-level BPE encoding and decoding by monoid tree reduction (see ``bpe``).

``encode`` adds ids to a table of texts, ``decode`` turns ids back into bytes by concatenating up a tree of blocks.
Both are narrow: no shuffle, memory bounded by one batch of texts.  A null or empty text has no ids and decodes to
no bytes; repeated rows give repeated rows; an empty table gives an empty one; of the input, only the id and text
columns are read, so other columns can have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import _base, bpe

BLOCK = 4096  #: ids decoded at once at the leaves of the decoding tree


class Decoder:
    def __init__(self, tokens: list[bytes]):
        self.table = pa.array(tokens, pa.binary())

    def leaf(self, ids: np.ndarray) -> bytes:
        return b"".join(self.table.take(pa.array(ids)).to_pylist()) if len(ids) < 16 else _values(self.table.take(pa.array(ids)))

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= BLOCK:
            return self.leaf(ids) if len(ids) else b""
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _values(a: pa.Array) -> bytes:
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return a.buffers()[2][int(off[0]) : int(off[-1])].to_pybytes()


_decoders: dict[tuple[str, str], tuple[Decoder, Decoder]] = {}


def _decoder(path: str, pattern: str) -> tuple[Decoder, Decoder]:
    """Of token bytes, and of decimal numbers each followed by one space."""
    if (path, pattern) not in _decoders:
        tokens = [s.encode("latin-1") for s in bpe.from_ranks(path)[0].spelled]
        _decoders[path, pattern] = Decoder(tokens), Decoder([b"%d " % k for k in range(len(tokens))])
    return _decoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.coder("ranks", path, pattern)
        for b in _base.sliced(batches):
            ids = coder.encode(b.column("text"))
            flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield _base.record_batch(["doc_id", "ids"], [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.int32)))])

    _base.batches_of(docs.sparkSession)
    return _base.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, bytes binary)`` from ``(doc_id, ids)``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(path, pattern)[0]
        for b in batches:
            out = [None if x is None else decoder.decode(np.array(x, np.int64)) for x in b.column("ids").to_pylist()]
            yield _base.record_batch(["doc_id", "bytes"], [b.column("doc_id"), pa.array(out, pa.binary())])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.

    ``ids_sha256`` is over the decimal ids joined by one space, ``decoded_sha256`` over the bytes decoded from the ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, (tokens, decimals) = bpe.coder("ranks", path, pattern), _decoder(path, pattern)
        sha = hashlib.sha256
        for b in _base.sliced(batches):
            n, written, back = [], [], []
            for ids in coder.encode(b.column("text")):
                ids = ids.astype(np.int32)
                n.append(len(ids))
                written.append(sha(decimals.decode(ids)[:-1]).hexdigest())
                back.append(sha(tokens.decode(ids)).hexdigest())
            yield _base.record_batch(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(written), pa.array(back)])

    _base.batches_of(docs.sparkSession)
    return _base.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
