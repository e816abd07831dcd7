"""Token counts with the whole-token shortcut.

When a worker starts, it proves which vocabulary strings encode alone as one token, by encoding each of them alone.
A pre-token that is such a string counts one; only the rest is merged by the library, and remembered.

The pre-tokens are what lies between single spaces.  They are independent of each other because no piece of the
vocabulary holds the space mark after another character (checked at start), so no merge crosses such a border.  A text
in which spaces come in runs, lead or trail, or which holds the mark itself goes to the library as a whole.

Null and empty texts count 0; each row gives one row; only the id and text columns are read; no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tarnflow.llm import _base

MARK = "▁"  #: the space mark of the library
REMEMBERED = 400_000  #: pre-tokens that a worker remembers before it starts anew


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.cuts_hold = not any(MARK in p.lstrip(MARK) for p in pieces) and [len(x) for x in self.library.encode(["a b", "a", "b"])] == [2, 1, 1]
        words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:] and " " not in p]
        self.alone = {w for w, ids in zip(words, self.library.encode(words, num_threads=1)) if len(ids) == 1}
        self.known: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)] if texts else []

    def count(self, texts: pa.Array) -> np.ndarray:
        if not self.cuts_hold:
            return np.array(self.whole(texts.to_pylist()), np.int64)
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, alone = self.known, self.alone
        new = [w for w in words if w not in alone and w not in known]
        known.update(zip(new, self.whole(new)))
        each = np.fromiter((1 if w in alone else known[w] for w in words), np.int64, len(words))
        odd = np.fromiter((not w or MARK in w for w in words), bool, len(words))
        sums = np.concatenate([[0], np.cumsum(each[index])])
        out = sums[offsets[1:]] - sums[offsets[:-1]]
        loose = np.unique(np.searchsorted(offsets, np.flatnonzero(odd[index]), side="right") - 1).tolist()
        out[loose] = self.whole([texts[d].as_py() for d in loose])
        return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row, as the library would count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for b in _base.sliced(batches):
            n = count(b.column("text"))
            yield _base.record_batch(["doc_id", "n_bytes", "n_tokens", "over_limit"], [b.column("doc_id"), pc.binary_length(b.column("text")).cast(pa.int64()), pa.array(n), pa.array(n > limit)])

    _base.batches_of(docs.sparkSession)
    return _base.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
