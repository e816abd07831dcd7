"""Quality rules from a suffix array over words.

For each batch of texts one suffix array is built by prefix doubling, sorting again only the suffixes that are not yet
told apart; ranks start from (document, word), so only repeats inside a document count.  The longest common prefixes
of neighbouring suffixes bound the intervals of the maximal repeated substrings: for each word, the longest substring
that starts there and occurs again.  The spans of repeats of at least ``min_repeat`` words are united; a document is
rejected where they cover too large a share of its words or where the longest repeat is too long.

No shuffle; memory is bounded by one batch and its longest text; the work is n log n even for a text that is one
repeated word.  A null or empty text has no words and fails the base rules.  Repeated rows give repeated rows, an empty
table an empty one; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tarnflow.llm import _base

BLANK = b" \t\n\x0b\x0c\r"
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_words_pct: int = 50
    min_repeat: int = 8  #: words of a repeat that counts
    max_covered: float = 0.3  #: largest share of words inside repeats
    max_longest: int = 100  #: words of the longest repeat


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of a batch, and where each text's begin."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    there = np.asarray(pc.not_equal(flat, "").to_numpy(zero_copy_only=False), bool)
    counts = np.concatenate([[0], np.cumsum(there)])
    codes = flat.filter(pa.array(there)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, counts[offsets - offsets[0]]


def repeats(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring that starts there and occurs again in its document."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    lengths = np.diff(starts)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    end = np.repeat(starts[1:], lengths)
    key = doc * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], np.diff(key[order]) != 0])
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    suffixes = order
    levels = [rank.astype(np.int32)]
    h = 1
    while True:
        sizes = np.diff(np.append(np.flatnonzero(fresh), n))
        open_ = np.repeat(sizes > 1, sizes)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        own = suffixes[at]
        then = own + h
        inside = then < end[own]
        second = np.where(inside, rank[np.minimum(then, n - 1)] + 1, 0)
        combined = rank[own] * (n + 1) + second
        by = np.argsort(combined, kind="stable")
        own, combined = own[by], combined[by]
        new = np.concatenate([[True], np.diff(combined) != 0])
        fresh[at] = new
        rank = rank.copy()
        rank[own] = np.maximum.accumulate(np.where(new, at, 0))
        suffixes[at] = own
        levels.append(rank.astype(np.int32))
        h *= 2
    out = np.zeros(n, np.int64)
    p, q = suffixes[:-1], suffixes[1:]
    same = levels[0][p] == levels[0][q]
    p, q = p[same], q[same]
    common = np.zeros(len(p), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = p + common, q + common
        ok = (a < end[p]) & (b < end[q])
        ok &= levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        common += np.where(ok, 1 << k, 0)
    np.maximum.at(out, p, common)
    np.maximum.at(out, q, common)
    return out


def covered(longest: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Words of each document inside the united spans of repeats of at least ``least`` words."""
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    sums = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return sums[starts[1:]] - sums[starts[:-1]]


def quality(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, ``base_failed``, ``covered_words``, ``longest_repeat`` and ``kept`` for each row."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "covered_words", "longest_repeat", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _base.sliced(batches, limit=6 << 20):
            texts = b.column("text")
            codes, starts = words_of(texts)
            rep = repeats(codes, starts)
            n = np.diff(starts)
            n_repeat, cover = covered(rep, starts, 3), covered(rep, starts, limits.min_repeat)
            top = np.maximum.reduceat(np.append(rep, 0), np.minimum(starts[:-1], len(rep))) * (n > 0)
            longest = np.where(top >= limits.min_repeat, top, 0)
            spaces, symbols, dups = [], [], []
            for t in texts.cast(pa.binary()).to_pylist():
                spaces.append(len(t) - len(t.translate(None, BLANK)))
                symbols.append(len(t) - len(t.translate(None, SYMBOLS)))
                lines = [x for x in t.split(b"\n") if x.strip(BLANK)]
                dups.append(len(lines) - len(set(lines)))
            chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False) - np.array(spaces, np.int64)
            failed = (n < limits.min_words) | (100 * n_repeat > limits.max_repeat_words_pct * n)
            kept = ~failed & (cover <= limits.max_covered * n) & (longest <= limits.max_longest)
            yield _base.record_batch(names, [b.column("doc_id"), *(pa.array(np.asarray(x, np.int64)) for x in (n, chars, symbols, dups, n_repeat)), pa.array(failed), pa.array(cover), pa.array(longest), pa.array(kept)])

    _base.batches_of(docs.sparkSession)
    schema = ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in names)
    return _base.id_text(docs, id_col, text_col).mapInArrow(run, schema)
