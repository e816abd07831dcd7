"""Language ID by prediction by partial matching.

For each language, a variable-order byte context tree: contexts of 0 to 3 bytes with counts of what follows, and
escape probabilities (method C, no exclusions): in a context seen ``n`` times with ``d`` different followers, a follower
seen ``c`` times costs ``-log2(c / (n + d))`` bits, another one ``-log2(d / (n + d))`` bits and its cost in the next
shorter context; after the empty context an unseen byte costs 8 bits more.  A context that a language never saw costs
nothing to leave.  Statistics are frozen after training.  Each of these costs is rounded to 1/1024 bit once, so a text's
code length under every language is one exact integer sum over its bytes.

Training counts on the executors and learns from at most ``sample_docs`` documents of each language, those with the
smallest hash of the id; everything these hold is kept, as sorted tables of what occurs, which are broadcast.  Their size
is bounded by the sample, not by the corpus.  A language that most rows have is thinned by hash before it is sorted.
Scoring reads every whole text, without a shuffle, and looks each different run of four bytes of a batch up once.

Null text, or text without a letter (Unicode class L): ``und`` with score 0.  Null ids: not held out, not learned from.
Rows without a language are not learned from; with nothing to learn from, all rows are ``und``.  Repeated rows give
repeated rows.  Ties go to the language first in order.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm import _base, bpe

UNDETERMINED = "und"
UNIT = 1024  #: parts of a bit
PAD = b"\n\n\n"  #: what comes before a text
_letter = regex.compile(r"\p{L}").search


@dataclass(frozen=True)
class Training:
    sample_docs: int = 2000  #: labelled documents of each language


@dataclass
class Level:
    """Contexts of one length: costs of their followers and of leaving them, by language."""

    keys: np.ndarray  #: context and follower, as one number, sorted
    costs: np.ndarray  #: 1/1024 bit
    contexts: np.ndarray
    escapes: np.ndarray

    def cost(self, keys: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Of any followers, given their costs in the next shorter contexts."""
        known, at = _found(self.contexts, keys >> 8)
        out = shorter + np.where(known[:, None], self.escapes[at], 0)
        known, at = _found(self.keys, keys)
        out[known] = self.costs[at[known]]
        return out


def _found(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x, at


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]  #: from the empty context to that of three bytes

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """``(gram, language)``: cost of the last byte of each run of four after the others."""
        out = np.full((len(grams), len(self.languages)), 8 * UNIT, np.int32)
        for order, level in enumerate(self.levels):
            out = level.cost(grams & ((1 << 8 * (order + 1)) - 1), out)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + len(PAD)
        grams, inner = runs(texts, lengths)
        different, at = np.unique(grams[inner], return_inverse=True)
        each = np.zeros((len(grams) + 1, len(self.languages)), np.int32)
        each[:-1][inner] = self.cost(different.astype(np.int64))[at]
        ends = np.cumsum(lengths)
        out = np.add.reduceat(each, np.stack([ends - lengths + len(PAD), ends], axis=1).ravel(), axis=0, dtype=np.int64)[::2]
        out[lengths == len(PAD)] = 0
        return out


def runs(texts: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the padded texts, itself and the three before it as one number; and whether it is a text's own."""
    raw = np.frombuffer(PAD + PAD.join(texts), np.uint8).astype(np.uint32)
    grams = np.zeros(len(raw), np.uint32)
    grams[3:] = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    inner = np.ones(len(raw) + len(PAD), bool)
    starts = np.cumsum(lengths) - lengths
    for k in range(len(PAD)):
        inner[starts + k] = False
    return grams, inner[: len(raw)]


def _bits(share: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(share) * UNIT).astype(np.int32)


def build(grams: pd.DataFrame) -> Model | None:
    """The model from rows ``lang, gram, n``; a gram is three bytes and their follower, as a number."""
    if not len(grams):
        return None
    names, lang = np.unique(grams["lang"].to_numpy(str), return_inverse=True)
    g, n = grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.float64)
    model = Model(names.tolist(), [])
    for order in range(4):
        keys, at = np.unique(g & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        seen = np.zeros((len(keys), len(names)))
        np.add.at(seen, (at, lang), n)
        contexts, inside = np.unique(keys >> 8, return_inverse=True)
        total, different = np.zeros((2, len(contexts), len(names)))
        np.add.at(total, inside, seen)
        np.add.at(different, inside, seen > 0)
        shares = np.maximum(total + different, 1)
        escapes = np.where(total > 0, _bits(np.maximum(different, 1) / shares), 0)
        shorter = model.cost(keys) if order else np.full(seen.shape, 8 * UNIT, np.int32)
        costs = np.where(seen > 0, _bits(np.where(seen > 0, seen, 1) / shares[inside]), escapes[inside] + shorter)
        model.levels.append(Level(keys, costs.astype(np.int32), contexts, escapes.astype(np.int32)))
    return model


def held_out() -> F.Column:
    """Rows whose id's checksum falls into the fold that is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, training: Training = Training(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The frozen model of the labelled rows of ``docs`` outside the held-out fold."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    # a share of each language that holds the sample almost surely, so that no language is sorted as a whole
    sizes = _base.small(_base.materialize(rows.groupBy("lang").agg(F.count("*").alias("size")), "languages"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    thin = rows.select("doc_id", "lang").join(sizes, "lang").where(part * F.col("size") <= 2 * training.sample_docs + 100)
    order = Window.partitionBy("lang").orderBy(part, "doc_id")
    chosen = thin.withColumn("r", F.row_number().over(order)).where(F.col("r") <= training.sample_docs).select("doc_id", "lang").distinct()
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        for b in _base.sliced(batches, limit=4 << 20):
            for lang, frame in b.to_pandas().groupby("lang"):
                texts = [t.encode() for t in frame["text"]]
                grams, inner = runs(texts, np.fromiter(map(len, texts), np.int64, len(texts)) + len(PAD))
                found, n = np.unique(grams[inner], return_counts=True)
                yield _base.record_batch(["lang", "gram", "n"], [pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))])

    _base.batches_of(docs.sparkSession)
    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return build(grams.toPandas())


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row; the score is the posterior of the language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        m = shared.value
        for b in _base.sliced(batches, limit=4 << 20):
            lang, score = judge(m, b.column("text"))
            yield _base.record_batch(["doc_id", "lang_pred", "score"], [b.column("doc_id"), lang, score])

    _base.batches_of(docs.sparkSession)
    out = _base.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def judge(m: Model | None, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    texts = [t or "" for t in texts.to_pylist()]
    if m is None:
        return pa.array([UNDETERMINED] * len(texts)), pa.array([0.0] * len(texts))
    bits = m.score([t.encode() for t in texts]) / UNIT
    best = bits.argmin(axis=1)
    with np.errstate(under="ignore"):
        share = 1 / np.exp2(np.minimum(bits.min(axis=1, keepdims=True) - bits, 0)).sum(axis=1)
    known = [bool(_letter(t)) for t in texts]
    return pa.array([m.languages[k] if ok else UNDETERMINED for k, ok in zip(best, known)]), pa.array(np.where(known, share, 0.0))


def keep_known(docs: DataFrame, model: Model | None, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with at least ``min_score``; all if there is no model."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        for b in _base.sliced(batches, text_col, limit=4 << 20):
            lang, score = judge(shared.value, b.column(at))
            keep = [x != UNDETERMINED and s >= min_score for x, s in zip(lang.to_pylist(), score.to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    _base.batches_of(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
