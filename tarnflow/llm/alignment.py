"""Cross-tokenizer alignment: which tokens of two vocabularies share bytes of the corpus, and in how many documents.

Both tokenizers spell the same bytes.  Where a token of each ends, a group ends; all tokens of a group are linked with
all of the other side.  Neither tokenizer lets a token cross a single space between other characters, so texts are cut
there, each different word is aligned once and remembered, and a document's groups are those of its words in order.
Texts in which white space touches a space, or which hold the second vocabulary's space mark, are aligned as a whole.

Identity map.  For each id of the first vocabulary the id of the second with the same bytes, if there is one, is worked
out beforehand.  Links of such pairs, nearly all of them exact groups of one token each, are counted by document in a
vector as long as the vocabulary, one for each task.  Only other pairs are shuffled, summed by batch and by task
before.  A pair counts once for a document wherever in it it stands.

Ranks need all counts: the vector of the identity pairs, the highest count of each first id and the ``TOP`` most
frequent other pairs are sent to all tasks, all of fixed size; links of rarer pairs are joined with their counts.

Null and empty texts, and those whose tokens spell other bytes than a space and the text (a mark that stands for a
space, say): no tokens, zeros and an empty digest.  Rows that repeat an id are separate documents.  An empty table
gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import _base
from tarnflow.llm.bpe import byte_letters

MARK = "▁"  #: the space mark of the second vocabulary
SHIFT = 15  #: a pair is ``first << SHIFT | second``
TOP = 1 << 19  #: pairs whose counts all tasks get
REMEMBERED, PAIRS = 250_000, 4_000_000  #: words, and their pairs, that a worker remembers before it starts anew
AT_ONCE = 2000  #: words that the libraries get as one text
LONG = 100  #: characters of a word that goes to them alone
#: White space beside a space, at either end of a text, or the mark.
LOOSE = r"\s \s|\s  |  \s|\s | \s|^\s|\s$|▁"


class Aligner:
    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes: list[bytes] = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(k)]]
        assert len(self.b_bytes) <= 1 << SHIFT
        pieces = {v: k for k, v in reversed(list(enumerate(self.b_bytes))) if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k))}
        #: Identity map; -1 where no piece has the same bytes.
        self.same = np.array([pieces.get(x, -1) for x in self.a_bytes], np.int64)
        self.cuts_hold = not any(" " in x.lstrip(b" ").decode("utf-8", "replace") for x in self.b_bytes)
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        #: Ids as text, with what follows them inside a side, and at its end.
        self.a_text, self.b_text = (np.array([[f"{k},", f"{k}{end}"] for k in range(len(v))], object) for v, end in ((self.a_bytes, "|"), (self.b_bytes, ";")))
        self.forget()

    def forget(self) -> None:
        """No aligned words: entry ``k`` has the text of its groups, its numbers, and its pairs from ``starts[k]``."""
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers, self.sizes, self.pairs, self.times = [], [], [], []

    def _keep(self, groups: list[str], numbers: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        self.groups += groups
        for kept, new in ((self.numbers, numbers), (self.sizes, sizes), (self.pairs, pairs), (self.times, times)):
            kept.append(new.astype(np.int64))

    def _spelled(self, text: str, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == b"".join(map(self.b_bytes.__getitem__, b)) == b" " + text.encode()

    def _ids(self, text: str) -> tuple[list[int], list[int]]:
        return self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text, num_threads=1)

    def whole(self, text: str) -> None:
        """One entry for a text by itself; its groups may be long, so their pairs are counted by id."""
        a, b = self._ids(text)
        if not self._spelled(text, a, b):
            self._keep([""], np.zeros((1, 4)), np.zeros(1), np.zeros(0), np.zeros(0))
            return
        groups, pairs, links, i, j = [], Counter(), 0, 0, 0
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends, p_ends, q_ends = np.intersect1d(a_ends, b_ends, assume_unique=True, return_indices=True)
        for p, q in zip((p_ends + 1).tolist(), (q_ends + 1).tolist()):
            groups.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))};")
            links += (p - i) * (q - j)
            right = Counter(b[j:q]).items()
            for s, m in Counter(a[i:p]).items():
                for t, n in right:
                    pairs[s << SHIFT | t] += m * n
            i, j = p, q
        self._keep(["".join(groups)], np.array([[len(a), len(b), len(groups), links]]), np.array([len(pairs)]), np.array(list(pairs)), np.array(list(pairs.values())))

    def words(self, words: list[str]) -> None:
        """An entry for each word; all go to the libraries as one text, halves of it where that spells other bytes."""
        if not words:
            return
        if len(words) == 1:
            self.whole(words[0])
            return
        text = " ".join(words)
        a, b = self._ids(text)
        if not self._spelled(text, a, b):
            self.words(words[: len(words) // 2])
            self.words(words[len(words) // 2 :])
            return
        a, b = np.array(a), np.array(b)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        in_a, in_b = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)  # the group of each token
        n_a, n_b = np.bincount(in_a, minlength=len(ends)), np.bincount(in_b, minlength=len(ends))
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        # texts: the tokens of a group's first side, then those of its second
        tokens = np.empty(len(a) + len(b), object)
        tokens[np.arange(len(a)) + (last_b - n_b)[in_a]] = self.a_text[a, (np.arange(len(a)) + 1 == last_a[in_a]).astype(int)]
        tokens[np.arange(len(b)) + last_a[in_b]] = self.b_text[b, (np.arange(len(b)) + 1 == last_b[in_b]).astype(int)]
        tokens = tokens.tolist()
        # links: each token of the first side with all of its group's second
        each = n_b[in_a]
        b_at = np.repeat((last_b - n_b)[in_a] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        pairs = np.repeat(a, each) << SHIFT | b[b_at]
        stops = np.cumsum([len(w.encode()) + 1 for w in words])
        of_group = np.searchsorted(stops, ends)  # the word of each group
        sums = np.stack([np.bincount(of_group, x, len(words)).astype(np.int64) for x in (n_a, n_b, np.ones(len(ends)), n_a * n_b)], axis=1)
        cuts = np.concatenate([[0], np.cumsum(sums[:, 0] + sums[:, 1])]).tolist()
        self._keep(["".join(tokens[x:y]) for x, y in zip(cuts, cuts[1:])], sums, sums[:, 3], pairs, np.ones(len(pairs)))

    def entries(self, words: list[str]) -> np.ndarray:
        """The entry of each word."""
        if len(self.groups) > REMEMBERED or sum(map(len, self.pairs)) > PAIRS:
            self.forget()
        new = [w for w in words if w not in self.known]
        long = [w for w in new if len(w) > LONG]
        short = [w for w in new if len(w) <= LONG] if long else new
        self.known.update(zip(short, range(len(self.groups), len(self.groups) + len(short))))
        for at in range(0, len(short), AT_ONCE):
            self.words(short[at : at + AT_ONCE])
        for w in long:
            self.known[w] = len(self.groups)
            self.whole(w)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def batch(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: digest of its groups, ``n_a, n_b, n_groups, n_links``; then where its pairs begin, pairs, times."""
        size = len(texts)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        whole = (pc.match_substring_regex(texts, LOOSE).to_numpy(zero_copy_only=False) if self.cuts_hold else True) & ~empty
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        index, dictionary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        by_words = np.repeat(~(whole | empty), np.diff(offsets))
        used = np.zeros(len(dictionary), bool)
        used[index[by_words]] = True
        at = np.flatnonzero(used)
        of_word = np.zeros(len(dictionary), np.int64)
        of_word[at] = self.entries([dictionary[k] for k in at.tolist()])
        n_groups = np.array([len(g) for g in self.groups], np.int64)
        entry = [of_word[index[a:z]] if not (w or e) else index[:0] for a, z, w, e in zip(offsets, offsets[1:], whole, empty)]
        for d in range(size):
            if whole[d] or (len(entry[d]) and not n_groups[entry[d]].all()):
                self.whole(texts[d].as_py())
                entry[d] = np.array([len(self.groups) - 1] if self.groups[-1] else [], np.int64)
        groups = self.groups
        digests = [hashlib.sha256("".join(map(groups.__getitem__, e.tolist()))[:-1].encode()).hexdigest() if len(e) else "" for e in entry]
        for kept in (self.numbers, self.sizes, self.pairs, self.times):
            kept[:] = [np.concatenate(kept)] if kept else []
        numbers, sizes, pairs, times = (k[0] if k else np.zeros(0, np.int64) for k in (self.numbers, self.sizes, self.pairs, self.times))
        numbers, starts = numbers.reshape(-1, 4), np.cumsum(sizes) - sizes
        flat, n_entries = np.concatenate([*entry, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(e) for e in entry])
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(numbers[flat], axis=0)])
        stops = np.cumsum(n_entries)
        sums = sums[stops] - sums[stops - n_entries]
        each = sizes[flat]
        at = np.repeat(starts[flat] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        keys = np.repeat(np.repeat(np.arange(size), n_entries), each) << 32 | pairs[at]
        if (times[at] == 1).all():
            keys, total = np.unique(keys, return_counts=True)
        else:
            by = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], keys[by][1:] != keys[by][:-1]]))
            keys, total = keys[by][first], np.add.reduceat(times[at][by], first)
        return digests, sums, np.searchsorted(keys, np.arange(size + 1) << 32), (keys & 0xFFFFFFFF).astype(np.uint32), total.astype(np.int64)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    if (first, second) not in _aligners:
        _aligners[first, second] = Aligner(first, second)
    return _aligners[first, second]


def _aligned(docs: DataFrame, first: str, second: str) -> DataFrame:
    """Each document with its digest, numbers, and the pairs linked in it (sorted) with how many links each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _base.sliced(batches, limit=4 << 20):
            digests, sums, starts, pairs, times = aligner(first, second).batch(b.column("text"))
            cut = lambda x: pa.array([x[a:z].tobytes() for a, z in zip(starts, starts[1:])], pa.binary())
            yield _base.record_batch(
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                [b.column("doc_id"), *(pa.array(sums[:, k]) for k in range(4)), pa.array(digests), cut(pairs), cut(times.astype(np.uint32 if times.max(initial=0) < 1 << 32 else np.uint64))],
            )

    out = docs.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")
    return out.withColumn("row", F.monotonically_increasing_id())


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of documents: pairs, times, and how many pairs each has."""
    pairs, times = b.column("pairs").to_pylist(), b.column("times").to_pylist()
    sizes = np.array([len(p) // 4 for p in pairs], np.int64)
    wide = [np.frombuffer(t, np.uint32 if len(t) == len(p) else np.uint64).astype(np.int64) for t, p in zip(times, pairs)]
    return np.frombuffer(b"".join(pairs), np.uint32).astype(np.int64), np.concatenate([*wide, np.zeros(0, np.int64)]), sizes


def _counts(found: DataFrame, same: np.ndarray) -> DataFrame:
    """``(pair, n)``: in how many documents each pair is linked. Identity pairs leave a task as one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(len(same), np.int64)
        for b in batches:
            pairs = _arrays(b)[0]
            exact = same[pairs >> SHIFT] == pairs & ((1 << SHIFT) - 1)
            vector += np.bincount(pairs[exact] >> SHIFT, minlength=len(same))
            other, n = np.unique(pairs[~exact], return_counts=True)
            yield _base.record_batch(["pair", "n"], [pa.array(other), pa.array(n.astype(np.int64))])
        at = np.flatnonzero(vector)
        yield _base.record_batch(["pair", "n"], [pa.array(at << SHIFT | same[at]), pa.array(vector[at])])

    return found.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _scored(found: DataFrame, exact: np.ndarray, top: tuple[np.ndarray, np.ndarray], best: np.ndarray, same: np.ndarray) -> DataFrame:
    """``found`` with ``n_best`` and ``count_sum`` over the pairs whose counts all tasks have, and the ``rare`` others."""
    shared = found.sparkSession.sparkContext.broadcast((exact, *top, best, same))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, pairs_known, counts, best, same = shared.value
        for b in batches:
            pairs, times, sizes = _arrays(b)
            a = pairs >> SHIFT
            at = np.minimum(np.searchsorted(pairs_known, pairs), max(0, len(pairs_known) - 1))
            there = pairs_known[at] == pairs if len(pairs_known) else np.zeros(len(pairs), bool)
            n = np.where(same[a] == pairs & ((1 << SHIFT) - 1), exact[a], np.where(there, counts[at], 0) if len(counts) else 0)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            out = np.zeros((2, len(sizes)), np.int64)
            ends = np.cumsum(sizes)
            for k, x in enumerate((times * (n == best[a]), times * n)):
                x = np.concatenate([[0], np.cumsum(x)])
                out[k] = x[ends] - x[ends - sizes]
            rare = np.flatnonzero(n == 0)
            ends = np.searchsorted(doc[rare], np.arange(len(sizes) + 1))
            rows = pa.StructArray.from_arrays([pa.array(pairs[rare]), pa.array(times[rare]), pa.array(best[a[rare]])], ["pair", "times", "best"])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows)
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield _base.record_batch([*names, "n_best", "count_sum", "rare"], [*(b.column(c) for c in names), pa.array(out[0]), pa.array(out[1]), lists])

    return found.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rare array<struct<pair:long,times:long,best:long>>")


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of each row; ``first`` is a tokenizers
    file of byte-level BPE, ``second`` a sentencepiece model."""
    spark = docs.sparkSession
    _base.batches_of(spark)
    began = _base.mark()
    same = aligner(first, second).same
    found = _base.materialize(_aligned(_base.id_text(docs, id_col, text_col), first, second), "aligned")
    counts = _base.materialize(_counts(found, same), "pair-counts")
    highest = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("n")).toArrow()  # a row for each id of the vocabulary at most
    best, exact = np.zeros(len(same), np.int64), np.zeros(len(same), np.int64)
    best[highest["a"].to_numpy()] = highest["n"].to_numpy()
    pairs = spark.createDataFrame(pa.table({"pair": pa.array(np.flatnonzero(same >= 0) << SHIFT | same[same >= 0])}))
    vector = counts.join(F.broadcast(pairs), "pair").toArrow()
    exact[vector["pair"].to_numpy() >> SHIFT] = vector["n"].to_numpy()
    frequent = counts.join(F.broadcast(pairs), "pair", "left_anti").orderBy(F.desc("n"), "pair").limit(top).toArrow().sort_by("pair")
    scored = _base.materialize(_scored(found, exact, (frequent["pair"].to_numpy(), frequent["n"].to_numpy()), best, same), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(counts, "pair")
    sums = rare.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
    sums = _base.materialize(sums, "rare")
    _base.discard(began, scored, sums)
    number = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
    return scored.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", number("n_best", "more_best"), number("count_sum", "more"), "groups_sha256")
