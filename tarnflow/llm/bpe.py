"""Byte-pair encoding by monoid tree reduction, and whole batches of texts through it.

A pre-token is encoded as a balanced tree: each half is encoded by itself, and two neighbours are joined by encoding
again a window around their boundary.  The window grows until the tokens outside are proved stable.

Why that is exact.  A sequence of tokens is the encoding of its text if and only if every two neighbouring tokens are
the encoding of their own text.  Greedy merging picks the lowest rank, leftmost first.  As long as no merge crosses
the boundary of two neighbours, the order in which the two advance depends on these two alone, so the first crossing
merge of the whole text would also happen in the text of these two tokens.  Pairs inside each half hold already;
a join has to look only at the pairs at both ends of its window.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import json
import os
import re
from array import array
from collections.abc import Callable
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

LEAF = 3  #: up to so many symbols are merged directly
REMEMBERED = 10  #: longer strings are not kept in the memo of a tree
MEMO = 150_000  #: strings that a tree remembers before it starts anew
PIECES = 120_000  #: pieces in a generation beyond which a worker starts a new one; it keeps two
WORDS = 200_000  #: the same for the words of pieces
LONGEST = 64  #: characters of a piece or word that is remembered
SHORT = 24  #: symbols up to which a scan for the lowest rank is faster than a heap
END = 256  #: offset of the symbols that carry the end-of-word mark


class TreeBPE:
    """Encode strings over the symbols 0..255 (bytes) and 256..511 (bytes at the end of a word)."""

    def __init__(self, initial: dict[int, int], spelled: list[str], pair: Callable[[int, int], tuple[int, int] | None]):
        self.initial, self.spelled, self.pair = initial, spelled, pair
        self.memo: dict[str, tuple[int, ...]] = {}
        self.joined: dict[int, tuple[int, ...]] = {}

    def merged(self, s: str) -> tuple[int, ...]:
        """Plain greedy merging, for leaves and windows."""
        if len(s) > SHORT:
            return self.heaped(s)
        ids, pair = [self.initial[ord(c)] for c in s], self.pair
        ranks = [pair(a, b) for a, b in zip(ids, ids[1:])]
        while True:
            best = min((p[0] for p in ranks if p), default=None)
            if best is None:
                return tuple(ids)
            k = next(i for i, p in enumerate(ranks) if p and p[0] == best)
            ids[k : k + 2] = [ranks[k][1]]
            del ranks[k]
            if k:
                ranks[k - 1] = pair(ids[k - 1], ids[k])
            if k < len(ranks):
                ranks[k] = pair(ids[k], ids[k + 1])

    def heaped(self, s: str) -> tuple[int, ...]:
        """The same for long strings: possible merges wait in a heap by rank and place, tokens form a linked list."""
        ids, pair, n = [self.initial[ord(c)] for c in s], self.pair, len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := pair(ids[i], ids[i + 1]))]
        heapify(waiting)
        while waiting:
            _, i, a, b, made = heappop(waiting)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two is gone already
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if p := pair(made, ids[k]):
                    heappush(waiting, (p[0], i, made, ids[k], p[1]))
            h = before[i]
            if h >= 0 and (p := pair(ids[h], made)):
                heappush(waiting, (p[0], h, ids[h], made, p[1]))
        return tuple(x for x in ids if x >= 0)

    def both(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of the text of two tokens."""
        key = a << 20 | b
        known = self.joined.get(key)
        if known is None:
            if len(self.joined) > MEMO:
                self.joined.clear()
            known = self.joined[key] = self.merged(self.spelled[a] + self.spelled[b])
        return known

    def holds(self, a: int, b: int) -> bool:
        return self.both(a, b) == (a, b)

    def join(self, left: tuple[int, ...], right: tuple[int, ...], own: dict[str, tuple[int, ...]] | None = None) -> tuple[int, ...]:
        """While the two tokens at the boundary don't hold, take one more token from the right: the window around the
        boundary grows to the left until it holds there, then the boundary moves on behind it."""
        if self.holds(left[-1], right[0]):
            return left + right
        out, at = list(left), 0
        while at < len(right) and not self.holds(out[-1], right[at]):
            i, window = 1, self.both(out[-1], right[at])
            while i < len(out) and not self.holds(out[-i - 1], window[0]):
                i = min(2 * i, len(out))
                window = self.window("".join(self.spelled[t] for t in [*out[-i:], right[at]]), own)
            out[-i:] = window
            at += 1
        return (*out, *right[at:])

    def window(self, s: str, own: dict[str, tuple[int, ...]] | None) -> tuple[int, ...]:
        memo = self.memo if len(s) <= REMEMBERED else own
        known = memo.get(s) if memo is not None else None
        if known is None:
            known = self.merged(s)
            if memo is not None:
                memo[s] = known
        return known

    def encode(self, s: str, own: dict[str, tuple[int, ...]] | None = None) -> tuple[int, ...]:
        """``own`` remembers the longer parts of one string, of which repetitive strings have few different ones."""
        n = len(s)
        memo = self.memo if n <= REMEMBERED else own
        known = memo.get(s) if memo is not None else None
        if known is None:
            if n <= LEAF:
                known = self.merged(s)
            else:
                own = {} if own is None and n > LONGEST else own
                known = self.join(self.encode(s[: n // 2], own), self.encode(s[n // 2 :], own), own)
            if memo is not None:
                if memo is self.memo and len(memo) > MEMO:
                    memo.clear()
                memo[s] = known
        return known


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of byte-level tokenizers, by its published rule."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def from_ranks(path: str) -> tuple[TreeBPE, dict[str, int]]:
    """A rank file: any two neighbours merge whose joined bytes have a rank. Also returns the ranks by Latin-1 string."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    spelled = [""] * (max(ranks.values()) + 1)
    for s, r in ranks.items():
        spelled[r] = s

    def pair(a: int, b: int) -> tuple[int, int] | None:
        r = ranks.get(spelled[a] + spelled[b])
        return None if r is None else (r, r)

    return TreeBPE({b: ranks[chr(b)] for b in range(256)}, spelled, pair), ranks


def from_merges(path: str) -> TreeBPE:
    """A tokenizer file with a merge list, with or without end-of-word marks."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab, mark = byte_letters(), model["vocab"], model.get("end_of_word_suffix") or ""

    def spell(token: str) -> str:
        last = bool(mark) and token.endswith(mark) and token != mark
        codes = [letters.get(c, 63) for c in (token.removesuffix(mark) if last else token)]
        if last:
            codes[-1] += END
        return "".join(map(chr, codes))

    spelled = [""] * (max(vocab.values()) + 1)
    for token, k in vocab.items():
        spelled[k] = spell(token)
    initial = {b: vocab[c] for c, b in letters.items() if c in vocab}
    initial |= {END + b: vocab[c + mark] for c, b in letters.items() if mark and c + mark in vocab}
    merges: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        merges[vocab[a], vocab[b]] = (rank, vocab[a.removesuffix(mark) + b if mark else a + b])
    return TreeBPE(initial, spelled, lambda a, b: merges.get((a, b)))


class Coder:
    """Texts to ids, a batch at a time: texts are cut at spaces, each distinct piece of a batch is encoded once.

    ``pieces(chunks, first)`` gives the ids of each piece as a bytes object of little-endian 32-bit ids;
    ``whole(text)`` those of a text where cuts at spaces could change the result: one in which a piece before the
    last is empty or ends in white space, so that the cut lies inside a run of white space.  Two generations of short
    pieces outlive a batch, bounded in number and length, unless ``pieces`` remembers what it needs itself.
    """

    def __init__(self, pieces: Callable[[list[str], bool], list[bytes]], whole: Callable[[str], bytes], first_differs: bool = True, runs_matter: bool = True, remember: bool = True):
        self.pieces, self.whole, self.first_differs, self.runs_matter, self.remember = pieces, whole, first_differs, runs_matter, remember
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _remembered(self, words: list[str]) -> list[bytes]:
        if len(self.known) > PIECES:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        units = [known.get(w) or older.get(w) for w in words]
        new = [k for k, u in enumerate(units) if u is None]
        for k, u in zip(new, self.pieces([words[k] for k in new], False)):
            units[k] = u
        if len(known) + len(words) <= 3 * PIECES:
            known.update((w, u) for w, u in zip(words, units) if len(w) <= LONGEST)
        return units

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        units = self._remembered(words) if self.remember else self.pieces(words, False)
        starts_at = offsets[:-1]
        if self.first_differs:
            firsts, where = np.unique(index[starts_at], return_inverse=True)
            index = index.copy()
            index[starts_at] = len(units) + where
            units = units + self.pieces([words[k] for k in firsts], True)
        _, ends, data = pa.array(units, pa.large_binary()).take(pa.array(index)).buffers()
        bounds = np.frombuffer(ends, np.int64, len(index) + 1)[offsets] >> 2 if len(index) else np.zeros(len(offsets), np.int64)
        ids = np.frombuffer(data, "<u4", int(bounds[-1])) if bounds[-1] else np.zeros(0, "<u4")
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        if self.runs_matter:
            odd = np.fromiter((not w or w[-1].isspace() for w in words), bool, len(words))
            loose = odd[coded.indices.to_numpy(zero_copy_only=False)]
            loose[offsets[1:] - 1] = False
            loose[starts_at] &= np.fromiter((bool(words[k]) for k in coded.indices.to_numpy(zero_copy_only=False)[starts_at]), bool, len(starts_at)) if len(starts_at) else False
            for d in np.unique(np.searchsorted(offsets, np.flatnonzero(loose), side="right") - 1).tolist():
                out[d] = np.frombuffer(self.whole(texts[d].as_py()), "<u4")
        return out


def packed(ids) -> bytes:
    return array("I", ids).tobytes()


#: Whether a string is one pre-token under all patterns here: letters, with a space in front or not.
_word = re.compile("[ ]?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+").fullmatch


def byte_rank_coder(path: str, pattern: str) -> Coder:
    """The ids that a rank file gives, every match of ``pattern`` by itself, a match with a rank of its own directly."""
    tree, ranks = from_ranks(path)
    find = regex.compile(pattern).findall

    def ids(text: str) -> bytes:
        if _word(text):
            s = text.encode().decode("latin-1")
            r = ranks.get(s)
            return packed((r,) if r is not None else tree.encode(s))
        found = []
        for m in find(text):
            s = m.encode().decode("latin-1")
            r = ranks.get(s)
            found.append((r,) if r is not None else tree.encode(s))
        return packed(chain.from_iterable(found))

    return Coder(lambda chunks, first: [ids(c if first else " " + c) for c in chunks], ids)


def _library(path: str):
    """The tokenizer library's reader of a file, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


JOINED = 2000  #: words that the library gets as one text


def _by_borders(encode: Callable[[str], list[int]], text: Callable[[list[str]], str], border: np.ndarray, at_end: bool, words: list[str]) -> list[bytes]:
    """The ids of each word, from texts of many words; ``border`` marks the ids that a word's first (or last) token has,
    and no other.  Should their number ever differ from that of the words, each goes to the library by itself."""
    out: list[bytes] = []
    for a in range(0, len(words), JOINED):
        some = words[a : a + JOINED]
        ids = np.array(encode(text(some)), np.uint32)
        at = np.flatnonzero(border[ids])
        if len(at) != len(some):
            out += [packed(encode(text([w]))) for w in some]
            continue
        data = ids.tobytes()
        edges = [0, *(4 * at + 4).tolist()] if at_end else [*(4 * at).tolist(), len(data)]
        out += [data[i:j] for i, j in zip(edges, edges[1:])]
    return out


def _letters_of(library, path: str) -> list[str]:
    vocab = library.get_vocab(with_added_tokens=True)
    out = [""] * (max(vocab.values()) + 1)
    for token, k in vocab.items():
        out[k] = token
    return out


def merge_list_coder(path: str) -> Coder:
    """The ids of the tokenizer library for a byte-level file.  Pieces are given to it many at a time, each with its
    space in front: the space starts a pre-token, so no token but a piece's first begins with one."""
    library = _library(path)
    space = next(c for c, b in byte_letters().items() if b == 32)
    border = np.array([t.startswith(space) for t in _letters_of(library, path)])
    encode = lambda text: library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def pieces(chunks: list[str], first: bool) -> list[bytes]:
        if first:
            return [packed(encode(c)) for c in chunks]
        alone = [k for k, c in enumerate(chunks) if not c or c[0].isspace() or c[-1].isspace() or "<|" in c]
        inside = set(alone)
        rest = iter(_by_borders(encode, lambda ws: " " + " ".join(ws), border, False, [c for k, c in enumerate(chunks) if k not in inside]))
        return [packed(encode(" " + c)) if k in inside else next(rest) for k, c in enumerate(chunks)]

    return Coder(pieces, lambda text: packed(encode(text)))


#: Fixed value: the word pattern that the vocabulary file with end-of-word marks names, for lower-cased text.
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Finds characters on whose class or case Python and the tokenizer library might differ, and starts of special tokens.
_unusual = re.compile("[^\\x00-\\x1b\\x20-\\xff]|<\\|").search


def word_end_coder(path: str) -> Coder:
    """The ids of the tokenizer library for a lower-casing file with end-of-word marks, which drops white space.  It gets
    the words of many pieces at a time, each different one in lower case once while two generations of them remember it; the
    last token of a word, and no other, carries the mark."""
    library = _library(path)
    with open(path, encoding="utf-8") as f:
        mark = json.load(f)["model"]["end_of_word_suffix"]
    border = np.array([t.endswith(mark) for t in _letters_of(library, path)])
    encode = lambda text: library.encode_batch_fast([text], add_special_tokens=False)[0].ids
    find = regex.compile(WORD_END_PATTERN).findall

    known: dict[str, bytes] = {}
    older: dict[str, bytes] = {}

    def remembered(words: list[str]) -> list[bytes]:
        nonlocal known, older
        if len(known) > WORDS:
            known, older = {}, known
        new = set(words).difference(known)
        known.update((w, older[w]) for w in new.intersection(older))
        new = list(new.difference(older))
        known.update(zip(new, _by_borders(encode, " ".join, border, True, new)))
        out = list(map(known.__getitem__, words))
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return out

    def pieces(chunks: list[str], first: bool) -> list[bytes]:
        words, counts = [], []
        for c in chunks:
            if _word(c):
                words.append(c.lower())
                counts.append(1)
            elif _unusual(c):
                counts.append(-1)
            else:
                found = find(c.lower())
                words += found
                counts.append(len(found))
        ids, out, at = remembered(words), [], 0
        for c, n in zip(chunks, counts):
            if n == 1:
                out.append(ids[at])
            else:
                out.append(packed(encode(c)) if n < 0 else b"".join(ids[at : at + n]))
            at += max(n, 0)
        return out

    return Coder(pieces, lambda text: packed(encode(text)), first_differs=False, runs_matter=False, remember=False)


_coders: dict[tuple, Coder] = {}


def forget() -> None:
    """Let go of this worker process's coder, and give its memory back, before an operator that needs none."""
    if _coders:
        _coders.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def coder(kind: str, *args: str) -> Coder:
    """One coder for each worker process, and only the last one used: what another operator left is let go."""
    key = (kind, *args)
    if key not in _coders:
        _coders.clear()
        _coders[key] = {"ranks": byte_rank_coder, "merges": merge_list_coder, "word_end": word_end_coder}[kind](*args)
    return _coders[key]
