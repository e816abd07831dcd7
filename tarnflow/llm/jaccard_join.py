"""N-gram Jaccard join: documents whose sets of word shingles overlap enough, and the classes that these links form.

Sets.  Words are hashed to 64 bits, shingles combine them, a set is a sorted array; equal sets are one set from then on.

Tiles.  Sets are banded by size.  Two linked sets whose larger one lies in a band differ in at most ``d`` shingles; if
all shingles are dealt to more than ``d`` parts by hash, some part is the same in both.  A tile is a band, a part and
its content; a set enters the tiles of its band and, if smaller partners may be there, of the next.  So linked sets
always meet in a tile, and a passage that many documents share does not bring them together unless it is a whole part.
Empty parts say nothing: a set with more of them than a band allows for is dealt again by another hash, as are all its
possible partners, for which the same holds.

Links.  In a tile, the set that is in most shared tiles is the pivot; each set is compared with the pivot it meets most
often.  Where the classes found so far leave several in one tile, its sets are compared with each other; of tiles with
the same sets, one is enough.  A tile of more than ``BLOCK`` sets is cut into blocks by class and size, block against
block as far as sizes allow; blocks of one class are not compared with each other.  Every comparison first bounds the
overlap from above by bit counts of hashed bitmaps, then intersects the sorted arrays exactly.  Only sets that share a
tile meet, no link between classes is lost, and pairs are never listed.

Null or empty text, or no word: an empty set, linked with nothing.  Fewer words than a shingle: one shingle of all.
Null ids: smaller than all others.  Rows that repeat an id are separate rows of one document.  An empty table gives no
rows.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import _base, graph
from tarnflow.llm.words import ODD, mix, word_hashes

SEEDS = 4  #: hashes by which a set may be dealt
GROWTH = 1.5  #: of band limits
BLOCK = 256  #: sets compared with as many others at once
COLUMNS = 4096  #: shingles that a count of overlaps takes at once
SALTS = 8
BUNDLE = 1024, 1 << 20  #: rows, and shingles, of comparisons that one call handles
FILTER_BITS = 1 << 20, 1 << 27  #: least and most of the filter that selects documents to read again: 16 MB at most


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w, starts = word_hashes(texts)
    out = []
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(w) - k + 1), np.uint64)
        for i in range(k):
            full += w[i : len(full) + i] * ODD[i % 8] + np.uint64(i)
        full = mix(full)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(full[a : b - k + 1]))
            elif b > a:
                out.append(mix((w[a:b] * ODD[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(1000 + b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


@lru_cache(1 << 16)
def band(n: int) -> int:
    k, top = 0, 1
    while n > top:
        top = max(top + 1, int(top * GROWTH))
        k += 1
    return k


@lru_cache(1 << 12)
def parts(b: int, percent: int) -> tuple[int, int]:
    """Number of parts of a band, and how many of them may be empty."""
    top = low = 1
    for _ in range(b):
        low, top = top + 1, max(top + 1, int(top * GROWTH))
    d = 2 * top * (100 - percent) // (100 + percent)
    spare = 0
    for _ in range(4):
        p = d + 1 + spare
        m = p * exp(-low * percent / 100 / p)
        spare = min(ceil(m + 4 * sqrt(m)), (d + 1) // 8)
    return d + 1 + spare, spare


def tiles(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the tiles of a set."""
    n, out = len(s), []
    own = band(n)
    last = band(n * 100 // percent)
    with np.errstate(over="ignore"):
        for b in range(own, last + 1):
            p, spare = parts(b, percent)
            for seed in range(SEEDS):
                at = ((mix(s + np.uint64(seed)) >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
                by = np.argsort(at, kind="stable")
                at = at[by]
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                base = ODD[2] * np.uint64(b * SEEDS + seed)
                out.append(mix(np.add.reduceat(s[by], first) * ODD[3] + at[first] * ODD[4] + base))
                empty = p - len(first)
                if empty <= spare:
                    break
                if seed == SEEDS - 1:
                    out.append(mix(np.setdiff1d(np.arange(p, dtype=np.uint64), at[first]) * ODD[4] + base))
    return np.concatenate(out)


def width(n: int) -> int:
    """Words of 64 bits of the bitmap of a set: about two bits for each shingle, a power of two."""
    return 1 << max(0, (2 * n - 1).bit_length() - 6)


def bitmap(s: np.ndarray, words: int) -> np.ndarray:
    bits = (s & np.uint64(64 * words - 1)).astype(np.int64)
    on = np.zeros(64 * words, np.uint8)
    on[bits] = 1
    return np.packbits(on, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The narrower bitmap of the same set."""
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def enough(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def may_link(x: np.ndarray, a: int, y: np.ndarray, b: int, percent: int) -> bool:
    """Whether two bitmaps, of sets of ``a`` and ``b`` shingles, leave room for a link: a bit that only one of them has
    stands for a shingle that the other does not have."""
    if not enough(min(a, b), a, b, percent):
        return False
    w = min(len(x), len(y))
    x, y = folded(x, w), folded(y, w)
    most = min(a - int(np.bitwise_count(x & ~y).sum()), b - int(np.bitwise_count(y & ~x).sum()))
    return bool(enough(most, a, b, percent))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    return bool(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, n, sid)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _base.sliced(batches):
            s = shingle_sets(b.column("text"), k)
            yield _base.record_batch(["doc_id", "n", "sid"], [b.column("doc_id"), pa.array([len(x) for x in s], pa.int64()), pa.array([set_id(x) for x in s], pa.int64())])

    return docs.mapInArrow(run, "doc_id long, n long, sid long")


def _tiles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``(tile, sid)``; a task gives each set once, however many copies it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _base.sliced(batches, limit=4 << 20):
            keys, ids = [], []
            for s in shingle_sets(b.column("text"), k):
                sid = set_id(s)
                if sid is not None and sid not in seen:
                    seen.add(sid)
                    keys.append(tiles(s, percent))
                    ids.append(sid)
            if keys:
                yield _base.record_batch(["tile", "sid"], [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), [len(x) for x in keys]))])

    return docs.select("text").mapInArrow(run, "tile long, sid long")


def _shared(members: DataFrame) -> DataFrame:
    """The rows of tiles with at least two sets, from rows sorted by tile and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_t, rest_s = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def several(t: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
            t, s = t[fresh], s[fresh]
            many = np.zeros(len(t), bool)
            same = t[1:] == t[:-1]
            many[1:] |= same
            many[:-1] |= same
            return _base.record_batch(["tile", "sid"], [pa.array(t[many]), pa.array(s[many])])

        for b in batches:
            t = np.concatenate([rest_t, b.column("tile").to_numpy()])
            s = np.concatenate([rest_s, b.column("sid").to_numpy()])
            if not len(t):
                continue
            cut = int(np.searchsorted(t, t[-1]))
            if cut:
                yield several(t[:cut], s[:cut])
            rest_t, rest_s = t[cut:], s[cut:]
            keep = np.ones(len(rest_s), bool)
            keep[1:] = rest_s[1:] != rest_s[:-1]
            rest_t, rest_s = rest_t[keep], rest_s[keep]
        if len(rest_t):
            yield several(rest_t, rest_s)

    return members.mapInArrow(run, "tile long, sid long")


def _filter_of(ids: DataFrame, n_bits: int) -> np.ndarray:
    """A bitmap that holds all ``doc_id`` given (and some others), built by Spark."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(n_bits))
    words = ids.select(F.floor(at / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("bits"))
    rows = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(n_bits // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def _arrays(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(sid, n, bits, shingles)`` of the sets ``wanted (doc_id, sid)``: read again, only documents that pass a filter of
    at most ``FILTER_BITS``; with more documents than that it passes more of them, and the join alone decides."""
    spark = docs.sparkSession
    n_bits = min(max(FILTER_BITS[0], 1 << (16 * wanted.count()).bit_length()), FILTER_BITS[1])
    chosen = spark.sparkContext.broadcast(_filter_of(wanted, n_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("at").to_numpy(zero_copy_only=False)
            b = b.filter(pa.array((chosen.value[at >> 6] >> (at & 63)) & 1 == 1))
            for c in _base.sliced([b]):
                s = shingle_sets(c.column("text"), k)
                maps = pa.array([bitmap(x, width(len(x))).tobytes() for x in s], pa.binary())
                yield _base.record_batch(["doc_id", "sid", "n", "bits", "shingles"], [c.column("doc_id"), pa.array([set_id(x) for x in s], pa.int64()), pa.array([len(x) for x in s], pa.int64()), maps, pa.array([x.tobytes() for x in s], pa.binary())])

    read = docs.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(n_bits))).mapInArrow(run, "doc_id long, sid long, n long, bits binary, shingles binary")
    return read.join(_base.small(wanted), [read.doc_id.eqNullSafe(wanted.doc_id), read.sid == wanted.sid], "left_semi").select("sid", "n", "bits", "shingles")


def _with_both(pairs: DataFrame, data: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs (v, parent)`` with the columns of both, those of the parent with a prefix; a parent of very many is salted."""
    left = data.select(F.col("sid").alias("v"), *columns).join(_base.small(pairs), "v").withColumn("salt", F.pmod(F.col("v"), F.lit(SALTS)))
    named = _base.materialize(pairs.select(F.col("parent").alias("sid")).distinct(), "pivots")
    parents = data.select("sid", *columns).join(_base.small(named), "sid", "left_semi")
    right = parents.select(F.col("sid").alias("parent"), *(F.col(c).alias(f"p_{c}") for c in columns), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return left.join(right, ["parent", "salt"]).select("v", "parent", *columns, *(f"p_{c}" for c in columns))


def _words64(value) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(v, parent)`` that are links: bitmaps first, arrays only of the pairs that these leave."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [may_link(_words64(x), a, _words64(y), z, percent) for x, a, y, z in zip(b.column("bits"), b.column("n").to_pylist(), b.column("p_bits"), b.column("p_n").to_pylist())]
            yield b.select(["v", "parent"]).filter(pa.array(ok, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(_words64(x), _words64(y), percent) for x, y in zip(b.column("shingles"), b.column("p_shingles"))]
            yield b.select(["v", "parent"]).filter(pa.array(ok, pa.bool_()))

    left = _base.materialize(_with_both(pairs, arrays, ["n", "bits"]).mapInArrow(bounded, "v long, parent long").distinct(), "bounded")
    return _with_both(left, arrays, ["shingles"]).mapInArrow(exact, "v long, parent long").distinct()


def _placed(members: DataFrame) -> DataFrame:
    """``members`` with a ``block``: one for a cluster of up to ``BLOCK`` sets, else of about ``BLOCK`` sets of similar size,
    parts of one class if that is large, else small classes together.  Only counts decide, so no task sees a whole cluster."""
    sized = members.withColumn("size", F.floor(F.log2(F.col("n")) * 2))
    counts = sized.groupBy("cluster", "size", "class").agg(F.count("*").alias("own"))
    counts = counts.withColumn("large", F.col("own") > BLOCK // 2)
    small = counts.where("NOT large").groupBy("cluster", "size").agg(F.sum("own").alias("rest"))
    groups = counts.join(small, ["cluster", "size"], "left").withColumn("parts", F.ceil(F.when(F.col("large"), F.col("own")).otherwise(F.col("rest")) / BLOCK))
    groups = groups.join(counts.groupBy("cluster").agg((F.sum("own") <= BLOCK).alias("one")), "cluster")
    groups = _base.materialize(groups.select("cluster", "size", "class", "large", "parts", "one"), "groups")
    graph.release(groups)
    part = F.pmod(F.xxhash64(F.when(F.col("large"), F.col("sid")).otherwise(F.col("class"))), F.col("parts"))
    block = F.when(F.col("one"), F.lit(0).cast("long")).otherwise(F.xxhash64("size", F.when(F.col("large"), F.col("class")), part))
    return sized.join(groups, ["cluster", "size", "class"]).withColumn("block", block).select("cluster", "sid", "class", "n", "block")


def _block_pairs(members: DataFrame, percent: int, within: bool = False) -> DataFrame:
    """``(cluster, i, j, block, sid, class)``: every pair of blocks of ``members (cluster, sid, class, n)`` that sizes allow;
    blocks that are of one class only ``within`` classes."""
    placed = _base.materialize(_placed(members), "blocks")
    blocks = placed.groupBy("cluster", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("class").alias("c0"), F.max("class").alias("c1"))
    x, y = blocks.alias("x"), blocks.alias("y")
    sizes = f"100 * x.hi >= {percent} * y.lo AND 100 * y.hi >= {percent} * x.lo"
    near = x.join(y, F.expr(f"x.cluster = y.cluster AND x.block <= y.block AND {sizes} AND ({str(within).lower()} OR x.c0 <> y.c0 OR x.c1 <> y.c1 OR x.c0 <> x.c1)"))
    sides = near.selectExpr("x.cluster AS cluster", "x.block AS i", "y.block AS j").selectExpr("cluster", "i", "j", "explode(array_distinct(array(i, j))) AS block")
    return _base.materialize(sides.join(placed, ["cluster", "block"]).select("cluster", "i", "j", "block", "sid", "class"), "block-pairs")


def _candidates_of(maps: np.ndarray, n: np.ndarray, a: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of ``others`` the bit counts leave for set ``a``."""
    shared = np.bitwise_count(maps[others] & maps[a]).sum(axis=1, dtype=np.int64)
    only_a = int(np.bitwise_count(maps[a]).sum()) - shared
    only_b = np.bitwise_count(maps[others]).sum(axis=1, dtype=np.int64) - shared
    return others[enough(np.minimum(n[a] - only_a, n[others] - only_b), n[a], n[others], percent)]


def _facing(table: pa.Table, group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each set of the first block and those of the second that are of another class, no pair twice."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    block = table["block"].to_numpy()
    second = np.flatnonzero(block == j)
    for a in np.flatnonzero(block == i).tolist():
        others = second[group[second] != group[a]]
        if i == j:
            others = others[others > a]
        if len(others):
            yield a, others


def _bundled(rows: DataFrame, n_rows: int, n_shingles: int) -> DataFrame:
    """``rows`` with the ``bundle`` of their comparison ``(cluster, i, j)``, so that one call handles many small ones."""
    n = max(1, -(-n_rows // BUNDLE[0]), -(-n_shingles // BUNDLE[1]))
    return rows.withColumn("bundle", F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(n)))


def _comparisons(table: pa.Table) -> Iterator[pa.Table]:
    """The rows of each comparison of a bundle."""
    keys = [table[c].to_numpy() for c in ("j", "i", "cluster")]
    by = np.lexsort(keys)
    ends = np.flatnonzero(np.logical_or.reduce([np.diff(k[by]) != 0 for k in keys])) + 1
    table = table.take(pa.array(by)).combine_chunks()
    at = [0, *ends.tolist(), len(by)]
    for a, b in zip(at[:-1], at[1:]):
        if b - a > 1:
            yield table.slice(a, b - a)


def _distinct_tiles(left: DataFrame) -> DataFrame:
    """``left (tile, sid, class)`` without tiles that hold the same sets as another one; 128 bits tell sets of sets apart."""
    seen = left.groupBy("tile").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y"))
    first = seen.groupBy("m", "x", "y").agg(F.min("tile").alias("tile")).select("tile")
    return left.join(first, "tile", "left_semi")


def _block_links(members: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between classes among the sets of each cluster of ``members (cluster, sid, class)``.

    First by bitmaps alone, which leaves the sets that still have a possible partner; then these by their arrays.
    """

    def bounded(bundle: pa.Table) -> pa.Table:
        out = []
        for table in _comparisons(bundle):
            n, group = table["n"].to_numpy(), np.unique(table["class"].to_numpy(), return_inverse=True)[1]
            raw = [_words64(v) for v in table["bits"]]
            w = min(map(len, raw))
            maps, alive = np.stack([folded(x, w) for x in raw]), np.zeros(len(n), bool)
            for a, others in _facing(table, group):
                left = _candidates_of(maps, n, a, others, percent)
                if len(left):
                    alive[a] = alive[left] = True
            if alive.any():
                out.append(table.select(["cluster", "sid", "class"]).filter(pa.array(alive)))
        return pa.concat_tables(out) if out else bundle.select(["cluster", "sid", "class"]).slice(0, 0)

    def exact(bundle: pa.Table) -> pa.Table:
        out = []
        for table in _comparisons(bundle):
            sid, group = table["sid"].to_numpy(), np.unique(table["class"].to_numpy(), return_inverse=True)[1]
            sets = [_words64(v) for v in table["shingles"]]
            n = np.array([len(x) for x in sets])
            w = width(int(n.max()))
            maps = np.stack([bitmap(x, w) for x in sets])
            for a, others in _facing(table, group):
                for b in _candidates_of(maps, n, a, others, percent).tolist():
                    if group[a] != group[b] and linked(sets[a], sets[b], percent):
                        out.append((sid[a], sid[b]))
                        group[group == group[b]] = group[a]
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    def sides(members: DataFrame, column: str) -> DataFrame:
        pairs = _block_pairs(members.join(arrays.select("sid", "n"), "sid"), percent)
        rows = arrays.select("sid", "n", column).join(_base.small(pairs), "sid")
        size = pairs.join(arrays.select("sid", "n"), "sid").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        return _bundled(rows, *size).groupBy("bundle")

    alive = sides(members, "bits").applyInArrow(bounded, "cluster long, sid long, class long").distinct()
    alive = _base.materialize(alive, "alive")
    graph.release(alive)
    return sides(alive, "shingles").applyInArrow(exact, "a long, b long").distinct()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The size of the intersection of every set of one side with every set of the other."""
    x, y = np.concatenate(left), np.concatenate(right)
    i, j = np.repeat(np.arange(len(left)), list(map(len, left))), np.repeat(np.arange(len(right)), list(map(len, right)))
    both = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), np.int64)
    sides = []
    for v, rows in ((x, i), (y, j)):
        at = np.minimum(np.searchsorted(both, v), max(0, len(both) - 1))
        there = both[at] == v if len(both) else np.zeros(len(v), bool)
        by = np.argsort(at[there], kind="stable")
        sides.append((at[there][by], rows[there][by]))
    for a in range(0, len(both), COLUMNS):
        dense = []
        for (at, rows), sets in zip(sides, (left, right)):
            lo, hi = np.searchsorted(at, [a, a + COLUMNS])
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[rows[lo:hi], at[lo:hi] - a] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)  # whole numbers below 2**24
    return out


def _link_counts(tied: DataFrame, arrays: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """``(sid, n_links)``: in how many documents each set has other sets that it links with; ``tied (a, b)`` joins all
    sets that share a tile."""

    def count(table: pa.Table) -> pa.Table:
        block, copies, sid = table["block"].to_numpy(), table["copies"].to_numpy(), table["sid"].to_numpy()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sets = [_words64(v) for v in table["shingles"]]
        n = np.array([len(v) for v in sets])
        ok = enough(overlaps([sets[a] for a in x], [sets[b] for b in y]), n[x][:, None], n[y][None, :], percent)
        if i == j:
            np.fill_diagonal(ok, False)
            ids, numbers = sid[x], ok @ copies[y]
        else:
            ids, numbers = np.concatenate([sid[x], sid[y]]), np.concatenate([ok @ copies[y], copies[x] @ ok])
        return pa.table({"sid": pa.array(ids, pa.int64()), "n_links": pa.array(numbers, pa.int64())}).filter(pa.array(numbers > 0))

    clusters = graph.components(tied).select(F.col("v").alias("sid"), F.col("root").alias("cluster"))
    one_each = arrays.dropDuplicates(["sid"])
    members = clusters.join(one_each.select("sid", "n"), "sid").withColumn("class", F.col("sid"))
    pairs = _block_pairs(members, percent, within=True)
    rows = one_each.select("sid", "shingles").join(copies, "sid").join(_base.small(pairs), "sid")
    counted = rows.groupBy("cluster", "i", "j").applyInArrow(count, "sid long, n_links long")
    return _base.materialize(counted.groupBy("sid").agg(F.sum("n_links").alias("n_links")), "link-counts")


def join(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row, with ``count_links`` also ``n_links``.

    Sets link when ``100 * intersection >= percent * union``.  ``component_id`` is the smallest id that links reach;
    ``n_links`` counts all links of the row's set: other documents with the same set or one that links with it.  That
    takes all pairs of different sets of a class, so its work grows with the square of a class; the classes don't need it.
    """
    spark = docs.sparkSession
    _base.batches_of(spark)
    began = _base.mark()
    plain = _base.id_text(docs, id_col, text_col)
    rows = _base.materialize(_sets(plain, k), "sets")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = _base.materialize(_shared(_tiles(plain, k, percent).repartition(n_parts, "tile").sortWithinPartitions("tile", "sid")), "tiles")
    graph.release(met)
    # the pivot of a tile is the set that is in most shared tiles; each set goes to the pivot it meets most often
    degree = met.groupBy("sid").agg(F.count("*").alias("degree"))
    ranked = _base.materialize(met.join(degree, "sid").select("tile", "sid", F.struct("degree", "sid").alias("r")), "ranked")
    pivots = ranked.groupBy("tile").agg(F.max("r").alias("p"), F.min("sid").alias("low"))
    meets = ranked.join(pivots, "tile").where("p.sid <> sid").groupBy("sid", F.col("p").alias("p")).agg(F.count("*").alias("times"))
    pairs = _base.materialize(meets.groupBy("sid").agg(F.max(F.struct("times", "p")).alias("best")).select(F.col("sid").alias("v"), F.col("best.p.sid").alias("parent")), "pairs")
    reps = rows.join(degree.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    arrays = _base.materialize(_arrays(plain, _base.materialize(reps, "reps"), k), "arrays")
    graph.release(met)
    links = _base.materialize(_verified(pairs, arrays, percent), "verified")
    classes = graph.roots(links)
    # tiles that still hold several classes
    known = ranked.select("tile", "sid").join(classes.withColumnRenamed("v", "sid"), "sid", "left").select("tile", "sid", F.coalesce("root", "sid").alias("class"))
    known = _base.materialize(known, "classes")
    split = known.groupBy("tile").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).where("c0 <> c1").select("tile")
    left = _base.materialize(known.join(split, "tile"), "unsettled")
    all_links = links.select(F.col("v").alias("a"), F.col("parent").alias("b"))
    graph.release(met)
    if left.limit(1).count():
        members = _base.materialize(_distinct_tiles(left).select(F.col("tile").alias("cluster"), "sid", "class"), "members")
        more = _base.materialize(_block_links(members, arrays, percent), "block-links")
        graph.release(met)
        all_links = all_links.union(more)
        classes = graph.components(all_links)
    named = rows.join(classes.withColumnRenamed("v", "sid"), "sid", "left")
    if count_links:
        copies = rows.where("sid IS NOT NULL").groupBy("sid").agg((F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))).alias("copies"))
        tied = ranked.join(pivots, "tile").select(F.col("sid").alias("a"), F.col("low").alias("b"))
        counts = _link_counts(tied, arrays, copies, percent)
        number = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("n_links", F.lit(0))
        named = named.join(copies, "sid", "left").join(counts, "sid", "left").withColumn("n_links", number.cast("long"))
    extra = ["n_links"] if count_links else []
    named = _base.materialize(named.select("doc_id", "n", F.coalesce("root", "sid").alias("class"), *extra), "named")
    smallest = named.where("class IS NOT NULL").groupBy("class").agg(F.count("*").alias("size"), F.min("doc_id").alias("first")).where("size > 1").select("class", "first")
    smallest = _base.materialize(smallest, "smallest")  # apart from the join, which Spark can then split where one class is large
    _base.discard(began, named, smallest)
    return named.join(smallest, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.coalesce("first", "doc_id")).alias("component_id"), *extra)


def representatives(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents whose class holds a smaller id."""
    found = join(docs, k, percent, id_col, text_col)
    later = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(later, docs[id_col].cast("long") == later["doc_id"], "left_anti")
