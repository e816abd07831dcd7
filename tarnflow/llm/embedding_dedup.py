"""Near-duplicate vectors by product quantisation, with bounds under which no link is lost.

Vectors are scaled to length 1, so a cosine of at least ``c`` is a distance of at most ``r = sqrt(2 - 2c)``.  Equal
vectors of one label are one vector from then on.  A codebook is fitted on a bounded sample: coarse centroids, and for
each group of dimensions the centroids of what is left after the coarse one.

Probes.  A vector belongs to the list of its nearest centroid and visits every other list whose border (the plane
midway between the two centroids) is nearer than ``r / 2``.  Of two linked vectors in different lists one always does:
their distances from the border add up to no more than their own.

Distances.  A list is kept in blocks of about ``BLOCK`` vectors; what visits them is codes alone, some 30 bytes each.  The
distance of a vector of the block from a decoded visitor is a sum of table entries, and a link is out of the question
where it exceeds ``r`` by more than the visitor's own error, which travels with its code.  Only vectors that still have
a possible partner are sent whole, and the cosine is taken in double precision.  A pair is judged in one place: where
both may visit the other's list, in the list of the smaller number.

No pairs are written: a block gives each vector its number of links and one link of a spanning set, and the links of
all blocks give the classes.  The count of links takes all pairs of a group of near copies (as products of matrices);
rows grow with its blocks.

Null label or vector, a null, infinite or undefined component, a zero or empty vector: no link.  Vectors of different
lengths have no cosine and don't link.  Rows that repeat an id are separate rows.  A null id is never the smallest.
An empty table gives no rows.  Only the id, vector and label columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm import _base, graph

SAMPLE = 20_000  #: vectors that the codebook is fitted on, at most
CELL = 500  #: vectors of a label that a list should hold
LISTS = 2048  #: of a codebook, at most
PART = 4  #: dimensions of a subspace
BLOCK = 2048  #: vectors of a list that are compared together
ROUNDS = 6  #: of each fit
SLACK = 1e-3  #: what rounding may take from a bound


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def fitted(x: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` centres by Lloyd's rounds, from rows taken at equal steps."""
    k = min(k, len(x))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, x[:, d], k) for d in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Codebook:
    """Coarse lists and the codes of what is left, for unit vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = fitted(sample, lists)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.parts = [slice(a, min(a + PART, sample.shape[1])) for a in range(0, sample.shape[1], PART)]
        self.fine = [fitted(rest[:, p], 256) for p in self.parts]
        gaps = np.sqrt(np.maximum(((self.coarse[:, None] - self.coarse[None]) ** 2).sum(2), 0)) if len(self.coarse) <= 512 else np.sqrt(np.maximum((self.coarse**2).sum(1)[:, None] + (self.coarse**2).sum(1)[None] - 2 * self.coarse @ self.coarse.T, 0))
        self.gaps = np.maximum(gaps, 1e-12)

    def home(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.coarse)

    def visits(self, x: np.ndarray, home: np.ndarray, reach: float) -> np.ndarray:
        """Which lists each vector visits: its own, and those whose border is within ``reach``."""
        d = (self.coarse**2).sum(1) - 2 * (x @ self.coarse.T)
        margin = (d - d[np.arange(len(x)), home][:, None]) / (2 * self.gaps[home])
        out = margin <= reach + SLACK
        out[np.arange(len(x)), home] = True
        return out

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each vector from what its code stands for."""
        rest = x - self.coarse[home]
        codes = np.stack([nearest(rest[:, p], f) for p, f in zip(self.parts, self.fine)], axis=1).astype(np.uint8)
        return codes, np.sqrt(((x - self.decode(codes, home)) ** 2).sum(1))

    def decode(self, codes: np.ndarray, home: np.ndarray) -> np.ndarray:
        return self.coarse[home] + np.concatenate([f[codes[:, k]] for k, f in enumerate(self.fine)], axis=1)

    def tables(self, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each vector its products with all centres: of every subspace, and the coarse ones."""
        return [(x[:, p] @ f.T).astype(np.float32) for p, f in zip(self.parts, self.fine)], (x @ self.coarse.T).astype(np.float32)

    def distances(self, tables: tuple[list[np.ndarray], np.ndarray], codes: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Asymmetric distances of the vectors behind the tables from the decoded vectors, by lookups."""
        fine, coarse = tables
        inner = coarse[:, home]
        for k, t in enumerate(fine):
            inner += t[:, codes[:, k]]
        size = (self.decode(codes, home) ** 2).sum(1).astype(np.float32)
        return np.sqrt(np.maximum(1 + size[None] - 2 * inner, 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _distinct(rows: DataFrame) -> DataFrame:
    """``(sid, label, dim, v, copies, first, h, g)``: each vector of a label that can link, once."""
    usable = "label IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)"
    once = rows.where(usable).groupBy("h", "g").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    return once.select(F.monotonically_increasing_id().alias("sid"), "label", F.size("v").alias("dim"), "v", "copies", "first", "h", "g")


def _codebooks(vectors: DataFrame, lists: int) -> dict[int, Codebook]:
    """One for each length of vectors in the sample, which takes those of smallest hash."""
    sample, found = vectors.orderBy("h", "g").limit(SAMPLE).select("dim", "v").toArrow(), {}
    for dim, v in zip(sample["dim"].to_pylist(), sample["v"].to_pylist()):
        found.setdefault(dim, []).append(v)
    return {dim: Codebook(unit(np.array(v, np.float64)), lists) for dim, v in found.items()}


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """The rows of a batch by the length of their vectors, and these vectors at length 1."""
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = b.filter(pa.array(dims == dim))
        yield dim, unit(_matrix(part.column("v"))), part


def _placed(vectors: DataFrame, books: Callable[[int], Codebook], reach: float) -> DataFrame:
    """``(sid, label, dim, v, list, code, error, visits)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, x, part in _by_length(b):
                book = books(dim)
                home = book.home(x)
                codes, error = book.encode(x, home)
                visits = [np.flatnonzero(row).astype(np.int32) for row in book.visits(x, home, reach)]
                yield _base.record_batch(["sid", "label", "dim", "v", "list", "code", "error", "visits"], [*(part.column(c) for c in ("sid", "label", "dim", "v")), pa.array(home.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(visits, pa.list_(pa.int32()))])

    kind = dict(vectors.dtypes)["v"]
    return vectors.select("sid", "label", "dim", "v").mapInArrow(run, f"sid long, label string, dim int, v {kind}, list int, code binary, error double, visits array<int>")


KEY = ["label", "dim", "list", "part"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Runs of rows of one block and side, from rows in order; ``True`` with the last rows of a side that comes first."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*(b.column(c).to_pylist() for c in [*KEY, "side"])))
        edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, z in zip(edges, edges[1:]):
            yield keys[a][:4], keys[a][4] == 1, b.slice(a, z - a)


def _streamed(batches: Iterator[pa.RecordBatch], begin: Callable, visit: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Hand each block's own rows together to ``begin``, what visits it to ``visit``, a run of rows at a time."""
    now, own, state = None, [], None
    for key, visitor, rows in _blocks(batches):
        if key != now:
            if now is not None:
                yield from end(now, begin(now, pa.Table.from_batches(own)) if state is None and own else state)
            now, own, state = key, [], None
        if not visitor:
            own.append(rows)
        elif own or state is not None:
            if state is None:
                state, own = begin(now, pa.Table.from_batches(own)), []
            yield from visit(now, state, rows)
    if now is not None:
        yield from end(now, begin(now, pa.Table.from_batches(own)) if state is None and own else state)


def _alive(rows: DataFrame, books: Callable[[int], Codebook], r: float) -> DataFrame:
    """``(label, dim, list, part, side, sid, origin)``: which vectors of a block and which visitors may have a partner."""

    def begin(key: tuple, table: pa.Table) -> dict:
        book, x = books(key[1]), unit(_matrix(table["v"].combine_chunks()))
        home = np.full(len(x), key[2])
        codes = np.stack([np.frombuffer(c, np.uint8) for c in table["code"].to_pylist()])
        state = {"x": x, "sid": table["sid"].to_numpy(), "alive": np.zeros(len(x), bool), "visits": book.visits(x, home, r / 2), "tables": book.tables(x)}
        for a in range(0, len(x), 256):
            part = ([t[a : a + 256] for t in state["tables"][0]], state["tables"][1][a : a + 256])
            near = book.distances(part, codes, home) <= r + table["error"].to_numpy()[None] + SLACK
            near[np.arange(len(near)), np.arange(a, a + len(near))] = False
            state["alive"][a : a + 256] |= near.any(1)
            state["alive"] |= near.any(0)
        return state

    def visit(key: tuple, state: dict, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        book = books(key[1])
        for a in range(0, rows.num_rows, 512):
            some = rows.slice(a, 512)
            codes, home = np.stack([np.frombuffer(c, np.uint8) for c in some.column("code").to_pylist()]), some.column("origin").to_numpy()
            near = book.distances(state["tables"], codes, home) <= r + some.column("error").to_numpy()[None] + SLACK
            near &= ~state["visits"][:, home] | (key[2] <= home)[None]
            state["alive"] |= near.any(1)
            found = some.filter(pa.array(near.any(0)))
            if found.num_rows:
                yield _base.record_batch([*KEY, "side", "sid", "origin"], [found.column(c) for c in (*KEY, "side", "sid", "origin")])  # all columns may hold nulls, as those of other batches

    def end(key: tuple, state: dict | None) -> Iterator[pa.RecordBatch]:
        if state is not None and state["alive"].any():
            sid = state["sid"][state["alive"]]
            n = len(sid)
            fixed = [pa.array([key[0]] * n, pa.string()), *(pa.array(np.full(n, k, np.int32)) for k in (*key[1:], 0))]
            yield _base.record_batch([*KEY, "side", "sid", "origin"], [*fixed, pa.array(sid), pa.array(np.full(n, key[2], np.int32))])

    return rows.mapInArrow(lambda batches: _streamed(batches, begin, visit, end), "label string, dim int, list int, part int, side int, sid long, origin int")


def _linked(rows: DataFrame, books: Callable[[int], Codebook], cosine: float) -> DataFrame:
    """``(a, b, n)``: a vector, one it links with (or itself), and in how many others it links with within a block."""
    reach = sqrt(2 - 2 * cosine) / 2

    def joined(root: np.ndarray, at: np.ndarray) -> None:
        roots = np.unique(root[at])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]

    def begin(key: tuple, table: pa.Table) -> dict:
        x, copies = unit(_matrix(table["v"].combine_chunks())), table["copies"].to_numpy()
        state = {"x": x, "sid": table["sid"].to_numpy(), "copies": copies, "n": np.zeros(len(x), np.int64), "root": np.arange(len(x)), "visits": books(key[1]).visits(x, np.full(len(x), key[2]), reach)}
        for a in range(0, len(x), 512):
            near = x[a : a + 512] @ x.T >= cosine
            near[np.arange(len(near)), np.arange(a, a + len(near))] = False
            state["n"][a : a + 512] = near @ copies
            for i in np.flatnonzero(near.any(1)).tolist():
                joined(state["root"], np.append(np.flatnonzero(near[i]), a + i))
        return state

    def visit(key: tuple, state: dict, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, rows.num_rows, 512):
            some = rows.slice(a, 512)
            y, home = unit(_matrix(some.column("v"))), some.column("origin").to_numpy()
            near = state["x"] @ y.T >= cosine
            near &= ~state["visits"][:, home] | (key[2] <= home)[None]
            state["n"] += near @ some.column("copies").to_numpy()
            hit = np.flatnonzero(near.any(0))
            for j in hit.tolist():
                joined(state["root"], np.flatnonzero(near[:, j]))
            if len(hit):
                first = state["sid"][near[:, hit].argmax(0)]
                yield _base.record_batch(["a", "b", "n"], [pa.array(some.column("sid").to_numpy()[hit]), pa.array(first), pa.array(state["copies"] @ near[:, hit])])

    def end(key: tuple, state: dict | None) -> Iterator[pa.RecordBatch]:
        if state is not None and state["n"].any():
            hit = state["n"] > 0
            yield _base.record_batch(["a", "b", "n"], [pa.array(state["sid"][hit]), pa.array(state["sid"][state["root"]][hit]), pa.array(state["n"][hit])])

    return rows.mapInArrow(lambda batches: _streamed(batches, begin, visit, end), "a long, b long, n long")


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY).sortWithinPartitions(*KEY, "side", "sid")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row: links with other rows, the smallest id that links reach."""
    spark = vectors.sparkSession
    _base.batches_of(spark, 2000)
    began = _base.mark()
    r = sqrt(2 - 2 * cosine)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("h", F.xxhash64("label", "v")).withColumn("g", F.xxhash64(F.lit(7), "v", "label"))
    once = _base.materialize(_distinct(rows), "vectors")
    n, n_labels = once.agg(F.count("*"), F.approx_count_distinct("label")).first()
    fits = spark.sparkContext.broadcast(_codebooks(once, min(LISTS, max(1, n // (CELL * max(1, n_labels))))))

    def books(dim: int) -> Codebook:
        """A length that the sample lacks has one list, and codes that say nothing but zero."""
        if dim not in fits.value:
            fits.value[dim] = Codebook(np.zeros((1, dim)), 1)
        return fits.value[dim]

    placed = _base.materialize(_placed(once, books, r / 2), "placed")
    cells = _base.materialize(placed.groupBy("label", "dim", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cells")
    cell = ["label", "dim", "list"]
    homes = placed.join(_base.small(cells), cell).withColumn("part", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    targets = _base.small(cells.withColumnRenamed("list", "to"))
    sent = homes.drop("v", "blocks").withColumnRenamed("list", "origin").withColumn("to", F.explode("visits")).drop("visits").join(targets, ["label", "dim", "to"])
    last = F.when(F.col("to") == F.col("origin"), F.col("part")).otherwise(F.col("blocks"))  # of its own list only the blocks before its own
    sent = sent.where(last > 0).withColumn("at", F.explode(F.sequence(F.lit(0), last - 1)))
    kind = dict(placed.dtypes)["v"]
    visitors = sent.select("label", "dim", F.col("to").alias("list"), F.col("at").alias("part"), F.lit(1).alias("side"), "sid", F.lit(None).cast(kind).alias("v"), "code", "error", "origin")
    own = homes.select("label", "dim", "list", "part", F.lit(0).alias("side"), "sid", "v", "code", "error", F.col("list").alias("origin"))
    alive = _base.materialize(_alive(_in_blocks(own.union(visitors)), books, r), "alive")
    whole = alive.join(once.select("sid", "v", "copies"), "sid").select(*KEY, "side", "sid", "origin", "v", "copies")
    found = _base.materialize(_linked(_in_blocks(whole), books, cosine), "links")
    classes = graph.components(found)
    counts = found.groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("n"))
    known = once.select("sid", "h", "g", "first", "copies").join(counts, "sid", "left").join(classes.withColumnRenamed("v", "sid"), "sid", "left")
    known = _base.materialize(known.select("h", "g", "first", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "sid").alias("class")), "known")
    smallest = _base.materialize(known.groupBy("class").agg(F.min("first").alias("component_id")), "smallest")
    known = _base.materialize(known.join(smallest, "class").select("h", "g", "n_links", "component_id"), "named")
    _base.discard(began, known)
    out = rows.select("vec_id", "h", "g").join(known, ["h", "g"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
